"""Manifests of artifacts and claims: checksums, plausibility, audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Monthly medians (percent of dry mass) of shrubs, and the factor within which a mean is plausible.
MONTHLY_LFMC = {1: 76, 2: 94, 3: 113, 4: 119, 5: 105, 6: 86, 7: 73, 8: 65, 9: 61, 10: 60, 11: 63, 12: 70}
TOLERANCE = 2.0

ARTIFACT = "path string, checksum_md5 string, size_bytes long, bundled boolean, provenance_status string, provenance_note string"
CLAIM = "description string, metric string, value double, backing_artifact string, independence string, synthetic boolean"


def load_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(artifacts, claims), one row each, of a JSON manifest."""
    schema = T.StructType().add("artifacts", T.MapType(T.StringType(), T._parse_datatype_string(ARTIFACT))).add("claims", T.MapType(T.StringType(), T._parse_datatype_string(CLAIM)))
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    return tuple(raw.select(F.explode(c).alias(k, "v")).select(k, "v.*") for c, k in (("artifacts", "artifact_key"), ("claims", "claim_key")))


def file_checksums(spark: SparkSession, folder: str) -> DataFrame:
    """(path, md5, size) of the files below a folder, paths relative to it."""
    root = "/" + folder.removeprefix("file:").strip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    path = F.regexp_replace("path", "^(file:)?/*", "/")
    return files.select(F.substring(path, len(root) + 1, 1 << 20).alias("path"), F.md5("content").alias("md5"), F.col("length").alias("size"))


def verify_artifacts(artifacts: DataFrame, files: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """(artifact_key, status): ok, missing, mismatch, not_bundled, no_checksum; unknown for asked ``keys`` without an entry."""
    held = artifacts.join(files.select("path", F.col("md5").alias("_md5")), "path", "left")
    status = (
        F.when(~F.coalesce("bundled", F.lit(False)), "not_bundled").when(F.coalesce("checksum_md5", F.lit("")) == "", "no_checksum").when(F.col("_md5").isNull(), "missing").when(F.col("_md5") == F.col("checksum_md5"), "ok").otherwise("mismatch")
    )
    out = held.select("artifact_key", status.alias("status"))
    return out if keys is None else keys.join(out, "artifact_key", "left").select("artifact_key", F.coalesce("status", F.lit("unknown")).alias("status"))


def plausible_lfmc(mean: Column, month: Column, tolerance: float = TOLERANCE) -> Column:
    """Whether a mean is within [median / tolerance, median * tolerance] of its month; false for other months."""
    table = F.create_map(*[F.lit(x) for kv in MONTHLY_LFMC.items() for x in kv])
    median = F.try_element_at(table, month.cast("int")).cast("double")
    return F.coalesce(mean.between(median / tolerance, median * tolerance), F.lit(False))


def audit_claims(claims: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(claim_key, severity, finding): claims on absent or unverifiable artifacts, without backing, or on targets of their own."""
    known = artifacts.select(F.col("artifact_key").alias("backing_artifact"), "provenance_status", F.lit(True).alias("_known"))
    held = claims.join(known, "backing_artifact", "left")
    backed, synthetic = F.col("backing_artifact").isNotNull(), F.coalesce("synthetic", F.lit(False))
    rules = [
        ("error", "backing artifact not found", backed & F.col("_known").isNull()),
        ("warning", "backing artifact unverifiable", backed & (F.col("provenance_status") == "unverifiable")),
        ("error", "no backing artifact and not synthetic", ~backed & ~synthetic),
        ("error", "independence none and not synthetic", (F.col("independence") == "none") & ~synthetic),
    ]
    found = F.array_compact(F.array(*[F.when(rule, F.struct(F.lit(s).alias("severity"), F.lit(t).alias("finding"))) for s, t, rule in rules]))
    return held.select("claim_key", F.explode(found).alias("f")).select("claim_key", "f.*")


def claims_table(claims: DataFrame) -> DataFrame:
    """One row: a markdown table of the claims in order of their keys."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", "claim_key", F.coalesce("metric", F.lit("")), F.coalesce(F.col("value").cast("string"), F.lit("-")), F.coalesce("backing_artifact", F.lit("-")), F.coalesce("independence", F.lit(""))), F.lit(" |"))
    rows = claims.agg(F.array_sort(F.collect_list(F.struct("claim_key", line.alias("line")))).alias("r"))
    head = "| claim | metric | value | backing | independence |\n|---|---|---|---|---|"
    return rows.select(F.concat_ws("\n", F.lit(head), F.transform("r", lambda x: x["line"])).alias("markdown"))
