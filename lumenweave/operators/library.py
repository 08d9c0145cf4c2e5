"""Endmember libraries: (spectrum_id, name, category, source, spectrum) rows; small, but handled as tables all the same."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenweave.functions.arrays import dot, rmse, spectral_angle, stddev
from lumenweave.functions.bands import Bands
from lumenweave.functions.kernels import spectra_block
from lumenweave.functions.missing import clip
from lumenweave.operators.indices import resample, response_weights

CATEGORIES = ("char", "ash", "pv", "npv", "soil", "shade")

#: Words in names that tell the material, in order of precedence, by source of the library.
MINERAL_FILE_WORDS = (
    ("char", "char"), ("ash", "ash"), ("vegetation", "pv"), ("grass", "pv"), ("leaf", "pv"), ("conifer", "pv"), ("dry_grass", "npv"), ("dryveg", "npv"),
    ("npv", "npv"), ("litter", "npv"), ("wood", "npv"), ("bark", "npv"), ("soil", "soil"), ("mineral", "soil"), ("rock", "soil"),
)
FIELD_FILE_WORDS = (
    ("char", "char"), ("ash", "ash"), ("burn", "char"), ("dryveg", "npv"), ("dry_veg", "npv"), ("dry-veg", "npv"), ("npv", "npv"), ("litter", "npv"), ("woody", "npv"),
    ("dead", "npv"), ("gv", "pv"), ("green", "pv"), ("photosynthetic", "pv"), ("vegetation", "pv"), ("chaparral", "pv"), ("soil", "soil"), ("rock", "soil"), ("mineral", "soil"),
)
SAMPLE_WORDS = (
    ("char", "char"), ("ash", "ash"), ("non-photosynthetic", "npv"), ("dry vegetation", "npv"), ("dryveg", "npv"), ("litter", "npv"), ("wood", "npv"), ("bark", "npv"),
    ("vegetation", "pv"), ("tree", "pv"), ("grass", "pv"), ("shrub", "pv"), ("soil", "soil"), ("rock", "soil"), ("mineral", "soil"),
)


def category_of(name: Column, words: Sequence[tuple[str, str]]) -> Column:
    """The category of the first word that the name holds, else other."""
    lower = F.lower(F.coalesce(name, F.lit("")))
    out = F.lit("other")
    for word, category in reversed(words):
        out = F.when(F.contains(lower, F.lit(word)), category).otherwise(out)
    return out


def merge(*libraries: DataFrame, bands: Sequence[Bands] = ()) -> DataFrame:
    """All spectra, held to [0, 1], with ids made unique by _dup1, _dup2 ... in the order of the libraries.

    With their ``bands`` libraries whose wavelengths differ are refused.
    """
    same_bands(*bands)
    tagged = [lib.withColumn("_lib", F.lit(i)) for i, lib in enumerate(libraries)]
    if not tagged:
        raise ValueError("no library given")
    whole = tagged[0]
    for t in tagged[1:]:
        whole = whole.unionByName(t, allowMissingColumns=True)
    again = F.row_number().over(Window.partitionBy("spectrum_id").orderBy("_lib", "name")) - 1
    named = whole.withColumn("_again", again).withColumn("spectrum", F.transform("spectrum", lambda v: clip(v)))
    return named.withColumn("spectrum_id", F.when(F.col("_again") > 0, F.concat("spectrum_id", F.lit("_dup"), F.col("_again"))).otherwise(F.col("spectrum_id"))).drop("_lib", "_again")


def same_bands(*tables: Bands, tolerance: float = 1e-3) -> None:
    """Refuse libraries whose wavelengths differ."""
    for t in tables[1:]:
        if len(t) != len(tables[0]) or any(abs(a - b) > tolerance for a, b in zip(t.wavelengths, tables[0].wavelengths)):
            raise ValueError("the libraries have different wavelengths; resample them first")


def resample_library(library: DataFrame, source: Bands, target: Bands, fwhm: float = 5.5, source_fwhm: float = 1.0) -> DataFrame:
    """The library on other bands, held to [0, 1]."""
    weights = response_weights(source, target.wavelengths, target.fwhm or (fwhm,) * len(target), source_fwhm)
    return library.withColumn("spectrum", F.transform(resample(F.col("spectrum"), weights), lambda v: clip(v)))


def most_varied(library: DataFrame, most: int, order: str = "spectrum_id") -> DataFrame:
    """The ``most`` spectra of each category with the largest standard deviation; equal ones in ``order``."""
    best = Window.partitionBy("category").orderBy(F.desc("_sd"), order)
    ranked = library.withColumn("_sd", stddev(F.col("spectrum"))).withColumn("_rank", F.row_number().over(best))
    return ranked.filter(F.col("_rank") <= most).drop("_sd", "_rank").orderBy(order)


def separability(library: DataFrame) -> DataFrame:
    """(band, fisher): variance between categories over that within them, for each band."""
    long = library.select("category", F.posexplode("spectrum").alias("band", "v"))
    by_class = long.groupBy("band", "category").agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s"))
    means = long.groupBy("band").agg(F.avg("v").alias("m_all"))
    d = F.col("m") - F.col("m_all")
    return by_class.join(means, "band").groupBy("band").agg((F.sum(F.col("n") * d * d) / F.greatest(F.sum(F.col("n") * F.col("s")), F.lit(1e-12))).alias("fisher"))


def zone_edges(n_total: int, n_zones: int) -> list[int]:
    return [int(k * n_total / n_zones) for k in range(n_zones + 1)]


def pick_bands(library: DataFrame, n_total: int, n_bands: int = 40) -> list[int]:
    """Positions of the band that separates best in each of ``n_bands`` equal zones (the first of equals)."""
    if not 0 < n_bands <= n_total:
        raise ValueError(f"cannot pick {n_bands} of {n_total} bands")
    edges = zone_edges(n_total, n_bands)
    zone = sum((F.when(F.col("band") >= e, 1).otherwise(0) for e in edges[1:-1]), F.lit(0))
    scored = separability(library).withColumn("zone", zone)
    best = scored.groupBy("zone").agg(F.max_by("band", F.struct("fisher", -F.col("band"))).alias("band"))
    return sorted(r.band for r in best.collect())  # at most one row a zone


def quality(library: DataFrame) -> DataFrame:
    """``library`` with ear (mean rmse of the category's spectra modelled by this one and shade) and masa_deg (mean angle to them).

    Pairs are met within a category only; libraries are small. A category of one spectrum has ear and masa 0.
    """
    own = library.select(F.col("spectrum_id").alias("a_id"), "category", F.col("spectrum").alias("a"))
    other = library.select(F.col("spectrum_id").alias("b_id"), F.col("category"), F.col("spectrum").alias("b"))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(dot(F.col("a"), F.col("a")) > 0, dot(F.col("a"), F.col("b")) / dot(F.col("a"), F.col("a"))).otherwise(0.0)))
    pairs = own.join(other, "category").filter(F.col("a_id") != F.col("b_id")).withColumn("share", share)
    scored = pairs.select("a_id", rmse(F.transform("a", lambda v: v * F.col("share")), F.col("b")).alias("e"), spectral_angle(F.col("a"), F.col("b")).alias("m"))
    means = scored.groupBy("a_id").agg(F.avg("e").alias("ear"), F.avg("m").alias("masa_deg"))
    joined = library.join(F.broadcast(means), library["spectrum_id"] == means["a_id"], "left").drop("a_id")
    return joined.withColumns({"ear": F.coalesce("ear", F.lit(0.0)), "masa_deg": F.coalesce("masa_deg", F.lit(0.0))})


def prune(library: DataFrame, ear: float = 0.025, masa_deg: float = 10.0) -> DataFrame:
    """Spectra without those that exceed both thresholds; all of them if none is left."""
    scored = quality(library)
    kept = scored.filter(~((F.col("ear") > ear) & (F.col("masa_deg") > masa_deg)))
    return kept if kept.limit(1).count() else scored


def purest_pixels(df: DataFrame, n: int = 30, projections: int = 1000, seed: int = 0, spectrum: str = "spectrum", keys: Sequence[str] = ("row", "col")) -> DataFrame:
    """The ``n`` pixels that are most often the extreme of random projections: (keys, hits, spectrum).

    A task returns its extremes only (two rows a projection), which meet in one aggregation.
    """
    names = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, best = None, None
        for batch in batches:
            column = batch.column(len(names))
            lengths = column.value_lengths().drop_null()
            if not len(lengths):
                continue
            x = np.nan_to_num(spectra_block(column, lengths[0].as_py()))
            if vectors is None:
                vectors = np.random.default_rng(seed).normal(size=(projections, x.shape[1]))
                best = {s: [(-np.inf, None, None)] * projections for s in (1, -1)}
            scores = x @ vectors.T
            ids = list(zip(*(batch.column(i).to_pylist() for i in range(len(names)))))
            for sign in (1, -1):
                at = (sign * scores).argmax(0)
                for p, i in enumerate(at):
                    if (s := sign * scores[i, p]) > best[sign][p][0]:
                        best[sign][p] = (float(s), ids[i], x[i].tolist())
        if vectors is not None:
            rows = [(2 * p + (sign < 0), s, *i, x) for sign in best for p, (s, i, x) in enumerate(best[sign])]
            cols = list(zip(*rows))
            kinds = [pa.int64(), pa.float64(), *[pa.int64()] * len(names), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["p", "score", *names, "spectrum"])

    schema = "p long, score double, " + ", ".join(f"{k} long" for k in names) + ", spectrum array<double>"
    extremes = df.select(*[F.col(k).cast("long").alias(k) for k in names], F.col(spectrum).cast("array<double>").alias("spectrum")).mapInArrow(run, schema)
    winner = extremes.groupBy("p").agg(F.max_by(F.struct(*names, "spectrum"), F.struct("score", *[-F.col(k) for k in names])).alias("w"))
    return winner.select("w.*").groupBy(*names).agg(F.count("*").alias("hits"), F.first("spectrum").alias("spectrum")).orderBy(F.desc("hits"), *names).limit(n)


def build(target: Bands, sources: Sequence[tuple[DataFrame, Bands]], most_per_class: int | None = None, prune_ear: float = 0.025, prune_masa: float = 10.0) -> DataFrame:
    """Sources on the target's bands, merged, pruned, thinned, and a shade spectrum of zeros at the end."""
    if not sources:
        raise ValueError("no library could be loaded")
    merged = prune(merge(*[resample_library(lib, bands, target) for lib, bands in sources]), prune_ear, prune_masa).drop("ear", "masa_deg")
    kept = most_varied(merged, most_per_class) if most_per_class else merged
    spark = merged.sparkSession
    shade = spark.range(1).select(F.lit("shade_0000").alias("spectrum_id"), F.lit("shade").alias("name"), F.lit("shade").alias("category"), F.lit("synthetic").alias("source"), F.array_repeat(F.lit(0.0), len(target)).alias("spectrum"))
    return kept.unionByName(shade, allowMissingColumns=True)


