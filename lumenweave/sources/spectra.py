"""Spectral library readers: ASCII files and SQLite databases to (spectrum_id, name, category, source, spectrum) rows.

Files reach the executors through Spark (``text`` and ``binaryFile``), so any store that Spark reads will do.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenweave.functions.arrays import interpolate
from lumenweave.functions.bands import Bands
from lumenweave.functions.missing import clip, to_null
from lumenweave.operators.library import FIELD_FILE_WORDS, MINERAL_FILE_WORDS, SAMPLE_WORDS, category_of

#: Values at or below this are missing in the mineral library; wavelengths are micrometres if all are below the second,
#: reflectance is percent if any exceeds the third.
MINERAL_MISSING, MICROMETRES_BELOW, PERCENT_ABOVE = -1.0e30, 50.0, 1.5
VSWIR = (350.0, 2500.0)


def _files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(stem, lines) of the text files below a folder."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(folder, wholetext=True)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    lines = F.filter(F.transform(F.split("value", r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    return raw.select(F.regexp_replace(F.url_decode(name), r"\.[^.]*$", "").alias("stem"), lines.alias("lines"))


def _number(text: Column) -> Column:
    return text.try_cast("double")


def numbers_of(lines: Column) -> Column:
    """The first token of each line that is a number; other lines, a header among them, are passed over."""
    return F.filter(F.transform(lines, lambda x: _number(F.get(F.split(x, r"\s+"), F.lit(0)))), lambda v: v.isNotNull())


def pairs_of(lines: Column) -> Column:
    """(w, r) of each line whose first two tokens, set off by commas or white space, are numbers."""
    parts = F.transform(lines, lambda x: F.split(x, r"[,\s]+"))
    both = F.transform(parts, lambda p: F.struct(_number(F.get(p, F.lit(0))).alias("w"), _number(F.get(p, F.lit(1))).alias("r")))
    return F.filter(both, lambda p: p["w"].isNotNull() & p["r"].isNotNull())


def _identified(df: DataFrame, source: str, keep: Sequence[str] | None, category_map: dict[str, str] | None, words) -> DataFrame:
    """Categories by a map of stems or by words; ids counted within each category in order of the stems."""
    category = category_of(F.col("stem"), words)
    for stem, given in (category_map or {}).items():
        category = F.when(F.col("stem") == stem, given).otherwise(category)
    held = df.withColumn("category", category).filter(F.col("category") != "other")
    if keep is not None:
        held = held.filter(F.lower("category").isin([k.lower() for k in keep]))
    n = F.row_number().over(Window.partitionBy("category").orderBy("stem"))  # a library's files are few
    named = F.format_string(f"{source}_%s_%04d", "category", n)
    return held.select(named.alias("spectrum_id"), F.col("stem").alias("name"), "category", F.lit(source).alias("source"), "spectrum")


def mineral_library(spark: SparkSession, folder: str, sensor: str = "ASD", categories: Sequence[str] | None = None, category_map: dict[str, str] | None = None) -> tuple[DataFrame, Bands]:
    """Single-column files (stems s07...SENSOR...) on the wavelengths (micrometres) of the sensor's wavelength file.

    Missing values, then spectra without any value in 380-2500 nm, are dropped; other missing values become 0.
    """
    axis = _files(spark, folder, "*Wavelengths*").filter(F.contains(F.upper("stem"), F.lit(sensor.upper()))).orderBy("stem").select(numbers_of(F.col("lines")).alias("w")).first()
    if axis is None:
        raise FileNotFoundError(f"no wavelength file for {sensor} below {folder}")
    bands = Bands(tuple(w * 1000 for w in axis.w))
    inside = bands.within(380, 2500)
    spectra = _files(spark, folder, "*.txt").filter(F.lower("stem").rlike(f"^s07[a-z0-9]*{sensor.lower()}"))
    values = spectra.select("stem", numbers_of(F.col("lines")).alias("v")).filter(F.size("v") == len(bands))
    held = values.withColumn("spectrum", F.transform("v", lambda x: F.when(x > MINERAL_MISSING, to_null(x))))
    some = F.exists(F.slice("spectrum", inside[0] + 1, len(inside)), lambda x: x.isNotNull())
    filled = held.filter(some).withColumn("spectrum", F.transform("spectrum", lambda x: F.coalesce(clip(x), F.lit(0.0))))
    return _identified(filled, "mineral", categories, category_map, MINERAL_FILE_WORDS), bands


def field_library(spark: SparkSession, folder: str, pattern: str = "*.txt", categories: Sequence[str] | None = None, category_map: dict[str, str] | None = None) -> tuple[DataFrame, Bands]:
    """Two-column files; the first (by name) gives the axis, the others are interpolated to it (NULL outside)."""
    files = _files(spark, folder, pattern).withColumn("p", pairs_of(F.col("lines"))).filter(F.size("p") >= 2)
    micro = F.array_max(F.col("p.w")) < MICROMETRES_BELOW
    percent = F.array_max(F.col("p.r")) > PERCENT_ABOVE
    scaled = files.select("stem", F.transform("p", lambda p: F.struct(F.when(micro, p["w"] * 1000).otherwise(p["w"]).alias("w"), clip(F.when(percent, p["r"] / 100).otherwise(p["r"])).alias("r"))).alias("p"))
    first = scaled.filter(category_of(F.col("stem"), FIELD_FILE_WORDS) != "other").orderBy("stem").select("p.w").first()
    if first is None:
        raise ValueError(f"no spectra below {folder}")
    axis = first.w
    return _identified(scaled.withColumn("spectrum", regrid(F.col("p"), axis)), "field", categories, category_map, FIELD_FILE_WORDS), Bands(tuple(axis))


def regrid(pairs: Column, axis: Sequence[float]) -> Column:
    """Linear interpolation of sorted (w, r) pairs at the axis; NULL outside."""
    before = lambda w: F.element_at(F.filter(pairs, lambda p: p["w"] <= w), -1)
    after = lambda w: F.get(F.filter(pairs, lambda p: p["w"] >= w), F.lit(0))

    def at(w):
        n_low, n_high = F.size(F.filter(pairs, lambda p: p["w"] <= w)), F.size(F.filter(pairs, lambda p: p["w"] >= w))
        a, b = before(w), after(w)
        inner = F.when(b["w"] > a["w"], a["r"] + (b["r"] - a["r"]) * (w - a["w"]) / (b["w"] - a["w"])).otherwise(a["r"])
        return F.when((n_low > 0) & (n_high > 0), inner)

    return F.transform(F.array(*[F.lit(float(w)) for w in axis]), at)


def sample_database(spark: SparkSession, path: str, categories: Sequence[str] | None = None) -> tuple[DataFrame, Bands]:
    """Spectra of a SQLite database of samples (tables Spectra and Samples; x and y as packed float32 or text).

    Axes in micrometres; percent detected; bands outside 350-2500 nm dropped; the first spectrum's axis holds for all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_pylist(sample_rows(content), schema=pa.schema([("n", pa.int64()), ("what", pa.string()), ("stem", pa.string()), ("p", pa.list_(pa.struct([("w", pa.float64()), ("r", pa.float64())])))]))

    raw = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "n long, what string, stem string, p array<struct<w:double,r:double>>")
    held = raw.withColumn("category", category_of(F.col("what"), SAMPLE_WORDS)).filter(F.col("category") != "other")
    if categories is not None:
        held = held.filter(F.col("category").isin([c.lower() for c in categories]))
    first = held.orderBy("n").select("p.w").first()
    if first is None:
        raise ValueError(f"no spectra in {path}")
    n = F.row_number().over(Window.orderBy("n"))  # a library is small
    rows = held.withColumn("spectrum", F.transform(regrid(F.col("p"), first.w), lambda v: clip(v)))
    return rows.select(F.format_string("samples_%s_%04d", "category", n).alias("spectrum_id"), F.col("stem").alias("name"), "category", F.lit("samples").alias("source"), "spectrum"), Bands(tuple(first.w))


def sample_rows(content: bytes) -> list[dict]:
    """The database's spectra in order of their ids: n, what (type, class, subclass), stem, p (nm, share)."""
    db = sqlite3.connect(":memory:")
    db.deserialize(content)
    text = "SELECT p.SpectrumID, s.Type, s.Class, s.SubClass, s.Name, p.XData, p.YData FROM Spectra p JOIN Samples s USING (SampleID)"
    rows = db.execute(f"{text} WHERE p.XUnit LIKE '%micrometer%' OR p.XUnit LIKE '%um%' ORDER BY 1").fetchall() or db.execute(f"{text} ORDER BY 1").fetchall()
    out = []
    for n, kind, cls, sub, name, x, y in rows:
        pairs = sorted(zip((w * 1000 for w in _floats(x)), _floats(y)))
        share = 100.0 if max((r for _, r in pairs), default=0) > PERCENT_ABOVE else 1.0
        held = [{"w": w, "r": r / share} for w, r in pairs if VSWIR[0] <= w <= VSWIR[1]]
        if held:
            out.append({"n": n, "what": " ".join(t or "" for t in (kind, cls, sub)), "stem": str(name), "p": held})
    return out


def _floats(held: bytes | str) -> list[float]:
    if isinstance(held, str):
        return [float(t) for t in held.replace(",", " ").split()]
    import array

    a = array.array("f")
    a.frombytes(held)
    return a.tolist()


def at_wavelength(spectrum: Column, bands: Bands, wavelength: float) -> Column:
    """A spectrum's value between its bands."""
    return interpolate(F.lit(float(wavelength)), bands.wavelengths, spectrum)
