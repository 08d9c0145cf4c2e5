"""Deterministic projections of the shared test tables as rasters, libraries, points and series; each with its SQL twin."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenweave.functions.bands import Bands
from lumenweave.operators.grid import Grid

N_BANDS = 64
BANDS = Bands(tuple(380 + i * 2120 / 63 for i in range(N_BANDS)))
#: The first 20 rows of the raster of ``px``, and of ``px2``, which lies two rows and three columns off; ``grids`` has all rows.
GRID = Grid(350000.0, 3760000.0, 30.0, 25, 20, "EPSG:32611")
GRID2 = Grid(350090.0, 3759940.0, 30.0, 25, 20, "EPSG:32611")
FAR = 1500.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels from ``embeddings``: row, col, spectrum, category."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.expr("cast(vec_id div 25 as int)").alias("row"), F.expr("cast(vec_id % 25 as int)").alias("col"), F.transform("embedding", lambda v: v.cast("double") + 0.5).alias("spectrum"), F.col("label").alias("category"), "vec_id"
    )


def px2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The later scene: spectra scaled by 0.8 below FAR and 0.5 above, on GRID2."""
    scale = [0.8 if w < FAR else 0.5 for w in BANDS.wavelengths]
    weights = F.array(*[F.lit(s) for s in scale])
    return px(spark, sf_dir).withColumn("spectrum", F.zip_with("spectrum", weights, lambda v, s: v * s))


def grids(spark: SparkSession, sf_dir: str) -> tuple[Grid, Grid]:
    """The grids of ``px`` and ``px2`` with as many rows as the table fills."""
    last = table(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0]
    height = 1 if last is None else last // GRID.width + 1
    return replace(GRID, height=height), replace(GRID2, height=height)


def lib(spark: SparkSession, sf_dir: str, most: int | None = 6) -> DataFrame:
    """A library: the spectra of the lowest ids of each label (of all ids without ``most``), held to [0, 1]."""
    from pyspark.sql import Window

    e = px(spark, sf_dir)
    if most is not None:
        e = e.withColumn("n", F.row_number().over(Window.partitionBy("category").orderBy("vec_id"))).filter(F.col("n") <= most)
    return e.select(
        F.format_string("s%05d", "vec_id").alias("spectrum_id"), F.concat(F.lit("n"), F.col("vec_id").cast("string")).alias("name"), F.concat(F.lit("c"), F.col("category").cast("string")).alias("category"), F.lit("px").alias("source"),
        F.transform("spectrum", lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))).alias("spectrum"),
    )


def pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points from ``events`` on and about GRID: event_id, x, y, ordinal."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", (F.lit(349950.0) + (F.col("event_id") * 7 % 850).cast("double")).alias("x"), (F.lit(3759370.0) + (F.col("event_id") * 11 % 680).cast("double")).alias("y"), (F.col("user_id") % 5).cast("int").alias("ordinal"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values by day and class from ``events``."""
    return table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), F.col("event_type").alias("cls"), "value", "ts")


def big(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large pixels from ``lineitem``: four pseudo-bands and a class code."""
    t = table(spark, sf_dir, "lineitem")
    code = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return t.select(
        "l_orderkey", "l_linenumber", (F.col("l_quantity") / 50.0).alias("b1"), (F.col("l_discount") * 10.0).alias("b2"), (F.col("l_tax") * 10.0).alias("b3"), (F.col("l_extendedprice") / 100000.0).alias("b4"), code.alias("code"), F.col("l_linestatus").alias("status"), "l_suppkey",
    )


def fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fractions and an rmse from the first six entries of each embedding."""
    p = px(spark, sf_dir)
    parts = [F.abs(F.get("spectrum", F.lit(i)) - 0.5) for i in range(5)]
    whole = sum(parts[1:], parts[0])
    cols = [(v / whole).alias(n) for n, v in zip(("char", "pv", "npv", "soil", "shade"), parts)]
    return p.select("row", "col", "category", *cols, (F.abs(F.get("spectrum", F.lit(5)) - 0.5) / 5.0).alias("rmse"))


# --- the same in SQL

PX = "px AS (SELECT CAST(vec_id // 25 AS INTEGER) AS r, CAST(vec_id % 25 AS INTEGER) AS c, [CAST(v AS DOUBLE) + 0.5 FOR v IN embedding] AS s, label, vec_id FROM embeddings)"
_SCALE = "[" + ", ".join("CAST(0.8 AS DOUBLE)" if w < FAR else "CAST(0.5 AS DOUBLE)" for w in BANDS.wavelengths) + "]"
PX2 = f"px2 AS (SELECT r, c, [s[i] * {_SCALE}[i] FOR i IN range(1, 65)] AS s, label, vec_id FROM px)"
LIB = "lib AS (SELECT printf('s%05d', vec_id) AS id, 'c' || label AS category, [least(greatest(v, 0.0), 1.0) FOR v IN s] AS s, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM px) WHERE n <= 6)"
LIB_ALL = "lib AS (SELECT printf('s%05d', vec_id) AS id, 'c' || label AS category, [least(greatest(v, 0.0), 1.0) FOR v IN s] AS s, vec_id FROM px)"
PTS = "pts AS (SELECT event_id, CAST(349950 AS DOUBLE) + (event_id * 7 % 850) AS x, CAST(3759370 AS DOUBLE) + (event_id * 11 % 680) AS y, CAST(user_id % 5 AS INTEGER) AS ordinal FROM events)"
BIG = "big AS (SELECT l_orderkey, l_linenumber, l_quantity / CAST(50 AS DOUBLE) AS b1, l_discount * CAST(10 AS DOUBLE) AS b2, l_tax * CAST(10 AS DOUBLE) AS b3, l_extendedprice / CAST(100000 AS DOUBLE) AS b4, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS code, l_linestatus AS status, l_suppkey FROM lineitem)"
_F = [f"abs(s[{i + 1}] - CAST(0.5 AS DOUBLE))" for i in range(6)]
FRACTIONS = "fr AS (SELECT r, c, label, " + ", ".join(f"{_F[i]} / ({' + '.join(_F[:5])}) AS {n}" for i, n in enumerate(("char", "pv", "npv", "soil", "shade"))) + f", {_F[5]} / CAST(5 AS DOUBLE) AS rmse FROM px)"


def band(wavelength: float, tie: str = "larger", s: str = "s") -> str:
    """SQL of the nearest band of a spectrum."""
    return f"{s}[{BANDS.nearest(wavelength, tie) + 1}]"


def clipped(v: str) -> str:
    return f"(CASE WHEN {v} IS NOT NULL THEN least(greatest({v}, CAST(0 AS DOUBLE)), CAST(1 AS DOUBLE)) END)"


def nd(a: str, b: str) -> str:
    return f"(CASE WHEN abs({a} + {b}) >= 1e-3 THEN ({a} - {b}) / ({a} + {b}) END)"


def index(a: float, b: float, s: str = "s") -> str:
    return nd(clipped(band(a, s=s)), clipped(band(b, s=s)))


NBR, NDVI, NDWI = index(860, 2200), index(860, 660), index(560, 860)
