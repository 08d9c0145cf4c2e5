"""The data side of maps and figures: styles, extents, down-sampled rasters, figure tables. Rendering is the caller's."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenweave.functions.projection import from_utm
from lumenweave.operators.severity import DNBR_EDGES


class Style(NamedTuple):
    cmap: str
    vmin: float
    vmax: float
    label: str
    class_ticks: tuple[float, ...] | None = None


#: How products are shown.
STYLES = {
    "nbr": Style("RdYlGn", -1.0, 1.0, "NBR"),
    "ndvi": Style("RdYlGn", -1.0, 1.0, "NDVI"),
    "ndwi": Style("RdYlBu", -1.0, 1.0, "NDWI"),
    "dnbr": Style("RdYlGn_r", -0.5, 1.3, "dNBR (Burn Severity)", DNBR_EDGES),
    "cbi": Style("YlOrRd", 0.0, 3.0, "CBI (Composite Burn Index)", (0.0, 1.0, 2.0, 3.0)),
    "severity": Style("tab10", 0.0, 4.0, "Severity Class", (0, 1, 2, 3, 4)),
    "char": Style("Reds", 0.0, 1.0, "Char Fraction"),
    "pv": Style("Greens", 0.0, 1.0, "Photosynthetic Vegetation"),
    "npv": Style("YlOrBr", 0.0, 1.0, "Non-Photosynthetic Vegetation"),
    "soil": Style("copper", 0.0, 1.0, "Soil Fraction"),
    "lfmc": Style("RdYlGn", 0.0, 200.0, "LFMC (%)", (30, 60, 90, 120)),
}


def extent(df: DataFrame) -> DataFrame:
    """One row: left_edge, right_edge, bottom, top of a raster with x and y of pixel centres."""
    half = lambda v, n: F.when(F.countDistinct(n) > 1, (F.max(v) - F.min(v)) / (F.max(n) - F.min(n)) / 2).otherwise(0.0)
    q = df.agg(*[f(v).alias(f"{n}_{v}") for v in ("x", "y") for n, f in (("lo", F.min), ("hi", F.max))], half("x", "col").alias("hx"), half("y", "row").alias("hy"))
    return q.select((F.col("lo_x") - F.col("hx")).alias("left_edge"), (F.col("hi_x") + F.col("hx")).alias("right_edge"), (F.col("lo_y") - F.col("hy")).alias("bottom"), (F.col("hi_y") + F.col("hy")).alias("top"))


def thumbnail(df: DataFrame, value: str, rows: int, cols: int, most: int = 512) -> DataFrame:
    """Block means of a raster of ``rows`` x ``cols`` cells, at most ``most`` cells a side, to be drawn on the driver."""
    f = max(1, -(-max(rows, cols) // most))
    return df.groupBy(F.expr(f"row div {f}").cast("int").alias("row"), F.expr(f"col div {f}").cast("int").alias("col")).agg(F.avg(value).alias(value))


def shared_scale(before: DataFrame, after: DataFrame, value: str) -> DataFrame:
    """One row: the range of a value over two rasters."""
    return before.select(value).unionByName(after.select(value)).agg(F.min(value).alias("vmin"), F.max(value).alias("vmax"))


def trajectory_table(stats: DataFrame, day: str, fire_date: str) -> DataFrame:
    """Mean with its error band and whether it is after the fire, in order of time."""
    return stats.select(day, "v_mean", (F.col("v_mean") - F.col("v_std")).alias("low"), (F.col("v_mean") + F.col("v_std")).alias("high"), (F.col(day) >= F.lit(fire_date).cast("date")).alias("after_fire")).orderBy(day)


def contour_levels(difference: Column) -> Column:
    """How many of the contour levels of a difference map a value reaches."""
    return sum((F.when(difference >= e, 1).otherwise(0) for e in DNBR_EDGES), F.lit(0))


def map_centre(df: DataFrame, epsg: int) -> DataFrame:
    """One row: longitude and latitude of the middle of a UTM raster, for a map on the web."""
    mid = df.agg(((F.min("x") + F.max("x")) / 2).alias("x"), ((F.min("y") + F.max("y")) / 2).alias("y"))
    lon, lat = from_utm(F.col("x"), F.col("y"), epsg)
    return mid.select(lon.alias("lon"), lat.alias("lat"))


def perimeter_labels(rings: DataFrame, name: str = "name") -> DataFrame:
    """(name, x, y): area centroid of each ring of (name, ring array<struct<x,y>>)."""
    n = F.size("ring")
    step = lambda f: F.aggregate(F.sequence(F.lit(1), n - 1), F.lit(0.0), lambda s, i: s + f(F.get("ring", i - 1), F.get("ring", i)))
    cross = lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]
    area = step(cross) / 2
    return rings.select(name, (step(lambda a, b: (a["x"] + b["x"]) * cross(a, b)) / (6 * area)).alias("x"), (step(lambda a, b: (a["y"] + b["y"]) * cross(a, b)) / (6 * area)).alias("y"))


def scalebar(left: float, right: float, bottom: float, top: float, length: float) -> Mapping[str, float]:
    """Where a scale bar of ``length`` stands: margins of 5 %, height of 1 % of the map."""
    return {"x0": left + 0.05 * (right - left), "x1": left + 0.05 * (right - left) + length, "y": bottom + 0.05 * (top - bottom), "height": 0.01 * (top - bottom)}


def severity_panels(df: DataFrame, products: Sequence[str] = ("nbr", "dnbr", "severity", "char", "pv", "soil")) -> dict[str, tuple[DataFrame, Style | None]]:
    """The six panels of a severity summary: each product's raster and its style."""
    return {p: (df.select("row", "col", p), STYLES.get(p)) for p in products}
