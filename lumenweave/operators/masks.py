"""Pixel masks (true = keep) and row filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenweave.functions.bands import Bands
from lumenweave.functions.missing import finite
from lumenweave.functions.quantiles import quantiles
from lumenweave.operators.indices import ndwi


def nodata_mask(spectrum: Column, fill: float | None = None) -> Column:
    """Whether every band is a number (and, if given, none is ``fill``)."""
    ok = F.forall(spectrum, lambda v: finite(v))
    return ok if fill is None else ok & F.forall(spectrum, lambda v: v != F.lit(fill))


def cloud_mask(cirrus: Column | None = None, cloud: Column | None = None) -> Column:
    """Clear where no given flag is set; a missing flag is clear."""
    flags = [F.coalesce(f, F.lit(0)) == 0 for f in (cirrus, cloud) if f is not None]
    return flags[0] & flags[1] if len(flags) == 2 else flags[0] if flags else F.lit(True)


def water_mask(spectrum: Column, bands: Bands, threshold: float = 0.3) -> Column:
    """Land where NDWI is at most ``threshold``; a missing NDWI is no land."""
    return F.coalesce(ndwi(spectrum, bands) <= threshold, F.lit(False))


def apply_masks(df: DataFrame, masks: Sequence[Column], columns: Sequence[str] = ("spectrum",), drop_rows: bool = False) -> DataFrame:
    """NULL in ``columns`` where any mask fails; with ``drop_rows`` those rows go instead."""
    if not masks:
        raise ValueError("no mask given")
    keep = F.lit(True)
    for m in masks:
        keep = keep & F.coalesce(m, F.lit(False))
    return df.filter(keep) if drop_rows else df.withColumns({c: F.when(keep, F.col(c)) for c in columns})


def in_bbox(lon: Column, lat: Column, west: float, south: float, east: float, north: float) -> Column:
    return lon.between(west, east) & lat.between(south, north)


def in_range(v: Column, low: float, high: float) -> Column:
    return v.between(low, high)


def contains_any(v: Column, needles: Sequence[str]) -> Column:
    """Whether the value holds any of the strings, whatever their case."""
    return F.coalesce(F.exists(F.array(*[F.lit(n.lower()) for n in needles]), lambda n: F.contains(F.lower(v), n)), F.lit(False))


def near_any_date(when: Column, dates: Sequence[str], days: int = 30) -> Column:
    """Whether a time lies within ``days`` of any of the dates; false without dates."""
    if not dates:
        return F.lit(False)
    seconds = days * 86400
    stamps = F.array(*[F.to_timestamp(F.lit(d)) for d in dates])
    return F.coalesce(F.exists(stamps, lambda d: F.abs(F.unix_micros(when.cast("timestamp")) - F.unix_micros(d)) <= seconds * 1_000_000), F.lit(False))


def heuristic_classes(nbr: Column, ndvi: Column, ndwi_: Column) -> Column:
    """Material class by absolute thresholds; the first that fits of char, pv, npv, soil."""
    return (
        F.when((nbr < -0.1) & (ndvi < 0.2), "char")
        .when(ndvi > 0.5, "pv")
        .when((ndvi > 0.15) & (ndvi < 0.4) & (nbr > 0), "npv")
        .when((ndvi < 0.15) & (ndwi_ < -0.1), "soil")
    )


def percentile_classes(df: DataFrame, nbr: str = "nbr", ndvi: str = "ndvi", least: int = 25) -> DataFrame:
    """Flags ``is_char, is_pv, is_npv, is_soil`` by percentiles of the whole table; classes of under ``least`` pixels are empty."""
    shares = (0.15, 0.30, 0.35, 0.40, 0.60, 0.80)
    some = quantiles(df, [nbr, ndvi], shares)
    q = some.select(F.array(*[F.col(f"q_{nbr}")[i] for i in (0, 1)]).alias("qn"), F.array(*[F.col(f"q_{ndvi}")[i] for i in range(1, 6)]).alias("qv"))
    n, v = F.col(nbr), F.col(ndvi)
    flagged = df.join(F.broadcast(q)).withColumns(
        {
            "is_char": (n <= F.col("qn")[0]) & (v <= F.col("qv")[1]),
            "is_pv": v >= F.col("qv")[4],
            "is_npv": v.between(F.col("qv")[2], F.col("qv")[3]),
            "is_soil": (v <= F.col("qv")[0]) & (n >= F.col("qn")[1]),
        }
    )
    names = ("is_char", "is_pv", "is_npv", "is_soil")
    counts = flagged.agg(*[F.count_if(F.col(c)).alias(f"n_{c}") for c in names])
    out = flagged.join(F.broadcast(counts))
    return out.withColumns({c: F.col(c) & (F.col(f"n_{c}") >= least) for c in names}).drop("qn", "qv", *[f"n_{c}" for c in names])


def crop(df: DataFrame, size: int, centre: DataFrame | None = None) -> DataFrame:
    """Pixels of the ``size`` x ``size`` window about the middle of the grid, or about the median (row, col) of ``centre``."""
    half = size // 2
    if centre is None:
        mid = df.agg(F.expr("(min(row) + max(row) + 1) div 2").alias("r0"), F.expr("(min(col) + max(col) + 1) div 2").alias("c0"))
    else:
        mid = quantiles(centre, ["row", "col"], [0.5]).select(F.floor(F.col("q_row")[0]).alias("r0"), F.floor(F.col("q_col")[0]).alias("c0"))
    inside = (F.col("row") >= F.col("r0") - half) & (F.col("row") < F.col("r0") - half + size) & (F.col("col") >= F.col("c0") - half) & (F.col("col") < F.col("c0") - half + size)
    return df.join(F.broadcast(mid), inside, "inner").drop("r0", "c0")
