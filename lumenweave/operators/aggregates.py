"""Grouped summaries of products, regions, classes and dates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenweave.functions.quantiles import with_quantiles


def summary(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Count, least, largest, mean and exact median of the values that aren't missing."""
    v = F.col(value)
    out = df.groupBy(*by).agg(F.count(v).alias("n_valid"), F.min(v).alias("v_min"), F.max(v).alias("v_max"), F.avg(v).alias("v_mean"))
    return with_quantiles(out, df, [value], [0.5], by).withColumn("v_median", F.col(f"q_{value}")[0]).drop(f"q_{value}")


def mean_spectra(df: DataFrame, by: str, spectrum: str = "spectrum", least: int = 1, least_groups: int = 1) -> DataFrame:
    """(by, n_pixels, spectrum): mean spectrum of each group of at least ``least`` pixels; missing bands left out, else 0.

    Band sums are partial sums before the shuffle: a group costs one row a band and task, however many pixels it has.
    """
    counts = df.groupBy(by).agg(F.count("*").alias("n_pixels")).filter(F.col("n_pixels") >= least)
    sums = df.select(by, F.posexplode(spectrum).alias("band", "v")).groupBy(by, "band").agg(F.coalesce(F.avg("v"), F.lit(0.0)).alias("v"))
    ordered = sums.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("band", "v"))), lambda s: s["v"]).alias(spectrum))
    out = ordered.join(counts, by).select(by, "n_pixels", spectrum)
    if least_groups > 1 and out.limit(least_groups).count() < least_groups:
        raise RuntimeError(f"fewer than {least_groups} classes have {least} pixels")
    return out


def region_means(df: DataFrame, regions: Mapping[str, tuple[int, int, int, int]], spectrum: str = "spectrum") -> DataFrame:
    """Mean spectra of windows (first row, row end, first col, col end) by name; a pixel counts for each window it is in."""
    names = F.array_compact(F.array(*[F.when(F.col("row").between(r0, r1 - 1) & F.col("col").between(c0, c1 - 1), F.lit(n)) for n, (r0, r1, c0, c1) in regions.items()]))
    return mean_spectra(df.withColumn("region", F.explode(names)), "region", spectrum)


def class_histogram(df: DataFrame, code: str) -> DataFrame:
    """(code, n, percent) of codes that aren't missing."""
    counts = df.filter(F.col(code).isNotNull()).groupBy(code).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select(code, "n", (100.0 * F.col("n") / F.col("total")).alias("percent"))


def stratified_means(df: DataFrame, code: str, values: Sequence[str]) -> DataFrame:
    """(code, n, mean of each value) by class."""
    return df.filter(F.col(code).isNotNull()).groupBy(code).agg(F.count("*").alias("n"), *[F.avg(v).alias(f"mean_{v}") for v in values])


def is_monotonic(means: DataFrame, code: str, value: str, rising: bool = True) -> DataFrame:
    """One row: whether the value goes only up (or down) with the class code; classes are few."""
    before = F.lag(value).over(Window.orderBy(code))
    step = F.col(value) > F.col("_b") if rising else F.col(value) < F.col("_b")
    return means.withColumn("_b", before).filter(F.col("_b").isNotNull()).agg(F.coalesce(F.bool_and(step), F.lit(True)).alias("monotonic"))


def trajectory_stats(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean and population standard deviation by date (and more)."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("v_mean"), F.stddev_pop(value).alias("v_std"))


def top_pixel(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, row, col, value) of the largest value, the first in row order of equals; missing ones never win."""
    best = F.max_by(F.struct("row", "col", value), F.struct(value, -F.col("row"), -F.col("col")))
    return df.filter(F.col(value).isNotNull()).groupBy(*by).agg(best.alias("t")).select(*by, "t.*")


def recovery_slope(df: DataFrame, by: Sequence[str], day: str, value: str, baseline: Column) -> DataFrame:
    """From first to last date: slope a day, and days from the last to ``baseline`` (NULL unless the slope is positive)."""
    ends = df.groupBy(*by).agg(F.min_by(value, day).alias("v0"), F.max_by(value, day).alias("v1"), F.datediff(F.max(day), F.min(day)).alias("days"), F.max(baseline).alias("baseline"))
    slope = F.when(F.col("days") > 0, (F.col("v1") - F.col("v0")) / F.col("days"))
    left = F.when(F.col("slope") > 0, F.greatest((F.col("baseline") - F.col("v1")) / F.col("slope"), F.lit(0.0)))
    return ends.withColumn("slope", slope).withColumn("days_to_baseline", left)


def site_medians(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Median and count of a value by site."""
    out = df.groupBy(*keys).agg(F.count(value).alias("n"))
    return with_quantiles(out, df, [value], [0.5], keys).select(*keys, F.col(f"q_{value}")[0].alias("v_median"), "n")


def pivot_mean(df: DataFrame, row: str, column: str, value: str, names: Sequence[str]) -> DataFrame:
    """Means of ``value`` by ``row``, one column for each of the given ``names`` of ``column``."""
    return df.groupBy(row).pivot(column, list(names)).avg(value)


def bounds_intersection(df: DataFrame) -> DataFrame:
    """The rectangle that all rows' xmin, ymin, xmax, ymax share; NULL ends where they share none."""
    out = df.agg(F.max("xmin").alias("xmin"), F.max("ymin").alias("ymin"), F.min("xmax").alias("xmax"), F.min("ymax").alias("ymax"))
    some = (F.col("xmin") < F.col("xmax")) & (F.col("ymin") < F.col("ymax"))
    return out.select(*[F.when(some, F.col(c)).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


def quicklook_range(df: DataFrame, value: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """The exact percentiles between which a quicklook is stretched."""
    q = with_quantiles(df.agg(F.count(value).alias("n")), df, [value], [low, high])
    return q.select(F.col(f"q_{value}")[0].alias("v_low"), F.col(f"q_{value}")[1].alias("v_high"))
