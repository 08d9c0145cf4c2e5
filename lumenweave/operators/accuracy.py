"""Agreement of predictions with observations: continuous, classified, ranked, by group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenweave.functions.durable import cut, numbered
from lumenweave.functions.missing import finite
from lumenweave.functions.quantiles import with_quantiles
from lumenweave.operators.grid import Grid, sample_points

#: Damage categories of structures in order.
DAMAGE = ("No Damage", "Affected (1-9%)", "Minor (10-25%)", "Major (26-50%)", "Destroyed (>50%)")

#: Distinct values that one task may put in order.
ORDERED = 1 << 20


def _valid(df: DataFrame, pred: str, obs: str) -> DataFrame:
    return df.filter(F.col(pred).isNotNull() & F.col(obs).isNotNull() & ~F.isnan(pred) & ~F.isnan(obs))


def _some(n: str, what: str = "no valid pairs") -> F.Column:
    """A count; none is an error when the result is used."""
    return F.when(F.coalesce(F.col(n), F.lit(0)) == 0, F.raise_error(F.lit(what)).cast("long")).otherwise(F.col(n)).alias(n)


def average_ranks(df: DataFrame, value: str, rank: str = "rank", weight: str | None = None) -> DataFrame:
    """``df`` with the rank of ``value`` from 1 on, equal values sharing their mean; a row counts ``weight`` times.

    Distinct values are counted, then ordered: up to ``ORDERED`` of them by one task, more by ranges, so that no task
    sees all rows or an unbounded number of values. NULL values have no rank.
    """
    times = F.count("*") if weight is None else F.sum(weight)
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(times.alias("_n"))
    if counts.count() <= ORDERED:
        to = F.sum("_n").over(Window.orderBy(value))
        return df.join(counts.select(value, (to - (F.col("_n") - 1) / 2).alias(rank)), value, "left")
    placed = numbered(counts, value).withColumn("_block", F.expr("number div 4096"))
    inner = Window.partitionBy("_block").orderBy("number")
    sums = placed.withColumn("_to", F.sum("_n").over(inner))
    blocks = placed.groupBy("_block").agg(F.sum("_n").alias("_b"))
    # Blocks of 4096 distinct values: their running total is over few rows.
    before = blocks.withColumn("_from", F.sum("_b").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = sums.join(before.select("_block", F.coalesce("_from", F.lit(0)).alias("_from")), "_block")
    mean = F.col("_from") + F.col("_to") - (F.col("_n") - 1) / 2
    return df.join(ranked.select(value, mean.alias(rank)), value, "left")


def spearman(df: DataFrame, pred: str, obs: str) -> DataFrame:
    """One row: the rank correlation; NULL for fewer than two pairs or constant ranks.

    Equal pairs are counted first, so what is ranked and joined is a row a distinct pair.
    """
    cells = cut(_valid(df, pred, obs).groupBy(F.col(pred).alias("p"), F.col(obs).alias("o")).agg(F.count("*").alias("w")))
    n = cells.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
    ranked = average_ranks(average_ranks(cells, "p", "rp", "w"), "o", "ro", "w")
    # The mean of all ranks is known, so the sums are of what ranks differ from it.
    a, b, w = F.col("rp") - (n + 1) / 2, F.col("ro") - (n + 1) / 2, F.col("w")
    rho = F.try_divide(F.sum(w * a * b), F.sqrt(F.sum(w * a * a)) * F.sqrt(F.sum(w * b * b)))
    return ranked.agg(F.when(F.lit(n > 1), rho).alias("spearman"))


def correlation(a: str, b: str) -> F.Column:
    """Pearson's correlation; NULL for fewer than two pairs or a constant side."""
    return F.when(F.count("*") > 1, F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def continuous(df: DataFrame, pred: str, obs: str, by: Sequence[str] = (), rollup: bool = False) -> DataFrame:
    """n_valid, r2 (1 - SSE / SST), rmse, mae, bias of the pairs, in one pass; by group, with totals if ``rollup``.

    r2 of constant observations is 1 if they are met and 0 if not, NULL for one pair; no pair at all is an error when the result is used.
    """
    held = _valid(df, pred, obs)
    grouped = held.rollup(*by) if rollup else held.groupBy(*by)
    d = F.col(pred) - F.col(obs)
    out = grouped.agg(F.count("*").alias("n_valid"), F.sum(d * d).alias("sse"), F.var_pop(obs).alias("var"), F.avg(F.abs(d)).alias("mae"), F.avg(d).alias("bias"))
    r2 = F.when(F.col("var") > 0, 1 - F.col("sse") / (F.col("var") * F.col("n_valid"))).when(F.col("n_valid") > 1, F.when(F.col("sse") == 0, 1.0).otherwise(0.0))
    return out.select(*by, _some("n_valid"), r2.alias("r2"), F.sqrt(F.col("sse") / F.col("n_valid")).alias("rmse"), "mae", "bias")


def compare_methods(a: DataFrame, b: DataFrame, value: str = "value") -> DataFrame:
    """One row of two rasters on one grid: pearson, rmse, bias (mean of a - b), n_valid."""
    pairs = a.select("row", "col", F.col(value).alias("a")).join(b.select("row", "col", F.col(value).alias("b")), ["row", "col"])
    d = F.col("a") - F.col("b")
    return _valid(pairs, "a", "b").agg(correlation("a", "b").alias("pearson"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(d).alias("bias"), F.count("*").alias("n_valid"))


def confusion(df: DataFrame, pred: str, obs: str, nodata: int | None = -1) -> DataFrame:
    """(obs, pred, n) of the pairs in which neither is missing or ``nodata``."""
    held = df.filter(F.col(pred).isNotNull() & F.col(obs).isNotNull())
    if nodata is not None:
        held = held.filter((F.col(pred) != nodata) & (F.col(obs) != nodata))
    return held.groupBy(F.col(obs).alias("obs"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def class_scores(cells: DataFrame) -> DataFrame:
    """(label, n_obs, n_pred, n_hit, f1) of a confusion table, for every label that occurs on either side."""
    sides = cells.select(F.explode(F.array(F.struct(F.col("obs").alias("label"), F.col("n").alias("o"), F.lit(0).cast("long").alias("p")), F.struct(F.col("pred").alias("label"), F.lit(0).cast("long").alias("o"), F.col("n").alias("p")))).alias("s"), F.when(F.col("obs") == F.col("pred"), F.col("n")).otherwise(0).alias("h"))
    out = sides.groupBy(F.col("s.label").alias("label")).agg(F.sum("s.o").alias("n_obs"), F.sum("s.p").alias("n_pred"), F.expr("sum(case when s.o > 0 then h else 0 end)").alias("n_hit"))
    return out.withColumn("f1", F.when(F.col("n_obs") + F.col("n_pred") > 0, 2.0 * F.col("n_hit") / (F.col("n_obs") + F.col("n_pred"))).otherwise(0.0))


def classified(df: DataFrame, pred: str, obs: str, nodata: int | None = -1) -> DataFrame:
    """One row: n_valid, accuracy, kappa, f1_macro. Only the confusion table leaves the first aggregation."""
    labels = class_scores(confusion(df, pred, obs, nodata))
    t = labels.agg(F.sum("n_obs").alias("n_valid"), F.sum("n_hit").alias("hit"), F.sum(F.col("n_obs").cast("double") * F.col("n_pred")).alias("cross"), F.avg("f1").alias("f1_macro"))
    po, pe = F.col("hit") / F.col("n_valid"), F.col("cross") / (F.col("n_valid").cast("double") * F.col("n_valid"))
    return t.select(_some("n_valid"), po.alias("accuracy"), F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"), "f1_macro")


def detection(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """One row: tp, fp, fn, tn, accuracy, precision, recall, f1 (0 where undefined)."""
    p, a = F.col(predicted), F.col(actual)
    t = df.agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"), F.count_if(~p & ~a).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    part = lambda top, bottom: F.when(bottom > 0, top / bottom).otherwise(0.0)
    return t.select("tp", "fp", "fn", "tn", part(tp + tn, tp + fp + fn + tn).alias("accuracy"), part(tp, tp + fp).alias("precision"), part(tp, tp + fn).alias("recall"), part(2.0 * tp, 2 * tp + fp + fn).alias("f1"))


def check_structures(points: DataFrame, raster: DataFrame, grid: Grid, value: str, threshold: float = 0.1, damaged_from: int = 1, ordinal: str = "ordinal") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(detection scores with counts inside and outside, statistics by ordinal, rank correlation) of structures on a product."""
    sampled = sample_points(points, raster, grid, [value])
    inside = sampled.filter(F.col(value).isNotNull())
    flagged = inside.withColumns({"_p": F.col(value) >= threshold, "_a": F.col(ordinal) >= damaged_from})
    counts = sampled.agg(F.count(value).alias("n_inside"), (F.count("*") - F.count(value)).alias("n_outside")).select(_some("n_inside", "no point falls on a valid pixel"), "n_outside")
    scores = detection(flagged, "_p", "_a").join(F.broadcast(counts))
    means = inside.groupBy(ordinal).agg(F.count("*").alias("n"), F.avg(value).alias("v_mean"), F.stddev_pop(value).alias("v_std"))
    stats = with_quantiles(means, inside, [value], [0.5], [ordinal]).select(ordinal, "n", "v_mean", F.col(f"q_{value}")[0].alias("v_median"), "v_std")
    return scores, stats, spearman(inside, value, ordinal)


def compare_sensors(df: DataFrame, a: str, b: str, truth: str) -> DataFrame:
    """(metric, a, b, delta): agreement of two products with the truth side by side; errors as reduction in percent."""
    x, y = (continuous(df, c, truth).select(*[F.col(m).alias(f"{p}_{m}") for m in ("r2", "rmse", "mae", "bias")]) for p, c in (("a", a), ("b", b)))
    both = x.join(F.broadcast(y))
    less = lambda m: F.when(F.col(f"b_{m}") > 0, 100 * (F.col(f"b_{m}") - F.col(f"a_{m}")) / F.col(f"b_{m}")).otherwise(0.0)
    delta = {"r2": F.col("a_r2") - F.col("b_r2"), "rmse": less("rmse"), "mae": less("mae"), "bias": F.col("a_bias") - F.col("b_bias")}
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"a_{m}").alias("a"), F.col(f"b_{m}").alias("b"), d.alias("delta")) for m, d in delta.items()])
    return both.select(F.explode(rows).alias("r")).select("r.*")


def finite_pairs(df: DataFrame, pred: str, obs: str) -> DataFrame:
    """Only pairs of two numbers, infinities dropped too."""
    return df.filter(finite(F.col(pred)) & finite(F.col(obs)))
