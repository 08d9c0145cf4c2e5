"""Exact percentiles of any number of rows: no task holds the values of a group.

Values are counted into ``BINS`` equal stretches between their group's least and largest; the stretch that holds a
wanted rank is known from the counts, and only its distinct values are ordered. The result equals that of Spark's
``percentile``, which keeps every distinct value of a group in one task's memory. Where all groups together have few
values, the distinct ones are put in order at once, by a sort that can spill.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenweave.functions.durable import cut

#: Stretches that the values of a group are counted into; their counts are the rows of one window.
BINS = 1 << 14
#: Groups up to which their few numbers are broadcast, so that values needn't be dealt by group.
FEW = 10_000
#: Values of all groups up to which each group's are ordered by one task.
ORDERED = 1 << 20


def _bin(v: Column, lo: Column, hi: Column) -> Column:
    """The stretch of a value; grows with the value, infinite ends included."""
    place = (v - lo) / F.when(hi > lo, hi - lo).otherwise(1.0) * BINS
    return F.when((place >= 0) & (place < BINS), F.floor(place)).when(place >= BINS, BINS - 1).otherwise(0).cast("int")


def _places(shares: Sequence[float]) -> list[Column]:
    """Where between the ranks 0 and n - 1 the shares lie."""
    return [F.lit(float(q)) * (F.col("n") - 1) for q in shares]


def _between(place: Column, low: Column, high: Column) -> Column:
    """What lies at a place between the values of the ranks below and above it."""
    return F.when(F.floor(place) == F.ceil(place), low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)


def _ordered(held: DataFrame, shares: Sequence[float]) -> DataFrame:
    """(k, q) by the order of each group's distinct values."""
    group = Window.partitionBy("k")
    counts = held.groupBy("k", "v").agg(F.count("*").alias("m"))
    to = counts.withColumns({"to": F.sum("m").over(group.orderBy("v")), "n": F.sum("m").over(group)})
    at = lambda rank: F.max(F.when((rank < F.col("to")) & (rank >= F.col("to") - F.col("m")), F.col("v")))
    ends = [x for i, p in enumerate(_places(shares)) for x in (at(F.floor(p)).alias(f"l{i}"), at(F.ceil(p)).alias(f"h{i}"))]
    found = to.groupBy("k").agg(F.max("n").alias("n"), *ends)
    return found.select("k", F.array(*[_between(p, F.col(f"l{i}"), F.col(f"h{i}")) for i, p in enumerate(_places(shares))]).alias("q"))


def quantiles(df: DataFrame, values: Sequence[str], shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by..., q_<value> for each of ``values``): an array of the interpolated percentiles at ``shares``, NULL where a value has no number.

    NULL and NaN are left out; a NULL in ``by`` is a group of its own; groups without any number have no row.
    """
    stacked = F.explode(F.array(*[F.struct(F.lit(v).alias("name"), F.col(v).cast("double").alias("v")) for v in values]))
    rows = df.select(F.struct(*by, F.lit(0).alias("_")).alias("g"), stacked.alias("s")).select(F.struct("g", "s.name").alias("k"), F.col("s.v").alias("v"))
    held = cut(rows.filter(F.col("v").isNotNull() & ~F.isnan("v")))
    if held.count() <= ORDERED:
        return _by_value(_ordered(held, shares), values)
    ends = cut(held.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")))
    hint = F.broadcast if ends.limit(FEW + 1).count() <= FEW else lambda small: small
    binned = held.join(hint(ends.select("k", "lo", "hi")), "k").select("k", "v", _bin(F.col("v"), F.col("lo"), F.col("hi")).alias("bin"))
    counts = binned.groupBy("k", "bin").agg(F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    counts = counts.withColumn("before", F.sum("c").over(Window.partitionBy("k").orderBy("bin")) - F.col("c"))
    place = _places(shares)
    ranks = F.array_distinct(F.array(*[f(p).cast("long") for p in place for f in (F.floor, F.ceil)]))
    wanted = ends.select("k", F.explode(ranks).alias("rank"))
    # As many rows as ranks are wanted.
    hit = cut(counts.join(hint(wanted), "k").filter((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("c"))))
    narrow = hit.filter("lo < hi")
    inner = binned.join(hint(narrow.select("k", "bin").distinct()), ["k", "bin"]).groupBy("k", "bin", "v").agg(F.count("*").alias("m"))
    inner = inner.withColumn("to", F.sum("m").over(Window.partitionBy("k", "bin").orderBy("v")))
    there = F.col("rank") - F.col("before")
    found = narrow.select("k", "bin", "rank", "before").join(inner, ["k", "bin"]).filter((there < F.col("to")) & (there >= F.col("to") - F.col("m")))
    at = found.select("k", "rank", "v").unionByName(hit.filter("lo = hi").select("k", "rank", F.col("lo").alias("v")))
    table = ends.select("k", "n").join(at.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("m")), "k")
    value = lambda p, f: F.element_at("m", f(p).cast("long"))
    return _by_value(table.select("k", F.array(*[_between(p, value(p, F.floor), value(p, F.ceil)) for p in place]).alias("q")), values)


def _by_value(found: DataFrame, values: Sequence[str]) -> DataFrame:
    """(k, q) as a row a group with a column q_<value> for each value."""
    out = found.select(F.col("k.g").alias("g"), F.col("k.name").alias("name"), "q")
    return out.groupBy("g").agg(*[F.max(F.when(F.col("name") == v, F.col("q"))).alias(f"q_{v}") for v in values]).select("g.*", *[f"q_{v}" for v in values]).drop("_")


def with_quantiles(groups: DataFrame, df: DataFrame, values: Sequence[str], shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """``groups``, one row for each ``by`` of ``df`` (one row without), with the columns of ``quantiles``."""
    found = quantiles(df, values, shares, by)
    if not by:
        return groups.join(F.broadcast(found), F.lit(True), "left")  # one row
    names = {c: f"_own_{c}" for c in by}
    own = groups.withColumnsRenamed(names)
    same = [own[n].eqNullSafe(found[c]) for c, n in names.items()]
    return own.join(found, same, "left").drop(*by).withColumnsRenamed({n: c for c, n in names.items()})
