"""Cuts of lineage that survive lost executors, and a numbering of rows in a global order."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where the session names none and all runs in one process (``local``) a temporary folder is made; elsewhere
    each executor would write to a disk of its own, so that is an error.
    """
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named and not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    sc.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="lumenweave-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: lost executors cost nothing of it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def numbers(xs: Iterable[int]) -> Column:
    """An array of whole numbers as one literal of the plan."""
    return F.split(F.lit(",".join(str(int(x)) for x in xs)), ",").cast("array<bigint>")


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``number``: each row's place from 0 on in the order of these columns.

    Rows are dealt by ranges of the order and numbered in their partition; only the partitions' sizes reach the
    driver. Equal rows spread over partitions if all of their columns are in ``order`` and some differ.
    """
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33).cast("int")
    sizes = dict(placed.groupBy(part.alias("p")).count().collect())
    before, starts = 0, []
    for p in range(max(sizes, default=-1) + 1):
        starts.append(before)
        before += sizes.get(p, 0)
    return placed.withColumn("number", F.get(numbers(starts or [0]), part) + F.col("_m").bitwiseAND((1 << 33) - 1)).drop("_m")
