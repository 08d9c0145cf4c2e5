"""Helpers that the corpus operators share: durable cuts of lineage and Arrow plumbing."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenweave.functions.durable import cut, numbered, numbers, shared_dir

__all__ = ["arrow_map", "cut", "new_path", "numbered", "numbers", "shared_dir", "slices", "store", "table", "utf8"]


def new_path(spark: SparkSession, what: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def store(df: DataFrame, what: str) -> DataFrame:
    """As ``cut``, as a Parquet table of its own: smaller on disk than a checkpoint, with columns that can be pruned."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``fn`` on slices of Arrow batches, each of at most some MB of text, so that long rows stay bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield fn(part)

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Split a batch so that no slice holds much more than ``most`` bytes (one row at least)."""
    n = batch.num_rows
    if n == 0:
        return
    step = max(1, min(n, int(n * most / max(1, batch.nbytes))))
    for at in range(0, n, step):
        yield batch.slice(at, step)


def utf8(col) -> F.Column:
    """Text with null as empty."""
    return F.coalesce(col, F.lit(""))
