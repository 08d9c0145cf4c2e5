"""Windowed trajectory statistics over a stream of observations.

The same aggregation as the batch trajectories, with a watermark that bounds the state: windows older than it are
final, later data for them are dropped, and only open windows are kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenweave.functions.durable import shared_dir


def windowed(stream: DataFrame, at: str, cls: str, value: str, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """(window_start, cls, n, v_mean, v_std) of a (streaming or batch) table."""
    bins = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(F.window(at, window).alias("w"), F.col(cls).alias("cls"))
    out = bins.agg(F.count(value).alias("n"), F.avg(value).alias("v_mean"), F.stddev_pop(value).alias("v_std"))
    return out.select(F.col("w.start").alias("window_start"), "cls", "n", "v_mean", "v_std")


def read(spark: SparkSession, path: str, files_a_batch: int = 1) -> DataFrame:
    """A stream of the Parquet files at ``path``."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def run_once(spark: SparkSession, path: str, at: str, cls: str, value: str) -> DataFrame:
    """All that is there now, through the streaming engine, as a table: each window's last state.

    State, progress and results live in the shared folder, so the stream outlives lost executors.
    """
    root = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{root}/out/b={batch_id}")

    # A file's folder may hold other tables, so the stream reads the folder with this file's name as its glob.
    folder, _, name = path.rstrip("/").rpartition("/")
    schema = spark.read.parquet(path).schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", name if is_file(spark, path) else "*").parquet(folder if is_file(spark, path) else path)
    query = windowed(source, at, cls, value).writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    done = spark.read.parquet(f"{root}/out")
    return done.groupBy("window_start", "cls").agg(*[F.max_by(c, "batch").alias(c) for c in ("n", "v_mean", "v_std")])


def is_file(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile()
