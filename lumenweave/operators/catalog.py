"""Scene catalogs: items with times, boxes and assets; phases relative to ignition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ignition dates, and scenes (id, time, phase, fire complex, days from ignition).
IGNITION = {"palisades": "2025-01-07", "hughes": "2025-01-22"}
SCENES = (
    ("20241215_185916_33_4001", "2024-12-15T18:59:16Z", "pre-fire", "palisades", -23),
    ("20250123_185507_64_4001", "2025-01-23T18:55:07Z", "post-fire", "hughes", 1),
    ("20250123_185518_92_4001", "2025-01-23T18:55:18Z", "post-fire", "palisades", 16),
    ("20250407_192235_24_4001", "2025-04-07T19:22:35Z", "early-recovery", "hughes", 75),
    ("20250407_192229_16_4001", "2025-04-07T19:22:29Z", "early-recovery", None, 90),
    ("20250724_190927_83_4001", "2025-07-24T19:09:27Z", "other", None, None),
    ("20250726_192343_21_4001", "2025-07-26T19:23:43Z", "mid-recovery", None, 200),
    ("20250726_192422_87_4001", "2025-07-26T19:24:22Z", "mid-recovery", None, 200),
    ("20250902_190116_02_4001", "2025-09-02T19:01:16Z", "other", None, None),
    ("20250902_190121_86_4001", "2025-09-02T19:01:21Z", "other", None, None),
    ("20250920_193207_61_4001", "2025-09-20T19:32:07Z", "late-recovery", None, 256),
)



def known_scenes(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(SCENES, "scene_id string, at string, phase string, fire_complex string, days_relative_to_ignition int")
    return rows.withColumn("datetime", F.to_timestamp("at")).drop("at")


def parse_time(text: Column) -> Column:
    """A timestamp of ISO 8601 with or without fraction or zone, or of a bare date (midnight); UTC where no zone is named."""
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))


def between(scenes: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Scenes with a time in the closed interval; a bare end date ends at its midnight."""
    out = scenes.filter(F.col("datetime").isNotNull())
    if start:
        out = out.filter(F.col("datetime") >= F.to_timestamp(F.lit(start)))
    return out.filter(F.col("datetime") <= F.to_timestamp(F.lit(end))) if end else out


def phase(days: Column) -> Column:
    """The phase of a day relative to ignition."""
    named = F.when(days < 0, "pre-fire").when(days <= 30, "post-fire").when(days <= 120, "early-recovery").when(days <= 270, "mid-recovery")
    return named.when(days <= 365, "late-recovery").otherwise("other")


def size_mb(assets: Column) -> Column:
    """Megabytes of all assets that name a size; NULL if none does."""
    sizes = F.array_compact(F.transform(F.map_values(assets), lambda a: a["size"]))
    return F.when(F.size(sizes) > 0, F.aggregate(sizes, F.lit(0).cast("long"), lambda s, x: s + x) / 1024.0 / 1024.0)


def with_phases(items: DataFrame, scenes: DataFrame) -> DataFrame:
    """Items of a catalog with what is known of their scenes, without those of phase other, in order of time."""
    known = scenes.select("scene_id", "phase", "fire_complex", "days_relative_to_ignition")
    return items.join(known, "scene_id", "left").filter(F.coalesce("phase", F.lit("")) != "other").orderBy("datetime")
