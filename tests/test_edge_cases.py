"""Edge cases of agreement, overlaps and trajectories."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenweave.operators import accuracy, grid


def pairs(spark, rows):
    return spark.createDataFrame(rows, "p double, o double")


def test_constant_observations(spark):
    r2 = lambda rows: accuracy.continuous(pairs(spark, rows), "p", "o").first().r2
    assert (r2([(2.0, 2.0), (2.0, 2.0)]), r2([(1.0, 2.0), (2.0, 2.0)]), r2([(1.0, 2.0)])) == (1.0, 0.0, None)


def test_no_valid_pair_is_an_error(spark):
    none = pairs(spark, [(None, 1.0), (1.0, None), (float("nan"), 1.0)])
    for f in (lambda: accuracy.continuous(none, "p", "o"), lambda: accuracy.classified(none.select(F.col("p").cast("int").alias("p"), F.lit(-1).alias("o")).filter("p is null"), "p", "o")):
        with pytest.raises(Exception, match="no valid pairs"):
            f().collect()
    assert accuracy.continuous(none, "p", "o", ["o"]).collect() == []
    raster = spark.createDataFrame([(0, 0, 1.0)], "row int, col int, v double")
    far = spark.createDataFrame([(1, 999.0, 999.0)], "ordinal int, x double, y double")
    scores, _, _ = accuracy.check_structures(far, raster, grid.Grid(0, 10, 10, 1, 1, "EPSG:32611"), "v")
    with pytest.raises(Exception, match="no point falls"):
        scores.collect()


def test_overlaps_of_scenes_of_all_sizes(spark):
    rng = np.random.default_rng(5)
    side = 2.0 ** rng.uniform(-3, 9, 60)
    x, y = rng.uniform(-500, 500, (2, 60))
    boxes = [(f"s{i:02d}", float(x[i]), float(y[i]), float(x[i] + side[i]), float(y[i] + side[i] / 2)) for i in range(60)]
    boxes.append(("all", -2000.0, -2000.0, 2000.0, 2000.0))
    df = spark.createDataFrame(boxes, "scene_id string, xmin double, ymin double, xmax double, ymax double")
    got = {(r.a, r.b): r.overlap for r in grid.overlap_matrix(df).collect()}
    want = {}
    for a in boxes:
        for b in boxes:
            w, h = min(a[3], b[3]) - max(a[1], b[1]), min(a[4], b[4]) - max(a[2], b[2])
            if a[0] < b[0] and w > 0 and h > 0:
                want[a[0], b[0]] = w * h / min((s[3] - s[1]) * (s[4] - s[2]) for s in (a, b))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
