import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lumenweave.functions import bands as B
from lumenweave.operators.grid import Grid
from lumenweave.operators.unmix import Constraints
from lumenweave.plans import workflows

BANDS = B.even(400, 2450, 83, 25.0)
W = np.array(BANDS.wavelengths)
PV = np.where(W < 700, 0.05, np.where(W < 1300, 0.5, 0.2))
CHAR = 0.05 + 0.15 * (W - 400) / 2050
SOIL = 0.15 + 0.2 * (W - 400) / 2050


def scene(spark, height=12, width=12, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for r in range(height):
        for c in range(width):
            base = (PV, CHAR, SOIL)[r * 3 // height]
            rows.append((r, c, (base * rng.uniform(0.9, 1.0)).tolist(), 1 if (r, c) == (0, 0) else 0))
    return spark.createDataFrame(rows, "row int, col int, spectrum array<double>, cloud int")


def lib(spark):
    return spark.createDataFrame([(f"{c}_0", c, c, "t", s.tolist()) for c, s in (("pv", PV), ("char", CHAR), ("soil", SOIL))], "spectrum_id string, name string, category string, source string, spectrum array<double>")


def test_products(spark):
    out = {(r.row, r.col): r for r in workflows.scene_products(scene(spark), BANDS).collect()}
    assert len(out) == 144 and out[0, 0].nbr is None and out[0, 1].nbr > 0.3 and out[6, 6].nbr < 0 and out[0, 1].cr_depths is not None


def test_own_library(spark):
    out = {(r.row, r.col): r for r in workflows.fractions_by_scene_library(scene(spark), BANDS, 8, 20, Constraints(max_rmse=0.1)).collect()}
    assert out[1, 1].pv > 0.8 and out[6, 6].char > 0.8


def test_severity_with_truth(spark):
    rng = np.random.default_rng(1)
    rows = [(i, 0, float(m + rng.normal(0, 0.02)), c) for c, m in enumerate((0.3, 0.0, -0.3)) for i in range(c * 60, c * 60 + 60)]
    df = spark.createDataFrame(rows, "row int, col int, nbr double, code int")
    classed, scores = workflows.severity_with_truth(df, df)
    assert scores.first().kappa > 0.95 and classed.count() == 180


def test_sensors(spark):
    got = {(r.sensor, r.demand): r for r in workflows.sensor_demands(scene(spark), BANDS).collect()}
    assert len(got) == 9 and got["EMIT", "nbr"].r2 > 0.95


def test_cross_validation(spark):
    fine, coarse = Grid(0, 120, 10, 12, 12, "EPSG:32611"), Grid(0, 120, 30, 4, 4, "EPSG:32611")
    reference = scene(spark)
    truth = spark.createDataFrame([(r, c, 1.0 if 4 <= r * 3 + 1 < 8 else 0.0) for r in range(4) for c in range(4)], "row int, col int, char double")
    out = workflows.cross_validate(reference, BANDS, fine, truth, coarse, lib(spark), BANDS, Constraints(max_rmse=0.1)).first()
    assert out.n_valid == 16 and out.rmse < 0.5
    with pytest.raises(PySparkException, match="fewer than 99"):
        workflows.cross_validate(reference, BANDS, fine, truth, coarse, lib(spark), BANDS, least=99).collect()


def test_series(spark):
    g = Grid(0, 120, 10, 12, 12, "EPSG:32611")
    later = scene(spark, seed=1).withColumn("row", 11 - F.col("row"))
    out = workflows.date_series({"2025-01-01": (scene(spark), g), "2025-02-01": (later, g)}, lib(spark), constraints=Constraints(max_rmse=0.1)).collect()
    assert len(out) == 2 and all(r.n == 144 for r in out)
