import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lumenweave.operators import accuracy, aggregates, grid
from lumenweave.operators.grid import Grid


def raster(spark, values, name="v"):
    h, w = values.shape
    return spark.createDataFrame([(r, c, None if np.isnan(values[r, c]) else float(values[r, c])) for r in range(h) for c in range(w)], f"row int, col int, {name} double")


def dense(df, h, w, name="v"):
    out = np.full((h, w), np.nan)
    for r in df.collect():
        out[r.row, r.col] = np.nan if r[name] is None else r[name]
    return out


A = Grid(300000, 4000000, 900, 5, 4, "EPSG:32611")
B2 = Grid(302000, 4005500, 900, 6, 5, "EPSG:32611")


def test_common_grid():
    with pytest.raises(ValueError, match="two grids"):
        grid.common_grid([A])
    with pytest.raises(ValueError, match="reference system"):
        grid.common_grid([A, Grid(0, 0, 1, 1, 1, "EPSG:32612")])
    with pytest.raises(ValueError, match="overlap"):
        grid.common_grid([A, Grid(900000, 4000000, 900, 5, 4, A.crs)])
    with pytest.raises(ValueError, match="only"):
        grid.common_grid([A, Grid(304400, 3996500, 900, 5, 4, A.crs)])
    g = grid.common_grid([A, Grid(302000, 4000500, 900, 6, 5, A.crs)], resolution=30)
    assert (g.west, g.north, g.width, g.height) == (302000, 4000000, 83, 120)
    assert grid.common_grid([A, B2], bounds=(0, 0, 75, 45), resolution=30).width == 2  # halves to even


def test_nearest_reprojection(spark):
    v = np.arange(20.0).reshape(4, 5)
    target = Grid(A.west + 900, A.north - 900, 450, 6, 4, A.crs)
    got = dense(grid.reproject(raster(spark, v), A, target, ["v"]), 4, 6)
    assert np.array_equal(got, np.kron(v[1:3, 1:4], np.ones((2, 2))))
    with pytest.raises(ValueError):
        grid.reproject(raster(spark, v), A, Grid(0, 0, 1, 1, 1, None), ["v"])


@pytest.mark.parametrize("method", ["bilinear", "cubic"])
def test_smooth_reprojection_keeps_planes(spark, method):
    r, c = np.mgrid[0:12, 0:12]
    src = Grid(0, 120, 10, 12, 12, "EPSG:32611")
    target = Grid(33, 86, 5, 8, 8, "EPSG:32611")
    got = dense(grid.reproject(raster(spark, 2.0 * r + 3.0 * c), src, target, ["v"], method), 8, 8)
    x, y = 33 + (np.arange(8) + 0.5) * 5, 86 - (np.arange(8) + 0.5) * 5
    want = 2 * ((120 - y) / 10 - 0.5)[:, None] + 3 * (x / 10 - 0.5)[None, :]
    assert np.allclose(got, want)
    with pytest.raises(ValueError):
        grid.reproject(raster(spark, r * 1.0), src, target, ["v"], "other")


def test_align_skips_what_is_aligned(spark):
    v = np.arange(20.0).reshape(4, 5)
    frames, g = grid.align({"a": (raster(spark, v), A), "b": (raster(spark, v + 1), A)}, ["v"], resolution=900)
    assert g == A and np.array_equal(dense(frames["b"], 4, 5) - dense(frames["a"], 4, 5), np.ones((4, 5)))


def test_sampling_ties_and_edges(spark):
    v = np.arange(100.0).reshape(10, 10)
    g = Grid(350000, 3760300, 30, 10, 10, "EPSG:32611")
    pts = [(0, 350015, 3760285), (1, 350030, 3760285), (2, 350015, 3760270), (3, 350000, 3760300), (4, 349999, 3760285), (5, 350300, 3760000), (6, 350301, 3760150)]
    df = spark.createDataFrame([(i, float(x), float(y)) for i, x, y in pts], "i int, x double, y double")
    got = {r.i: r.v for r in grid.sample_points(df, raster(spark, v), g, ["v"]).collect()}
    assert got == {0: 0, 1: 0, 2: 10, 3: 0, 4: None, 5: 99, 6: None}


def test_coarsening_trims_and_skips_missing(spark):
    v = np.arange(35.0).reshape(5, 7)
    v[0, 0] = np.nan
    got = dense(grid.coarsen(raster(spark, v), ["v"], 2, 3, 5, 7), 2, 2)
    assert np.allclose(got, [[np.nanmean(v[:2, :3]), v[:2, 3:6].mean()], [v[2:4, :3].mean(), v[2:4, 3:6].mean()]])
    assert [grid.coarsening_factor(s, 30) for s in (12, 20, 60, 30)] == [2, 2, 1, 1]


def test_overlap_matrix(spark):
    rng = np.random.default_rng(0)
    box = [(i, *lo, *(lo + rng.uniform(1, 30, 2))) for i, lo in enumerate(rng.uniform(0, 100, (40, 2)))]
    df = spark.createDataFrame([(i, *map(float, b)) for i, *b in box], "scene_id int, xmin double, ymin double, xmax double, ymax double")
    want = {}
    for i, a, b, c, d in box:
        for j, e, f, g, h in box:
            w, t = min(c, g) - max(a, e), min(d, h) - max(b, f)
            if i < j and w > 0 and t > 0:
                want[i, j] = w * t / min((c - a) * (d - b), (g - e) * (h - f))
    got = {(r.a, r.b): r.overlap for r in grid.overlap_matrix(df).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def ranks(v):
    return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])


def test_ranks_and_spearman(spark):
    rng = np.random.default_rng(1)
    v, w = rng.integers(0, 40, 500) / 4.0, rng.normal(size=500)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(v, w))] + [(500, None, 1.0)], "i int, a double, b double")
    got = {r.i: r["rank"] for r in accuracy.average_ranks(df, "a").collect()}
    assert np.allclose([got[i] for i in range(500)], ranks(v)) and got[500] is None
    assert accuracy.spearman(df, "a", "b").first()[0] == pytest.approx(np.corrcoef(ranks(v), ranks(w))[0, 1])
    assert accuracy.spearman(df.withColumn("a", F.lit(1.0)), "a", "b").first()[0] is None
    assert accuracy.spearman(df.limit(1), "a", "b").first()[0] is None


def test_ranks_by_ranges_equal_those_by_one_order(spark, monkeypatch):
    rng = np.random.default_rng(2)
    v, w = rng.integers(0, 9000, 12_000) / 4.0, rng.integers(0, 30, 12_000)
    df = spark.createDataFrame(pd.DataFrame({"a": v, "b": w.astype(float)}))
    at_once = accuracy.spearman(df, "a", "b").first()[0]
    monkeypatch.setattr(accuracy, "ORDERED", -1)
    assert accuracy.spearman(df, "a", "b").first()[0] == pytest.approx(at_once, abs=1e-12)
    assert at_once == pytest.approx(np.corrcoef(pd.Series(v).rank(), pd.Series(w).rank())[0, 1])


def test_ranks_over_many_blocks(spark):
    df = spark.range(10_000).select((F.col("id") * 7919 % 10_000).cast("double").alias("a"))
    assert accuracy.average_ranks(df, "a").filter("rank != a + 1").count() == 0


def test_continuous(spark):
    df = spark.createDataFrame([(1.0, 1.0, "x"), (2.0, 2.5, "x"), (3.0, 2.5, "y"), (None, 1.0, "y"), (float("nan"), 1.0, "y")], "p double, o double, g string")
    r = accuracy.continuous(df, "p", "o").first()
    assert (r.n_valid, r.mae, r.bias) == (3, pytest.approx(1 / 3), pytest.approx(0)) and r.r2 == pytest.approx(1 - 0.5 / 1.5)
    rolled = {x.g: x.n_valid for x in accuracy.continuous(df, "p", "o", ["g"], rollup=True).collect()}
    assert rolled == {"x": 2, "y": 1, None: 3}


def test_classified(spark):
    pairs = [(0, 0)] * 5 + [(0, 1)] * 2 + [(1, 1)] * 3 + [(2, 1)] + [(-1, 1), (1, -1), (None, 1)]
    df = spark.createDataFrame(pairs, "p int, o int")
    r = accuracy.classified(df, "p", "o").first()
    po, pe = 8 / 11, (7 * 5 + 3 * 6) / 121
    f1 = np.mean([2 * 5 / 12, 2 * 3 / 9, 0])
    assert (r.n_valid, r.accuracy, r.kappa, r.f1_macro) == (11, pytest.approx(po), pytest.approx((po - pe) / (1 - pe)), pytest.approx(f1))
    assert {(x.obs, x.pred): x.n for x in accuracy.confusion(df, "p", "o").collect()} == {(0, 0): 5, (1, 0): 2, (1, 1): 3, (1, 2): 1}


def test_structures(spark):
    g = Grid(0, 100, 10, 10, 10, "EPSG:32611")
    v = np.zeros((10, 10))
    v[0] = 0.5
    pts = [(0, 5.0, 95.0), (3, 15.0, 95.0), (4, 25.0, 55.0), (0, 35.0, 55.0), (2, 999.0, 0.0)]
    df = spark.createDataFrame([(o, x, y) for o, x, y in pts], "ordinal int, x double, y double")
    scores, stats, rho = accuracy.check_structures(df, raster(spark, v), g, "v")
    s = scores.first()
    assert (s.tp, s.fp, s.fn, s.tn, s.n_inside, s.n_outside) == (1, 1, 1, 1, 4, 1) and s.f1 == 0.5
    assert {r.ordinal: r.n for r in stats.collect()} == {0: 2, 3: 1, 4: 1} and rho.first()[0] is not None
    none = accuracy.detection(df.filter("false").withColumns({"p": F.lit(True), "a": F.lit(True)}), "p", "a").first()
    assert (none.accuracy, none.precision, none.recall, none.f1) == (0, 0, 0, 0)


def test_mean_spectra(spark):
    df = spark.createDataFrame([("a", [1.0, None]), ("a", [3.0, None]), ("b", [5.0, 6.0])], "k string, spectrum array<double>")
    got = {r.k: (r.n_pixels, r.spectrum) for r in aggregates.mean_spectra(df, "k").collect()}
    assert got == {"a": (2, [2.0, 0.0]), "b": (1, [5.0, 6.0])}
    with pytest.raises(RuntimeError):
        aggregates.mean_spectra(df, "k", least=2, least_groups=2)


def test_recovery(spark):
    df = spark.createDataFrame([("a", "2025-01-01", 0.2), ("a", "2025-01-11", 0.4), ("b", "2025-01-01", 0.5), ("b", "2025-02-01", 0.1), ("c", "2025-01-01", 1.0)], "k string, d string, v double").withColumn("d", F.to_date("d"))
    got = {r.k: (r.slope, r.days_to_baseline) for r in aggregates.recovery_slope(df, ["k"], "d", "v", F.lit(0.8)).collect()}
    assert got["a"] == pytest.approx((0.02, 20)) and got["b"][0] < 0 and got["b"][1] is None and got["c"] == (None, None)


def test_bounds_intersection(spark):
    df = spark.createDataFrame([(0.0, 0.0, 10.0, 10.0), (5.0, 5.0, 20.0, 20.0)], "xmin double, ymin double, xmax double, ymax double")
    assert tuple(aggregates.bounds_intersection(df).first()) == (5, 5, 10, 10)
    apart = df.union(spark.createDataFrame([(30.0, 0.0, 40.0, 9.0)], df.schema))
    assert tuple(aggregates.bounds_intersection(apart).first()) == (None,) * 4


def test_spatial_info_round_trip(spark):
    x, y = A.centres(F.col("row"), F.col("col"))
    info = grid.spatial_info(A.cells(spark.range(1)).withColumns({"x": x, "y": y})).first()
    assert grid.grid_from(info, A.crs) == A


def test_errors_reach_the_user(spark):
    from lumenweave.operators import severity

    with pytest.raises(PySparkException, match="no class for code 9"):
        severity.remap_codes(spark.createDataFrame([(9,)], "code int"), "code").collect()
