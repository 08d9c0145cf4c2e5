"""Exact percentiles against NumPy, and the products that rest on them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenweave.functions import bands as B
from lumenweave.functions import quantiles as Q
from lumenweave.operators import grid, library


def frame(spark, rows):
    return spark.createDataFrame(rows, "g int, h string, v double, w float")


@pytest.mark.parametrize("bins, few", [(1, 0), (7, 0), (7, 100), (Q.BINS, Q.FEW)])
def test_against_numpy(spark, monkeypatch, bins, few):
    monkeypatch.setattr(Q, "BINS", bins)
    monkeypatch.setattr(Q, "FEW", few)
    rng = np.random.default_rng(bins)
    groups = {(1, "a"): rng.normal(0, 1, 301), (1, None): rng.integers(0, 3, 50).astype(float), (None, "b"): np.array([5.0]), (2, "a"): np.array([1e300, -1e300, 0.0, 1.0]), (3, "c"): np.array([np.inf, 1.0, 2.0, 3.0, 4.0])}
    rows = [(*k, float(x), float(np.float32(x * 0 if abs(x) > 1e30 else x))) for k, xs in groups.items() for x in xs] + [(1, "a", None, None), (1, "a", float("nan"), None), (9, "z", None, None)]
    shares = (0.0, 0.02, 0.25, 0.5, 0.98, 1.0)
    got = {(r.g, r.h): r for r in Q.quantiles(frame(spark, rows), ["v", "w"], shares, ["g", "h"]).collect()}
    assert got.keys() == groups.keys()
    for k, xs in groups.items():
        finite = xs[np.isfinite(xs)]
        assert np.allclose(got[k].q_v[:-2], np.quantile(xs, shares[:-2], method="linear") if len(finite) == len(xs) else np.quantile(xs, shares[:-2]), rtol=1e-12, atol=1e-12)
        assert got[k].q_v[-1] == xs.max()
    whole = frame(spark, rows).filter("g = 1 and h = 'a'")
    want = whole.filter(~F.isnan("v")).agg(F.percentile("v", F.array(*[F.lit(q) for q in shares])).alias("q")).first().q
    assert Q.quantiles(whole, ["v"], shares).first().q_v == want


@pytest.mark.parametrize("bins, few", [(1, 0), (7, 100), (Q.BINS, Q.FEW)])
def test_by_stretches_against_numpy(spark, monkeypatch, bins, few):
    monkeypatch.setattr(Q, "ORDERED", -1)
    test_against_numpy(spark, monkeypatch, bins, few)


def test_groups_without_numbers_and_no_rows(spark):
    df = frame(spark, [(1, "a", None, 1.0), (None, "a", 2.0, 1.0)])
    groups = df.groupBy("g").count()
    got = {r.g: (r["count"], r.q_v) for r in Q.with_quantiles(groups, df, ["v"], [0.5], ["g"]).collect()}
    assert got == {1: (1, None), None: (1, [2.0])}
    empty = df.limit(0)
    assert Q.quantiles(empty, ["v"], [0.5]).collect() == []
    assert Q.with_quantiles(empty.agg(F.count("*").alias("n")), empty, ["v"], [0.5]).first().q_v is None


def test_no_plan_holds_all_values(spark):
    df = frame(spark, [(1, "a", 1.0, 1.0)])
    plan = Q.quantiles(df, ["v"], [0.5], ["g"])._jdf.queryExecution().toString()
    assert "percentile" not in plan and "median" not in plan


G = grid.Grid(300000, 4000000, 30, 8, 6, "EPSG:32611")
SHIFTED = grid.Grid(300060, 3999970, 30, 8, 6, "EPSG:32611")


def test_dnbr_of_scenes_on_different_grids(spark):
    bands = B.even(400, 2500, 22)
    nir, swir = bands.nearest(860), bands.nearest(2200)

    def scene(level):
        spectra = lambda r, c: [0.1 + 0.01 * (r * 8 + c) * level if i == nir else 0.2 if i == swir else 0.0 for i in range(22)]
        return spark.createDataFrame([(r, c, spectra(r, c)) for r in range(6) for c in range(8)], "row int, col int, spectrum array<double>")

    def nbr(level, r, c):
        a = 0.1 + 0.01 * (r * 8 + c) * level
        return (a - 0.2) / (a + 0.2)

    got = {(r.row, r.col): r.dnbr for r in grid.dnbr(scene(1), scene(0.5), bands, grids=(G, SHIFTED)).collect()}
    assert got.keys() == {(r, c) for r in range(5) for c in range(6)}
    assert all(abs(d - (nbr(1, r + 1, c + 2) - nbr(0.5, r, c))) < 1e-9 for (r, c), d in got.items())
    assert grid.dnbr(scene(1), scene(0.5), bands, grids=(G, G)).count() == 48
    with pytest.raises(ValueError, match="different grids"):
        grid.dnbr(scene(1), scene(0.5), bands, grids=(G, SHIFTED), auto_align=False)
    far = grid.Grid(900000, 4000000, 30, 8, 6, "EPSG:32611")
    with pytest.raises(ValueError, match="do not overlap"):
        grid.dnbr(scene(1), scene(0.5), bands, grids=(G, far))


def test_libraries_of_other_wavelengths_are_not_merged(spark):
    lib = spark.createDataFrame([("a", "a", [0.1, 2.0])], "spectrum_id string, name string, spectrum array<double>")
    two, other = B.even(400, 500, 2), B.even(400, 600, 2)
    assert sorted(r.spectrum_id for r in library.merge(lib, lib, bands=(two, two)).collect()) == ["a", "a_dup1"]
    with pytest.raises(ValueError, match="wavelengths"):
        library.merge(lib, lib, bands=(two, other))
