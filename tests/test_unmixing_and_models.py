import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lumenweave.functions import bands as B
from lumenweave.operators import library, moisture, severity, unmix
from lumenweave.operators.grid import Grid

W = np.linspace(400, 2400, 30)
PURE = {"char": np.full(30, 0.05), "npv": 0.2 + 0.2 * (W - 400) / 2000, "pv": np.where(W < 700, 0.05, 0.45), "soil": 0.15 + 0.3 * np.sqrt((W - 400) / 2000)}


def lib_frame(spark, extra=()):
    rows = [(f"{c}_0", c, c, "test", s.tolist()) for c, s in PURE.items()] + list(extra)
    return spark.createDataFrame(rows, "spectrum_id string, name string, category string, source string, spectrum array<double>")


def scene(spark, spectra):
    return spark.createDataFrame([(i, 0, None if s is None else [float(v) for v in s]) for i, s in enumerate(spectra)], "row int, col int, spectrum array<double>")


SHADE = ("shade_0", "shade", "shade", "test", [0.0] * 30)


@pytest.mark.parametrize("engine", ["mesma", "nnls"])
def test_pure_and_broken_pixels(spark, engine):
    df = scene(spark, [*PURE.values(), None, [float("nan")] * 30])
    out = {r.row: r for r in unmix.unmix(df, lib_frame(spark, [SHADE]), engine).collect()}
    for i, c in enumerate(PURE):
        assert out[i][c] > 0.8 and out[i].rmse < 0.02
        assert sum(out[i][k] for k in ("char", "pv", "npv", "soil", "shade")) == pytest.approx(1, abs=0.05)
    assert out[4].pv is None and out[5].rmse is None


def test_mixture_and_limits(spark):
    mixed = 0.6 * PURE["pv"] + 0.3 * PURE["soil"]
    out = unmix.unmix(scene(spark, [mixed]), lib_frame(spark), "mesma").first()
    assert (out.pv, out.soil, out.shade) == pytest.approx((0.6, 0.3, 0.1), abs=1e-6)
    noise = np.random.default_rng(7).uniform(0.05, 0.95, (3, 30))
    for engine in ("mesma", "nnls"):
        none = unmix.unmix(scene(spark, noise), lib_frame(spark), engine, unmix.Constraints(max_rmse=1e-6)).collect()
        assert all(r.pv is None and r.rmse is None for r in none)
    with pytest.raises(ValueError):
        unmix.unmix(scene(spark, [mixed]), lib_frame(spark), "other")
    with pytest.raises(ValueError):
        unmix.models_of(["a"] * 300 + ["b"] * 300, (3,))


@pytest.mark.parametrize("seed", range(5))
def test_nnls_meets_its_conditions(seed):
    rng = np.random.default_rng(seed)
    a, y = rng.uniform(0, 1, (20, 6)), rng.uniform(-0.2, 1, (200, 20))
    a[:, 5] = 0 if seed == 0 else a[:, 5]
    x = unmix.nnls_block(y, a)
    gradient = (y - x @ a.T) @ a
    assert (x >= 0).all() and (gradient <= 1e-7).all() and np.abs(gradient * x).max() < 1e-7


def test_closed_form_subsets_agree_with_nnls():
    rng = np.random.default_rng(9)
    a, y = rng.uniform(0, 1, (12, 4)), rng.uniform(0, 1, (50, 12))
    best = np.full(50, np.inf)
    for mask in range(16):
        on = [i for i in range(4) if mask >> i & 1]
        s = np.linalg.lstsq(a[:, on], y.T, rcond=None)[0] if on else np.zeros((0, 50))
        err = ((y.T - a[:, on] @ s) ** 2).sum(0)
        best = np.where((s >= 0).all(0), np.minimum(best, err), best)
    got = ((y - unmix.nnls_block(y, a) @ a.T) ** 2).sum(1)
    assert np.allclose(got, best)


def test_library_tools(spark):
    lib = lib_frame(spark, [("char_0", "again", "char", "b", [1.5] * 30), ("char_0", "third", "char", "c", [-0.5] * 30)])
    merged = library.merge(lib)
    assert {r.spectrum_id for r in merged.collect() if r.category == "char"} == {"char_0", "char_0_dup1", "char_0_dup2"}
    assert merged.select(F.max(F.array_max("spectrum")), F.min(F.array_min("spectrum"))).first()[:] == (1.0, 0.0)
    top = library.most_varied(lib, 1).collect()
    assert [r.category for r in top] == ["char", "npv", "pv", "soil"]
    with pytest.raises(ValueError):
        library.same_bands(B.Bands((1.0, 2.0)), B.Bands((1.0, 3.0)))
    library.same_bands(B.Bands((1.0, 2.0)), B.Bands((1.0, 2.0005)))
    with pytest.raises(ValueError):
        library.pick_bands(lib, 30, 0)
    found = library.pick_bands(lib, 30, 10)
    assert len(found) == 10 and all(i // 3 == k for k, i in enumerate(found))
    assert library.prune(lib, -1, -1).count() == lib.count()


def test_words_in_order(spark):
    df = spark.createDataFrame([("s07ASD_Dry_Grass",), ("Pinus CHAR",), ("quartz",), (None,)], "n string")
    got = [r.c for r in df.select(library.category_of(F.col("n"), library.MINERAL_FILE_WORDS).alias("c")).collect()]
    assert got == ["pv", "char", "other", "other"]


def test_purest_pixels_are_the_corners(spark):
    rng = np.random.default_rng(0)
    inner = rng.dirichlet(np.ones(3) * 5, 60)
    df = scene(spark, np.vstack([np.eye(3), inner]))
    got = library.purest_pixels(df, 3, 200, 5)
    assert {r.row for r in got.collect()} == {0, 1, 2}
    assert [r.hits for r in got.collect()] == [r.hits for r in library.purest_pixels(df.repartition(3), 3, 200, 5).collect()]


def test_build_adds_shade(spark):
    axis = B.Bands(tuple(W))
    out = library.build(B.even(400, 2400, 11), [(lib_frame(spark), axis)]).collect()
    assert {r.category for r in out} == {*PURE, "shade"} and all(len(r.spectrum) == 11 for r in out)
    with pytest.raises(ValueError):
        library.build(axis, [])


def test_calibration(spark):
    rng = np.random.default_rng(7)
    rows = [(c, float(m + d)) for c, m in ((0, 0.05), (1, -0.2), (2, -0.4)) for d in rng.normal(0, 0.01, 60)] + [(3, -0.9)] * 5 + [(-1, 0.0)] * 90
    df = spark.createDataFrame(rows, "code int, nbr double")
    got = {r.code: r for r in severity.calibrate(df).collect()}
    assert got.keys() == {0, 1, 2} and got[0].threshold == pytest.approx(-0.075, abs=0.01) and got[1].threshold == pytest.approx(-0.3, abs=0.01) and got[2].threshold is None
    with pytest.raises(PySparkException, match="do not fall"):
        severity.calibrate(df.withColumn("nbr", -F.col("nbr"))).collect()
    with pytest.raises(PySparkException, match="two classes"):
        severity.calibrate(df.filter("code = 0")).collect()


def test_classes(spark):
    df = spark.createDataFrame([(0.09,), (0.1,), (0.27,), (0.66,), (None,)], "v double")
    assert [r.c for r in df.select(severity.dnbr_classes(F.col("v")).alias("c")).collect()] == [0, 1, 2, 4, None]
    got = [r.c for r in df.select(severity.classify_nbr(F.col("v"), [5, 6, 7], [0.27, 0.1]).alias("c")).collect()]
    assert got == [7, 6, 5, 5, None]
    for bad in (([1], [0.1]), ([1, 2, 3], [0.1, 0.2])):
        with pytest.raises(ValueError):
            severity.classify_nbr(F.col("v"), *bad)


def test_forests(spark):
    rng = np.random.default_rng(3)
    f = rng.dirichlet(np.ones(4), 240)
    rows = [(i, *map(float, x), float(3 * x[0]), int(x[0] > 0.3)) for i, x in enumerate(f)]
    df = spark.createDataFrame(rows, "ord int, char double, pv double, npv double, soil double, cbi_t double, cls int")
    reg = severity.train_regressor(df, "cbi_t", ["ord"], trees=20, folds=3)
    assert reg.scores["r2"] > 0.8 and reg.n_samples == 240
    holed = df.withColumn("pv", F.when(F.col("ord") > 0, F.col("pv")))
    out = {r.ord: r for r in severity.predict(holed, reg).collect()}
    assert out[0].cbi is None and out[0].severity is None and all(0 <= out[i].cbi <= 3 for i in range(1, 240))
    cls = severity.train_classifier(df, "cls", trees=20, folds=3)
    assert cls.scores["kappa"] > 0.7 and {r.severity for r in severity.predict(df, cls).collect()} == {0, 1}


def test_trajectories(spark):
    g = Grid(0, 60, 30, 2, 2, "EPSG:32611")
    shifted = Grid(0, 60, 30, 2, 3, "EPSG:32611")
    four = spark.createDataFrame([(r, c, PURE["pv"].tolist()) for r in range(2) for c in range(2)], "row int, col int, spectrum array<double>")
    out = severity.trajectories({"2025-01-01": (four, g), "run two": (four, shifted)}, lib_frame(spark), engine="mesma", levels=(2,)).collect()
    assert len(out) == 8 and {r.ts is None for r in out if r.key == "run two"} == {True} and all(r.pv > 0.99 for r in out)
    with pytest.raises(ValueError):
        severity.trajectories({}, lib_frame(spark))
    with pytest.raises(ValueError):
        severity.trajectories({"a": (four, g), "b": (four, shifted)}, lib_frame(spark), aligned=False)


def nipals(x, y, k):
    """Textbook PLS1 on centred, scaled columns."""
    mx, sx, my, sy = x.mean(0), x.std(0, ddof=1), y.mean(), y.std(ddof=1)
    e, f = (x - mx) / sx, (y - my) / sy
    ws, ps, qs, ts = [], [], [], []
    for _ in range(k):
        w = e.T @ f
        w /= np.linalg.norm(w)
        t = e @ w
        p, q = e.T @ t / (t @ t), f @ t / (t @ t)
        e, f = e - np.outer(t, p), f - q * t
        ws.append(w), ps.append(p), qs.append(q), ts.append(t)
    w, p, q = np.array(ws).T, np.array(ps).T, np.array(qs)
    beta = w @ np.linalg.solve(p.T @ w, q) * sy / sx
    gain = np.array([(t @ t) * b * b for t, b in zip(ts, q)])
    vip = np.sqrt(x.shape[1] * (w**2 @ gain) / gain.sum())
    return beta, my - mx @ beta, vip


def test_pls_from_moments_equals_the_textbook(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 12))
    y = x[:, 3] * 2 - x[:, 7] + rng.normal(0, 0.1, 80) + 100
    df = spark.createDataFrame([(i, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y))], "ord int, spectrum array<double>, lfmc double")
    whole = moisture.moments(df, "spectrum", "lfmc", F.lit(0))[0]
    for k in (1, 3, 6):
        fit = moisture.fit_pls(whole, k)
        beta, intercept, vip = nipals(x, y, k)
        assert np.allclose(fit.coef, beta) and fit.intercept == pytest.approx(intercept) and np.allclose(fit.vip, vip)
        assert moisture.squared_error(whole, fit) == pytest.approx(((y - x @ beta - intercept) ** 2).sum(), rel=1e-6)
    best = moisture.train_pls(df, "spectrum", "lfmc", F.col("ord") % 5)
    assert best.r2 > 0.95 and set(np.argsort(best.vip)[-2:]) == {3, 7}
    out = moisture.predict_lfmc(df.union(spark.createDataFrame([(99, None, None), (98, [1e6] * 12, None)], df.schema)), best).collect()
    by = {r.ord: r for r in out}
    assert by[99].lfmc is None and by[99].low_lfmc is False and by[98].lfmc in (0.0, 300.0) and by[0].lfmc_uncertainty == pytest.approx(best.rmse)
    with pytest.raises(PySparkException, match="needs 12 bands"):
        moisture.predict_lfmc(spark.createDataFrame([([1.0],)], "spectrum array<double>"), best).collect()


def test_site_filters(spark):
    rows = [(34.0, -118.0, "2025-01-10", 80.0, "Chamise"), (34.0, -118.0, "2025-06-01", 80.0, "Pine"), (40.0, -118.0, "2025-01-10", 80.0, "Chamise"), (34.0, -118.0, "2025-01-10", 900.0, "Chamise"), (None, 1.0, "2025-01-10", 1.0, "x")]
    df = spark.createDataFrame(rows, "latitude double, longitude double, date string, lfmc_percent double, species string").withColumn("date", F.to_timestamp("date"))
    got = moisture.filter_sites(df, (-119, 33, -117, 35), (0, 300), ["chamise", "pine"], ["2025-01-20"]).collect()
    assert [(r.species, r.colocated) for r in got] == [("Chamise", True), ("Pine", False)]
