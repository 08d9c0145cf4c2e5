import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenweave.functions import bands as B
from lumenweave.functions.missing import array_to_null, clip, normalized_difference, to_null
from lumenweave.functions.projection import from_utm, to_utm
from lumenweave.operators import display, hull, indices, masks

FULL = B.even(380, 2500, 426)


def pixels(spark, spectra, more=()):
    rows = [(i // 4, i % 4, None if s is None else [None if v is None else float(v) for v in s], *(m[i] for m in more)) for i, s in enumerate(spectra)]
    return spark.createDataFrame(rows, "row int, col int, spectrum array<double>" + "".join(f", m{k} int" for k in range(len(more))))


def one(df, column):
    return df.select(column.alias("v")).first().v


def test_missing_values(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, float("inf")), (3, -9999.0), (4, None), (5, 0.5)], "i int, v double")
    got = {r.i: r.n for r in df.select("i", to_null(F.col("v"), -9999.0).alias("n")).collect()}
    assert got == {1: None, 2: None, 3: None, 4: None, 5: 0.5}
    got = {r.i: r.c for r in df.filter("i > 2").select("i", clip(F.col("v")).alias("c")).collect()}
    assert got == {3: 0.0, 4: None, 5: 0.5}
    with pytest.raises(ValueError):
        clip(F.col("v"), 1, 0)


def test_normalized_difference_near_zero(spark):
    df = spark.createDataFrame([(0.7, 0.3), (0.0004, 0.0005), (0.0005, 0.0005), (0.5, -0.5)], "a double, b double")
    got = [r.v for r in df.select(normalized_difference(F.col("a"), F.col("b")).alias("v")).collect()]
    assert got[0] == pytest.approx(0.4) and got[1] is None and got[2] == pytest.approx(0.0) and got[3] is None


def test_band_selection():
    b = B.Bands((400.0, 500.0, 600.0, 700.0))
    assert b.nearest(550) == 2 and b.nearest(550, "first") == 1 and b.nearest(0) == 0
    assert b.within(500, 600) == [1, 2]
    for bad in ((None, 500), (500, None), (701, 900)):
        with pytest.raises(ValueError):
            b.within(*bad)
    assert b.usable([(450, 550)]) == [0, 2, 3] and b.usable([], (True, False, True, True)) == [0, 2, 3]
    with pytest.raises(ValueError):
        b.usable([], (True,))
    with pytest.raises(ValueError):
        B.Bands((1.0, 2.0), fwhm=(1.0,))
    assert len(FULL.usable()) == 324
    assert [len(B.sensor(n)) for n in ("EMIT", "PRISMA", "SENTINEL2")] == [285, 239, 10]
    with pytest.raises(KeyError):
        B.sensor("?")


def test_select_and_mask_bands(spark):
    b = B.Bands((400.0, 500.0, 600.0, 700.0))
    df = pixels(spark, [[1, 2, 3, 4]])
    s, kept = indices.select_bands(F.col("spectrum"), b, wavelengths=(690, 410, 690))
    assert one(df, s) == [4, 1, 4] and kept.wavelengths == (700, 400, 700)
    s, _ = indices.select_bands(F.col("spectrum"), b, 450, 650)
    assert one(df, s) == [2, 3]
    with pytest.raises(ValueError):
        indices.select_bands(F.col("spectrum"), b)
    s, kept = indices.mask_bad_bands(F.col("spectrum"), b, [(500, 600)])
    assert one(df, s) == [1, 4] and len(kept) == 2


def test_nearest_on_axis():
    axis = [0.0, 10.0, 20.0]
    assert [B.nearest_on_axis(axis, v) for v in (-5, -5.1, 5, 5.1, 25, 25.1)] == [0, None, 0, 1, 2, None]
    assert [B.nearest_on_axis(axis[::-1], v) for v in (5, 15, 20)] == [2, 1, 0]


def test_indices_on_known_bands(spark):
    spectrum = np.zeros(426)
    for w, v in ((860, 0.7), (2200, 0.3), (660, 0.1), (560, 0.3)):
        spectrum[FULL.nearest(w)] = v
    df = pixels(spark, [spectrum, None])
    s = F.col("spectrum")
    rows = df.select(indices.nbr(s, FULL).alias("nbr"), indices.ndvi(s, FULL).alias("ndvi"), indices.ndwi(s, FULL).alias("ndwi")).collect()
    assert (rows[0].nbr, rows[0].ndvi, rows[0].ndwi) == pytest.approx((0.4, 0.75, -0.4))
    assert tuple(rows[1]) == (None, None, None)


def test_out_of_range_values_are_clamped_first(spark):
    spectrum = np.full(426, -0.5)
    spectrum[FULL.nearest(860)] = 1.7
    assert one(pixels(spark, [spectrum]), indices.nbr(F.col("spectrum"), FULL)) == 1.0


def test_absorption_depth(spark):
    w = np.array(FULL.wavelengths)
    spectrum = 0.45 * (1 - 0.4 * np.exp(-0.5 * ((w - 970) / 20) ** 2))
    df = pixels(spark, [spectrum, np.full(426, 0.45)])
    got = [r.v for r in df.select(indices.sai(F.col("spectrum"), FULL, 970, 850, 1100).alias("v")).collect()]
    assert got[0] == pytest.approx(0.4, abs=0.01) and got[1] == pytest.approx(0, abs=1e-9)
    assert one(df, indices.sai(F.col("spectrum"), FULL, 970, 1100, 850)) is None
    stack = indices.water_indices(F.col("spectrum"), FULL)
    assert list(stack) == ["SAI970", "SAI1200", "NDWI_1240", "NDWI_1640", "NDWI_2130", "WI"]
    with pytest.raises(ValueError):
        indices.water_indices(F.col("spectrum"), B.even(900, 2500, 10))


def brute_hull(x, y):
    return np.array([max(y[j] if j == k else y[j] + (y[k] - y[j]) * (x[i] - x[j]) / (x[k] - x[j]) for j in range(i + 1) for k in range(i, len(x))) for i in range(len(x))])


def test_continuum_against_chords(spark):
    rng = np.random.default_rng(7)
    x = np.linspace(400, 2400, 24)
    y = rng.uniform(0.1, 0.9, (60, 24))
    y[0], y[1, 5:15] = 0.5, 0.0
    want = np.array([np.minimum(r / brute_hull(x, r), 1) for r in y])
    assert np.allclose(hull.remove_continuum(x, y), want, atol=1e-12)
    df = pixels(spark, [*y, None, [None, *y[0][1:]]])
    out, kept = hull.continuum_removal(df, B.Bands(tuple(x)))
    got = {(r.row, r.col): r.cr for r in out.collect()}
    for i, r in enumerate(want):
        assert np.allclose(got[i // 4, i % 4], r)
    assert got[15, 0] is None and all(v is None for v in got[15, 1])
    assert want[2][0] == want[2][-1] == 1 and np.allclose(want[0], 1)


def test_hull_edge_cases():
    assert np.array_equal(hull.remove_continuum(np.array([1.0, 2.0]), np.array([[0.2, 0.4]])), [[1, 1]])
    assert np.isnan(hull.remove_continuum(np.arange(4.0), np.zeros((1, 4)))).all()


def test_depths_map(spark):
    w = np.array(FULL.wavelengths)
    spectrum = 0.5 - 0.2 * np.exp(-0.5 * ((w - 1200) / 40) ** 2)
    (r,) = hull.depths(pixels(spark, [spectrum]), FULL).collect()
    assert r.cr_depths[1200.0] == pytest.approx(0.4, abs=0.01) and r.cr_depths[2100.0] == pytest.approx(0, abs=1e-6)


def test_resampling_weights(spark):
    source = B.even(400, 1000, 121, 5.0)
    w = indices.response_weights(source, [500.0, 700.0, 5000.0], [20.0, 40.0, 10.0])
    assert sum(w[0]) == pytest.approx(1) == pytest.approx(sum(w[1])) and not any(w[2])
    df = pixels(spark, [np.full(121, 0.3), [None] * 121])
    got = [r.v for r in df.select(indices.resample(F.col("spectrum"), w).alias("v")).collect()]
    assert got[0][:2] == pytest.approx([0.3, 0.3]) and got[0][2] is None and got[1] == [0, 0, None]
    assert one(df, indices.resample(F.col("spectrum"), w, clipped=True))[2] == 0.0


def test_masks(spark):
    b = B.Bands((560.0, 860.0))
    nan = float("nan")
    df = pixels(spark, [[0.1, 0.4], [0.5, 0.1], [nan, 0.4], None, [0.75, 0.25]], [(0, 1, 0, 0, None), (0, 0, None, 1, None)])
    s = F.col("spectrum")
    got = df.select(masks.nodata_mask(s).alias("n"), masks.cloud_mask(F.col("m0"), F.col("m1")).alias("c"), masks.water_mask(F.transform(s, lambda v: to_null(v)), b, 0.5).alias("w")).collect()
    assert [r.n for r in got] == [True, True, False, None, True]
    assert [r.c for r in got] == [True, False, True, False, True]
    assert [r.w for r in got] == [True, False, False, False, True]
    held = masks.apply_masks(df, [masks.nodata_mask(s), masks.cloud_mask(F.col("m0"))]).collect()
    assert [r.spectrum is not None for r in held] == [True, False, False, False, True] and len(held) == 5
    assert masks.apply_masks(df, [masks.nodata_mask(s)], drop_rows=True).count() == 3
    with pytest.raises(ValueError):
        masks.apply_masks(df, [])
    assert one(df, masks.nodata_mask(array_to_null(s))) is True


def test_row_filters(spark):
    df = spark.createDataFrame([("Chamise SHRUB", "2025-01-10"), ("oak", "2025-03-01"), (None, None)], "name string, day string").withColumn("t", F.to_timestamp("day"))
    assert [r.v for r in df.select(masks.contains_any(F.col("name"), ["shrub", "pine"]).alias("v")).collect()] == [True, False, False]
    assert [r.v for r in df.select(masks.near_any_date(F.col("t"), ["2025-01-20", "2020-01-01"], 10).alias("v")).collect()] == [True, False, False]
    assert [r.v for r in df.select(masks.near_any_date(F.col("t"), []).alias("v")).collect()] == [False] * 3


def test_crop(spark):
    df = spark.range(400).select(F.expr("cast(id div 20 as int)").alias("row"), F.expr("cast(id % 20 as int)").alias("col"))
    got = masks.crop(df, 4).collect()
    assert {(r.row, r.col) for r in got} == {(r, c) for r in range(8, 12) for c in range(8, 12)}
    about = masks.crop(df, 2, df.filter("row = 3 and col in (5, 6, 7)")).collect()
    assert {(r.row, r.col) for r in about} == {(2, 5), (2, 6), (3, 5), (3, 6)}


def test_fractions(spark):
    rows = [(0.2, 0.2, 0.1, 0.1, 0.4, 0.01), (0.0, 0.0, 0.0, 0.0, 1.0, 0.01), (-0.04, 0.5, 0.2, 0.2, 0.14, 0.01), (0.3, 0.3, 0.2, 0.2, 0.0, 0.03), (None,) * 6]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, char double, pv double, npv double, soil double, shade double, rmse double")
    got = {r.i: r for r in indices.normalize_fractions(df).collect()}
    assert (got[0].char, got[0].soil) == pytest.approx((1 / 3, 1 / 6)) and "shade" not in got[0]
    assert got[1].char is None and got[2].char == 0 and got[2].char + got[2].pv + got[2].npv + got[2].soil == pytest.approx(1)
    assert indices.normalize_fractions(df, remove_shade=False).columns == df.columns
    with pytest.raises(ValueError):
        indices.normalize_fractions(df.drop("pv"))
    kept = {r.i: r.rmse for r in indices.post_constraints(df).collect()}
    assert kept == {0: 0.01, 1: 0.01, 2: 0.01, 3: None, 4: None}
    m = spark.createDataFrame([({"pv": 0.5, "ash": 0.1},), (None,)], "m map<string,double>").select(*indices.assemble_fractions(F.col("m"), ["ash"])).collect()
    assert tuple(m[0]) == (0, 0.5, 0, 0, 0, 0.1) and tuple(m[1]) == (None,) * 6


def test_projection_round_trip(spark):
    df = spark.createDataFrame([(-118.5, 34.0), (-117.0, 0.0), (-114.2, 60.5)], "lon double, lat double")
    x, y = to_utm(F.col("lon"), F.col("lat"), 32611)
    lon, lat = from_utm(F.col("x"), F.col("y"), 32611)
    back = df.withColumns({"x": x, "y": y}).withColumns({"lon2": lon, "lat2": lat}).collect()
    for r in back:
        assert (r.lon2, r.lat2) == pytest.approx((r.lon, r.lat), abs=1e-7)
    assert back[1].x == pytest.approx(500000) and back[1].y == pytest.approx(0, abs=1e-6)
    assert (back[0].x, back[0].y) == pytest.approx((361472, 3763170), abs=2)
    with pytest.raises(ValueError):
        to_utm(F.col("lon"), F.col("lat"), 4326)


def test_display(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (0.0, 2.0), (0.0, 0.0)]
    df = spark.createDataFrame([("a", ring)], "name string, ring array<struct<x:double,y:double>>")
    r = display.perimeter_labels(df).first()
    assert (r.x, r.y) == pytest.approx((2, 1))
    assert display.STYLES["dnbr"].class_ticks == (0.10, 0.27, 0.44, 0.66) and len(display.STYLES) == 11
    assert display.scalebar(0, 100, 0, 50, 10) == {"x0": 5, "x1": 15, "y": 2.5, "height": 0.5}
    assert math.isclose(display.STYLES["cbi"].vmax, 3)
