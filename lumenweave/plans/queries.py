"""The registered queries of the raster operators and their SQL (none where SQL cannot express the operator)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenweave.functions import arrays, projection
from lumenweave.functions.bands import MULTISPECTRAL, at, sensor
from lumenweave.functions.missing import array_to_null, normalized_difference
from lumenweave.operators import accuracy, aggregates, catalog, grid, hull, indices, library, masks, moisture, provenance, severity, unmix
from lumenweave.plans import sqlfunctions
from lumenweave.plans import views as v
from lumenweave.streaming import trajectory as live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def r6(c) -> F.Column:
    return F.round(c, 6)


def long(c) -> F.Column:
    return c.cast("long")




# --- band algebra


def _index_query(name, fn, sql):
    def run(spark, d):
        p = v.px(spark, d)
        return p.select("row", "col", r6(fn(F.col("spectrum"), v.BANDS)).alias("value"))

    run.__name__ = name
    query(f'WITH {v.PX} SELECT r AS "row", c AS "col", round({sql}, 6) AS value FROM px')(run)


_index_query("nbr", indices.nbr, v.NBR)
_index_query("ndvi", indices.ndvi, v.NDVI)
_index_query("ndwi", indices.ndwi, v.NDWI)


@query(f"WITH {v.BIG} SELECT l_orderkey, l_linenumber, round({v.nd('b2', 'b3')}, 6) AS nd FROM big")
def nd_guard_big(spark, d):
    return v.big(spark, d).select("l_orderkey", "l_linenumber", r6(normalized_difference(F.col("b2"), F.col("b3"))).alias("nd"))


def _shape(p: DataFrame, spectrum) -> DataFrame:
    s = p.withColumn("s", spectrum)
    return s.select("row", "col", long(F.size("s")).alias("n_bands"), r6(F.get("s", F.lit(0))).alias("s_first"), r6(F.element_at("s", -1)).alias("s_last"), r6(arrays.total(F.col("s"))).alias("s_sum"))


def _shape_sql(expr: str) -> str:
    return f'WITH {v.PX}, q AS (SELECT r, c, {expr} AS x FROM px) SELECT r AS "row", c AS "col", CAST(len(x) AS BIGINT) AS n_bands, round(x[1], 6) AS s_first, round(x[len(x)], 6) AS s_last, round(list_sum(x), 6) AS s_sum FROM q'


def _positions(found) -> str:
    return "[s[i] FOR i IN [" + ", ".join(str(i + 1) for i in found) + "]]"


@query(_shape_sql(_positions(v.BANDS.within(500, 900))))
def select_range(spark, d):
    p = v.px(spark, d)
    return _shape(p, indices.select_bands(F.col("spectrum"), v.BANDS, 500, 900)[0])


@query(_shape_sql(_positions([v.BANDS.nearest(w) for w in (660, 860, 2200, 660)])))
def select_nearest(spark, d):
    p = v.px(spark, d)
    return _shape(p, indices.select_bands(F.col("spectrum"), v.BANDS, wavelengths=(660, 860, 2200, 660))[0])


@query(_shape_sql(_positions([i for i, w in enumerate(v.BANDS.wavelengths) if not any(a <= w <= b for a, b in ((0, 400), (1340, 1480), (1780, 1970), (2350, 2500)))])))
def mask_bad_bands(spark, d):
    p = v.px(spark, d)
    return _shape(p, indices.mask_bad_bands(F.col("spectrum"), v.BANDS)[0])


@query(_shape_sql("[least(greatest(x, CAST(0 AS DOUBLE)), CAST(1 AS DOUBLE)) FOR x IN s]"))
def clamp_reflectance(spark, d):
    p = v.px(spark, d)
    return _shape(p, indices.clamp(F.col("spectrum")))


def _sai_sql(target, left, right) -> str:
    t, a, b = (v.clipped(v.band(w, "first")) for w in (target, left, right))
    wt, wa, wb = (v.BANDS.wavelengths[v.BANDS.nearest(w, "first")] for w in (target, left, right))
    line = f"({a} + ({b} - {a}) * CAST({(wt - wa) / (wb - wa)!r} AS DOUBLE))"
    return f"(CASE WHEN {line} > 0 THEN {v.clipped(f'(({line} - {t}) / {line})')} END)"


@query(f'WITH {v.PX} SELECT r AS "row", c AS "col", round({_sai_sql(970, 850, 1100)}, 6) AS sai970, round({_sai_sql(1200, 1080, 1320)}, 6) AS sai1200 FROM px')
def sai(spark, d):
    s = F.col("spectrum")
    return v.px(spark, d).select("row", "col", r6(indices.sai(s, v.BANDS, 970, 850, 1100)).alias("sai970"), r6(indices.sai(s, v.BANDS, 1200, 1080, 1320)).alias("sai1200"))


def _wi_sql() -> str:
    a, b = v.clipped(v.band(900)), v.clipped(v.band(970))
    return f"(CASE WHEN abs({b}) >= 1e-3 THEN {a} / {b} END)"


@query(
    f'WITH {v.PX} SELECT r AS "row", c AS "col", round({_sai_sql(970, 850, 1100)}, 6) AS SAI970, round({_sai_sql(1200, 1080, 1320)}, 6) AS SAI1200, '
    + ", ".join(f"round({v.index(860, w)}, 6) AS NDWI_{w}" for w in (1240, 1640, 2130))
    + f", round({_wi_sql()}, 6) AS WI FROM px"
)
def lfmc_stack(spark, d):
    p = v.px(spark, d)
    return p.select("row", "col", *[r6(c).alias(n) for n, c in indices.water_indices(F.col("spectrum"), v.BANDS).items()])


_KEPT = v.BANDS.within(800, 2400)
_HULL = f"""
h AS (SELECT r, c, [least(greatest(s[i], CAST(0 AS DOUBLE)), CAST(1 AS DOUBLE)) FOR i IN [{", ".join(str(i + 1) for i in _KEPT)}]] AS y FROM px),
n AS (SELECT unnest(range(1, {len(_KEPT) + 1})) AS i),
chords AS (SELECT h.r, h.c, t.i, max(CASE WHEN j.i = k.i THEN y[j.i] ELSE y[j.i] + (y[k.i] - y[j.i]) * (t.i - j.i) / CAST(k.i - j.i AS DOUBLE) END) AS hull, any_value(y[t.i]) AS v
  FROM h, n t, n j, n k WHERE j.i <= t.i AND k.i >= t.i AND (j.i < k.i OR j.i = t.i) {{where}} GROUP BY h.r, h.c, t.i),
cr AS (SELECT r, c, i, CASE WHEN hull <> 0 THEN least(v / hull, 1) END AS x FROM chords)"""
_TARGETS = {f"d{int(t)}": v.BANDS.take(_KEPT).nearest(t) + 1 for t in indices.DEPTH_TARGETS}


@query(
    f"WITH {v.PX}, {_HULL.format(where='AND t.i IN (' + ', '.join(map(str, _TARGETS.values())) + ')')} SELECT r AS \"row\", c AS \"col\", "
    + ", ".join(f"round(1 - max(CASE WHEN i = {i} THEN x END), 6) AS {n}" for n, i in _TARGETS.items())
    + " FROM cr GROUP BY r, c"
)
def cr_depths(spark, d):
    out = hull.depths(v.px(spark, d), v.BANDS)
    return out.select("row", "col", *[r6(F.element_at("cr_depths", F.lit(float(n[1:])))).alias(n) for n in _TARGETS])


@query(f'WITH {v.PX}, {_HULL.format(where="AND h.c = 3")} SELECT r AS "row", round(sum(x), 5) AS cr_sum, round(min(x), 6) AS cr_min FROM cr GROUP BY r')
def continuum_removal(spark, d):
    p = v.px(spark, d).filter("col = 3").withColumn("clamped", indices.clamp(F.col("spectrum")))
    out, _ = hull.continuum_removal(p, v.BANDS, "clamped", "cr", 800, 2400)
    return out.select("row", F.round(arrays.total(F.col("cr")), 5).alias("cr_sum"), r6(F.array_min("cr")).alias("cr_min"))


@query()
def continuum_removal_all(spark, d):
    """Every pixel; ``continuum_removal`` keeps to the column that its SQL names."""
    p = v.px(spark, d).withColumn("clamped", indices.clamp(F.col("spectrum")))
    out, _ = hull.continuum_removal(p, v.BANDS, "clamped", "cr", 800, 2400)
    return out.select("row", "col", F.round(arrays.total(F.col("cr")), 5).alias("cr_sum"), r6(F.array_min("cr")).alias("cr_min"))


_S2 = sensor("SENTINEL2")
_W2 = indices.response_weights(v.BANDS, _S2.wavelengths, _S2.fwhm, 33.65)


def _weights_sql(weights) -> str:
    return "[" + ", ".join(" + ".join(f"s[{i + 1}] * CAST({w!r} AS DOUBLE)" for i, w in enumerate(row) if w) or "NULL" for row in weights) + "]"


@query(f'WITH {v.PX}, q AS (SELECT r, c, {_weights_sql(_W2)} AS x FROM px) SELECT r AS "row", c AS "col", ' + ", ".join(f"round(x[{i + 1}], 6) AS {n}" for i, n in enumerate(MULTISPECTRAL)) + " FROM q")
def simulate_sensor(spark, d):
    out = v.px(spark, d).withColumn("x", indices.resample(F.col("spectrum"), _W2))
    return out.select("row", "col", *[r6(at(F.col("x"), i)).alias(n) for i, n in enumerate(MULTISPECTRAL)])


_TARGET = v.BANDS.take(range(0, 64, 4))
_WL = indices.response_weights(v.BANDS, _TARGET.wavelengths, (60.0,) * 16, 33.65)


@query(f"WITH {v.PX}, {v.LIB}, q AS (SELECT id, [{v.clipped('x')} FOR x IN {_weights_sql(_WL)}] AS y FROM lib) SELECT id AS spectrum_id, round(list_sum(y), 6) AS s_sum, round(y[7], 6) AS s_seventh FROM q")
def resample_library(spark, d, most=6):
    out = library.resample_library(v.lib(spark, d, most), v.BANDS, _TARGET, 60.0, 33.65)
    return out.select("spectrum_id", r6(arrays.total(F.col("spectrum"))).alias("s_sum"), r6(at(F.col("spectrum"), 6)).alias("s_seventh"))


@query(f'WITH {v.PX} SELECT r AS "row", c AS "col", round(exp(-0.5 * power((s[1] * 1000 - 560) / (35 / CAST(2.3548 AS DOUBLE)), 2)), 6) AS response FROM px')
def gaussian_response(spark, d):
    return v.px(spark, d).select("row", "col", r6(indices.gaussian_response(at(F.col("spectrum"), 0) * 1000, 560.0, 35.0)).alias("response"))


# --- masks and filters


@query(f'WITH {v.PX} SELECT r AS "row", c AS "col", CASE WHEN vec_id % 7 = 0 THEN FALSE ELSE TRUE END AS valid FROM px')
def nodata_mask(spark, d):
    holed = v.px(spark, d).withColumn("spectrum", array_to_null(F.transform("spectrum", lambda x, i: F.when((F.col("vec_id") % 7 == 0) & (i == 5), F.lit(float("nan"))).otherwise(x))))
    return holed.select("row", "col", masks.nodata_mask(F.col("spectrum")).alias("valid"))


@query("SELECT event_id, user_id % 3 <> 1 AND (event_id % 4 <> 1) AS clear FROM events")
def cloud_mask(spark, d):
    e = v.table(spark, d, "events")
    return e.select("event_id", masks.cloud_mask(F.when(F.col("user_id") % 3 == 1, 1).when(F.col("user_id") % 3 == 0, 0), (F.col("event_id") % 4 == 1).cast("int")).alias("clear"))


@query(f'WITH {v.PX} SELECT r AS "row", c AS "col", coalesce({v.NDWI} <= 0.1, FALSE) AS land FROM px')
def water_mask(spark, d):
    return v.px(spark, d).select("row", "col", masks.water_mask(F.col("spectrum"), v.BANDS, 0.1).alias("land"))


@query(f'WITH {v.PX} SELECT r AS "row", c AS "col", CASE WHEN coalesce({v.NDWI} <= 0.1, FALSE) AND vec_id % 5 <> 0 THEN round(list_sum(s), 6) END AS s_sum FROM px')
def apply_masks(spark, d):
    p = v.px(spark, d)
    out = masks.apply_masks(p, [masks.water_mask(F.col("spectrum"), v.BANDS, 0.1), masks.cloud_mask((F.col("vec_id") % 5 == 0).cast("int"))])
    return out.select("row", "col", r6(arrays.total(F.col("spectrum"))).alias("s_sum"))


@query("SELECT event_id, value FROM events WHERE user_id BETWEEN 100 AND 400 AND event_id BETWEEN 50 AND 5000")
def bbox_filter(spark, d):
    return v.table(spark, d, "events").filter(masks.in_bbox(F.col("user_id"), F.col("event_id"), 100, 50, 400, 5000)).select("event_id", "value")


@query("SELECT event_id, value FROM events WHERE value BETWEEN 10 AND 60")
def range_filter(spark, d):
    return v.table(spark, d, "events").filter(masks.in_range(F.col("value"), 10, 60)).select("event_id", "value")


@query("SELECT p_partkey, p_type FROM part WHERE contains(lower(p_type), 'steel') OR contains(lower(p_type), 'eco') OR contains(lower(p_type), 'brass')")
def substring_filter(spark, d):
    return v.table(spark, d, "part").filter(masks.contains_any(F.col("p_type"), ("STEEL", "eco", "Brass"))).select("p_partkey", "p_type")


@query("SELECT o_orderkey, coalesce(abs(epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1995-03-15')) <= 30 * 86400 * 1000000::BIGINT OR abs(epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1996-07-01')) <= 30 * 86400 * 1000000::BIGINT, FALSE) AS colocated FROM orders")
def colocation_window(spark, d):
    return v.table(spark, d, "orders").select("o_orderkey", masks.near_any_date(F.col("o_orderdate"), ("1995-03-15", "1996-07-01")).alias("colocated"))


_CLS = f"CASE WHEN {v.NBR} < -0.1 AND {v.NDVI} < 0.2 THEN 'char' WHEN {v.NDVI} > 0.5 THEN 'pv' WHEN {v.NDVI} > 0.15 AND {v.NDVI} < 0.4 AND {v.NBR} > 0 THEN 'npv' WHEN {v.NDVI} < 0.15 AND {v.NDWI} < -0.1 THEN 'soil' END"


@query(f'WITH {v.PX} SELECT r AS "row", c AS "col", {_CLS} AS cls FROM px')
def heuristic_classes(spark, d):
    s = F.col("spectrum")
    return v.px(spark, d).select("row", "col", masks.heuristic_classes(indices.nbr(s, v.BANDS), indices.ndvi(s, v.BANDS), indices.ndwi(s, v.BANDS)).alias("cls"))


@query(
    f"""WITH {v.PX}, i AS (SELECT r, c, {v.NBR} AS n, {v.NDVI} AS v FROM px),
 q AS (SELECT quantile_cont(n, 0.15) AS n15, quantile_cont(n, 0.30) AS n30, quantile_cont(v, 0.30) AS v30, quantile_cont(v, 0.35) AS v35, quantile_cont(v, 0.40) AS v40, quantile_cont(v, 0.60) AS v60, quantile_cont(v, 0.80) AS v80 FROM i)
 SELECT r AS "row", c AS "col", n <= n15 AND v <= v35 AS is_char, v >= v80 AS is_pv, v BETWEEN v40 AND v60 AS is_npv, v <= v30 AND n >= n30 AS is_soil FROM i, q"""
)
def percentile_classes(spark, d):
    s = F.col("spectrum")
    p = v.px(spark, d).select("row", "col", indices.nbr(s, v.BANDS).alias("nbr"), indices.ndvi(s, v.BANDS).alias("ndvi"))
    return masks.percentile_classes(p, least=5).select("row", "col", "is_char", "is_pv", "is_npv", "is_soil")


@query(f'WITH {v.PX}, m AS (SELECT (min(r) + max(r) + 1) // 2 AS r0, (min(c) + max(c) + 1) // 2 AS c0 FROM px) SELECT r AS "row", c AS "col" FROM px, m WHERE r >= r0 - 5 AND r < r0 + 5 AND c >= c0 - 5 AND c < c0 + 5')
def centre_crop(spark, d):
    return masks.crop(v.px(spark, d), 10).select("row", "col")


# --- grids and joins


@query(f"WITH {v.PX} SELECT min(350015 + 30 * c)::DOUBLE AS xmin, max(350015 + 30 * c)::DOUBLE AS xmax, min(3759985 - 30 * r)::DOUBLE AS ymin, max(3759985 - 30 * r)::DOUBLE AS ymax, CAST(max(r) - min(r) + 1 AS BIGINT) AS n_rows, CAST(max(c) - min(c) + 1 AS BIGINT) AS n_cols, CAST(30 AS DOUBLE) AS x_res, CAST(30 AS DOUBLE) AS y_res FROM px")
def spatial_info(spark, d):
    x, y = v.GRID.centres(F.col("row"), F.col("col"))
    return grid.spatial_info(v.px(spark, d).withColumns({"x": x, "y": y}))


_PAIR = f"{v.PX}, {v.PX2}, a AS (SELECT r - 2 AS r, c - 3 AS c, {v.NBR} AS x FROM px WHERE r < 20), b AS (SELECT r, c, {v.NBR} AS y FROM px2 WHERE r < 20), dn AS (SELECT a.r, a.c, x, y, x - y AS dnbr FROM a JOIN b ON a.r = b.r AND a.c = b.c WHERE a.r BETWEEN 0 AND 17 AND a.c BETWEEN 0 AND 21)"


def _dnbr(spark, d) -> DataFrame:
    """Index first, then align: two numbers a pixel travel instead of two spectra."""
    first, second = v.grids(spark, d)
    frames = {k: (p.select("row", "col", indices.nbr(F.col("spectrum"), v.BANDS).alias("nbr")), g) for k, p, g in (("pre", v.px(spark, d), first), ("post", v.px2(spark, d), second))}
    both, _ = grid.align(frames, ["nbr"])
    pre, post = both["pre"].withColumnRenamed("nbr", "nbr_pre"), both["post"].withColumnRenamed("nbr", "nbr_post")
    return pre.join(post, ["row", "col"]).withColumn("dnbr", F.col("nbr_pre") - F.col("nbr_post"))


@query(f'WITH {_PAIR} SELECT r AS "row", c AS "col", round(x, 6) AS nbr_pre, round(y, 6) AS nbr_post, round(dnbr, 6) AS dnbr FROM dn')
def dnbr_aligned(spark, d):
    return _dnbr(spark, d).select("row", "col", r6("nbr_pre").alias("nbr_pre"), r6("nbr_post").alias("nbr_post"), r6("dnbr").alias("dnbr"))


_DCLASS = "CASE WHEN dnbr IS NOT NULL THEN (dnbr >= 0.1)::INT + (dnbr >= 0.27)::INT + (dnbr >= 0.44)::INT + (dnbr >= 0.66)::INT END"


@query(f'WITH {_PAIR} SELECT r AS "row", c AS "col", {_DCLASS} AS severity FROM dn')
def severity_from_dnbr(spark, d):
    return _dnbr(spark, d).select("row", "col", severity.dnbr_classes(F.col("dnbr")).alias("severity"))


@query(f"WITH {_PAIR}, s AS (SELECT {_DCLASS} AS severity FROM dn) SELECT severity, count(*) AS n, round(100 * count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS percent FROM s WHERE severity IS NOT NULL GROUP BY severity")
def severity_histogram(spark, d):
    out = aggregates.class_histogram(severity_from_dnbr(spark, d), "severity")
    return out.select("severity", "n", r6("percent").alias("percent"))


@query(f'WITH {v.PX}, {v.PX2} SELECT a.r AS "row", a.c AS "col", round({v.index(860, 2200, "a.s")} - {v.index(860, 2200, "b.s")}, 6) AS dnbr FROM px a JOIN px2 b ON a.r = b.r AND a.c = b.c')
def dnbr_same_grid(spark, d):
    return grid.dnbr(v.px(spark, d), v.px2(spark, d), v.BANDS).select("row", "col", r6("dnbr").alias("dnbr"))


_HALF = grid.Grid(v.GRID.west + 45, v.GRID.north - 45, 30.0, 10, 8, v.GRID.crs)


@query(f'WITH {v.PX}, i AS (SELECT r, c, {v.NBR} AS x FROM px) SELECT t.r - 1 AS "row", t.c - 1 AS "col", round((t.x + u.x + w.x + z.x) / 4, 6) AS nbr FROM i t JOIN i u ON u.r = t.r + 1 AND u.c = t.c JOIN i w ON w.r = t.r AND w.c = t.c + 1 JOIN i z ON z.r = t.r + 1 AND z.c = t.c + 1 WHERE t.r BETWEEN 1 AND 8 AND t.c BETWEEN 1 AND 10')
def reproject_bilinear(spark, d):
    p = v.px(spark, d).select("row", "col", indices.nbr(F.col("spectrum"), v.BANDS).alias("nbr"))
    return grid.reproject(p, v.GRID, _HALF, ["nbr"], "bilinear").select("row", "col", r6("nbr").alias("nbr"))


@query()
def reproject_cubic(spark, d):
    p = v.px(spark, d).select("row", "col", indices.nbr(F.col("spectrum"), v.BANDS).alias("nbr"))
    whole, _ = v.grids(spark, d)
    # All cells between the centres of the source.
    target = grid.Grid(_HALF.west, _HALF.north, 30.0, whole.width - 2, whole.height - 2, whole.crs)
    return grid.reproject(p, whole, target, ["nbr"], "cubic").select("row", "col", r6("nbr").alias("nbr"))


_CELL = "CASE WHEN fx BETWEEN -0.5 AND 24.5 AND fy BETWEEN -0.5 AND 19.5 THEN"
_SAMPLE = f"{v.PX}, {v.PTS}, k AS (SELECT *, (x - 350015) / 30 AS fx, (3759985 - y) / 30 AS fy FROM pts), cell AS (SELECT *, {_CELL} greatest(ceil(fx - 0.5), 0) END AS pc, {_CELL} least(floor(fy + 0.5), 19) END AS pr FROM k), sampled AS (SELECT event_id, ordinal, {v.NBR} AS v FROM cell LEFT JOIN px ON pr = r AND pc = c)"


@query(f"WITH {_SAMPLE} SELECT event_id, round(v, 6) AS nbr FROM sampled")
def sample_points(spark, d):
    p = v.px(spark, d).select("row", "col", indices.nbr(F.col("spectrum"), v.BANDS).alias("nbr"))
    return grid.sample_points(v.pts(spark, d), p, v.GRID, ["nbr"]).select("event_id", r6("nbr").alias("nbr"))


@query(f"WITH {_SAMPLE}, t AS (SELECT v >= -0.05 AS p, ordinal >= 1 AS a FROM sampled WHERE v IS NOT NULL), k2 AS (SELECT count(*) FILTER (p AND a) AS tp, count(*) FILTER (p AND NOT a) AS fp, count(*) FILTER (NOT p AND a) AS fn, count(*) FILTER (NOT p AND NOT a) AS tn FROM t) SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn)::DOUBLE, 6) AS accuracy, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / (tp + fn)::DOUBLE, 6) AS recall, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS f1, (SELECT count(v) FROM sampled) AS n_inside, (SELECT count(*) - count(v) FROM sampled) AS n_outside FROM k2")
def structure_scores(spark, d):
    p = v.px(spark, d).select("row", "col", indices.nbr(F.col("spectrum"), v.BANDS).alias("nbr"))
    scores, _, _ = accuracy.check_structures(v.pts(spark, d), p, v.GRID, "nbr", -0.05)
    return scores.select("tp", "fp", "fn", "tn", "n_inside", "n_outside", *[r6(c).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@query(f"WITH {_SAMPLE} SELECT ordinal, count(*) AS n, round(avg(v), 6) AS v_mean, round(median(v), 6) AS v_median, round(stddev_pop(v), 6) AS v_std FROM sampled WHERE v IS NOT NULL GROUP BY ordinal")
def structure_stats(spark, d):
    p = v.px(spark, d).select("row", "col", indices.nbr(F.col("spectrum"), v.BANDS).alias("nbr"))
    _, stats, _ = accuracy.check_structures(v.pts(spark, d), p, v.GRID, "nbr", -0.05)
    return stats.select("ordinal", "n", *[r6(c).alias(c) for c in ("v_mean", "v_median", "v_std")])


@query(f"WITH {v.PX}, {v.PTS}, k AS (SELECT event_id, x, y, least(greatest(round((x - 350000) / 30 - 0.5), 0), 24) AS cx, least(greatest(round((3760000 - y) / 30 - 0.5), 0), 19) AS cy FROM pts), n AS (SELECT *, abs(350015 + 30 * cx - x) <= 20 AND abs(3759985 - 30 * cy - y) <= 20 AS near FROM k), j AS (SELECT n.event_id, near, {v.NDVI} AS v FROM n LEFT JOIN px ON near AND cy = r AND cx = c) SELECT event_id, CASE WHEN NOT near THEN 'outside' WHEN v IS NULL THEN 'masked' ELSE 'ok' END AS status FROM j")
def colocate_sites(spark, d):
    p = v.px(spark, d).select("row", "col", indices.ndvi(F.col("spectrum"), v.BANDS).alias("ndvi"))
    return grid.colocate_sites(v.pts(spark, d), p, v.GRID, "ndvi", 20.0).select("event_id", "status")


@query("SELECT p_partkey, CAST(CASE WHEN p_size % 8 = 7 THEN -1 WHEN p_size % 8 = 6 THEN 6 WHEN p_size % 8 = 5 THEN 4 WHEN p_size % 8 = 0 THEN -1 ELSE p_size % 8 END AS SMALLINT) AS code FROM part")
def class_remap(spark, d):
    p = v.table(spark, d, "part").select("p_partkey", (F.col("p_size") % 8).alias("code"))
    return severity.remap_codes(p, "code", severity.FIELD_CODES, strict=False, nodata=7)


@query(f'WITH {v.PX}, t AS (SELECT unnest(range(0, 200)) AS id), g AS (SELECT id // 20 AS r, id % 20 AS c FROM t) SELECT CAST(g.r AS INTEGER) AS "row", CAST(g.c AS INTEGER) AS "col", CAST(coalesce(label, -1) AS SMALLINT) AS code FROM g LEFT JOIN px ON px.r = g.r * 2 + 1 AND px.c = g.c * 2 + 1')
def align_classes(spark, d):
    p = v.px(spark, d).select("row", "col", F.col("category").cast("int").alias("code"))
    whole, _ = v.grids(spark, d)
    return grid.align_classes(p, whole, grid.Grid(whole.west, whole.north, 60.0, 20, whole.height // 2, whole.crs))


_SCENES = "sc AS (SELECT s_suppkey AS k, (s_suppkey * 37 % 100)::DOUBLE AS xmin, (s_suppkey * 53 % 100)::DOUBLE AS ymin, (s_suppkey * 37 % 100 + 5 + s_suppkey % 7)::DOUBLE AS xmax, (s_suppkey * 53 % 100 + 4 + s_suppkey % 5)::DOUBLE AS ymax FROM supplier)"


@query(f"WITH {_SCENES}, p AS (SELECT a.k AS a, b.k AS b, least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin) AS w, least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin) AS h, least((a.xmax - a.xmin) * (a.ymax - a.ymin), (b.xmax - b.xmin) * (b.ymax - b.ymin)) AS m FROM sc a JOIN sc b ON a.k < b.k) SELECT a, b, round(w * h / m, 6) AS overlap FROM p WHERE w > 0 AND h > 0")
def overlap_matrix(spark, d):
    k = F.col("s_suppkey")
    boxes = v.table(spark, d, "supplier").select(k.alias("scene_id"), (k * 37 % 100).cast("double").alias("xmin"), (k * 53 % 100).cast("double").alias("ymin"), (k * 37 % 100 + 5 + k % 7).cast("double").alias("xmax"), (k * 53 % 100 + 4 + k % 5).cast("double").alias("ymax"))
    return grid.overlap_matrix(boxes).select("a", "b", r6("overlap").alias("overlap"))


@query(f"WITH {_SCENES}, i AS (SELECT max(xmin) AS xmin, max(ymin) AS ymin, min(xmax) AS xmax, min(ymax) AS ymax FROM sc WHERE xmin < 20 AND xmax > 20) SELECT CASE WHEN xmin < xmax AND ymin < ymax THEN xmin END AS xmin, CASE WHEN xmin < xmax AND ymin < ymax THEN ymin END AS ymin, CASE WHEN xmin < xmax AND ymin < ymax THEN xmax END AS xmax, CASE WHEN xmin < xmax AND ymin < ymax THEN ymax END AS ymax FROM i")
def bounds_intersection(spark, d):
    k = F.col("s_suppkey")
    boxes = v.table(spark, d, "supplier").select((k * 37 % 100).cast("double").alias("xmin"), (k * 53 % 100).cast("double").alias("ymin"), (k * 37 % 100 + 5 + k % 7).cast("double").alias("xmax"), (k * 53 % 100 + 4 + k % 5).cast("double").alias("ymax"))
    return aggregates.bounds_intersection(boxes.filter("xmin < 20 and xmax > 20"))


@query("SELECT o_orderkey, round(x, 1) AS x, round(y, 1) AS y FROM (SELECT o_orderkey, 500000 + 0.9996 * n * (a + (1 - t + c) * a ** 3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep) * a ** 5 / 120) AS x, 0.9996 * (m + n * tan(phi) * (a ** 2 / 2 + (5 - t + 9 * c + 4 * c * c) * a ** 4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep) * a ** 6 / 720)) AS y FROM (SELECT *, 6378137 / sqrt(1 - e2 * sin(phi) ** 2) AS n, tan(phi) ** 2 AS t, ep * cos(phi) ** 2 AS c, lam * cos(phi) AS a, 6378137 * ((1 - e2 / 4 - 3 * e2 ** 2 / 64 - 5 * e2 ** 3 / 256) * phi - (3 * e2 / 8 + 3 * e2 ** 2 / 32 + 45 * e2 ** 3 / 1024) * sin(2 * phi) + (15 * e2 ** 2 / 256 + 45 * e2 ** 3 / 1024) * sin(4 * phi) - (35 * e2 ** 3 / 3072) * sin(6 * phi)) AS m FROM (SELECT o_orderkey, radians(CAST(33.5 AS DOUBLE) + (o_orderkey % 150) / CAST(100 AS DOUBLE)) AS phi, radians(CAST(-119.5 AS DOUBLE) + (o_custkey % 250) / CAST(100 AS DOUBLE) + 117) AS lam, CAST(0.0066943799901413165 AS DOUBLE) AS e2, CAST(0.0066943799901413165 AS DOUBLE) / (1 - CAST(0.0066943799901413165 AS DOUBLE)) AS ep FROM orders)))")
def to_utm(spark, d):
    o = v.table(spark, d, "orders")
    x, y = projection.to_utm(F.lit(-119.5) + (F.col("o_custkey") % 250) / 100.0, F.lit(33.5) + (F.col("o_orderkey") % 150) / 100.0, 32611)
    return o.select("o_orderkey", F.round(x, 1).alias("x"), F.round(y, 1).alias("y"))


# --- aggregation


@query(f"WITH {v.BIG} SELECT code, count(b4) AS n_valid, min(b4) AS v_min, max(b4) AS v_max, round(avg(b4), 6) AS v_mean, round(median(b4), 6) AS v_median FROM big GROUP BY code")
def product_summary(spark, d):
    return aggregates.summary(v.big(spark, d), "b4", ["code"]).select("code", "n_valid", "v_min", "v_max", r6("v_mean").alias("v_mean"), r6("v_median").alias("v_median"))


_ROI = {"a": (0, 6, 0, 6), "b": (4, 12, 3, 20), "c": (15, 18, 10, 12)}


@query(f"WITH {v.PX}, reg(region, r0, r1, c0, c1) AS (VALUES ('a', 0, 6, 0, 6), ('b', 4, 12, 3, 20), ('c', 15, 18, 10, 12)), e AS (SELECT region, unnest(range(1, 65)) AS i, s FROM px JOIN reg ON r >= r0 AND r < r1 AND c >= c0 AND c < c1), m AS (SELECT region, i, avg(s[i]) AS x, count(*) AS n FROM e GROUP BY region, i) SELECT region, max(n) AS n_pixels, round(sum(x), 5) AS s_sum, round(max(CASE WHEN i = 10 THEN x END), 6) AS s_tenth FROM m GROUP BY region")
def roi_mean(spark, d):
    out = aggregates.region_means(v.px(spark, d), _ROI)
    return out.select("region", "n_pixels", F.round(arrays.total(F.col("spectrum")), 5).alias("s_sum"), r6(at(F.col("spectrum"), 9)).alias("s_tenth"))


@query(f"WITH {v.PX}, m AS (SELECT label, unnest(range(1, 65)) AS i, s FROM px), a AS (SELECT label, i, avg(s[i]) AS x, count(*) AS n FROM m GROUP BY label, i) SELECT label AS category, max(n) AS n_pixels, round(sum(x), 5) AS s_sum FROM a GROUP BY label HAVING max(n) >= 45")
def mask_mean(spark, d):
    out = aggregates.mean_spectra(v.px(spark, d), "category", least=45)
    return out.select("category", "n_pixels", F.round(arrays.total(F.col("spectrum")), 5).alias("s_sum"))


@query(f'WITH {v.PX}, i AS (SELECT r, c, {v.NBR} AS x FROM px WHERE r < 18 AND c < 24) SELECT r // 3 AS "row", c // 4 AS "col", round(avg(x), 6) AS nbr FROM i GROUP BY ALL')
def coarsen(spark, d):
    whole, _ = v.grids(spark, d)
    p = v.px(spark, d).select("row", "col", indices.nbr(F.col("spectrum"), v.BANDS).alias("nbr"))
    return grid.coarsen(p, ["nbr"], 3, 4, whole.height, whole.width).select("row", "col", r6("nbr").alias("nbr"))


@query(f'WITH {v.PX}, i AS (SELECT r, c, {v.NBR} AS x FROM px WHERE r < 20 AND c < 24), m AS (SELECT r // 2 AS r, c // 2 AS c, avg(x) AS x FROM i GROUP BY ALL), g AS (SELECT unnest(range(0, 90)) AS id) SELECT CAST(id // 10 AS INTEGER) AS "row", CAST(id % 10 AS INTEGER) AS "col", round(x, 6) AS nbr FROM g LEFT JOIN m ON m.r = id // 10 + 1 AND m.c = id % 10 + 1')
def aggregate_to_grid(spark, d):
    whole, _ = v.grids(spark, d)
    p = v.px(spark, d).select("row", "col", indices.nbr(F.col("spectrum"), v.BANDS).alias("nbr"))
    target = grid.Grid(whole.west + 60, whole.north - 60, 60.0, 10, whole.height // 2 - 1, whole.crs)
    return grid.aggregate_to_grid(p, whole, target, ["nbr"]).select("row", "col", r6("nbr").alias("nbr"))


@query(f"WITH {v.BIG} SELECT code, count(*) AS n, round(100 * count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS percent FROM big GROUP BY code")
def class_histogram(spark, d):
    return aggregates.class_histogram(v.big(spark, d), "code").select("code", "n", r6("percent").alias("percent"))


@query(f"WITH {v.BIG} SELECT code, count(*) AS n, round(avg(b1), 6) AS mean_b1, round(avg(b4), 6) AS mean_b4 FROM big GROUP BY code")
def severity_stratified(spark, d):
    return aggregates.stratified_means(v.big(spark, d), "code", ["b1", "b4"]).select("code", "n", r6("mean_b1").alias("mean_b1"), r6("mean_b4").alias("mean_b4"))


@query(f"WITH {v.BIG}, m AS (SELECT code, avg(b4) AS x FROM big GROUP BY code), l AS (SELECT x, lag(x) OVER (ORDER BY code) AS p FROM m) SELECT coalesce(bool_and(x > p), TRUE) AS monotonic FROM l WHERE p IS NOT NULL")
def severity_monotonic(spark, d):
    return aggregates.is_monotonic(aggregates.stratified_means(v.big(spark, d), "code", ["b4"]), "code", "mean_b4")


@query("SELECT CAST(ts AS DATE) AS day, event_type AS cls, count(value) AS n, round(avg(value), 6) AS v_mean, round(stddev_pop(value), 6) AS v_std FROM events GROUP BY ALL")
def trajectory_stats(spark, d):
    return aggregates.trajectory_stats(v.series(spark, d), ["day", "cls"], "value").select("day", "cls", "n", r6("v_mean").alias("v_mean"), r6("v_std").alias("v_std"))


@query("WITH m AS (SELECT CAST(ts AS DATE) AS day, event_type AS cls, avg(value) AS x FROM events GROUP BY ALL), e AS (SELECT cls, arg_min(x, day) AS v0, arg_max(x, day) AS v1, date_diff('day', min(day), max(day)) AS days FROM m GROUP BY cls), s AS (SELECT *, CASE WHEN days > 0 THEN (v1 - v0) / days END AS slope FROM e) SELECT cls, round(slope, 6) AS slope, CASE WHEN slope > 0 THEN round(greatest((100 - v1) / slope, 0), 3) END AS days_to_baseline FROM s")
def recovery_slope(spark, d):
    daily = v.series(spark, d).groupBy("day", "cls").agg(F.avg("value").alias("value"))
    return aggregates.recovery_slope(daily, ["cls"], "day", "value", F.lit(100.0)).select("cls", r6("slope").alias("slope"), F.round("days_to_baseline", 3).alias("days_to_baseline"))


@query("SELECT user_id, round(median(value), 6) AS v_median, count(value) AS n FROM events GROUP BY user_id")
def site_medians(spark, d):
    return aggregates.site_medians(v.table(spark, d, "events"), ["user_id"], "value").select("user_id", r6("v_median").alias("v_median"), "n")


@query("SELECT user_id % 10 AS site, round(avg(value) FILTER (event_type = 'click'), 6) AS click, round(avg(value) FILTER (event_type = 'view'), 6) AS view FROM events GROUP BY ALL")
def sensor_pivot(spark, d):
    e = v.table(spark, d, "events").withColumn("site", F.col("user_id") % 10)
    out = aggregates.pivot_mean(e, "site", "event_type", "value", ["click", "view"])
    return out.select("site", r6("click").alias("click"), r6("view").alias("view"))


@query(f"WITH {v.BIG} SELECT round(quantile_cont(b4, 0.02), 6) AS v_low, round(quantile_cont(b4, 0.98), 6) AS v_high FROM big")
def quicklook_range(spark, d):
    return aggregates.quicklook_range(v.big(spark, d), "b4").select(r6("v_low").alias("v_low"), r6("v_high").alias("v_high"))


@query(f'WITH {v.PX}, i AS (SELECT r, c, label, {v.NDVI} AS x FROM px) SELECT label AS category, r AS "row", c AS "col", round(x, 6) AS ndvi FROM i WHERE x IS NOT NULL QUALIFY row_number() OVER (PARTITION BY label ORDER BY x DESC, r, c) = 1')
def top_pixel(spark, d):
    p = v.px(spark, d).select("row", "col", "category", indices.ndvi(F.col("spectrum"), v.BANDS).alias("ndvi"))
    return aggregates.top_pixel(p, "ndvi", ["category"]).select("category", "row", "col", r6("ndvi").alias("ndvi"))


# --- severity

_CAL = f"{v.BIG}, cal AS (SELECT code, b4 - 0.4 * code AS x FROM big), med AS (SELECT code, count(*) AS n, median(x) AS m FROM cal GROUP BY code)"


def _calibration(spark, d) -> DataFrame:
    return v.big(spark, d).withColumn("nbr", F.col("b4") - 0.4 * F.col("code"))


@query(f"WITH {_CAL} SELECT code, n, round(m, 6) AS v_median, round((m + lead(m) OVER (ORDER BY code)) / 2, 6) AS threshold FROM med")
def calibrate_nbr(spark, d):
    out = severity.calibrate(_calibration(spark, d))
    return out.select("code", "n", r6("v_median").alias("v_median"), r6("threshold").alias("threshold"))


@query(f"WITH {v.BIG} SELECT l_orderkey, l_linenumber, CASE WHEN b4 - 0.4 * code < CAST(-0.3 AS DOUBLE) THEN 4 WHEN b4 - 0.4 * code < CAST(0.1 AS DOUBLE) THEN 2 ELSE 1 END AS severity FROM big")
def classify_nbr(spark, d):
    return _calibration(spark, d).select("l_orderkey", "l_linenumber", severity.classify_nbr(F.col("nbr"), [1, 2, 4], [0.1, -0.3]).alias("severity"))


@query(f"WITH {v.BIG} SELECT l_orderkey, l_linenumber, (b1 * 3 >= 0.1)::INT + (b1 * 3 >= 1)::INT + (b1 * 3 >= 1.5)::INT + (b1 * 3 >= 2.25)::INT AS severity FROM big")
def cbi_classes(spark, d):
    return v.big(spark, d).select("l_orderkey", "l_linenumber", severity.cbi_classes(F.col("b1") * 3).alias("severity"))


# --- accuracy


@query(f"WITH {v.BIG} SELECT count(*) AS n_valid, round(1 - sum((b1 - b4) * (b1 - b4)) / (var_pop(b4) * count(*)), 6) AS r2, round(sqrt(avg((b1 - b4) * (b1 - b4))), 6) AS rmse, round(avg(abs(b1 - b4)), 6) AS mae, round(avg(b1 - b4), 6) AS bias FROM big")
def accuracy_continuous(spark, d):
    return accuracy.continuous(v.big(spark, d), "b1", "b4").select("n_valid", *[r6(c).alias(c) for c in ("r2", "rmse", "mae", "bias")])


@query(f"WITH {v.BIG} SELECT l_suppkey % 8 AS granule, count(*) AS n_valid, round(1 - sum((b1 - b4) * (b1 - b4)) / (var_pop(b4) * count(*)), 6) AS r2, round(sqrt(avg((b1 - b4) * (b1 - b4))), 6) AS rmse FROM big GROUP BY ROLLUP (granule)")
def granule_rollup(spark, d):
    out = accuracy.continuous(v.big(spark, d).withColumn("granule", F.col("l_suppkey") % 8), "b1", "b4", ["granule"], rollup=True)
    return out.select("granule", "n_valid", r6("r2").alias("r2"), r6("rmse").alias("rmse"))




@query(f"WITH {v.BIG}, k AS (SELECT rank() OVER (ORDER BY b1) + (count(*) OVER (PARTITION BY b1) - 1) / CAST(2 AS DOUBLE) AS a, rank() OVER (ORDER BY b4) + (count(*) OVER (PARTITION BY b4) - 1) / CAST(2 AS DOUBLE) AS b FROM big) SELECT round(corr(a, b), 6) AS spearman FROM k")
def spearman(spark, d):
    return accuracy.spearman(v.big(spark, d), "b1", "b4").select(r6("spearman").alias("spearman"))


@query(f"WITH {v.BIG} SELECT l_orderkey, l_linenumber, rank() OVER (ORDER BY b1) + (count(*) OVER (PARTITION BY b1) - 1) / CAST(2 AS DOUBLE) AS rank FROM big")
def average_ranks(spark, d):
    return accuracy.average_ranks(v.big(spark, d), "b1").select("l_orderkey", "l_linenumber", F.col("rank").cast("double").alias("rank"))


_PRED = "p AS (SELECT code AS obs, CASE WHEN b1 < 0.3 THEN 0 WHEN b1 < 0.6 THEN 1 WHEN b1 < 0.9 THEN 2 ELSE -1 END AS pred FROM big)"


def _predicted(spark, d) -> DataFrame:
    b = F.col("b1")
    return v.big(spark, d).withColumn("pred", F.when(b < 0.3, 0).when(b < 0.6, 1).when(b < 0.9, 2).otherwise(-1))


@query(f"WITH {v.BIG}, {_PRED} SELECT obs, pred, count(*) AS n FROM p WHERE pred <> -1 GROUP BY obs, pred")
def confusion_matrix(spark, d):
    return accuracy.confusion(_predicted(spark, d), "pred", "code")


@query(f"WITH {v.BIG}, {_PRED}, q AS (SELECT * FROM p WHERE pred <> -1), l AS (SELECT obs AS label FROM q UNION SELECT pred FROM q), s AS (SELECT label, (SELECT count(*) FROM q WHERE obs = label) AS o, (SELECT count(*) FROM q WHERE pred = label) AS r, (SELECT count(*) FROM q WHERE obs = label AND pred = label) AS h FROM l), t AS (SELECT sum(o) AS n, sum(h) AS h, sum(o::DOUBLE * r) AS x, avg(2.0 * h / (o + r)) AS f FROM s) SELECT CAST(n AS BIGINT) AS n_valid, round(h / n, 6) AS accuracy, round((h / n - x / (n * n)) / (1 - x / (n * n)), 6) AS kappa, round(f, 6) AS f1_macro FROM t")
def accuracy_classified(spark, d):
    return accuracy.classified(_predicted(spark, d), "pred", "code").select("n_valid", *[r6(c).alias(c) for c in ("accuracy", "kappa", "f1_macro")])


@query(f"WITH {v.BIG}, m AS (SELECT 1 - sum((b1 - b4) ** 2) / (var_pop(b4) * count(*)) AS ra, 1 - sum((b2 - b4) ** 2) / (var_pop(b4) * count(*)) AS rb, sqrt(avg((b1 - b4) ** 2)) AS ea, sqrt(avg((b2 - b4) ** 2)) AS eb, avg(abs(b1 - b4)) AS ma, avg(abs(b2 - b4)) AS mb, avg(b1 - b4) AS ba, avg(b2 - b4) AS bb FROM big) SELECT metric, round(a, 6) AS a, round(b, 6) AS b, round(delta, 6) AS delta FROM (SELECT 'r2' AS metric, ra AS a, rb AS b, ra - rb AS delta FROM m UNION ALL SELECT 'rmse', ea, eb, 100 * (eb - ea) / eb FROM m UNION ALL SELECT 'mae', ma, mb, 100 * (mb - ma) / mb FROM m UNION ALL SELECT 'bias', ba, bb, ba - bb FROM m)")
def compare_sensors(spark, d):
    out = accuracy.compare_sensors(v.big(spark, d), "b1", "b2", "b4")
    return out.select("metric", *[r6(c).alias(c) for c in ("a", "b", "delta")])


@query(f"WITH {v.PX}, i AS (SELECT {v.NBR} AS a, {v.NDVI} AS b FROM px) SELECT round(corr(a, b), 6) AS pearson, round(sqrt(avg((a - b) ** 2)), 6) AS rmse, round(avg(a - b), 6) AS bias, count(*) AS n_valid FROM i WHERE a IS NOT NULL AND b IS NOT NULL")
def compare_methods(spark, d):
    p, s = v.px(spark, d), F.col("spectrum")
    out = accuracy.compare_methods(p.select("row", "col", indices.nbr(s, v.BANDS).alias("value")), p.select("row", "col", indices.ndvi(s, v.BANDS).alias("value")))
    return out.select(*[r6(c).alias(c) for c in ("pearson", "rmse", "bias")], "n_valid")


# --- libraries and unmixing


@query(f"WITH {v.PX}, {v.LIB}, e AS (SELECT id, category, unnest(s) AS x FROM lib), sd AS (SELECT id, category, stddev_pop(x) AS sd FROM e GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY round(sd, 12) DESC, id) AS n FROM sd) SELECT id AS spectrum_id, category FROM k WHERE n <= 2")
def incob_topk(spark, d, most=6):
    return library.most_varied(v.lib(spark, d, most), 2).select("spectrum_id", "category")


_FISHER = "e AS (SELECT category, unnest(range(1, 65)) AS i, s FROM lib), b AS (SELECT i, category, count(*) AS n, avg(s[i]) AS m, var_pop(s[i]) AS w FROM e GROUP BY i, category), t AS (SELECT i, avg(s[i]) AS a FROM e GROUP BY i), f AS (SELECT i - 1 AS band, sum(n * (m - a) ** 2) / greatest(sum(n * w), 1e-12) AS fisher FROM b JOIN t USING (i) GROUP BY i)"


@query(f"WITH {v.PX}, {v.LIB}, {_FISHER} SELECT CAST(band AS INTEGER) AS band, round(fisher, 6) AS fisher FROM f")
def band_separability(spark, d, most=6):
    return library.separability(v.lib(spark, d, most)).select("band", r6("fisher").alias("fisher"))


@query(f"WITH {v.PX}, {v.LIB}, {_FISHER}, z AS (SELECT band, fisher, band // 4 AS zone FROM f) SELECT CAST(arg_max(band, fisher) AS INTEGER) AS band FROM z GROUP BY zone")
def uszu_bands(spark, d, most=6):
    found = library.pick_bands(v.lib(spark, d, most), 64, 16)
    return spark.range(1).select(F.explode(F.array(*[F.lit(i) for i in found])).alias("band"))


@query(f"WITH {v.PX}, {v.LIB}, u AS (SELECT id, s, 0 AS k FROM lib UNION ALL SELECT id, s, 1 FROM lib WHERE category IN ('c1', 'c2')) SELECT CASE WHEN n > 1 THEN id || '_dup' || (n - 1) ELSE id END AS spectrum_id, round(list_sum(s), 6) AS s_sum FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k) AS n FROM u)")
def hybrid_merge(spark, d, most=6):
    lib = v.lib(spark, d, most)
    return library.merge(lib, lib.filter("category in ('c1', 'c2')")).select("spectrum_id", r6(arrays.total(F.col("spectrum"))).alias("s_sum"))


def _on_all(fn) -> None:
    """Register ``fn`` a second time, with every row of ``px`` as its library."""

    def run(spark, d):
        return fn(spark, d, None)

    run.__name__ = f"{fn.__name__}_all"
    query(ORACLES[fn.__name__].replace(v.LIB, v.LIB_ALL))(run)


for _fn in (resample_library, incob_topk, band_separability, uszu_bands, hybrid_merge):
    _on_all(_fn)


_DOT = "list_sum([{a}[i] * {b}[i] FOR i IN range(1, 65)])"
_AA, _BB, _AB = (_DOT.format(a=a, b=b) for a, b in (("a.s", "a.s"), ("b.s", "b.s"), ("a.s", "b.s")))


@query(f"WITH {v.PX}, {v.LIB}, p AS (SELECT a.id, {_AA} AS aa, {_BB} AS bb, {_AB} AS ab FROM lib a JOIN lib b ON a.category = b.category AND a.id <> b.id), q AS (SELECT id, degrees(acos(least(1, greatest(-1, ab / (sqrt(aa) * sqrt(bb)))))) AS angle, sqrt(greatest((least(1, greatest(0, ab / aa)) ** 2 * aa - 2 * least(1, greatest(0, ab / aa)) * ab + bb) / 64, 0)) AS e FROM p) SELECT id AS spectrum_id, round(avg(e), 5) AS ear, round(avg(angle), 4) AS masa_deg FROM q GROUP BY id")
def ear_masa(spark, d):
    return library.quality(v.lib(spark, d)).select("spectrum_id", F.round("ear", 5).alias("ear"), F.round("masa_deg", 4).alias("masa_deg"))


@query(f"WITH {v.PX}, {v.LIB}, p AS (SELECT a.id, {_AA} AS aa, {_BB} AS bb, {_AB} AS ab FROM lib a JOIN lib b ON a.category = b.category AND a.id <> b.id), q AS (SELECT id, degrees(acos(least(1, greatest(-1, ab / (sqrt(aa) * sqrt(bb)))))) AS angle, sqrt(greatest((least(1, greatest(0, ab / aa)) ** 2 * aa - 2 * least(1, greatest(0, ab / aa)) * ab + bb) / 64, 0)) AS e FROM p), m AS (SELECT lib.id, coalesce(avg(e), 0) AS ear, coalesce(avg(angle), 0) AS masa FROM lib LEFT JOIN q USING (id) GROUP BY lib.id), k AS (SELECT *, NOT (ear > 0.16 AND masa > 20) AS kept FROM m) SELECT id AS spectrum_id, round(ear, 5) AS ear FROM k WHERE kept OR NOT (SELECT bool_or(kept) FROM k)")
def prune_library(spark, d):
    return library.prune(v.lib(spark, d), 0.16, 20.0).select("spectrum_id", F.round("ear", 5).alias("ear"))


_WORDS = "CASE " + " ".join(f"WHEN contains(lower(p_name), '{w}') THEN '{c}'" for w, c in library.FIELD_FILE_WORDS) + " ELSE 'other' END"


@query(f"SELECT p_partkey, {_WORDS} AS category FROM part")
def category_keywords(spark, d):
    return v.table(spark, d, "part").select("p_partkey", library.category_of(F.col("p_name"), library.FIELD_FILE_WORDS).alias("category"))


@query()
def purest_pixels(spark, d):
    return library.purest_pixels(v.px(spark, d), 10, 200, 1).select("row", "col", "hits")


@query(f'WITH {v.PX}, {v.FRACTIONS}, k AS (SELECT r, c, rmse, 1 - shade AS lit, {", ".join(f"least(greatest({n} / (1 - shade), 0), 1) AS {n}" for n in ("char", "pv", "npv", "soil"))} FROM fr WHERE TRUE) SELECT r AS "row", c AS "col", {", ".join(f"round({n} / (char + pv + npv + soil), 6) AS {n}" for n in ("char", "pv", "npv", "soil"))} FROM k')
def normalize_fractions(spark, d):
    out = indices.normalize_fractions(v.fractions(spark, d))
    return out.select("row", "col", *[r6(c).alias(c) for c in ("char", "pv", "npv", "soil")])


@query(f'WITH {v.PX}, {v.FRACTIONS}, k AS (SELECT *, rmse <= 0.025 AND char BETWEEN 0.05 AND 0.6 AND pv BETWEEN 0.05 AND 0.6 AND npv BETWEEN 0.05 AND 0.6 AND soil BETWEEN 0.05 AND 0.6 AND shade BETWEEN 0.05 AND 0.6 AS ok FROM fr) SELECT r AS "row", c AS "col", CASE WHEN ok THEN round(char, 6) END AS char, CASE WHEN ok THEN round(rmse, 6) END AS rmse FROM k')
def post_constraints(spark, d):
    out = indices.post_constraints(v.fractions(spark, d), min_fraction=0.05, max_fraction=0.6)
    return out.select("row", "col", r6("char").alias("char"), r6("rmse").alias("rmse"))


@query(f'WITH {v.PX}, {v.FRACTIONS}, q AS (SELECT min(char) AS c0, max(char) AS c1, min(pv) AS p0, max(pv) AS p1, min(soil) AS s0, max(soil) AS s1 FROM fr) SELECT r AS "row", c AS "col", round((char - c0) / (c1 - c0), 6) AS char, round((pv - p0) / (p1 - p0), 6) AS pv, round((soil - s0) / (s1 - s0), 6) AS soil FROM fr, q')
def fraction_composite(spark, d):
    out = indices.fraction_composite(v.fractions(spark, d))
    return out.select("row", "col", *[r6(c).alias(c) for c in ("char", "pv", "soil")])


@query(f'WITH {v.PX}, i AS (SELECT r, c, {v.band(660)} AS a, {v.band(560)} AS b, {v.band(470)} AS d FROM px), q AS (SELECT quantile_cont(a, 0.02) AS a0, quantile_cont(a, 0.98) AS a1, quantile_cont(b, 0.02) AS b0, quantile_cont(b, 0.98) AS b1, quantile_cont(d, 0.02) AS d0, quantile_cont(d, 0.98) AS d1 FROM i) SELECT r AS "row", c AS "col", round(least(greatest((a - a0) / greatest(a1 - a0, 1e-6), 0), 1), 6) AS red, round(least(greatest((b - b0) / greatest(b1 - b0, 1e-6), 0), 1), 6) AS green, round(least(greatest((d - d0) / greatest(d1 - d0, 1e-6), 0), 1), 6) AS blue FROM i, q')
def true_colour(spark, d):
    return indices.true_colour(v.px(spark, d), "spectrum", v.BANDS).select("row", "col", *[r6(c).alias(c) for c in ("red", "green", "blue")])


_TWO = "two AS (SELECT (SELECT s FROM lib ORDER BY id LIMIT 1) AS e1, (SELECT s FROM lib ORDER BY id DESC LIMIT 1) AS e2)"
_G = {"g11": ("e1", "e1"), "g12": ("e1", "e2"), "g22": ("e2", "e2"), "h1": ("e1", "s"), "h2": ("e2", "s"), "ss": ("s", "s")}


@query(
    f"WITH {v.PX}, {v.LIB}, {_TWO}, g AS (SELECT r, c, {', '.join(f'{_DOT.format(a=a, b=b)} AS {n}' for n, (a, b) in _G.items())} FROM px, two), "
    'u AS (SELECT *, (h1 * g22 - h2 * g12) / (g11 * g22 - g12 * g12) AS a, (h2 * g11 - h1 * g12) / (g11 * g22 - g12 * g12) AS b FROM g), '
    'w AS (SELECT *, CASE WHEN a >= 0 AND b >= 0 THEN a WHEN b < 0 THEN greatest(h1 / g11, 0) ELSE 0 END AS x1, CASE WHEN a >= 0 AND b >= 0 THEN b WHEN b < 0 THEN 0 ELSE greatest(h2 / g22, 0) END AS x2 FROM u) '
    'SELECT r AS "row", c AS "col", round(x1 / (x1 + x2), 5) AS f1, round(x2 / (x1 + x2), 5) AS f2 FROM w'
)
def nnls_unmix(spark, d):
    lib = v.lib(spark, d)
    ends = lib.orderBy("spectrum_id").limit(1).withColumn("category", F.lit("f1")).unionByName(lib.orderBy(F.desc("spectrum_id")).limit(1).withColumn("category", F.lit("f2")))
    out = unmix.unmix(v.px(spark, d).select("row", "col", "spectrum"), ends, "nnls", unmix.Constraints(max_rmse=10.0))
    return out.select("row", "col", F.round("f1", 5).alias("f1"), F.round("f2", 5).alias("f2"))


_BEST = "SELECT *, sqrt(greatest(ss - f * h, 0) / 64) AS rmse"


@query(f"WITH {v.PX}, {v.LIB}, m AS (SELECT px.r, px.c, lib.id, lib.category, {_DOT.format(a='px.s', b='lib.s')} / {_DOT.format(a='lib.s', b='lib.s')} AS f, {_DOT.format(a='px.s', b='lib.s')} AS h, {_DOT.format(a='px.s', b='px.s')} AS ss FROM px, lib), e AS ({_BEST} FROM m), k AS (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY rmse) AS n FROM e WHERE f BETWEEN -0.050000001 AND 1.050000001 AND 1 - f BETWEEN -1e-9 AND 0.800000001 AND rmse <= 10) SELECT px.r AS \"row\", px.c AS \"col\", round(1 - f, 5) AS shade, round(rmse, 5) AS rmse FROM px LEFT JOIN k ON px.r = k.r AND px.c = k.c AND n = 1")
def mesma_unmix(spark, d):
    out = unmix.unmix(v.px(spark, d).select("row", "col", "spectrum"), v.lib(spark, d), "mesma", unmix.Constraints(max_rmse=10.0), levels=(2,))
    return out.select("row", "col", F.round("shade", 5).alias("shade"), F.round("rmse", 5).alias("rmse"))


_THREE = (
    f"WITH {v.PX}, {v.LIB.replace('n <= 6', 'n <= 2')}, h AS (SELECT px.r, px.c, lib.id, lib.category, {_DOT.format(a='px.s', b='lib.s')} AS h, {_DOT.format(a='lib.s', b='lib.s')} AS g FROM px, lib), sq AS (SELECT r, c, {_DOT.format(a='s', b='s')} AS ss FROM px), "
    f"g AS (SELECT a.id AS i, b.id AS j, {_AB} AS g FROM lib a JOIN lib b ON a.category < b.category), "
    "two AS (SELECT a.r, a.c, (a.h * b.g - b.h * g.g) / (a.g * b.g - g.g * g.g) AS f1, (b.h * a.g - a.h * g.g) / (a.g * b.g - g.g * g.g) AS f2, a.h AS h1, b.h AS h2 FROM g JOIN h a ON a.id = g.i JOIN h b ON b.id = g.j AND a.r = b.r AND a.c = b.c WHERE a.g * b.g - g.g * g.g > 1e-9 * a.g * b.g), "
    "m AS (SELECT r, c, h / g AS f1, h / g AS f2, 1 - h / g AS shade, h * h / g AS fit FROM h UNION ALL SELECT r, c, f1, f2, 1 - f1 - f2, f1 * h1 + f2 * h2 FROM two), "
    "e AS (SELECT m.*, sqrt(greatest(ss - fit, 0) / 64) AS rmse FROM m JOIN sq USING (r, c)), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY rmse) AS n FROM e WHERE f1 BETWEEN -0.050000001 AND 1.050000001 AND f2 BETWEEN -0.050000001 AND 1.050000001 AND shade BETWEEN -1e-9 AND 0.800000001 AND rmse <= 0.2) "
    'SELECT px.r AS "row", px.c AS "col", round(shade, 5) + CAST(0 AS DOUBLE) AS shade, round(rmse, 5) AS rmse FROM px LEFT JOIN k ON px.r = k.r AND px.c = k.c AND n = 1'
)


@query(_THREE)
def mesma_three(spark, d):
    out = unmix.unmix(v.px(spark, d).select("row", "col", "spectrum"), v.lib(spark, d, 2), "mesma", unmix.Constraints(max_rmse=0.2))
    return out.select("row", "col", (F.round("shade", 5) + 0.0).alias("shade"), F.round("rmse", 5).alias("rmse"))


@query()
def fraction_trajectories(spark, d):
    first, second = v.grids(spark, d)
    scenes = {"2025-01-01": (v.px(spark, d), first), "2025-03-01": (v.px2(spark, d), second)}
    out = severity.trajectories(scenes, v.lib(spark, d, 2), engine="mesma", constraints=unmix.Constraints(max_rmse=10.0), levels=(2,))
    return out.select("ts", "row", "col", F.round("shade", 5).alias("shade"), F.round("rmse", 5).alias("rmse"))


# --- models


@query()
def rf_severity(spark, d):
    f = v.fractions(spark, d).withColumn("target", 3 * F.col("char"))
    trained = severity.train_regressor(f, "target", ["row", "col"], trees=10, folds=2)
    return severity.predict(f, trained).select("row", "col", F.round("cbi", 4).alias("cbi"), "severity")


@query()
def rf_classifier(spark, d):
    f = v.fractions(spark, d).withColumn("target", F.when(F.col("char") > 0.2, 1).otherwise(0))
    trained = severity.train_classifier(f, "target", trees=10, folds=2)
    return severity.predict(f, trained).select("row", "col", "severity")


@query()
def plsr_predict(spark, d):
    p = v.px(spark, d).withColumn("lfmc", 100 * at(F.col("spectrum"), 20) + 60 * at(F.col("spectrum"), 40))
    pls = moisture.train_pls(p, "spectrum", "lfmc", F.col("vec_id") % 5)
    return moisture.predict_lfmc(p.select("row", "col", "spectrum"), pls).select("row", "col", F.round("lfmc", 3).alias("lfmc"), "low_lfmc")


# --- SQL functions


@query(f"WITH {v.BIG} SELECT l_orderkey, l_linenumber, round({v.nd('b1', 'b4')}, 6) AS nd, (b3 >= 0.1)::INT + (b3 >= 0.27)::INT + (b3 >= 0.44)::INT + (b3 >= 0.66)::INT AS cls FROM big")
def sql_functions(spark, d):
    sqlfunctions.register(spark)
    return v.big(spark, d).select("l_orderkey", "l_linenumber", r6(F.expr("lw_nd(b1, b4)")).alias("nd"), F.expr("lw_dnbr_class(b3)").alias("cls"))


# --- provenance, catalog, streaming


_KNOWN = "known(scene_id, n) AS (VALUES ('s0', 0), ('s1', 1), ('s2', 2)), it AS (SELECT o_orderkey, 's' || (o_orderkey % 5) AS scene_id FROM orders)"


@query(f"WITH {_KNOWN} SELECT o_orderkey, CASE n WHEN 0 THEN 'pre-fire' WHEN 1 THEN 'post-fire' END AS phase FROM it LEFT JOIN known USING (scene_id) WHERE coalesce(n, 0) <> 2")
def scene_phases(spark, d):
    known = spark.createDataFrame([("s0", "pre-fire", "a", -1), ("s1", "post-fire", "a", 3), ("s2", "other", None, None)], "scene_id string, phase string, fire_complex string, days_relative_to_ignition int")
    items = v.table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("s"), (F.col("o_orderkey") % 5).cast("string")).alias("scene_id"), F.col("o_orderdate").alias("datetime"))
    return catalog.with_phases(items, known).select("o_orderkey", "phase")


_MEDIANS = "med(m, x) AS (VALUES " + ", ".join(f"({m}, {x})" for m, x in provenance.MONTHLY_LFMC.items()) + ")"


@query(f"WITH {_MEDIANS} SELECT o_orderkey, coalesce(o_totalprice / 1000 BETWEEN x / CAST(2 AS DOUBLE) AND x * CAST(2 AS DOUBLE), FALSE) AS plausible FROM orders LEFT JOIN med ON month(o_orderdate) = m")
def lfmc_range_check(spark, d):
    return v.table(spark, d, "orders").select("o_orderkey", provenance.plausible_lfmc(F.col("o_totalprice") / 1000, F.month("o_orderdate")).alias("plausible"))


_CLAIMS = "cl AS (SELECT s_name AS claim_key, CASE WHEN s_suppkey % 3 <> 0 THEN 'part' || (s_suppkey % 50) END AS backing, CASE WHEN s_suppkey % 4 = 1 THEN 'none' ELSE 'partial' END AS independence, s_suppkey % 5 = 0 AS synthetic FROM supplier), ar AS (SELECT 'part' || n_nationkey AS artifact_key, CASE WHEN n_nationkey % 6 = 0 THEN 'unverifiable' ELSE 'verified' END AS status FROM nation), j AS (SELECT cl.*, artifact_key, status FROM cl LEFT JOIN ar ON backing = artifact_key)"


@query(
    f"WITH {_CLAIMS} SELECT claim_key, 'error' AS severity, 'backing artifact not found' AS finding FROM j WHERE backing IS NOT NULL AND artifact_key IS NULL UNION ALL "
    "SELECT claim_key, 'warning', 'backing artifact unverifiable' FROM j WHERE status = 'unverifiable' UNION ALL SELECT claim_key, 'error', 'no backing artifact and not synthetic' FROM j WHERE backing IS NULL AND NOT synthetic UNION ALL "
    "SELECT claim_key, 'error', 'independence none and not synthetic' FROM j WHERE independence = 'none' AND NOT synthetic"
)
def audit_claims(spark, d):
    k = F.col("s_suppkey")
    claims = v.table(spark, d, "supplier").select(F.col("s_name").alias("claim_key"), F.when(k % 3 != 0, F.concat(F.lit("part"), (k % 50).cast("string"))).alias("backing_artifact"), F.when(k % 4 == 1, "none").otherwise("partial").alias("independence"), (k % 5 == 0).alias("synthetic"))
    artifacts = v.table(spark, d, "nation").select(F.concat(F.lit("part"), F.col("n_nationkey").cast("string")).alias("artifact_key"), F.when(F.col("n_nationkey") % 6 == 0, "unverifiable").otherwise("verified").alias("provenance_status"))
    return provenance.audit_claims(claims, artifacts)


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-02' AND ts <= TIMESTAMP '2024-01-20'")
def scene_filter(spark, d):
    e = v.table(spark, d, "events").withColumn("datetime", F.col("ts"))
    return catalog.between(e, "2024-01-02", "2024-01-20").select("event_id")


_PHASES = "CASE WHEN k < 0 THEN 'pre-fire' WHEN k <= 30 THEN 'post-fire' WHEN k <= 120 THEN 'early-recovery' WHEN k <= 270 THEN 'mid-recovery' WHEN k <= 365 THEN 'late-recovery' ELSE 'other' END"


@query(f"WITH o AS (SELECT o_orderkey, date_diff('day', DATE '1995-06-01', CAST(o_orderdate AS DATE)) AS k FROM orders) SELECT o_orderkey, {_PHASES} AS phase FROM o")
def fire_phase(spark, d):
    return v.table(spark, d, "orders").select("o_orderkey", catalog.phase(F.datediff(F.to_date("o_orderdate"), F.lit("1995-06-01").cast("date"))).alias("phase"))


@query("SELECT date_trunc('day', ts) AS window_start, event_type AS cls, count(value) AS n, round(avg(value), 6) AS v_mean FROM events GROUP BY ALL")
def streaming_trajectory(spark, d):
    return live.run_once(spark, f"{d}/events.parquet", "ts", "event_type", "value").select("window_start", F.col("cls"), "n", r6("v_mean").alias("v_mean"))


@query(f"WITH {v.PX} SELECT min(350015 + 30 * c)::DOUBLE - 15 AS left_edge, max(350015 + 30 * c)::DOUBLE + 15 AS right_edge, min(3759985 - 30 * r)::DOUBLE - 15 AS bottom, max(3759985 - 30 * r)::DOUBLE + 15 AS top FROM px")
def map_extent(spark, d):
    from lumenweave.operators import display

    x, y = v.GRID.centres(F.col("row"), F.col("col"))
    return display.extent(v.px(spark, d).withColumns({"x": x, "y": y}))


# The queries of files register themselves with the helpers above.
from lumenweave.plans import files  # noqa: E402, F401
