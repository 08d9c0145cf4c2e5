"""Registered raster queries on a table of more rows than the smallest ones have, against brute force."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lumenweave.plans import views as v
from lumenweave.plans.queries import QUERIES

N, WIDTH = 25 * 31, 25
ROWS = N // WIDTH


@pytest.fixture(scope="module")
def whole(tmp_path_factory):
    d = tmp_path_factory.mktemp("whole")
    rng = np.random.default_rng(3)
    x = rng.uniform(-0.4, 0.4, (N, 64)).astype(np.float32)
    label = rng.integers(0, 10, N).astype(np.int32)
    pq.write_table(pa.table({"vec_id": pa.array(range(N), pa.int64()), "embedding": pa.array(x.tolist(), pa.list_(pa.float32())), "label": pa.array(label)}), d / "embeddings.parquet")
    return str(d), x.astype(float) + 0.5, label


def nbr(s):
    a, b = (np.clip(s[..., v.BANDS.nearest(w)], 0, 1) for w in (860, 2200))
    return np.where(np.abs(a + b) >= 1e-3, (a - b) / (a + b), np.nan)


def got(spark, d, name, *values):
    rows = QUERIES[name](spark, d).collect()
    out = {(r["row"], r["col"]): tuple(r[x] for x in values) for r in rows}
    assert len(out) == len(rows)
    return out


def same(found, want):
    assert found.keys() == want.keys()
    assert all(np.allclose(np.array(found[k], float), np.array(want[k], float), atol=2e-6, equal_nan=True) for k in want)


def test_severity_of_all_rows(spark, whole):
    d, s, _ = whole
    pre = nbr(s).reshape(ROWS, WIDTH)
    post = nbr(s * np.where(np.array(v.BANDS.wavelengths) < v.FAR, 0.8, 0.5)).reshape(ROWS, WIDTH)
    want = {(r, c): (pre[r + 2, c + 3], post[r, c], pre[r + 2, c + 3] - post[r, c]) for r in range(ROWS - 2) for c in range(WIDTH - 3)}
    same(got(spark, d, "dnbr_aligned", "nbr_pre", "nbr_post", "dnbr"), want)
    classes = {k: sum(x[2] >= t for t in (0.1, 0.27, 0.44, 0.66)) for k, x in want.items()}
    same(got(spark, d, "severity_from_dnbr", "severity"), {k: (c,) for k, c in classes.items()})
    n = {r.severity: r.n for r in QUERIES["severity_histogram"](spark, d).collect()}
    assert n == {c: list(classes.values()).count(c) for c in set(classes.values())}


def test_blocks_of_all_rows(spark, whole):
    d, s, label = whole
    x = nbr(s).reshape(ROWS, WIDTH)
    same(got(spark, d, "coarsen", "nbr"), {(r, c): (x[3 * r : 3 * r + 3, 4 * c : 4 * c + 4].mean(),) for r in range(ROWS // 3) for c in range(WIDTH // 4)})
    same(got(spark, d, "aggregate_to_grid", "nbr"), {(r, c): (x[2 * r + 2 : 2 * r + 4, 2 * c + 2 : 2 * c + 4].mean(),) for r in range(ROWS // 2 - 1) for c in range(10)})
    codes = label.reshape(ROWS, WIDTH)
    same(got(spark, d, "align_classes", "code"), {(r, c): (codes[2 * r + 1, 2 * c + 1] if 2 * c + 1 < WIDTH else -1,) for r in range(ROWS // 2) for c in range(20)})
    assert set(got(spark, d, "reproject_cubic", "nbr")) == {(r, c) for r in range(ROWS - 2) for c in range(WIDTH - 2)}


def test_trajectories_of_all_rows(spark, whole):
    rows = [(str(r.ts)[:10], r.row, r.col) for r in QUERIES["fraction_trajectories"](spark, whole[0]).collect()]
    assert sorted(rows) == sorted((t, r, c) for t in ("2025-01-01", "2025-03-01") for r in range(ROWS - 2) for c in range(WIDTH - 3))


def hull_ratio(x, y):
    """Over the highest chord at each band, by all pairs of bands."""
    top = [max(y[j] if j == k else y[j] + (y[k] - y[j]) * (x[i] - x[j]) / (x[k] - x[j]) for j in range(i + 1) for k in range(i, len(x)) if j < k or j == i == k) for i in range(len(x))]
    return np.minimum(y / np.array(top), 1)


def test_continuum_of_all_pixels(spark, whole):
    d, s, _ = whole
    found = got(spark, d, "continuum_removal_all", "cr_sum", "cr_min")
    assert set(found) == {(r, c) for r in range(ROWS) for c in range(WIDTH)}
    kept = v.BANDS.within(800, 2400)
    x = np.array(v.BANDS.wavelengths)[kept]
    for i in range(0, N, 97):
        cr = hull_ratio(x, np.clip(s[i][kept], 0, 1))
        assert np.allclose(found[i // WIDTH, i % WIDTH], (cr.sum(), cr.min()), atol=2e-5)


def test_libraries_of_all_spectra(spark, whole):
    d, s, label = whole
    lib = np.clip(s, 0, 1)
    ids = [f"s{i:05d}" for i in range(N)]
    assert {r.spectrum_id for r in QUERIES["resample_library_all"](spark, d).collect()} == set(ids)
    merged = {r.spectrum_id: r.s_sum for r in QUERIES["hybrid_merge_all"](spark, d).collect()}
    want = dict(zip(ids, lib.sum(1))) | {f"{ids[i]}_dup1": lib[i].sum() for i in np.flatnonzero(np.isin(label, (1, 2)))}
    assert merged.keys() == want.keys() and all(abs(merged[k] - want[k]) < 1e-5 for k in want)
    best = {ids[i] for c in set(label) for i in sorted(np.flatnonzero(label == c), key=lambda i: -lib[i].std())[:2]}
    assert {r.spectrum_id for r in QUERIES["incob_topk_all"](spark, d).collect()} == best
    groups = [lib[label == c] for c in sorted(set(label))]
    fisher = sum(len(g) * (g.mean(0) - lib.mean(0)) ** 2 for g in groups) / sum(len(g) * g.var(0) for g in groups)
    found = {r.band: r.fisher for r in QUERIES["band_separability_all"](spark, d).collect()}
    assert sorted(found) == list(range(64)) and np.allclose([found[b] for b in range(64)], fisher, atol=2e-6)
    assert sorted(r.band for r in QUERIES["uszu_bands_all"](spark, d).collect()) == [z + int(fisher[z : z + 4].argmax()) for z in range(0, 64, 4)]


@pytest.fixture(scope="module")
def ragged(tmp_path_factory):
    """A folder and its cells: rows of two strips, the last one short, some cells and a whole row missing."""
    d = tmp_path_factory.mktemp("ragged")
    ids = [i for i in range(WIDTH * 66 + 6) if i not in (3, 40) and i // WIDTH != 9]
    # Every seventh spectrum is of zeros, which have no index.
    spectra = [[-0.5 if i % 7 == 0 else (i * 31 + b * 17) % 80 / 100 - 0.4 for b in range(64)] for i in ids]
    pq.write_table(pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(spectra, pa.list_(pa.float32())), "label": pa.array([i % 10 for i in ids], pa.int32())}), d / "embeddings.parquet")
    return str(d), ids, np.array(spectra, np.float32).astype(float) + 0.5


def test_class_raster_gives_the_cells_of_the_table(spark, ragged):
    d, ids, _ = ragged
    assert got(spark, d, "class_raster", "code") == {divmod(i, WIDTH): ((0, 1, 1, 4, -1)[i % 5],) for i in ids}


def test_geotiff_product_gives_the_cells_of_the_table(spark, ragged):
    d, ids, s = ragged
    x = nbr(s)
    found = got(spark, d, "geotiff_product", "nbr")
    assert np.isnan(x).sum() > 100 and found.keys() == {divmod(i, WIDTH) for i in ids}
    assert all(found[divmod(i, WIDTH)] == (None,) if np.isnan(y) else abs(found[divmod(i, WIDTH)][0] - y) < 1e-5 for i, y in zip(ids, x))
