"""Live fuel moisture: ground truth filters, partial least squares from distributed moments, prediction."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenweave.functions.kernels import spectra_block
from lumenweave.functions.missing import clip
from lumenweave.operators.masks import contains_any, in_bbox, in_range, near_any_date

#: Physical bounds and the low threshold, in percent.
LFMC_MIN, LFMC_MAX, LFMC_LOW = 0.0, 300.0, 60.0


def filter_sites(sites: DataFrame, bbox: tuple[float, float, float, float] | None = None, lfmc_range: tuple[float, float] | None = None, vegetation: Sequence[str] | None = None, dates: Sequence[str] = (), days: int = 30) -> DataFrame:
    """Sites in range, box (west, south, east, north) and vegetation, with ``colocated``: within ``days`` of a date."""
    out = sites.na.drop(subset=["latitude", "longitude", "date", "lfmc_percent"])
    if lfmc_range:
        out = out.filter(in_range(F.col("lfmc_percent"), *lfmc_range))
    if bbox:
        out = out.filter(in_bbox(F.col("longitude"), F.col("latitude"), *bbox))
    where = next((c for c in ("vegetation_type", "species") if c in sites.columns), None)
    if vegetation and where:
        out = out.filter(contains_any(F.col(where), vegetation))
    return out.withColumn("colocated", near_any_date(F.col("date"), dates, days))


@dataclass
class Moments:
    """Sums over samples of 1, x, y, xx', xy and yy."""

    n: float
    x: np.ndarray
    y: float
    xx: np.ndarray
    xy: np.ndarray
    yy: float

    def __add__(self, o: Moments) -> Moments:
        return Moments(self.n + o.n, self.x + o.x, self.y + o.y, self.xx + o.xx, self.xy + o.xy, self.yy + o.yy)

    def __sub__(self, o: Moments) -> Moments:
        return Moments(self.n - o.n, self.x - o.x, self.y - o.y, self.xx - o.xx, self.xy - o.xy, self.yy - o.yy)


def moments(df: DataFrame, x: str, y: str, fold: Column) -> dict[int, Moments]:
    """Moments by fold. A task sends one row a fold and band; their sums, (folds x bands) rows, reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            lengths = batch.column(1).value_lengths().drop_null()
            if not len(lengths):
                continue
            x, t = spectra_block(batch.column(1), lengths[0].as_py()), batch.column(2).to_numpy(zero_copy_only=False).astype(float)
            z = np.column_stack([np.ones(len(t)), x, t])
            folds, whole = batch.column(0).to_numpy(zero_copy_only=False), np.isfinite(z).all(1)
            for f in np.unique(folds[whole]).tolist():
                some = z[whole & (folds == f)]
                held[f] = held.get(f, 0) + some.T @ some
        for f, g in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([f] * len(g), pa.int32()), pa.array(range(len(g)), pa.int32()), pa.array(g.tolist(), pa.list_(pa.float64()))], names=["fold", "i", "v"])

    parts = df.select(fold.cast("int").alias("fold"), F.col(x).cast("array<double>").alias("x"), F.col(y).cast("double").alias("y")).mapInArrow(run, "fold int, i int, v array<double>")
    summed = parts.select("fold", "i", F.posexplode("v").alias("j", "v")).groupBy("fold", "i", "j").agg(F.sum("v").alias("v"))
    rows = summed.groupBy("fold", "i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda s: s["v"]).alias("v")).collect()
    out = {}
    for f in {r.fold for r in rows}:
        g = np.array([r.v for r in sorted((r for r in rows if r.fold == f), key=lambda r: r.i)])
        out[f] = Moments(g[0, 0], g[0, 1:-1], g[0, -1], g[1:-1, 1:-1], g[1:-1, -1], g[-1, -1])
    return out


@dataclass
class PLS:
    coef: np.ndarray
    intercept: float
    vip: np.ndarray
    n_components: int = 0
    r2: float = float("nan")
    rmse: float = 0.0
    n_samples: int = 0


def fit_pls(m: Moments, components: int) -> PLS:
    """Partial least squares for one target on centred, scaled bands, from moments alone (kernel algorithm)."""
    mx, my = m.x / m.n, m.y / m.n
    cxx, cxy = m.xx - m.n * np.outer(mx, mx), m.xy - m.n * mx * my
    syy = max(m.yy - m.n * my * my, 0.0)
    scale = np.sqrt(np.maximum(np.diag(cxx), 0) / max(m.n - 1, 1))
    scale[scale < 1e-12] = 1.0
    sy = np.sqrt(syy / max(m.n - 1, 1)) or 1.0
    a, b = cxx / np.outer(scale, scale), cxy / scale / sy
    p = len(b)
    weights, loadings, rotations, qs, gains = [], [], [], [], []
    left = b.copy()
    for _ in range(components):
        size = np.linalg.norm(left)
        if size < 1e-12:
            break
        w = left / size
        r = w.copy()
        for pj, rj in zip(loadings, rotations):
            r -= (pj @ w) * rj
        tt = float(r @ a @ r)
        if tt < 1e-12:
            break
        load, q = a @ r / tt, float(r @ b) / tt
        left = left - load * q * tt
        weights.append(w)
        loadings.append(load)
        rotations.append(r)
        qs.append(q)
        gains.append(tt * q * q)
    beta = sum((r * q for r, q in zip(rotations, qs)), np.zeros(p)) * sy / scale
    total = sum(gains)
    vip = np.sqrt(p * sum((g * w**2 for g, w in zip(gains, weights)), np.zeros(p)) / total) if total > 0 else np.zeros(p)
    return PLS(beta, float(my - mx @ beta), vip, len(weights), n_samples=int(m.n))


def squared_error(m: Moments, pls: PLS) -> float:
    """Sum of squared errors over the samples behind the moments."""
    b, c = pls.coef, pls.intercept
    return float(m.yy - 2 * (b @ m.xy + c * m.y) + b @ m.xx @ b + 2 * c * (b @ m.x) + m.n * c * c)


def train_pls(df: DataFrame, x: str, y: str, fold: Column, most_components: int = 10) -> PLS:
    """The model whose number of components has the least cross-validated error (the smaller of equals). One pass over the data."""
    parts = moments(df, x, y, fold)
    if not parts:
        raise ValueError("no samples")
    whole = sum(list(parts.values())[1:], list(parts.values())[0])
    n, p = int(whole.n), len(whole.x)
    best, found = None, None
    for k in range(1, max(1, min(most_components, n - 1, p)) + 1):
        sse = sum(squared_error(m, fit_pls(whole - m, k)) for m in parts.values()) if len(parts) > 1 else squared_error(whole, fit_pls(whole, k))
        if best is None or sse < best - 1e-12:
            best, found = sse, k
    out = fit_pls(whole, found)
    sst = whole.yy - whole.y**2 / whole.n
    out.rmse, out.r2, out.n_components = float(np.sqrt(max(best, 0) / n)), float(1 - best / sst) if sst > 0 else float("nan"), found
    return out


def predict_lfmc(df: DataFrame, pls: PLS, spectrum: str = "spectrum") -> DataFrame:
    """``df`` with lfmc (held to 0..300), its uncertainty and low_lfmc; all in JVM expressions."""
    coef = F.split(F.lit(",".join(repr(float(c)) for c in pls.coef)), ",").cast("array<double>")
    value = F.aggregate(F.zip_with(F.col(spectrum), coef, lambda v, c: v * c), F.lit(pls.intercept), lambda s, v: s + v)
    ok = F.when(F.size(spectrum) != len(pls.coef), F.raise_error(F.lit(f"the model needs {len(pls.coef)} bands")).cast("boolean")).otherwise(F.lit(True))
    lfmc = F.when(ok, clip(value, LFMC_MIN, LFMC_MAX))
    return df.withColumn("lfmc", lfmc).withColumns({"lfmc_uncertainty": F.when(F.col("lfmc").isNotNull(), F.lit(pls.rmse)), "low_lfmc": F.coalesce(F.col("lfmc") < LFMC_LOW, F.lit(False))})
