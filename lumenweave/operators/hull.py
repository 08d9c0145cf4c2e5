"""Continuum removal: a spectrum over its upper convex hull.

The kernel works on Arrow batches, all spectra of a batch at once. NULL spectra, and spectra with a NULL band, give
NULL; a hull of zero gives NULL bands; fewer than three bands give ones.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenweave.functions.bands import Bands, take
from lumenweave.functions.kernels import block_of_spectra, spectra_block
from lumenweave.operators.indices import DEPTH_TARGETS, clamp

#: Numbers of a batch's spectra that are worked on at a time.
BLOCK = 1 << 20


def hull_vertices(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which bands of each spectrum (a row of ``y``) are corners of its upper hull."""
    n, m = y.shape
    corner = np.zeros((n, m), np.int64)
    size = np.zeros(n, np.int64)
    rows = np.arange(n)
    for i in range(m):
        check = rows[size > 1]
        while len(check):
            b, a = corner[check, size[check] - 1], corner[check, size[check] - 2]
            ya, yb, yi = y[check, a], y[check, b], y[check, i]
            # b is no corner if it lies on or below the line from a to i.
            below = (x[b] - x[a]) * (yi - ya) >= (yb - ya) * (x[i] - x[a])
            check = check[below]
            size[check] -= 1
            check = check[size[check] > 1]
        corner[rows, size] = i
        size += 1
    out = np.zeros((n, m), bool)
    held = np.arange(m)[None, :] < size[:, None]
    out[np.repeat(rows, size), corner[held]] = True
    return out


def remove_continuum(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``y`` over its hull, at most 1; NaN where the hull is zero or the spectrum has a NaN."""
    n, m = y.shape
    if m < 3:
        return np.where(np.isnan(y).any(1, keepdims=True), np.nan, 1.0) * np.ones_like(y)
    broken = ~np.isfinite(y).all(1)
    z = np.where(broken[:, None], 0.0, y)
    at = hull_vertices(x, z)
    k = np.arange(m)
    left = np.maximum.accumulate(np.where(at, k, 0), axis=1)
    right = np.minimum.accumulate(np.where(at, k, m - 1)[:, ::-1], axis=1)[:, ::-1]
    yl, yr = np.take_along_axis(z, left, 1), np.take_along_axis(z, right, 1)
    span = np.where(right > left, x[right] - x[left], 1.0)
    hull = yl + (yr - yl) * (x[k] - x[left]) / span
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.where(hull != 0, np.minimum(z / hull, 1.0), np.nan)
    out[broken] = np.nan
    return out


def continuum_removal(df: DataFrame, bands: Bands, spectrum: str = "spectrum", output: str = "cr", low: float | None = None, high: float | None = None) -> tuple[DataFrame, Bands]:
    """``df`` with the continuum-removed spectrum of the bands in [low, high] (all without a range)."""
    found = list(range(len(bands))) if low is None and high is None else bands.within(low, high)
    kept = bands.take(found)
    x = np.array(kept.wavelengths)
    source = df.withColumn(output, take(F.col(spectrum), found).cast("array<double>"))
    at, schema = source.columns.index(output), T.StructType([f for f in source.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, BLOCK // max(1, len(x)))
        for batch in batches:
            for s in range(0, batch.num_rows, step):
                part = batch.slice(s, step)
                y = spectra_block(part.column(at), len(x))
                column = block_of_spectra(remove_continuum(x, y), part.column(at).is_valid().to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([column if i == at else c for i, c in enumerate(part.columns)], names=part.schema.names)

    return source.mapInArrow(run, schema), kept


def depths(df: DataFrame, bands: Bands, spectrum: str = "spectrum", targets: Sequence[float] = DEPTH_TARGETS, low: float = 800.0, high: float = 2400.0, output: str = "cr_depths") -> DataFrame:
    """``df`` with a map from each target wavelength to 1 - (continuum removed) at its nearest band."""
    clamped = df.withColumn("_clamped", clamp(F.col(spectrum).cast("array<double>")))
    removed, kept = continuum_removal(clamped, bands, "_clamped", "_cr", low, high)
    pairs = [x for t in targets for x in (F.lit(float(t)), 1 - F.get("_cr", F.lit(kept.nearest(t))))]
    return removed.withColumn(output, F.create_map(*pairs)).drop("_clamped", "_cr")
