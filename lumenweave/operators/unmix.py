"""Spectral unmixing in Arrow kernels: multiple-endmember models with photometric shade, and non-negative least squares.

The library is small (bands x tens of spectra) and travels to the tasks with the kernel; pixels never leave theirs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenweave.functions.bands import Bands, take
from lumenweave.functions.kernels import spectra_block
from lumenweave.operators.indices import CANONICAL, post_constraints

#: Models above which a search is refused, and numbers of a block of pixels.
MOST_MODELS, BLOCK = 50_000, 1 << 21
#: By how much rounding may carry a fraction over its bound: a pixel equal to its endmember has no shade at all.
SLACK = 1e-9


@dataclass(frozen=True)
class Constraints:
    min_fraction: float = -0.05
    max_fraction: float = 1.05
    min_shade: float = 0.0
    max_shade: float = 0.8
    max_rmse: float = 0.025


def collect_library(library: DataFrame) -> tuple[np.ndarray, list[str]]:
    """Spectra (bands x spectra, in order of their ids) and their categories."""
    rows = library.select("spectrum_id", "category", F.col("spectrum").cast("array<double>").alias("s")).orderBy("spectrum_id").collect()
    return np.array([r.s for r in rows]).T, [r.category for r in rows]


def nearest_library_bands(bands: Bands, library: Bands) -> list[int]:
    """For each library band the nearest band of the scene."""
    return [bands.nearest(w) for w in library.wavelengths]


def models_of(categories: Sequence[str], levels: Sequence[int]) -> list[tuple[int, ...]]:
    """Column numbers of each model: ``level`` - 1 spectra of as many categories, shade being the level's last part."""
    by_class: dict[str, list[int]] = {}
    for i, c in enumerate(categories):
        if c != "shade":
            by_class.setdefault(c, []).append(i)
    found = [m for level in levels for some in combinations(sorted(by_class), level - 1) for m in product(*(by_class[c] for c in some))]
    if len(found) > MOST_MODELS:
        raise ValueError(f"{len(found)} models exceed {MOST_MODELS}; thin the library out or lower the levels")
    return found


def mesma_block(pixels: np.ndarray, library: np.ndarray, models: Sequence[tuple[int, ...]], c: Constraints) -> tuple[np.ndarray, np.ndarray]:
    """(fractions of all library columns with shade last, rmse) by the best model; NaN where none fits."""
    n = len(pixels)
    best, out = np.full(n, np.inf), np.full((n, library.shape[1] + 1), np.nan)
    square = (pixels**2).sum(1)
    for m in models:
        e = library[:, m]
        gram = e.T @ e
        if np.linalg.matrix_rank(gram) < len(m):
            continue
        cross = pixels @ e
        f = cross @ np.linalg.inv(gram)
        rmse = np.sqrt(np.maximum(square - (f * cross).sum(1), 0) / library.shape[0])
        shade = 1 - f.sum(1)
        inside = (f >= c.min_fraction - SLACK).all(1) & (f <= c.max_fraction + SLACK).all(1) & (shade >= c.min_shade - SLACK) & (shade <= c.max_shade + SLACK)
        better = inside & (rmse < best - 1e-12) & (rmse <= c.max_rmse)
        best[better] = rmse[better]
        out[better] = 0
        out[np.ix_(better, m)] = f[better]
        out[better, -1] = shade[better]
    return out, np.where(np.isfinite(best), best, np.nan)


def nnls_block(pixels: np.ndarray, library: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Non-negative least squares of each pixel (a row): an active-set search, pixels with equal sets solved together."""
    n, k = len(pixels), library.shape[1]
    gram, cross = library.T @ library, pixels @ library
    x, passive = np.zeros((n, k)), np.zeros((n, k), bool)
    usable = np.diag(gram) > 0
    tolerance = 1e-10 * max(1.0, float(np.abs(cross).max(initial=0)))
    todo = np.arange(n)
    for _ in range(rounds):
        w = cross[todo] - x[todo] @ gram
        w[passive[todo] | ~usable] = -np.inf
        top = w.argmax(1)
        more = w[np.arange(len(todo)), top] > tolerance
        todo, top = todo[more], top[more]
        if not len(todo):
            break
        passive[todo, top] = True
        inner = todo
        while len(inner):
            s = np.zeros((len(inner), k))
            sets, which = np.unique(passive[inner], axis=0, return_inverse=True)
            for g, on in enumerate(sets):
                rows, at = np.flatnonzero(which.ravel() == g), np.flatnonzero(on)
                if len(at):
                    s[np.ix_(rows, at)] = np.linalg.lstsq(gram[np.ix_(at, at)], cross[np.ix_(inner[rows], at)].T, rcond=None)[0].T
            bad = passive[inner] & (s <= 0)
            fine = ~bad.any(1)
            x[inner[fine]] = s[fine]
            inner, s, bad = inner[~fine], s[~fine], bad[~fine]
            if len(inner):
                # As far towards s as no entry turns negative; what reaches zero leaves the set.
                with np.errstate(divide="ignore", invalid="ignore"):
                    step = np.where(bad, x[inner] / (x[inner] - s), np.inf)
                step[~np.isfinite(step)] = np.where(bad, 0.0, np.inf)[~np.isfinite(step)]
                a = step.min(1, keepdims=True)
                x[inner] += a * (s - x[inner])
                gone = bad & (step <= a)
                x[inner] = np.where(gone, 0.0, x[inner])
                passive[inner] &= ~gone
    return x


def fcls_block(pixels: np.ndarray, library: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fractions that sum to 1, rmse after that scaling); all-zero solutions stay as they are."""
    x = nnls_block(pixels, library)
    size = x.sum(1, keepdims=True)
    x = np.where(size > 1e-9, x / np.where(size > 1e-9, size, 1), x)
    return x, np.sqrt(((pixels - x @ library.T) ** 2).mean(1))


def unmix(df: DataFrame, library: DataFrame, engine: str = "mesma", constraints: Constraints = Constraints(), levels: Sequence[int] = (2, 3), positions: Sequence[int] | None = None, spectrum: str = "spectrum") -> DataFrame:
    """``df`` without its spectrum, with char, pv, npv, soil, shade, further categories and rmse.

    ``positions`` are the scene's bands that match the library's. The engine (mesma or nnls) is never switched.
    """
    spectra, categories = collect_library(library)
    if not len(categories):
        raise ValueError("the library is empty")
    classes = sorted(set(categories))
    names = list(CANONICAL) + [c for c in classes if c not in CANONICAL]
    if engine == "mesma":
        models = models_of(categories, levels)
        solve = lambda p: mesma_block(p, spectra, models, constraints)
    elif engine == "nnls":
        solve = lambda p: fcls_block(p, spectra)
    else:
        raise ValueError(engine)
    other = [f for f in df.schema.fields if f.name != spectrum]
    schema = T.StructType(other + [T.StructField(c, T.DoubleType()) for c in (*names, "rmse")])
    width = spectra.shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, BLOCK // max(1, width))
        for batch in batches:
            for s in range(0, batch.num_rows, step):
                part = batch.slice(s, step)
                n = part.num_rows
                pixels = spectra_block(part.column(part.schema.get_field_index(spectrum)), width)
                ok = np.isfinite(pixels).all(1)
                out = np.full((n, len(names) + 1), np.nan)
                if ok.any():
                    fractions, rmse = solve(pixels[ok])
                    held = np.zeros((len(fractions), len(names)))
                    for j, c in enumerate(names):
                        at = [i for i, x in enumerate(categories) if x == c]
                        held[:, j] = fractions[:, at].sum(1) if at else 0.0
                    if engine == "mesma":
                        held[:, names.index("shade")] = fractions[:, -1]
                        held[np.isnan(rmse)] = np.nan
                    out[ok, :-1], out[ok, -1] = held, rmse
                kept = [part.column(part.schema.get_field_index(f.name)) for f in other]
                yield pa.RecordBatch.from_arrays(kept + [pa.array(out[:, j], from_pandas=True) for j in range(out.shape[1])], names=[f.name for f in schema.fields])

    # Bands that no endmember has stay behind: only those of the library travel to the kernel.
    seen = F.col(spectrum) if positions is None else F.when(F.col(spectrum).isNotNull(), take(F.col(spectrum), positions))
    out = df.select(*[f.name for f in other], seen.cast("array<double>").alias(spectrum)).mapInArrow(run, schema)
    if engine == "nnls":
        out = post_constraints(out, names, constraints.max_rmse, constraints.min_fraction, constraints.max_fraction)
    return out
