"""Band algebra: selection, clamping, spectral indices, water absorption, fractions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenweave.functions.arrays import total
from lumenweave.functions.bands import ALIASES, Bands, at, take
from lumenweave.functions.missing import clip, normalized_difference, ratio
from lumenweave.functions.quantiles import with_quantiles

#: Centre (target, left, right) of the absorption indices, far bands of the water indices, targets of depths (nm).
SAI = {"SAI970": (970, 850, 1100), "SAI1200": (1200, 1080, 1320)}
NDWI_FAR = (1240, 1640, 2130)
DEPTH_TARGETS = (970.0, 1200.0, 1700.0, 2100.0)
LFMC_AXIS = (860, 2130)
CANONICAL = ("char", "pv", "npv", "soil", "shade")


def select_bands(spectrum: Column, bands: Bands, low: float | None = None, high: float | None = None, wavelengths: Sequence[float] | None = None) -> tuple[Column, Bands]:
    """The spectrum and bands of a closed range or of the bands nearest to ``wavelengths`` (order and repeats kept)."""
    if (wavelengths is None) == (low is None and high is None):
        raise ValueError("give either a range or wavelengths")
    found = [bands.nearest(w) for w in wavelengths] if wavelengths is not None else bands.within(low, high)
    return take(spectrum, found), bands.take(found)


def mask_bad_bands(spectrum: Column, bands: Bands, zones: Sequence[tuple[float, float]] | None = None, good: Sequence[bool] | None = None) -> tuple[Column, Bands]:
    """The spectrum and bands outside unusable zones and flagged good."""
    found = bands.usable(zones, good)
    return take(spectrum, found), bands.take(found)


def clamp(spectrum: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.transform(spectrum, lambda v: clip(v, low, high))


def reflectance(spectrum: Column, bands: Bands, wavelength: float) -> Column:
    """The nearest band, held to [0, 1]."""
    return clip(at(spectrum, bands.nearest(wavelength)))


def _index(spectrum: Column, bands: Bands, a: str, b: str) -> Column:
    return normalized_difference(reflectance(spectrum, bands, ALIASES[a]), reflectance(spectrum, bands, ALIASES[b]))


def nbr(spectrum: Column, bands: Bands) -> Column:
    return _index(spectrum, bands, "NIR", "SWIR2")


def ndvi(spectrum: Column, bands: Bands) -> Column:
    return _index(spectrum, bands, "NIR", "RED")


def ndwi(spectrum: Column, bands: Bands) -> Column:
    return _index(spectrum, bands, "GREEN", "NIR")


def sai(spectrum: Column, bands: Bands, target: float, left: float, right: float) -> Column:
    """Depth at ``target`` below the straight line between the shoulders, held to [0, 1]."""
    low, high = bands.wavelengths[0], bands.wavelengths[-1]
    t, a, b = (bands.nearest(w, "first") for w in (target, left, right))
    wt, wa, wb = (bands.wavelengths[i] for i in (t, a, b))
    if not (low <= left <= high and low <= right <= high and wa < wt < wb):
        return F.lit(None).cast("double")
    ra, rt, rb = (clip(at(spectrum, i)) for i in (a, t, b))
    line = ra + (rb - ra) * F.lit((wt - wa) / (wb - wa))
    return F.when(line > 0, clip((line - rt) / line))


def water_indices(spectrum: Column, bands: Bands) -> dict[str, Column]:
    """SAI970, SAI1200, NDWI_1240, NDWI_1640, NDWI_2130 and WI; the axis must span all their bands."""
    if bands.wavelengths[0] > LFMC_AXIS[0] or bands.wavelengths[-1] < LFMC_AXIS[1]:
        raise ValueError(f"bands must span {LFMC_AXIS[0]} to {LFMC_AXIS[1]} nm")
    near = reflectance(spectrum, bands, 860)
    out = {name: sai(spectrum, bands, *where) for name, where in SAI.items()}
    out |= {f"NDWI_{w}": normalized_difference(near, reflectance(spectrum, bands, w)) for w in NDWI_FAR}
    return out | {"WI": ratio(reflectance(spectrum, bands, 900), reflectance(spectrum, bands, 970))}


def gaussian_response(wavelength: Column, centre: float, fwhm: float) -> Column:
    sigma = fwhm / 2.3548
    return F.exp(-0.5 * ((wavelength - centre) / sigma) ** 2)


def stretch(v: Column, low: Column, high: Column) -> Column:
    """Stretch to [0, 1] between two percentiles; missing is 0."""
    return F.coalesce(clip((v - low) / F.greatest(high - low, F.lit(1e-6))), F.lit(0.0))


def true_colour(df: DataFrame, spectrum: str, bands: Bands, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """``red, green, blue`` of each pixel, stretched between percentiles of the table."""
    names = {"red": 660, "green": 560, "blue": 470}
    held = df.withColumns({n: at(F.col(spectrum), bands.nearest(w)) for n, w in names.items()})
    q = with_quantiles(held.agg(F.count("*").alias("_n")), held, list(names), [low, high]).drop("_n")
    return held.join(F.broadcast(q)).withColumns({n: stretch(F.col(n), F.col(f"q_{n}")[0], F.col(f"q_{n}")[1]) for n in names}).drop(*[f"q_{n}" for n in names])


def fraction_composite(df: DataFrame, channels: Sequence[str] = ("char", "pv", "soil")) -> DataFrame:
    """Each channel between its least and largest value over the table; a constant one unscaled, missing black."""
    q = df.agg(*[f(c).alias(f"{n}_{c}") for c in channels for n, f in (("lo", F.min), ("hi", F.max))])
    scaled = {}
    for c in channels:
        lo, hi = F.col(f"lo_{c}"), F.col(f"hi_{c}")
        scaled[c] = F.coalesce(clip(F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(F.col(c))), F.lit(0.0))
    return df.join(F.broadcast(q)).withColumns(scaled).drop(*[f"{n}_{c}" for c in channels for n in ("lo", "hi")])


def normalize_fractions(df: DataFrame, remove_shade: bool = True, extras: Sequence[str] = ()) -> DataFrame:
    """Fractions without shade that sum to 1: by 1 - shade, held to [0, 1], by their sum; extras by 1 - shade only."""
    missing = [c for c in CANONICAL if c not in df.columns]
    if missing:
        raise ValueError(f"missing fractions: {missing}")
    if not remove_shade:
        return df
    lit = 1 - F.col("shade")
    part = lambda c: F.when(F.abs(lit) > 1e-6, F.col(c) / lit)
    held = {c: clip(part(c)) for c in CANONICAL[:-1]}
    whole = sum(list(held.values())[1:], list(held.values())[0])
    return df.withColumns({c: F.when(whole > 1e-6, v / whole) for c, v in held.items()} | {c: part(c) for c in extras}).drop("shade")


def assemble_fractions(fractions: Column, extras: Sequence[str] = ()) -> list[Column]:
    """Columns of a map of fractions: the canonical ones, zero where absent, then extras; all NULL if the map is."""
    return [F.when(fractions.isNotNull(), F.coalesce(F.try_element_at(fractions, F.lit(c)), F.lit(0.0))).alias(c) for c in (*CANONICAL, *extras)]


def post_constraints(df: DataFrame, classes: Sequence[str] = CANONICAL, max_rmse: float = 0.025, min_fraction: float = -0.05, max_fraction: float = 1.05) -> DataFrame:
    """NULL in all fractions and rmse where the rmse is too large or a fraction out of bounds."""
    ok = (F.col("rmse") <= max_rmse) & (F.col("rmse") < 9999)
    for c in classes:
        ok = ok & F.col(c).between(min_fraction, max_fraction)
    return df.withColumns({c: F.when(ok, F.col(c)) for c in (*classes, "rmse")})


def response_weights(source: Bands, centres: Sequence[float], fwhm: Sequence[float], source_fwhm: float | None = None) -> list[list[float]]:
    """Weights of the source bands in each target band: the target's Gaussian over the source bands' extents, sum 1.

    A target that no source band overlaps has no weights (all zero). Extents reach half a width to both sides.
    """
    widths = source.fwhm if source.fwhm is not None and source_fwhm is None else (source_fwhm or 1.0,) * len(source)
    out = []
    for c, f in zip(centres, fwhm):
        sigma = f / 2.3548200450309493
        cdf = lambda w: 0.5 * (1 + math.erf((w - c) / (sigma * math.sqrt(2))))  # noqa: B023, E731
        row = []
        for w, s in zip(source.wavelengths, widths):
            low, high = max(w - s / 2, c - f), min(w + s / 2, c + f)
            row.append(cdf(high) - cdf(low) if high > low else 0.0)
        size = sum(row)
        out.append([v / size for v in row] if size > 0 else row)
    return out


def resample(spectrum: Column, weights: Sequence[Sequence[float]], clipped: bool = False) -> Column:
    """Weighted means over source bands; NULL counts as 0, a target without weights is NULL (0 if ``clipped``)."""
    filled = F.transform(spectrum, lambda v: F.coalesce(v, F.lit(0.0)))
    rows = F.array(*[F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(w)).alias("w")) for i, w in enumerate(r) if w]) if any(r) else F.lit(None).cast("array<struct<i:int,w:double>>") for r in weights])
    value = F.transform(rows, lambda r: F.when(r.isNotNull(), total(F.transform(r, lambda p: F.get(filled, p["i"]) * p["w"]))))
    return F.transform(value, lambda v: F.coalesce(clip(v), F.lit(0.0))) if clipped else value
