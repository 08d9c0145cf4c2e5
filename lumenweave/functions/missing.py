"""Missing values. NaN, infinities and fill values become NULL here, at the boundary; nothing else handles NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A ratio whose denominator is nearer to zero than this is missing.
NEAR_ZERO = 1e-3


def finite(v: Column) -> Column:
    """Whether ``v`` is a number: neither NULL nor NaN nor infinite."""
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))


def to_null(v: Column, fill: float | None = None) -> Column:
    """``v`` with NaN, infinities and ``fill`` as NULL."""
    good = finite(v) if fill is None else finite(v) & (v != F.lit(fill))
    return F.when(good, v)


def array_to_null(spectrum: Column, fill: float | None = None) -> Column:
    return F.transform(spectrum, lambda v: to_null(v, fill))


def clip(v: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """``v`` held to [low, high]; NULL stays NULL (greatest and least would drop it)."""
    if low > high:
        raise ValueError(f"low {low} exceeds high {high}")
    return F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(float(low))), F.lit(float(high))))


def ratio(top: Column, bottom: Column, near_zero: float = NEAR_ZERO) -> Column:
    """``top / bottom``, NULL where the bottom is nearer to zero than ``near_zero``."""
    return F.when(F.abs(bottom) >= near_zero, top / bottom)


def normalized_difference(a: Column, b: Column) -> Column:
    return ratio(a - b, a + b)
