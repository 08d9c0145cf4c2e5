"""Arithmetic on spectrum arrays, all in JVM expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(xs: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in xs])


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def mean(a: Column) -> Column:
    """Mean of the entries that are not NULL."""
    held = F.filter(a, lambda v: v.isNotNull())
    return F.when(F.size(held) > 0, total(held) / F.size(held))


def stddev(a: Column) -> Column:
    """Population standard deviation of the entries that are not NULL."""
    held = F.filter(a, lambda v: v.isNotNull())
    m = mean(a)
    return F.sqrt(mean(F.transform(held, lambda v: (v - m) * (v - m))))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def spectral_angle(a: Column, b: Column) -> Column:
    """Angle in degrees; NULL if either is all zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot(a, b) / size)))))


def rmse(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))) / F.size(a))


def matrix_apply(rows: Sequence[Sequence[float]], a: Column) -> Column:
    """The products of ``a`` with each row of a small matrix; zeros of a row cost nothing."""
    out = []
    for row in rows:
        terms = [F.get(a, F.lit(i)) * F.lit(float(w)) for i, w in enumerate(row) if w]
        out.append(sum(terms[1:], terms[0]) if terms else F.lit(0.0))
    return F.array(*out)


def interpolate(x: Column, xs: Sequence[float], ys: Column) -> Column:
    """Linear interpolation of ``ys`` over ``xs`` at ``x``; NULL outside."""
    out = F.lit(None).cast("double")
    for i in range(len(xs) - 2, -1, -1):
        a, b = F.get(ys, F.lit(i)), F.get(ys, F.lit(i + 1))
        share = (x - F.lit(xs[i])) / F.lit(xs[i + 1] - xs[i])
        out = F.when((x >= xs[i]) & (x <= xs[i + 1]), a + (b - a) * share).otherwise(out)
    return out
