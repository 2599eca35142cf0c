"""Vector expressions over ``array<double>`` columns; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Norms are floored and the result is clamped to [-1, 1]."""
    raw = dot(a, b) / (F.greatest(norm(a), F.lit(EPS)) * F.greatest(norm(b), F.lit(EPS)))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw))


def cosine_unclamped(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(EPS))


def _spread(x: Column, like: Column) -> Column:
    """A value as an array as long as another; a lambda would work the value out again for every component."""
    return F.array_repeat(x, F.size(like))


def normalise(a: Column) -> Column:
    """Unit length; a vector of length up to 1e-8 stays as it is."""
    n = norm(a)
    return F.zip_with(a, _spread(F.when(n > EPS, n).otherwise(F.lit(1.0)), a), lambda x, m: x / m)


def zscore(a: Column) -> Column:
    """Population z-score of the components; the deviation is floored at 1e-8."""
    mean = F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    off = F.zip_with(a, _spread(mean, a), lambda x, m: x - m)
    sd = F.sqrt(F.aggregate(off, F.lit(0.0), lambda s, x: s + x * x) / F.size(a))
    return F.zip_with(off, _spread(F.greatest(sd, F.lit(EPS)), a), lambda x, m: x / m)


def blend(a: Column, b: Column, alpha: float) -> Column:
    return normalise(F.zip_with(a, b, lambda x, y: x + F.lit(alpha) * (y - x)))


def distance(a: Column, b: Column) -> Column:
    """Cosine distance."""
    return 1 - cosine(a, b)


def six(x: Column) -> Column:
    """Six digits by the binary product, halves away from zero: ties of values that were rounded before fall as they do in SQL engines that multiply."""
    return F.signum(x) * F.floor(F.abs(x) * 1e6 + 0.5) / 1e6 + 0.0
