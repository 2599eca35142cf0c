"""Whether an edit went the way it was meant to without losing its source: worst-covered unit against a null of the same size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrowgrid.functions import text as T

DIRECTIONS = ("shorter", "longer", "rephrased")
#: Other names of directions (fixed values).
NAMES = {"short": "shorter", "shorten": "shorter", "long": "longer", "expand": "longer", "rephrase": "rephrased", "reword": "rephrased"}
#: Change of size that a rephrasing may make, and lead over the null that holds (fixed values).
SLACK, LEAD = 0.15, 0.02


def parse(name: str) -> str:
    low = name.strip().lower()
    out = NAMES.get(low, low)
    if out not in DIRECTIONS:
        raise ValueError(f"no direction {name}")
    return out


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"\s+"), "")


def null(before: Column, size: Column, direction: str) -> Column:
    """The cheapest text of ``size`` words: the first words, the words over again, or the words by the order of a hash."""
    w = _words(before)
    if direction == "shorter":
        return F.array_join(F.slice(w, 1, size), " ")
    if direction == "longer":
        times = F.ceil(size / F.greatest(F.size(w), F.lit(1))).cast("int")
        return F.array_join(F.slice(F.flatten(F.array_repeat(w, F.greatest(times, F.lit(1)))), 1, F.greatest(size, F.size(w))), " ")
    keyed = F.transform(w, lambda x, i: F.struct(F.md5(F.concat(x, i.cast("string"))).alias("h"), x.alias("x")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda p: p["x"]), " ")


def _units(text: Column, least: int) -> Column:
    parts = F.transform(F.split(text, r"[.\n;]"), lambda x: F.trim(x))
    return F.transform(F.filter(parts, lambda x: F.size(_words(x)) >= least), lambda x: F.array_distinct(T.terms(x)))


def retention(before: Column, after: Column, whole: bool = False) -> Column:
    """Least over units of the source (three words or more) of the best cosine of its terms with a unit of the result; 0 without units.

    ``whole`` compares all terms of both texts instead.
    """
    cos = lambda a, b: F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.sqrt(F.size(a).cast("double") * F.size(b)))
    if whole:
        return cos(F.array_distinct(T.terms(before)), F.array_distinct(T.terms(after)))
    results = _units(after, 1)
    best = F.transform(_units(before, 3), lambda u: F.array_max(F.transform(results, lambda x: cos(u, x))))
    return F.coalesce(F.array_min(F.transform(best, lambda x: F.coalesce(x, F.lit(0.0)))), F.lit(0.0))


def check(pairs: DataFrame, before: str, after: str, direction: str, whole: bool = False) -> DataFrame:
    """``pairs`` with ``moved, retention, null_retention, holds``. Texts are a row's own, so nothing is shuffled. Null texts count as empty; an empty source holds nothing."""
    direction = parse(direction)
    b, a = F.coalesce(before, F.lit("")), F.coalesce(after, F.lit(""))
    n, m = T.token_estimate(b), T.token_estimate(a)
    moved = {"shorter": m < n, "longer": m > n, "rephrased": F.abs(m - n) <= SLACK * F.greatest(n, F.lit(1))}[direction]
    out = pairs.withColumns({"moved": moved, "retention": retention(b, a, whole), "null_retention": retention(b, null(b, F.size(_words(a)), direction), whole)})
    return out.withColumn("holds", F.col("moved") & (F.col("retention") - F.col("null_retention") > LEAD))
