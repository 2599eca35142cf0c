"""Triple patterns and transforms over ``facts(s, p, o, kind, confidence)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INVERSE = {"requires": "produces", "produces": "requires"}


def match(facts: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
    """One pattern: ``?x`` binds a variable, None matches anything, other text must be equal; a variable used twice must agree."""
    out, bound = facts, {}
    for col, want in (("s", s), ("p", p), ("o", o)):
        if want is None:
            continue
        if want.startswith("?"):
            if want[1:] in bound:
                out = out.where(F.col(col) == F.col(bound[want[1:]]))
            else:
                bound[want[1:]] = col
        else:
            out = out.where(F.col(col) == want)
    return out.select(*[F.col(c).alias(v) for v, c in bound.items()])


def homomorphisms(facts: DataFrame, patterns: list[tuple[str | None, str | None, str | None]]) -> DataFrame:
    """All bindings of a list of patterns (bag semantics), joined on the variables they share. Patterns without a shared variable are refused."""
    out = match(facts, *patterns[0])
    for pattern in patterns[1:]:
        nxt = match(facts, *pattern)
        shared = [c for c in out.columns if c in nxt.columns]
        if not shared:
            raise ValueError(f"pattern {pattern} shares no variable with those before it")
        out = out.join(nxt, shared)
    return out


def _derived(rows: DataFrame, confidence: float) -> DataFrame:
    return rows.select("s", "p", "o", F.lit("derived").alias("kind"), F.lit(confidence).alias("confidence")).distinct()


def union_new(facts: DataFrame, derived: DataFrame) -> DataFrame:
    """Facts with derived ones that aren't there yet; an existing row wins."""
    return facts.select("s", "p", "o", "kind", "confidence").unionByName(derived.join(facts.select("s", "p", "o"), ["s", "p", "o"], "left_anti"))


def invert(facts: DataFrame, p: str) -> DataFrame:
    return _derived(facts.where(F.col("p") == p).select(F.col("o").alias("s"), F.lit(INVERSE.get(p, p)).alias("p"), F.col("s").alias("o")), 0.8)


def compose(facts: DataFrame, p: str, q: str, name: str) -> DataFrame:
    a = facts.where(F.col("p") == p).select("s", F.col("o").alias("m"))
    b = facts.where(F.col("p") == q).select(F.col("s").alias("m"), "o")
    return _derived(a.join(b, "m").select("s", F.lit(name).alias("p"), "o"), 0.8)


def substitute(facts: DataFrame, old: str, new: str) -> DataFrame:
    swap = lambda c: F.when(F.col(c) == old, new).otherwise(F.col(c)).alias(c)
    return _derived(facts.where((F.col("s") == old) | (F.col("o") == old)).select(swap("s"), "p", swap("o")), 0.8)


def generalize(facts: DataFrame, role: str) -> DataFrame:
    """Facts with their subject (``s``) or object (``o``) made Any."""
    return _derived(facts.withColumn(role, F.lit("Any")), 0.6)


def analogize(facts: DataFrame, mapping: dict[str, str]) -> DataFrame:
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    rows = facts.where(F.col("s").isin(*mapping)).select(m[F.col("s")].alias("s"), "p", F.coalesce(m[F.col("o")], F.col("o")).alias("o"))
    return _derived(rows, 0.6)


def violations(facts: DataFrame, constraints: DataFrame) -> DataFrame:
    """``desc``: required triples that are missing and forbidden ones that are there."""
    key = ["s", "p", "o"]
    there = facts.select(*key).distinct()
    missing = constraints.where("kind = 'requires'").join(there, key, "left_anti")
    present = constraints.where("kind = 'forbids'").join(there, key, "left_semi")
    return missing.unionByName(present).select("desc", "kind")


def causal_clashes(facts: DataFrame) -> DataFrame:
    """Pairs (s, o) that one fact joins causally and another contradicts."""
    cause = facts.where(F.col("p").isin("causes", "enables")).select("s", "o").distinct()
    return cause.join(facts.where("p = 'contradicts'").select("s", "o").distinct(), ["s", "o"], "left_semi")


#: Composite that a transformation must reach (fixed value).
ACCEPT = 0.5


def gates(before: DataFrame, after: DataFrame, valid: bool = True, violated: int = 0) -> DataFrame:
    """One row ``empirical, logical, temporal, causal, procedural, composite, accepted, facts`` of a transformation of facts.

    Empirical: observed facts are kept. Logical: the operation is valid and no constraint is violated. Temporal: nothing
    precedes itself. Causal: no pair is joined causally and contradicts. Accepted: the mean reaches ``ACCEPT``, with
    nothing lost of the first two.
    """
    spo = ["s", "p", "o"]
    lost = before.where("kind = 'observed'").select(spo).join(after.select(spo), spo, "left_anti").agg(F.count("*").alias("lost"))
    clash = causal_clashes(after).agg(F.count("*").alias("clash"))
    g = after.agg(F.count("*").alias("facts"), F.count_if((F.col("p") == "precedes") & (F.col("s") == F.col("o"))).alias("self"))
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    out = g.join(lost).join(clash)  # single rows
    out = out.select(
        one(F.col("lost") == 0).alias("empirical"), F.lit(1.0 if valid and not violated else 0.0).alias("logical"), one(F.col("self") == 0).alias("temporal"),
        one(F.col("clash") == 0).alias("causal"), F.lit(1.0 if valid else 0.0).alias("procedural"), "facts",
    )
    names = ("empirical", "logical", "temporal", "causal", "procedural")
    out = out.withColumn("composite", sum((F.col(c) for c in names), F.lit(0.0)) / len(names))
    return out.withColumn("accepted", (F.col("composite") >= ACCEPT) & (F.col("logical") == 1) & (F.col("empirical") == 1))
