"""Records of what is believed: defaults, checked scores, and appends; nothing is updated in place.

``complete`` makes rows of a kind whole. Writers return new frames (or the rows to append), so any store can hold them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparrowgrid.operators.beliefs import clamp

#: Columns of each kind with their type and default (fixed values); a default of None is null.
KINDS: dict[str, dict[str, tuple[str, object]]] = {
    "hypothesis": {"statement": ("string", None), "status": ("string", "candidate"), "confidence": ("double", 0.5), "coherence": ("double", 0.5), "fitness": ("double", 0.5), "provenance": ("string", None), "valid_from": ("timestamp", None), "valid_until": ("timestamp", None)},
    "assumption": {"h_id": ("string", None), "assumption": ("string", None)},
    "evidence": {"h_id": ("string", None), "source": ("string", None), "claim": ("string", None), "supports": ("boolean", True), "confidence": ("double", 1.0), "intake_id": ("string", None)},
    "prediction": {"h_id": ("string", None), "statement": ("string", None), "expected": ("string", None), "actual": ("string", None), "correct": ("boolean", None), "confidence": ("double", 0.5)},
    "contradiction": {"a": ("string", None), "b": ("string", None), "resolution": ("string", "open"), "explanation": ("string", None)},
    "party": {"claim": ("string", None), "source": ("string", None), "authority": ("double", 0.5), "confidence": ("double", 0.5)},
    "edge": {"source": ("string", None), "target": ("string", None), "relation": ("string", "related"), "confidence": ("double", 1.0), "weight": ("double", 1.0), "evidence": ("string", None), "valid_from": ("timestamp", None), "valid_until": ("timestamp", None)},
    "measurement": {"metric": ("string", None), "value": ("double", None), "unit": ("string", None)},
    "deviation": {"metric": ("string", None), "expected": ("double", None), "actual": ("double", None), "severity": ("double", 0.0)},
    "intervention": {"target": ("string", None), "action": ("string", None), "reason": ("string", None)},
    "outcome": {"intervention_id": ("string", None), "success": ("boolean", None), "note": ("string", None)},
    "cycle": {"process": ("string", None), "measurements": ("long", 0), "deviations": ("long", 0), "interventions": ("long", 0), "outcomes": ("long", 0)},
}
#: Scores that are kept in [0, 1].
SCORES = ("confidence", "authority", "coherence", "fitness", "severity")
#: Verdicts by name (fixed values).
VERDICTS = {"success": 1.0, "inert": 0.0, "failure": -1.0}


def complete(rows: DataFrame, kind: str) -> DataFrame:
    """Rows with every column of their kind: missing ones and nulls get the default, scores are clamped, further columns stay."""
    if kind not in KINDS:
        raise ValueError(f"no kind {kind}")
    out = rows
    for name, (of, default) in KINDS[kind].items():
        value = F.col(name).cast(of) if name in out.columns else F.lit(None).cast(of)
        if default is not None:
            value = F.coalesce(value, F.lit(default).cast(of))
        out = out.withColumn(name, clamp(value) if name in SCORES else value)
    return out


def append(log: DataFrame, rows: DataFrame, kind: str) -> DataFrame:
    """The log (of any columns) with whole rows of a kind after it."""
    return log.unionByName(complete(rows, kind), allowMissingColumns=True)


def add_evidence(hypotheses: DataFrame, evidence: DataFrame) -> DataFrame:
    """Hypotheses with the status that new evidence (``h_id, supports``) gives: any against it contradicts; else support makes a candidate supported. Evidence for what isn't there does nothing."""
    e = evidence.groupBy("h_id").agg(F.count_if(~F.coalesce("supports", F.lit(True))).alias("_against"), F.count("*").alias("_n"))
    status = F.when(F.col("_against") > 0, "contradicted").when((F.col("_n") > 0) & (F.col("status") == "candidate"), "supported").otherwise(F.col("status"))
    return hypotheses.join(e, "h_id", "left").withColumn("status", status).drop("_against", "_n")


def transition(hypotheses: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hypotheses, events) after ``changes(h_id, status, at, reason)``: of several for one hypothesis the latest counts for its status.

    Every change of a known hypothesis is an event with the status before it; one to the same status changes nothing and is no event.
    """
    w = Window.partitionBy("h_id").orderBy("at", "new")
    steps = changes.select("h_id", F.col("status").alias("new"), "at", "reason").join(hypotheses.select("h_id", F.col("status").alias("was")), "h_id")
    events = steps.withColumn("previous", F.coalesce(F.lag("new").over(w), F.col("was"))).where("previous <> new").select("h_id", "at", "previous", "new", "reason")
    last = steps.groupBy("h_id").agg(F.max_by("new", F.struct("at", "new")).alias("to"))
    out = hypotheses.join(last, "h_id", "left").withColumn("status", F.coalesce("to", "status")).drop("to")
    return out, events


def resolve_predictions(predictions: DataFrame, outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(predictions, refused) after ``outcomes(h_id, idx, correct, at)``: an open prediction takes its first outcome; ``refused`` has
    the others with ``why``: no such prediction, already resolved, or no outcome."""
    w = Window.partitionBy("h_id", "idx").orderBy(F.col("correct").isNull(), "at", F.col("correct").cast("int"))
    asked = outcomes.withColumn("_n", F.row_number().over(w))
    known = predictions.select("h_id", "idx", F.lit(True).alias("_known"), F.col("correct").alias("_was"))
    j = asked.join(known, ["h_id", "idx"], "left")
    why = F.when(F.col("_known").isNull(), "no such prediction").when(F.col("correct").isNull(), "no outcome").when(F.col("_was").isNotNull() | (F.col("_n") > 1), "already resolved")
    j = j.withColumn("why", why)
    taken = j.where("why IS NULL").select("h_id", "idx", F.col("correct").alias("_correct"), F.col("at").alias("observed_at"))
    out = predictions.join(taken, ["h_id", "idx"], "left").withColumn("correct", F.coalesce("correct", "_correct")).drop("_correct")
    return out, j.where("why IS NOT NULL").select("h_id", "idx", "at", "why")


def verdict(name: Column) -> Column:
    """The number of a verdict's name; another name gives null."""
    m = F.create_map(*[F.lit(x) for kv in VERDICTS.items() for x in kv])
    return m[F.lower(name)]


def assert_verdicts(nodes: DataFrame, verdicts: DataFrame, key: str = "id") -> DataFrame:
    """Nodes with ``verdict``: the latest of ``verdicts(key, verdict, at)``, kept in [-1, 1], else what they had."""
    last = verdicts.groupBy(key).agg(F.max_by("verdict", "at").alias("_v"))
    had = F.col("verdict") if "verdict" in nodes.columns else F.lit(None).cast("double")
    return nodes.join(last, key, "left").withColumn("verdict", F.coalesce(clamp(F.col("_v"), -1.0), had)).drop("_v")


def incident(edges: DataFrame, node: Column) -> DataFrame:
    return edges.where((F.col("source") == node) | (F.col("target") == node))


def pair_contradictions(hypotheses: DataFrame, pairs: DataFrame) -> DataFrame:
    """Open contradictions of hypotheses ``a, b`` that both exist, each unordered pair once."""
    known = hypotheses.select("h_id")
    both = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    both = both.join(known.withColumnRenamed("h_id", "a"), "a", "left_semi").join(known.withColumnRenamed("h_id", "b"), "b", "left_semi")
    return complete(both, "contradiction")


def settle(contradictions: DataFrame, prefix: str, resolution: str) -> DataFrame:
    """Contradictions after the one whose ``id`` starts with ``prefix`` is resolved; an unknown or ambiguous prefix is refused."""
    hit = [r["id"] for r in contradictions.where(F.col("id").startswith(prefix)).select("id").distinct().limit(2).collect()]
    if len(hit) != 1:
        raise ValueError(f"{prefix}: {'no' if not hit else 'more than one'} contradiction")
    return contradictions.withColumn("resolution", F.when(F.col("id") == hit[0], resolution).otherwise(F.col("resolution")))
