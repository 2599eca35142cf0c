"""One door to the questions about what is believed: a kind and its arguments give a frame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowgrid.operators import beliefs, neighbours


@dataclass(frozen=True)
class World:
    """``hypotheses(h_id, statement, status, semantic_fit, ontological_fit, logical_consistency)``, ``evidence(h_id, ord, claim, supports, confidence, source)``,
    ``predictions(h_id, idx, correct, made_at)``, ``revisions(h_id, at, previous, new)``, ``edges(source, target, relation)``, ``nodes(id, v, verdict, coherence)``, ``links(subject, at, source)``."""

    hypotheses: DataFrame
    evidence: DataFrame
    predictions: DataFrame
    revisions: DataFrame
    edges: DataFrame
    nodes: DataFrame
    links: DataFrame


def _fit(w: World) -> DataFrame:
    return beliefs.fitness(w.hypotheses, w.evidence, w.predictions)


def why_believed(w: World, id: str) -> DataFrame:
    """The hypothesis with its fitness, evidence on both sides and provenance, oldest link first."""
    side = lambda s, n: w.evidence.where((F.col("h_id") == id) & (F.col("supports") == s)).agg(F.sort_array(F.collect_list(F.struct("ord", "claim", "source"))).alias(n))
    chain = w.links.where(F.col("subject") == id).agg(F.sort_array(F.collect_list(F.struct("at", "source"))).alias("provenance"))
    # Each side is one row about one hypothesis.
    return _fit(w).where(F.col("h_id") == id).join(side(True, "supporting")).join(side(False, "contradicting")).join(chain)


def what_contradicts(w: World, id: str) -> DataFrame:
    """``claim, source``: contradicting claims that name the id or are of it, and ends of contradicts-edges at it."""
    claims = w.evidence.where(~F.col("supports") & ((F.col("h_id") == id) | F.contains("claim", F.lit(id)))).select("claim", "source")
    ends = w.edges.where((F.col("relation") == "contradicts") & ((F.col("source") == id) | (F.col("target") == id)))
    return claims.union(ends.select(F.when(F.col("source") == id, F.col("target")).otherwise(F.col("source")), F.lit("edge")))


def after_prediction(w: World, id: str) -> DataFrame:
    return w.predictions.where(F.col("h_id") == id).orderBy("idx")


def changed(w: World, id: str) -> DataFrame:
    return w.revisions.where((F.col("h_id") == id) & (F.col("previous") != F.col("new"))).orderBy("at")


def insufficient(w: World) -> DataFrame:
    """Nodes that nothing coheres with."""
    return w.nodes.where(F.col("coherence") < 0.3).select("id", "coherence").orderBy("id")


def strongest(w: World, limit: int = 10) -> DataFrame:
    return _fit(w).orderBy(F.col("composite").desc(), "h_id").limit(limit)


def empirical(w: World, limit: int = 10) -> DataFrame:
    return _fit(w).orderBy(F.col("empirical").desc(), "h_id").limit(limit)


def failed_predictions(w: World, limit: int = 10) -> DataFrame:
    return w.predictions.where(~F.col("correct")).orderBy("h_id", "idx").limit(limit)


def _similar(w: World, v: list[float], limit: int, good: bool) -> DataFrame:
    cases = w.nodes.where(F.col("verdict") > 0 if good else F.col("verdict") < 0)
    q = w.nodes.sparkSession.createDataFrame([(-1, [float(x) for x in v])], "id long, v array<double>")
    return neighbours.top_k(q, cases, "id", "v", limit, skip_self=False).select(F.col("j").alias("id"), "s", "rank")


def succeeded(w: World, v: list[float], limit: int = 5) -> DataFrame:
    return _similar(w, v, limit, True)


def failed(w: World, v: list[float], limit: int = 5) -> DataFrame:
    return _similar(w, v, limit, False)


QUESTIONS: dict[str, Callable[..., DataFrame]] = {
    "why-believed": why_believed, "what-contradicts": what_contradicts, "after-prediction": after_prediction, "similar-succeeded": succeeded, "similar-failed": failed,
    "why-changed": changed, "insufficient-concepts": insufficient, "strongest": strongest, "failed-predictions": failed_predictions, "highest-empirical": empirical,
}


def ask(world: World, kind: str, **arguments) -> DataFrame:
    if kind not in QUESTIONS:
        raise ValueError(f"no question {kind}; there are {', '.join(QUESTIONS)}")
    return QUESTIONS[kind](world, **arguments)
