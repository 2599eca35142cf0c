"""Hypotheses with evidence and predictions: fitness, retraction, status, and queries over them.

``hypotheses(h_id, semantic_fit, ontological_fit, logical_consistency, status, ...)``,
``evidence(h_id, ord, supports boolean, confidence, source)``, ``predictions(h_id, idx, correct boolean or null, made_at)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of the composite and bounds of its penalties (fixed values).
WEIGHTS = {"semantic": 0.20, "ontological": 0.15, "logical": 0.15, "empirical": 0.25, "predictive": 0.25}
CONTRADICTION, CONTRADICTION_MOST, MISS, MISS_MOST = 0.10, 0.40, 0.15, 0.50
LIVE = ("candidate", "supported", "contradicted", "confirmed", "certified", "isolated")


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """The value inside its bounds; null stays null."""
    return F.when(x < low, low).when(x > high, high).otherwise(x)


def tally(evidence: DataFrame, predictions: DataFrame) -> DataFrame:
    """Per hypothesis: sums and counts that fitness needs; both sides are aggregated before they meet."""
    sign = F.when(F.col("supports"), F.col("confidence")).otherwise(-F.col("confidence"))
    e = evidence.groupBy("h_id").agg(F.count("*").alias("n"), F.sum(sign).alias("net"), F.count_if(~F.col("supports")).alias("con"), F.count_if("supports").alias("sup"))
    p = predictions.groupBy("h_id").agg(F.count("correct").alias("resolved"), F.count_if("correct").alias("hits"))
    return e.join(p, "h_id", "full")


def fitness(hypotheses: DataFrame, evidence: DataFrame, predictions: DataFrame) -> DataFrame:
    """Hypotheses with ``empirical, predictive, contradiction_penalty, miss_penalty, composite, sup, con``."""
    return scored(hypotheses.join(tally(evidence, predictions), "h_id", "left")).drop("n", "net", "resolved", "hits")


def scored(h: DataFrame) -> DataFrame:
    """``fitness`` from rows that have their tally."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    empirical = F.when(zero("n") == 0, 0.5).otherwise(clamp(0.5 + 0.5 * F.col("net") / F.col("n")))
    predictive = F.when(zero("resolved") == 0, 0.5).otherwise(F.col("hits") / F.col("resolved"))
    h = h.withColumns(
        {
            "empirical": empirical, "predictive": predictive, "sup": zero("sup"), "con": zero("con"),
            "contradiction_penalty": F.least(CONTRADICTION * zero("con"), F.lit(CONTRADICTION_MOST)),
            "miss_penalty": F.least(MISS * (zero("resolved") - zero("hits")), F.lit(MISS_MOST)),
        }
    )
    w = WEIGHTS
    total = w["semantic"] * F.col("semantic_fit") + w["ontological"] * F.col("ontological_fit") + w["logical"] * F.col("logical_consistency")
    total = total + w["empirical"] * F.col("empirical") + w["predictive"] * F.col("predictive") - F.col("contradiction_penalty") - F.col("miss_penalty")
    return h.withColumn("composite", clamp(total))


def fitness_terms(fit: DataFrame) -> DataFrame:
    """``h_id, term, value``: the weighted terms and the two penalties of each composite."""
    w = WEIGHTS
    terms = {
        "semantic": w["semantic"] * F.col("semantic_fit"), "ontological": w["ontological"] * F.col("ontological_fit"), "logical": w["logical"] * F.col("logical_consistency"),
        "empirical": w["empirical"] * F.col("empirical"), "predictive": w["predictive"] * F.col("predictive"), "contradictions": -F.col("contradiction_penalty"), "misses": -F.col("miss_penalty"),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("term"), v.alias("value")) for k, v in terms.items()])
    return fit.select("h_id", F.explode(rows).alias("t")).select("h_id", "t.term", "t.value")


def derived_status(status: Column, sup: Column, con: Column) -> Column:
    """Status that the evidence gives; a certified hypothesis stays so."""
    return F.when(status == "certified", status).when(con > 0, "contradicted").when(sup > 0, "supported").otherwise("candidate")


def retract(hypotheses: DataFrame, evidence: DataFrame, source: Column) -> DataFrame:
    """``h_id, retracted, status`` after the evidence of a source is taken away."""
    gone = F.coalesce(source, F.lit(False))
    e = evidence.groupBy("h_id").agg(
        F.count_if(gone).alias("retracted"), F.count_if(~gone & F.col("supports")).alias("sup"), F.count_if(~gone & ~F.col("supports")).alias("con")
    )
    h = hypotheses.join(e, "h_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    status = F.when(zero("retracted") == 0, F.col("status")).otherwise(derived_status(F.col("status"), zero("sup"), zero("con")))
    return h.select("h_id", zero("retracted").alias("retracted"), status.alias("status"))


def route(status: Column, delta: Column) -> Column:
    """What a change of status by ``delta`` needs."""
    return F.when(status == "certified", "protected").when(delta > 0.40, "review").otherwise("auto-apply")


def rating(score: Column) -> Column:
    return F.when(score > 0.2, "success").when(score < -0.2, "failure").otherwise("inert")


#: Empirical fit of a hypothesis that a failure gave rise to, and the neutral fit of what isn't known (fixed values).
DREAMT, NEUTRAL = 0.2, 0.5


def dream(failed: DataFrame) -> DataFrame:
    """``id, status, semantic, empirical, fitness``: a candidate hypothesis for each failed node (``id, coherence``)."""
    w = WEIGHTS
    total = w["semantic"] * F.col("coherence") + (w["ontological"] + w["logical"] + w["predictive"]) * NEUTRAL + w["empirical"] * DREAMT
    return failed.select("id", F.lit("candidate").alias("status"), F.col("coherence").alias("semantic"), F.lit(DREAMT).alias("empirical"), clamp(total).alias("fitness"))


def resolve(ids: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``prefix, state, n, id`` of prefixes (``prefix``) of ids (``id``): exact, unique, ambiguous or, with no id, unknown."""
    size = prefixes.select(F.length("prefix").alias("size")).distinct()
    # Ids meet prefixes by equality, once for each length of a prefix.
    cut = ids.join(F.broadcast(size), F.length("id") >= F.col("size")).select("id", F.expr("substring(id, 1, size)").alias("prefix"))
    found = prefixes.join(cut, "prefix", "left").groupBy("prefix").agg(F.count("id").alias("n"), F.min("id").alias("first"), F.max((F.col("id") == F.col("prefix")).cast("int")).alias("exact"))
    state = F.when(F.col("exact") == 1, "exact").when(F.col("n") == 1, "unique").when(F.col("n") == 0, "unknown").otherwise("ambiguous")
    return found.select("prefix", state.alias("state"), "n", F.when(F.col("exact") == 1, F.col("prefix")).when(F.col("n") == 1, F.col("first")).alias("id"))
