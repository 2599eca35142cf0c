"""Retraction of evidence to its end: what loses its support takes down what rests on it, round by round, cycles included.

Evidence falls with its source. A hypothesis whose last supporting evidence falls is fallen (a certified one stays); the nodes that
it refers to are lost, and with them the nodes that depend on them; a lost node takes along the sources that it vouches for. A
round only meets what the round before took away: sums of what fell are subtracted from each touched hypothesis's tally, and
nothing else is scored anew. What is lost stays lost, so rounds end, on cycles too, when a round takes nothing away.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowgrid.operators.beliefs import derived_status, scored, tally
from sparrowgrid.operators.graph import cut

SUMS = ("n", "net", "sup", "con")


def _sums(evidence: DataFrame) -> DataFrame:
    sign = F.when(F.col("supports"), F.col("confidence")).otherwise(-F.col("confidence"))
    return evidence.groupBy("h_id").agg(F.count("*").alias("n"), F.sum(sign).alias("net"), F.count_if("supports").alias("sup"), F.count_if(~F.col("supports")).alias("con"))


def retract(hypotheses: DataFrame, evidence: DataFrame, predictions: DataFrame, refs: DataFrame, depends: DataFrame, vouched: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(touched, lost) after the evidence of ``sources(source)`` is taken away and all that follows from it.

    ``refs`` has ``h_id, node``, ``depends`` ``source, target`` (the source depends on the target), ``vouched`` ``node, source``.
    touched: ``h_id, hop`` (the round that first took evidence from it, from 0), ``retracted, status_before, status_after,
    fitness_before, fitness_after``. lost: ``node, hop``. A source that no evidence has, and nulls, take nothing away.
    """
    whole = cut(hypotheses.join(tally(evidence, predictions), "h_id", "left"))
    front = cut(sources.where("source IS NOT NULL").select("source").distinct())
    gone_sources, gone = front, None
    lost, last, fallen = None, None, None
    hop = 0
    while True:
        hit = cut(_sums(evidence.join(front, "source", "left_semi")))
        every = hit.withColumn("hop", F.lit(hop)) if gone is None else gone.unionByName(hit.withColumn("hop", F.lit(hop)))
        gone = cut(every.groupBy("h_id").agg(*[F.sum(c).alias(c) for c in SUMS], F.min("hop").alias("hop")))
        # Only what this round touched is looked at.
        now = gone.join(hit, "h_id", "left_semi").select("h_id", F.col("sup").alias("less"))
        down = now.join(whole.select("h_id", "status", "sup"), "h_id").where((F.col("sup") > 0) & (F.col("sup") == F.col("less")) & (F.col("status") != "certified")).select("h_id")
        if fallen is not None:
            down = down.join(fallen, "h_id", "left_anti")
        down = cut(down)
        fallen = down if fallen is None else cut(fallen.unionByName(down))
        nodes = refs.join(down, "h_id", "left_semi").select("node")
        if last is not None:
            nodes = nodes.unionByName(depends.join(last.select(F.col("node").alias("target")), "target", "left_semi").select(F.col("source").alias("node")))
        nodes = nodes.where("node IS NOT NULL").distinct()
        if lost is not None:
            nodes = nodes.join(lost, "node", "left_anti")
        last = cut(nodes.select("node"))
        if last.isEmpty():
            break
        hop += 1
        found = last.withColumn("hop", F.lit(hop))
        lost = found if lost is None else cut(lost.unionByName(found))
        front = cut(vouched.join(last, "node", "left_semi").select("source").where("source IS NOT NULL").distinct().join(gone_sources, "source", "left_anti"))
        gone_sources = cut(gone_sources.unionByName(front))
    if lost is None:
        lost = last.withColumn("hop", F.lit(0))
    less = gone.select("h_id", "hop", F.col("n").alias("retracted"), *[F.col(c).alias(f"_{c}") for c in SUMS])
    touched = whole.join(less, "h_id")
    was = scored(touched).select("h_id", F.col("composite").alias("fitness_before"))
    after = touched.withColumns({c: F.coalesce(c, F.lit(0)) - F.col(f"_{c}") for c in SUMS})
    after = scored(after).select("h_id", "hop", "retracted", F.col("status").alias("status_before"), derived_status(F.col("status"), F.col("sup"), F.col("con")).alias("status_after"), F.col("composite").alias("fitness_after"))
    out = after.join(was, "h_id").select("h_id", "hop", "retracted", "status_before", "status_after", "fitness_before", "fitness_after")
    return out, lost
