"""What a changed node does to its neighbourhood, on a shadow of the graph: the base stays as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowgrid.functions import vector as V
from sparrowgrid.operators import graph, neighbours
from sparrowgrid.operators.beliefs import route

#: Loss of coherence that invalidates, and change that counts as none (fixed values).
DEGRADED, NOTHING = 0.25, 1e-6
#: Status of a hypothesis that degradation contradicts (fixed values).
STANDING = ("supported", "confirmed", "certified")
DELTAS = "node long, hop int, impact double, previous double, new double, delta string"


def classify(delta):
    return F.when(F.abs(delta) < NOTHING, "unchanged").when(delta > 0, "strengthened").when(delta < -DEGRADED, "invalidated").otherwise("shifted")


def evaluate(nodes: DataFrame, edges: DataFrame, target: int, new: list[float], hops: int = 5, decay: float = 0.85, floor: float = 0.01) -> DataFrame:
    """``node, hop, impact, previous, new, delta`` of every node (``id, v``) that a new vector of ``target`` reaches over ``edges(source, target)``.

    The wave goes ``hops`` edges far while its impact, the cosine of the old and new vector decayed by hop, isn't under the
    floor. Coherence, the mean of the five best cosines, is made anew for the nodes it reaches, over the base and over the
    shadow. An unchanged vector, or a target that isn't there, gives no rows.
    """
    spark = nodes.sparkSession
    new = [float(x) for x in new]
    old = nodes.where(F.col("id") == target).select("v").first()
    if old is None or list(old["v"]) == new:
        return spark.createDataFrame([], DELTAS)
    fresh = F.array(*[F.lit(x) for x in new])
    sim = nodes.where(F.col("id") == target).select(V.cosine(F.col("v"), fresh).alias("c")).first()["c"]
    shadow = nodes.withColumn("v", F.when(F.col("id") == target, fresh).otherwise(F.col("v")))
    seeds = spark.createDataFrame([(target,)], "node long")
    wave = graph.propagate(graph.walk(seeds, edges, hops), float(sim), decay, floor).select("node", "hop", "impact")
    hit = wave.select(F.col("node").alias("id"))

    def coherence(world: DataFrame, name: str) -> DataFrame:
        some = world.join(hit, "id", "left_semi")
        return neighbours.density(neighbours.top_k(some, world, "id", "v", 5), some, "id").select(F.col("id").alias("node"), F.col("coherence").alias(name))

    out = wave.join(coherence(nodes, "previous"), "node").join(coherence(shadow, "new"), "node")
    return out.select("node", "hop", "impact", "previous", "new", classify(F.col("new") - F.col("previous")).alias("delta"))


def revise(deltas: DataFrame, hypotheses: DataFrame, dependents: DataFrame | None = None) -> DataFrame:
    """``h_id, previous, new, loss, contradicted, route``: hypotheses (``h_id, ref, status``) re-scored by the coherence of what they refer to.

    ``dependents(node)``, where there are any, are the declared dependents that select hypotheses; without them every node
    of the wave does. A standing hypothesis that loses over ``DEGRADED`` gets contradicting evidence; ``route`` says who applies it.
    """
    chosen = deltas if dependents is None or dependents.isEmpty() else deltas.join(dependents.select("node").distinct(), "node", "left_semi")
    hit = hypotheses.join(chosen.select(F.col("node").alias("ref"), "previous", "new"), "ref")
    h = hit.groupBy("h_id", "status").agg(F.avg("previous").alias("previous"), F.avg("new").alias("new")).withColumn("loss", F.col("previous") - F.col("new"))
    fallen = (F.col("loss") > DEGRADED) & F.col("status").isin(*STANDING)
    return h.select("h_id", "previous", "new", "loss", fallen.alias("contradicted"), F.when(fallen, route(F.col("status"), F.col("loss"))).alias("route"))
