"""Graph operators: components, bounded walks, propagation."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowgrid.session import sound


def cut(df: DataFrame) -> DataFrame:
    """The frame with its lineage cut by checkpoint() in the cluster's shared folder; a local session without one gets a folder of its own."""
    sc = sound(df.sparkSession).sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="sparrowgrid-"))
    return df.checkpoint()


def free(spark: SparkSession) -> None:
    """Gives up shuffle files of steps that nothing refers to any more: they stay until the driver collects the plans that made them."""
    gc.collect()
    spark._jvm.System.gc()


def components(links: DataFrame) -> DataFrame:
    """``node, component`` of every node with a link in ``links(u, v)``; a component is named by its least node.

    A round links every node's greater neighbours to its least one (large star), then its lesser ones (small star); rounds
    grow with the logarithm of the longest path, and end when the links are stars.
    """
    edges = cut(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        large = cut(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("low"))
        moved = large.join(least, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        edges = cut(moved.union(least.select("u", "low")).distinct())
        # Links that a round leaves as they were are stars; their number and hash tell.
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
        state = now


#: Relations of edges by family (fixed values).
FAMILIES = {
    "epistemic": ("SUPPORTS", "CONTRADICTS", "EXPLAINS", "PREDICTS", "INVALIDATES", "DERIVED_FROM"),
    "causal": ("CAUSES", "INFLUENCES"),
    "procedural": ("PRECEDES", "FOLLOWS", "DEPENDS_ON", "REQUIRES", "PRODUCES", "MEASURES", "OBSERVES"),
}


def family(relation: Column) -> Column:
    """The family of a relation; null for another one."""
    out = F.lit(None).cast("string")
    for name, some in FAMILIES.items():
        out = F.when(F.upper(relation).isin(*some), name).otherwise(out)
    return out


def walk(seeds: DataFrame, edges: DataFrame, hops: int = 5) -> DataFrame:
    """``seed, node, hop``: least number of edges (``source -> target``) to each node, up to ``hops``; cycles end by the least hop.

    Each front is a checkpoint, so that no hop makes those before it again; the walk ends where a front is empty.
    """
    step = edges.select(F.col("source").alias("node"), "target")
    seen = front = seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("hop"))
    for h in range(1, hops + 1):
        reached = front.join(step, "node").select("seed", F.col("target").alias("node")).distinct()
        front = cut(reached.join(seen, ["seed", "node"], "left_anti").withColumn("hop", F.lit(h)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def propagate(walked: DataFrame, impact: float | object, decay: float = 0.85, floor: float = 0.01) -> DataFrame:
    """Impact of a change at the seed on each walked node, decayed by hop; beyond the seed, what falls under ``floor`` is dropped."""
    base = impact if not isinstance(impact, float) else F.lit(impact)
    out = walked.withColumn("impact", F.round(base * F.pow(F.lit(decay), F.col("hop")), 6))
    return out.where((F.col("hop") == 0) | (F.abs("impact") >= floor))
