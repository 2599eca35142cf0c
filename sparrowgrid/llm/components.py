"""Connected components of links: local contraction in each task, then rounds of large-star and small-star."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowgrid.llm.shared import batches, discard, written

EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _stars(u: list[int], v: list[int]) -> pa.RecordBatch:
    """The parts that links join, each as links from its nodes to its least id."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(u, v, strict=True):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    pairs = [(x, r) for x in parent if (r := root(x)) != x]
    return batches({"u": [p[0] for p in pairs], "v": [p[1] for p in pairs]}, EDGES)


def _by_batch(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in frames:
        yield _stars(b.column(0).to_pylist(), b.column(1).to_pylist())


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every greater neighbour of a node to the least of the node and its neighbours."""
    both = edges.union(edges.select("v", "u"))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its lesser neighbours to the least of these."""
    low = edges.groupBy("u").agg(F.min("v").alias("low"))
    moved = edges.join(low, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.union(low.select("u", "low")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, component`` of every node that has a link in ``links(u, v)``: the least id that links reach.

    Each batch of links is joined inside its task first; then each round (a table in the shared folder) shortens the longest path to
    the least id by a constant factor, so rounds grow with the logarithm of that path, and no task ever has all links. Nulls and links
    of a node to itself are left out.
    """
    clean = links.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v")
    stars = written(clean.mapInArrow(_by_batch, "u long, v long").distinct(), "edges")
    mark = F.struct(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")))
    before = None
    while (after := tuple(stars.agg(mark.alias("m")).first()["m"])) != before and after[0]:
        edges, before = stars, after
        stars = written(_small_star(_large_star(edges)), "edges")
        discard(edges)
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(stars.select("v", "v").distinct())
