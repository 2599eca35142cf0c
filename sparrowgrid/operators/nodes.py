"""Nodes with labels and vectors: registered once for each label, edited in place, deleted by label; coherence is made anew for what changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparrowgrid.operators import neighbours
from sparrowgrid.operators.overlay import Overlay

#: Neighbours whose mean similarity is a node's coherence, and what stands between a label and its parts (fixed values).
NEAREST, PART = 5, " → "


def coherence(some: DataFrame, nodes: DataFrame) -> DataFrame:
    """``id, coherence`` of ``some`` nodes (``id, v``) among all: the mean of the five best cosines, no less than 0, and 1 for a node alone."""
    return neighbours.density(neighbours.top_k(some, nodes, "id", "v", NEAREST, skip_self=True), some, "id")


def register(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """``id, label, node, fresh, coherence`` of each new row (``id, label, v``): the node that has its label, be it an old one (``id, label, v``) or the first new one.

    A row without a label is a node of its own. Fresh nodes have their coherence among all nodes, old and fresh; others have none.
    """
    old = nodes.where("label IS NOT NULL").groupBy("label").agg(F.min("id").alias("old"))
    first = F.min("id").over(Window.partitionBy("label"))
    rows = new.withColumn("first", F.when(F.col("label").isNotNull(), first).otherwise(F.col("id"))).join(old, "label", "left")
    rows = rows.withColumn("node", F.coalesce("old", "first")).withColumn("fresh", F.col("node").eqNullSafe(F.col("id")) & F.col("old").isNull())
    fresh = rows.where("fresh").select("id", "v")
    c = coherence(fresh, nodes.select("id", "v").unionByName(fresh))
    return rows.select("id", "label", "node", "fresh").join(c, "id", "left")


def edit(nodes: DataFrame, edits: DataFrame) -> tuple[Overlay, DataFrame]:
    """(overlay, changed) of edits (``id`` and the columns to set; null keeps what is there): nodes as they are now, and ``id, coherence`` of the edited ones that exist."""
    now = Overlay(nodes, "id").patch(edits)
    every = now.read()
    touched = every.join(edits.select("id").distinct(), "id", "left_semi").select("id", "v")
    return now, coherence(touched, every.select("id", "v"))


def delete(nodes: DataFrame, label: str) -> Overlay:
    """Nodes without those labelled ``label`` or with a label that begins with it and the sign for its parts."""
    return Overlay(nodes, "id").drop(nodes.where((F.col("label") == label) | F.startswith("label", F.lit(label + PART))).select("id"))
