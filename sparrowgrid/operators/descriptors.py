"""Descriptors of nodes that compare across spaces: by anchors, by labels, by the shape of a neighbourhood."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparrowgrid.functions import vector as V
from sparrowgrid.operators import sequence
from sparrowgrid.operators.graph import cut

FLOOR = 1e-8


def _z(x: str, by: str) -> Column:
    w = Window.partitionBy(by)
    return (F.col(x) - F.avg(x).over(w)) / F.greatest(F.stddev_pop(x).over(w), F.lit(FLOOR))


def anchor(nodes: DataFrame, anchors: DataFrame) -> DataFrame:
    """``vec_id, anchor, sim, z``: cosine of each node (``vec_id, v``) to each of a few anchors (``anchor, v``), z-scored within the node."""
    # A cross join by intent: anchors are given, one for each known correspondence; the optimiser broadcasts them while they are small.
    both = nodes.select("vec_id", F.col("v").alias("a")).crossJoin(anchors.select("anchor", F.col("v").alias("b")))
    return both.select("vec_id", "anchor", V.cosine(F.col("a"), F.col("b")).alias("sim")).withColumn("z", _z("sim", "vec_id"))


def by_label(nodes: DataFrame) -> DataFrame:
    """``vec_id, label, mean, z``: mean cosine of each node (``vec_id, label, v``) to the others of each label.

    A mean of cosines is an inner product with the label's sum of unit vectors, so no pairs of nodes are made; the sums are
    one row for each label. A label that holds nobody else gives no row.
    """
    unit = nodes.select("vec_id", "label", V.normalise(F.col("v")).alias("u"))
    parts = unit.select("label", F.posexplode("u").alias("pos", "x")).groupBy("label", "pos").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    sums = parts.groupBy(F.col("label").alias("to")).agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("sum"))
    both = unit.crossJoin(sums)
    mine = F.when(F.col("to") == F.col("label"), 1).otherwise(0)
    total = V.dot(F.col("u"), F.col("sum")) - mine * V.dot(F.col("u"), F.col("u"))
    mean = both.where(F.col("n") > mine).select("vec_id", F.col("to").alias("label"), (total / (F.col("n") - mine)).alias("mean"))
    return mean.withColumn("z", _z("mean", "vec_id"))


def structural(top: DataFrame, k: int, profile: int) -> DataFrame:
    """``i, degree, neighbour_degree, clustering, z`` from ``i, j, s, rank`` of every node.

    ``z`` is the z-scored array of the ``profile`` best similarities, the degree and the neighbours' mean degree over the
    number of nodes, and the clustering coefficient, in the graph of nodes that are among each other's ``k`` best.
    """
    near = top.where(F.col("rank") <= k).select("i", "j")
    graph = near.join(near.select(F.col("j").alias("i"), F.col("i").alias("j")), ["i", "j"])
    nodes = top.where("rank = 1").select("i")
    deg = nodes.join(graph.groupBy("i").agg(F.count("*").alias("d")), "i", "left").select("i", F.coalesce("d", F.lit(0)).alias("degree"))
    around = graph.join(deg.select(F.col("i").alias("j"), "degree"), "j").groupBy("i").agg(F.avg("degree").alias("nb"))
    # A node has at most k neighbours, so its pairs are few.
    x, y = graph.select("i", F.col("j").alias("a")), graph.select("i", F.col("j").alias("b"))
    ties = graph.select(F.col("i").alias("a"), F.col("j").alias("b"))
    tri = x.join(y, "i").where("a < b").join(ties, ["a", "b"]).groupBy("i").agg(F.count("*").alias("tri"))
    n = nodes.agg(F.count("*").alias("nodes"))
    best = top.where(F.col("rank") <= profile).groupBy("i").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "s"))), lambda p: p["s"]).alias("p"))
    d = deg.join(around, "i", "left").join(tri, "i", "left").join(best, "i").join(F.broadcast(n))  # one row
    pairs = F.col("degree") * (F.col("degree") - 1) / 2
    d = d.withColumns({"neighbour_degree": F.coalesce("nb", F.lit(0.0)), "clustering": F.when(pairs > 0, F.coalesce("tri", F.lit(0)) / pairs).otherwise(0.0)})
    v = F.concat("p", F.array(F.col("degree") / F.col("nodes"), F.col("neighbour_degree") / F.col("nodes"), F.col("clustering")))
    return d.select("i", "degree", "neighbour_degree", "clustering", V.zscore(v).alias("z"))


def candidates(left: DataFrame, right: DataFrame, top: int) -> DataFrame:
    """``i, j, s, rank``: for each descriptor ``id, z`` of one space the ``top`` most alike of another (cosine; ties to the smaller id)."""
    from sparrowgrid.operators.neighbours import top_k

    return top_k(left.select("id", "z"), right.select("id", "z"), "id", "z", top, skip_self=False)


def random_candidates(ids: DataFrame, top: int, seed: int = 7) -> DataFrame:
    """``i, j, rank``: for each id (column ``id``) ``top`` of all ids drawn by a hash: the null that rankings are read against.

    Ids are numbered in the order of a hash; draws are the places after a place that each id's hash names, so nothing is
    paired with everything.
    """
    from sparrowgrid.operators.discovery import numbered

    n = max(ids.count(), 1)
    places = numbered(ids.select("id"), F.struct(F.xxhash64("id", F.lit(seed)), "id"))
    start = F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(n))
    draws = places.select(F.col("id").alias("i"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(min(top, n) - 1)), lambda k: F.pmod(start + k, F.lit(n)))).alias("rank", "at"))
    return draws.join(places.select("at", F.col("id").alias("j")), "at").select("i", "j", (F.col("rank") + 1).alias("rank"))


def arm_score(found: DataFrame, left: DataFrame, right: DataFrame, rounds: int = 200) -> DataFrame:
    """One row ``n, top1, top3, preservation, low, high`` of an arm's ranked candidates ``i, j, rank``, where i's true match is i itself.

    ``preservation``: the share of edges ``i, j`` of the left graph whose ends' first candidates are joined by an edge of the right one (either
    way round; 0 without edges). ``low, high``: the 95 % bootstrap interval of top1, over nodes.
    """
    hits = cut(found.groupBy("i").agg(F.max(((F.col("rank") == 1) & (F.col("j") == F.col("i"))).cast("double")).alias("top1"), F.max(((F.col("rank") <= 3) & (F.col("j") == F.col("i"))).cast("double")).alias("top3")))
    first = found.where("rank = 1").select("i", F.col("j").alias("to"))
    edges = left.where("i <> j").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct()
    known = right.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).distinct().withColumn("there", F.lit(1))
    mapped = edges.join(first, "i", "left").join(first.select(F.col("i").alias("j"), F.col("to").alias("to_j")), "j", "left")
    # A node without candidates maps to itself.
    a, b = F.coalesce("to", "i"), F.coalesce("to_j", "j")
    kept = mapped.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).join(known, ["a", "b"], "left")
    share = kept.agg(F.coalesce(F.count("there") / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("preservation"))
    interval = sequence.bootstrap(hits, "top1", "i", rounds).select("low", "high")
    means = hits.agg(F.count("*").alias("n"), F.coalesce(F.avg("top1"), F.lit(0.0)).alias("top1"), F.coalesce(F.avg("top3"), F.lit(0.0)).alias("top3"))
    return means.join(share).join(interval)  # three single rows
