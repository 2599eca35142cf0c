"""Controls: permutation nulls over labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowgrid.operators.discovery import numbered
from sparrowgrid.operators.graph import cut
from sparrowgrid.operators.neighbours import top_k


def permutation_null(vectors: DataFrame, id_col: str, label_col: str, vec_col: str, permutations: int = 50, seed: int = 7) -> DataFrame:
    """One row ``fitness, null_mean, null_sd, z, above_null``: share of vectors whose nearest other has their label, against labels dealt anew.

    Neighbours are found once. A permutation deals the labels in the order of a hash of (id, permutation): ids have numbers, and all
    rows (permutation, hash) have numbers, from range partitions, so that no permutation is one task; they meet by
    permutation and place, in one job. Ids are distinct.
    """
    nn = cut(top_k(vectors, vectors, id_col, vec_col, 1).select("i", "j"))
    labels = cut(vectors.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label")))
    n = labels.count()
    places = numbered(labels, F.col("id"))
    perms = labels.select("id", "label", F.explode(F.sequence(F.lit(1), F.lit(permutations))).alias("p"))
    drawn = numbered(perms, F.struct("p", F.xxhash64("id", "p", F.lit(seed)), "id")).select("p", (F.col("at") - (F.col("p") - 1) * n).alias("at"), "label")
    dealt = places.select("id", "at").join(drawn, "at").select("p", "id", "label")
    # Permutation 0 leaves the labels where they are.
    dealt = dealt.unionByName(places.select(F.lit(0).alias("p"), "id", "label"))
    mine = dealt.select("p", F.col("id").alias("i"), F.col("label").alias("a"))
    other = dealt.select("p", F.col("id").alias("j"), F.col("label").alias("b"))
    rate = mine.join(nn, "i").join(other, ["p", "j"]).groupBy("p").agg(F.avg((F.col("a") == F.col("b")).cast("double")).alias("rate"))
    null = F.when(F.col("p") > 0, F.col("rate"))
    s = rate.agg(F.max(F.when(F.col("p") == 0, F.col("rate"))).alias("fitness"), F.avg(null).alias("null_mean"), F.stddev_pop(null).alias("null_sd"))
    z = F.when(F.col("null_sd") > 0, (F.col("fitness") - F.col("null_mean")) / F.col("null_sd"))
    return s.withColumn("z", z).withColumn("above_null", F.when(F.col("null_sd") > 0, F.col("z") >= 2).otherwise(F.col("fitness") > F.col("null_mean")))
