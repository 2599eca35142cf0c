"""Process telemetry and observation logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparrowgrid.operators.graph import cut


def deviations(measurements: DataFrame, constraints: DataFrame) -> DataFrame:
    """``id, constraint_id, expected, actual, severity`` of measurements outside a band of their metric; either bound may be missing.

    Constraints are a dimension; the join is left to the optimiser, which broadcasts it only where its size allows.
    """
    j = measurements.join(constraints, "metric")
    low, high = F.col("value") < F.col("min_value"), F.col("value") > F.col("max_value")
    expected = F.when(low, F.col("min_value")).when(high, F.col("max_value"))
    span = F.when(F.col("min_value").isNotNull() & F.col("max_value").isNotNull(), F.greatest(F.col("max_value") - F.col("min_value"), F.lit(1e-9))).otherwise(1.0)
    out = j.withColumn("expected", expected).where("expected IS NOT NULL")
    return out.select("id", "constraint_id", "expected", F.col("value").alias("actual"), F.least(F.abs(F.col("value") - F.col("expected")) / span, F.lit(1.0)).alias("severity"))


def concurrent(observations: DataFrame, bucket: int = 3600) -> DataFrame:
    """``a, b``: pairs of observations whose closed intervals [start, stop] (seconds) overlap, a before b.

    A range join by time buckets: an observation is in every bucket that it touches, and a pair is made in the bucket
    where the later of the two begins, once.
    """
    o = observations.select("seq", "start", "stop")
    placed = o.withColumn("k", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.col("stop") / bucket))))
    a = placed.select(F.col("seq").alias("a"), F.col("start").alias("s1"), F.col("stop").alias("e1"), "k")
    b = placed.select(F.col("seq").alias("b"), F.col("start").alias("s2"), F.col("stop").alias("e2"), "k")
    hit = a.join(b, "k").where((F.col("a") < F.col("b")) & (F.col("s1") <= F.col("e2")) & (F.col("s2") <= F.col("e1")))
    return hit.where(F.col("k") == F.floor(F.greatest("s1", "s2") / bucket)).select("a", "b")


def numbered(new: DataFrame, last: int, order: list[str]) -> DataFrame:
    """New log rows with rising numbers after ``last``, from per-partition offsets of a range sort; one global order, no single task."""
    s = cut(new.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id()}))
    s = s.withColumn("_i", F.col("_i") - F.shiftleft(F.col("_p").cast("long"), 33))
    sizes = s.groupBy("_p").agg(F.count("*").alias("n"))
    before = sizes.withColumn("off", F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))).select("_p", F.coalesce("off", F.lit(0)).alias("off"))
    return s.join(F.broadcast(before), "_p").withColumn("seq", F.col("off") + F.col("_i") + last + 1).drop("_p", "_i", "off")


def promote(observations: DataFrame) -> DataFrame:
    """Candidate claims that cite their observation; the body is cut to 200 characters."""
    return observations.select(F.concat(F.lit("obs:"), F.col("seq").cast("string")).alias("cites"), F.substring("body", 1, 200).alias("claim"), F.lit("candidate").alias("status"))


def cited(claims: DataFrame, observations: DataFrame) -> DataFrame:
    """``claim_id, seq``: observations that claims cite as ``obs:<n>``, each once."""
    refs = claims.select("claim_id", F.explode(F.regexp_extract_all("text", F.lit(r"obs:(\d+)"), 1)).alias("r")).select("claim_id", F.col("r").cast("long").alias("seq")).distinct()
    return refs.join(observations.select("seq"), "seq", "left_semi").select("claim_id", "seq")
