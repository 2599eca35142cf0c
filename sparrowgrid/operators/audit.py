"""Append-only audit events with two clocks: replay, bitemporal state, watermarks, retrospective proposals.

``events(seq, subject, arrival, asserted_at or null, posterior or null, valid_from, valid_until, valid_unknown)``. Assertion time
is ``coalesce(asserted_at, arrival)``. Everything is a grouped aggregate or a running window by subject or stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Posterior states that replay recognises.
STATES = ("candidate", "supported", "contradicted", "confirmed", "inert", "failed", "superseded", "isolated", "certified")


def asserted(events: DataFrame) -> DataFrame:
    return events.withColumn("at", F.coalesce("asserted_at", "arrival"))


def replay(events: DataFrame, at: Column, keep: Column | None = None) -> DataFrame:
    """``subject, status``: last recognised posterior asserted by ``at``, ties by arrival order; independent of the order of arrival."""
    e = asserted(events).where((F.col("at") <= at) & F.col("posterior").isin(*STATES))
    if keep is not None:
        e = e.where(keep)
    return e.groupBy("subject").agg(F.max_by("posterior", F.struct("at", "seq")).alias("status"))


def valid_at(t: Column) -> Column:
    """Known validity, start inclusive and end exclusive; unknown is not valid."""
    inside = (F.col("valid_from").isNull() | (F.col("valid_from") <= t)) & (F.col("valid_until").isNull() | (t < F.col("valid_until")))
    return ~F.coalesce("valid_unknown", F.lit(False)) & inside


def bitemporal(events: DataFrame, valid: Column, known: Column) -> DataFrame:
    """``subject, status, n_support, n_unknown, n_excluded`` as it was known at one time about another."""
    e = asserted(events).where(F.col("at") <= known)
    counts_ = valid_at(valid)
    ok = counts_ & F.col("posterior").isin(*STATES)
    return e.groupBy("subject").agg(
        F.max_by(F.when(ok, F.col("posterior")), F.when(ok, F.struct("at", "seq"))).alias("status"),
        F.count_if(counts_).alias("n_support"),
        F.count_if(F.coalesce("valid_unknown", F.lit(False))).alias("n_unknown"),
        F.count_if(~F.coalesce("valid_unknown", F.lit(False)) & ~counts_).alias("n_excluded"),
    )


def overlaps(a_from: Column, a_until: Column, b_from: Column, b_until: Column) -> Column:
    """Half-open intervals; null is unbounded."""
    low, high = F.lit("0001-01-01").cast("timestamp"), F.lit("9999-12-31").cast("timestamp")
    return (F.coalesce(a_from, low) < F.coalesce(b_until, high)) & (F.coalesce(b_from, low) < F.coalesce(a_until, high))


def intake(events: DataFrame, stream: str = "stream", order: str = "seq", episode: str = "episode") -> DataFrame:
    """Events with both running marks of their stream and a late flag. Late rows are flagged, never dropped; a null episode moves arrival only."""
    w = Window.partitionBy(stream).orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    late = F.coalesce(F.col(episode) < F.max(episode).over(before), F.lit(False))
    return events.withColumns({"arrival_mark": F.max(order).over(upto), "episode_mark": F.max(episode).over(upto), "late": late})


def project_revisions(revisions: DataFrame, transitions: DataFrame) -> DataFrame:
    """Revisions that the audit lacks: with a changed status and later than the subject's last status transition."""
    last = transitions.groupBy("subject").agg(F.max("at").alias("last"))
    out = revisions.where(F.col("previous") != F.col("new")).join(last, "subject", "left")
    return out.where(F.col("last").isNull() | (F.col("at") > F.col("last"))).drop("last")


def proposals(events: DataFrame, window: str) -> DataFrame:
    """``subject, proposal``: reactivate (observed again after retirement, within ``window`` of the last assertion) or retire (two contradictions or more since the last support)."""
    e = asserted(events)
    end = e.agg(F.max("at").alias("end"))  # one row
    s = e.groupBy("subject").agg(
        F.max(F.when(F.col("posterior").isin("failed", "superseded", "inert"), F.col("at"))).alias("retired"),
        F.max(F.when(F.col("posterior").isin("supported", "confirmed"), F.col("at"))).alias("seen"),
    )
    back = s.join(F.broadcast(end)).where(F.expr(f"seen > retired AND seen >= end - INTERVAL {window}")).select("subject", F.lit("reactivate").alias("proposal"))
    con = e.where("posterior = 'contradicted'").join(s, "subject").where("seen IS NULL OR at > seen").groupBy("subject").agg(F.count("*").alias("n")).where("n >= 2")
    return back.unionByName(con.select("subject", F.lit("retire").alias("proposal")))
