"""Classification of vectors on a grid of (domain, mode) cells, coverage and linkage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Share of the domain's score in a cell's score, and cells of a domain that make the domain's score.
DOMAIN_SHARE, DOMAIN_CELLS = 0.4, 2


@dataclass(frozen=True)
class Allowed:
    """What metadata a text must have: the first speaker and the first context named (where any are), and all tags."""

    speakers: tuple[str, ...] = ()
    contexts: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()

    def column(self, speaker: Column, context: Column, tags: Column) -> Column:
        """Whether a row's metadata is allowed; metadata that is asked for and missing isn't."""
        one = lambda want, have: F.coalesce(have == want[0], F.lit(False)) if want else F.lit(True)
        every = F.lit(True)
        for t in self.tags:
            every = every & F.coalesce(F.array_contains(tags, t), F.lit(False))
        return one(self.speakers, speaker) & one(self.contexts, context) & every


def snapshot(nodes: DataFrame, coherence: str, verdict: str) -> DataFrame:
    """One row ``nodes, coherence_index, high, mid, low, success, failure, inert, asserted_index``: bands over 0.7, over 0.3 and the rest; without nodes the index is 1."""
    from sparrowgrid.operators.beliefs import rating

    c, r = F.col(coherence), rating(F.col(verdict))
    said = F.col(verdict).isNotNull()
    return nodes.agg(
        F.count("*").alias("nodes"), F.coalesce(F.avg(c), F.lit(1.0)).alias("coherence_index"), F.count_if(c > 0.7).alias("high"), F.count_if((c > 0.3) & (c <= 0.7)).alias("mid"), F.count_if(c <= 0.3).alias("low"),
        *[F.count_if(said & (r == x)).alias(x) for x in ("success", "failure", "inert")], F.avg(verdict).alias("asserted_index"),
    )


#: Stability of a certified branch, and coherence over which nodes make it and under which a node is alone (fixed values).
STABLE, DENSE, APART = 0.85, 0.7, 0.3


def branches(nodes: DataFrame, id_col: str, coherence: str) -> DataFrame:
    """``branch, kind, node, score``: the certified branch of all dense nodes, named by the least of them, with its stability; and a branch of one for each
    node that is apart, with its coherence. Members are rows, so a branch may be of any size."""
    dense = nodes.where(F.col(coherence) > DENSE)
    name = dense.agg(F.min(id_col).alias("branch"))  # one row
    certified = dense.join(F.broadcast(name)).select("branch", F.lit("certified").alias("kind"), F.col(id_col).alias("node"), F.lit(STABLE).alias("score"))
    apart = nodes.where(F.col(coherence) < APART)
    return certified.unionByName(apart.select(F.col(id_col).alias("branch"), F.lit("isolated").alias("kind"), F.col(id_col).alias("node"), F.col(coherence).alias("score")))


def adaptive_k(n: Column) -> Column:
    """Entries that a cell's score averages, by its size."""
    return F.when(n.between(1, 3), 1).when(n.between(4, 10), 2).when(n.between(11, 30), 3).otherwise(4)


def population(n: Column) -> Column:
    """Weight of a cell by its number of entries."""
    return F.when(n >= 10, 1 + F.least(n / 100, F.lit(0.2))).when(n <= 3, 1 + (3 - n) / 10).otherwise(F.lit(1.0))


def score_cells(best: DataFrame, sizes: DataFrame) -> DataFrame:
    """``i, domain, mode, score, rank`` from each query's similarity to each cell (``i, domain, mode, s``) and cell sizes (``domain, mode, n``).

    A domain scores the mean of its two best cells; scores over 1 are scaled so that the query's best is 1.
    """
    by_domain = Window.partitionBy("i", "domain")
    ranked = best.withColumn("r", F.row_number().over(by_domain.orderBy(F.col("s").desc(), "mode")))
    top = ranked.withColumn("d", F.avg(F.when(F.col("r") <= DOMAIN_CELLS, F.col("s"))).over(by_domain))
    # Grid sizes are bounded by the grid, 45 cells by default.
    raw = top.join(F.broadcast(sizes), ["domain", "mode"]).withColumn("raw", (DOMAIN_SHARE * F.col("d") + (1 - DOMAIN_SHARE) * F.col("s")) * population(F.col("n")))
    scaled = raw.withColumn("top", F.max("raw").over(Window.partitionBy("i")))
    out = scaled.withColumn("score", F.round(F.when(F.col("top") > 1, F.col("raw") / F.col("top")).otherwise(F.col("raw")), 6))
    return out.select("i", "domain", "mode", "score", F.row_number().over(Window.partitionBy("i").orderBy(F.col("score").desc(), "domain", "mode")).alias("rank"))


def margins(scores: DataFrame) -> DataFrame:
    """Best cell of each query, its lead over the runner-up, and what the lead is worth: tie, weak or clear."""
    w = Window.partitionBy("i").orderBy("rank")
    led = scores.withColumn("lead", F.round(F.col("score") - F.lead("score").over(w), 6)).where("rank = 1")
    verdict = F.when(F.col("lead") < 0.02, "tie").when(F.col("lead") < 0.08, "weak").otherwise("clear")
    return led.select("i", "domain", "mode", "score", "lead", verdict.alias("verdict"))


def linkage(scores: DataFrame) -> DataFrame:
    """Unordered pairs of the two best cells of each query, with the number of queries; strongest first."""
    two = scores.where("rank <= 2").groupBy("i").agg(F.sort_array(F.collect_list(F.struct("domain", "mode"))).alias("c")).where(F.size("c") == 2)
    a, b = F.col("c")[0], F.col("c")[1]
    cols = [a["domain"].alias("domain_a"), a["mode"].alias("mode_a"), b["domain"].alias("domain_b"), b["mode"].alias("mode_b")]
    return two.select(*cols).groupBy("domain_a", "mode_a", "domain_b", "mode_b").agg(F.count("*").alias("n")).withColumn("cross_domain", F.col("domain_a") != F.col("domain_b"))


def gains(live: DataFrame, sims: DataFrame, threshold: float) -> DataFrame:
    """``candidate, newly_covered, lift``: records that a candidate covers first, and the sum of its improvements.

    ``live(record, s)``: best similarity to what there is (null: nothing); ``sims(record, candidate, s)``.
    """
    j = sims.join(live.select("record", F.coalesce("s", F.lit(-1.0)).alias("now")), "record")
    new = (F.col("now") < threshold) & (F.col("s") >= threshold)
    return j.groupBy("candidate").agg(
        F.sum(new.cast("long")).alias("newly_covered"), F.round(F.sum(F.greatest(F.lit(0.0), F.col("s") - F.col("now"))), 6).alias("lift")
    ).withColumn("useful", F.col("newly_covered") > 0)


def majority(rows: DataFrame, group: str, axes: list[str]) -> DataFrame:
    """``group, axis, value, n``: the most frequent value of each axis in each group; nulls don't count, ties go to the smaller value."""
    long = rows.select(group, F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("value")) for a in axes])).alias("f"))
    n = long.where("f.value IS NOT NULL").groupBy(group, "f.axis", "f.value").agg(F.count("*").alias("n"))
    w = Window.partitionBy(group, "axis").orderBy(F.col("n").desc(), "value")
    return n.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def failures(nodes: DataFrame, id_col: str, verdict: str) -> DataFrame:
    """``id_col, verdict, place, asserted_index``: nodes with a verdict under 0, worst first, beside the mean of all verdicts (null with none)."""
    index = nodes.agg(F.avg(verdict).alias("asserted_index"))  # one row
    bad = nodes.where(F.col(verdict) < 0).select(id_col, verdict)
    # Places come from counts of equal verdicts, so that only rows of one verdict meet in a window.
    counts = bad.groupBy(verdict).agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy(verdict).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    here = F.row_number().over(Window.partitionBy(verdict).orderBy(id_col))
    return bad.join(before, verdict).withColumn("place", (F.col("before") + here).cast("int")).drop("before").join(F.broadcast(index))
