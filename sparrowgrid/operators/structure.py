"""Structure of a text corpus: clusters of like texts, outliers, and recovery of a known truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowgrid.functions import text as T
from sparrowgrid.operators import graph, overlap

#: Grades of observations, strongest first; the first four certify (fixed values).
GRADES = ("Established", "Derived", "EstablishedFinite", "Numerical", "Heuristic", "Conjectural", "Contradicted", "InsufficientData")
CERTIFYING = GRADES[:4]
REPORT = "machine_reports array<struct<machine: string, observations: array<struct<machine: string, target: string, claim: string, quantity: double, status: string>>>>, verdict string"


def overlaps(docs: DataFrame, id_col: str, text_col: str, threshold: float, least_bytes: int = 4) -> DataFrame:
    """``a, b, overlap``: term Jaccard of all pairs at or over the threshold, by rare-first prefixes."""
    words = F.array_distinct(F.filter(T.terms(F.col(text_col)), lambda x: F.octet_length(x) >= least_bytes))
    near = overlap.similar(docs.select(F.lit(0).alias("grp"), F.col(id_col).alias("id"), words.alias("t")), None, threshold)
    return near.select("a", "b", overlap.jaccard().alias("overlap"))


def clusters(docs: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """``node, component`` of texts that chains of overlaps at or over the threshold join. Texts of the same terms are linked to one of them, which alone meets others."""
    words = F.array_sort(F.array_distinct(F.filter(T.terms(F.col(text_col)), lambda x: F.octet_length(x) >= 4)))
    sets = docs.select(F.col(id_col).alias("id"), words.alias("t")).where(F.size("t") > 0).select("id", "t", F.xxhash64("t").alias("k"), F.xxhash64(F.lit(1), "t").alias("l"))
    first = graph.cut(sets.groupBy("k", "l").agg(F.min(F.struct("id", "t")).alias("f")).select("k", "l", F.col("f.id").alias("rep"), F.col("f.t").alias("t")))
    copies = sets.select("id", "k", "l").join(first.select("k", "l", "rep").hint("merge"), ["k", "l"]).where("id <> rep")
    near = overlap.similar(first.select(F.lit(0).alias("grp"), F.col("rep").alias("id"), "t"), None, threshold)
    return graph.components(near.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(copies.select(F.col("rep").alias("u"), F.col("id").alias("v"))))


def family_recovery(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row ``families, recovered``: families (``node, family``) whose members are all in one cluster."""
    j = truth.join(found, "node", "left").groupBy("family").agg(F.countDistinct("component").alias("c"), F.count_if(F.col("component").isNull()).alias("lost"))
    return j.agg(F.count("*").alias("families"), F.count_if((F.col("c") == 1) & (F.col("lost") == 0)).alias("recovered"))


def pair_recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row ``known, found`` of unordered pairs ``a, b``."""
    flat = lambda f: f.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    j = flat(truth).join(flat(found).withColumn("hit", F.lit(1)), ["a", "b"], "left")
    return j.agg(F.count("*").alias("known"), F.count("hit").alias("found"))


def certified(observations: DataFrame) -> DataFrame:
    """Observations with a ``status`` that certifies."""
    return observations.where(F.col("status").isin(*CERTIFYING))


def reports(spark: SparkSession, path: str) -> DataFrame:
    """``machine, target, claim, quantity, status`` of all machines of the reports under a path. A report that doesn't parse, or an unknown grade, fails the load."""
    rows = spark.read.schema(REPORT).option("multiLine", True).option("mode", "FAILFAST").json(path)
    rows = rows.select(F.explode("machine_reports").alias("m")).select(F.inline("m.observations"))
    known = F.col("status").isin(*GRADES)
    return rows.withColumn("status", F.when(known, F.col("status")).otherwise(F.raise_error(F.concat(F.lit("no such grade: "), F.coalesce("status", F.lit("null"))))))


def determined(docs: DataFrame, id_col: str, text_col: str, threshold: float, found: DataFrame | None = None) -> DataFrame:
    """One row ``hash, again, deterministic``: hashes of the clusters of the same texts, as they lie (``found``, where they are made already) and dealt anew."""
    def hashed(d: DataFrame, name: str, made: DataFrame | None = None) -> DataFrame:
        c = clusters(d, id_col, text_col, threshold) if made is None else made
        # A hash of each row, summed: no row order, no single task that gathers the clusters.
        return c.agg(F.coalesce(F.sum(F.xxhash64("node", "component").cast("decimal(38,0)")), F.lit(0)).alias(name))

    both = hashed(docs, "hash", found).join(hashed(docs.repartition(F.xxhash64(id_col)), "again"))  # two single rows
    return both.withColumn("deterministic", F.col("hash") == F.col("again"))


def truth_corpus(spark) -> DataFrame:
    """``node, family, body``: three families of eight templated notes and two loners."""
    topics = ("pump station keeps water level steady near valve", "night shift records parcel counts beside dock gate", "garden crew plants maple seedlings along river bank")
    rows = [(f * 8 + k, f, f"{topics[f]} report {k}") for f in range(3) for k in range(8)]
    return spark.createDataFrame([*rows, (24, None, "completely unrelated musings"), (25, None, "orbital telemetry glitch")], "node long, family int, body string")
