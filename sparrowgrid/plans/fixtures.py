"""Queries that hold what is found against a truth: families of copies, graded observations, entries by facets."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparrowgrid.operators import structure
from sparrowgrid.operators.graph import cut, free
from sparrowgrid.plans.base import query
from sparrowgrid.plans.texts import TERMS_SQL, docs
from sparrowgrid.session import folder, table


@query(
    "benchmark_metrics",
    f"""WITH t AS (SELECT text, len(list_filter({TERMS_SQL}, lambda x: strlen(x) >= 4)) > 0 AS named FROM documents WHERE text IS NOT NULL), f AS (SELECT text, bool_or(named) AS named FROM t GROUP BY text HAVING count(*) > 1)
SELECT count(*) AS families, count(*) FILTER (named) AS recovered FROM f""",
)
def benchmark_metrics(spark, sf_dir):
    """Documents with the same text are a family; clusters of like texts recover it where it has words at all."""
    d = docs(spark, sf_dir).where("text IS NOT NULL").select(F.col("doc_id").alias("node"), "text")
    return recovery(d, structure.clusters(d, "node", "text", 0.95))


def recovery(d, found):
    """How many families of equal texts ``found`` holds together."""
    d = d.select("node", F.md5("text").alias("family"))
    copies = d.groupBy("family").agg(F.count("*").alias("n")).where("n > 1").select("family")
    return structure.family_recovery(found, d.join(copies, "family", "left_semi"))


@query(
    "benchmark_run",
    f"""WITH t AS (SELECT text, len(list_filter({TERMS_SQL}, lambda x: strlen(x) >= 4)) > 0 AS named FROM documents WHERE text IS NOT NULL), f AS (SELECT text, bool_or(named) AS named FROM t GROUP BY text HAVING count(*) > 1)
SELECT (SELECT count(*) FROM documents WHERE text IS NOT NULL) AS documents, count(*) AS families, count(*) FILTER (named) AS recovered, true AS deterministic FROM f""",
)
def benchmark_run(spark, sf_dir):
    """The recovery of known families, and whether the clusters are the same when the documents lie otherwise."""
    d = docs(spark, sf_dir).where("text IS NOT NULL").select(F.col("doc_id").alias("node"), "text")
    found = cut(structure.clusters(d, "node", "text", 0.95))
    free(spark)
    same = structure.determined(d, "node", "text", 0.95, found).select("deterministic")
    return d.agg(F.count("*").alias("documents")).join(recovery(d, found)).join(same)  # single rows


#: Grades of events by their type.
GRADES = {"purchase": "Established", "signup": "Numerical", "click": "Heuristic", "view": "Conjectural", "error": "Derived"}


@query("certified_observations", "SELECT 'm' || user_id % 7 AS machine, 'user ' || user_id AS target, event_id::VARCHAR AS claim, value AS quantity, CASE event_type WHEN 'purchase' THEN 'Established' WHEN 'signup' THEN 'Numerical' ELSE 'Derived' END AS status FROM events WHERE event_type IN ('purchase', 'signup', 'error')")
def certified_observations(spark, sf_dir):
    """Reports of seven machines, written as JSON from events and loaded again: the observations that certify."""
    status = F.create_map(*[F.lit(x) for kv in GRADES.items() for x in kv])[F.col("event_type")]
    machine = F.concat(F.lit("m"), F.col("user_id") % 7)
    o = F.struct(machine.alias("machine"), F.concat(F.lit("user "), F.col("user_id")).alias("target"), F.col("event_id").cast("string").alias("claim"), F.col("value").alias("quantity"), status.alias("status"))
    rows = table(spark, sf_dir, "events").groupBy(machine.alias("machine"), F.floor(F.col("event_id") / 5000).alias("part")).agg(F.collect_list(o).alias("observations"))
    to = folder(spark, "reports")
    rows.select(F.array(F.struct("machine", "observations")).alias("machine_reports"), F.lit("open").alias("verdict")).write.json(to)
    # One report a line: read as such.
    report = spark.read.schema(structure.REPORT).json(to)
    return structure.certified(report.select(F.explode("machine_reports").alias("m")).select(F.inline("m.observations")))


@query("facet_query", "SELECT p_name AS name, 'BUILD' AS lifecycle, p_partkey AS part FROM part WHERE p_size % 4 IN (0, 1) AND lower(p_brand) = 'brand#17'")
def facet_query(spark, sf_dir):
    """Parts as entries: sizes stand for a phase of life under several spellings; brands are domains, asked for in any case."""
    from sparrowgrid.sources import packs

    size = F.col("p_size") % 4
    life = F.when(size == 0, "fabricate").when(size == 1, "BUILD").when(size == 2, "Maintain")
    facets = F.struct(*[packs.canonical(life if f == "lifecycle" else F.lit(None).cast("string")).alias(f) for f in packs.FACETS])
    e = table(spark, sf_dir, "part").select("p_partkey", F.lit("human").alias("kind"), F.col("p_name").alias("name"), F.col("p_brand").alias("domain"), F.col("p_type").alias("mode"), facets.alias("facets"))
    return packs.by_facets(e, kind="human", domain="BRAND#17", lifecycle="build").select("name", "facets.lifecycle", F.col("p_partkey").alias("part"))
