"""Queries over relational facts and event streams: graphs, triples, n-grams, sequences, telemetry, shapes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparrowgrid.functions import text as T
from sparrowgrid.operators import graph, ngram, process, sequence, triples
from sparrowgrid.plans.base import query
from sparrowgrid.session import table

EDGE_SQL = """edges AS (SELECT 'o' || o_orderkey AS source, 'c' || o_custkey AS target FROM orders UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer
UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"""


def edges(spark, sf_dir):
    """Orders depend on customers, customers on nations, nations on regions."""
    e = lambda t, p, a, q, b: table(spark, sf_dir, t).select(F.concat(F.lit(p), F.col(a)).alias("source"), F.concat(F.lit(q), F.col(b)).alias("target"))
    return e("orders", "o", "o_orderkey", "c", "o_custkey").unionByName(e("customer", "c", "c_custkey", "n", "c_nationkey")).unionByName(e("nation", "n", "n_nationkey", "r", "n_regionkey"))


@query("edges_incident", f"WITH {EDGE_SQL}, i AS (SELECT source AS node FROM edges UNION ALL SELECT target FROM edges) SELECT node, count(*) AS degree FROM i GROUP BY node")
def edges_incident(spark, sf_dir):
    e = edges(spark, sf_dir)
    return e.select(F.col("source").alias("node")).unionAll(e.select("target")).groupBy("node").agg(F.count("*").alias("degree"))


WALK_SQL = f"""{EDGE_SQL}, up AS (SELECT target AS source, source AS target FROM edges),
w AS (WITH RECURSIVE r(seed, node, hop) AS (SELECT 'r' || r_regionkey, 'r' || r_regionkey, 0 FROM region UNION SELECT r.seed, up.target, r.hop + 1 FROM r JOIN up ON up.source = r.node WHERE r.hop < 5) SELECT seed, node, min(hop) AS hop FROM r GROUP BY seed, node)"""


def walked(spark, sf_dir):
    seeds = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("node"))
    return graph.walk(seeds, edges(spark, sf_dir).select(F.col("target").alias("source"), F.col("source").alias("target")))


@query("depends_on_walk", f"WITH {WALK_SQL} SELECT * FROM w")
def depends_on_walk(spark, sf_dir):
    return walked(spark, sf_dir)


@query("propagation_impact", f"WITH {WALK_SQL} SELECT seed, hop, count(*) AS nodes, round(max(0.9 * pow(0.85, hop)), 6) AS impact FROM w GROUP BY seed, hop")
def propagation_impact(spark, sf_dir):
    return graph.propagate(walked(spark, sf_dir), 0.9).groupBy("seed", "hop").agg(F.count("*").alias("nodes"), F.max("impact").alias("impact"))


@query(
    "revised_hypotheses",
    f"WITH {WALK_SQL}, a AS (SELECT node, min(hop) AS step FROM w GROUP BY node) SELECT o_orderkey AS h_id, step FROM orders JOIN a ON node = 'c' || o_custkey",
)
def revised_hypotheses(spark, sf_dir):
    a = walked(spark, sf_dir).groupBy("node").agg(F.min("hop").alias("step"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("h_id"), F.concat(F.lit("c"), F.col("o_custkey")).alias("node"))
    return o.join(a, "node").select("h_id", "step")


@query(
    "adjacency_union",
    f"WITH {EDGE_SQL}, a AS (SELECT source AS node, target AS other FROM edges UNION SELECT target, source FROM edges UNION SELECT 'n' || a.n_nationkey, 'n' || b.n_nationkey FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey) SELECT node, count(*) AS neighbours FROM a GROUP BY node",
)
def adjacency_union(spark, sf_dir):
    e, n = edges(spark, sf_dir), table(spark, sf_dir, "nation")
    pin = n.select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("node"), "n_regionkey").join(n.select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("other"), "n_regionkey"), "n_regionkey").where("node <> other")
    both = e.select(F.col("source").alias("node"), F.col("target").alias("other")).union(e.select("target", "source")).union(pin.select("node", "other")).distinct()
    return both.groupBy("node").agg(F.count("*").alias("neighbours"))


FACT_SQL = """facts AS (SELECT 'nation' || n_nationkey AS s, 'in' AS p, 'region' || n_regionkey AS o FROM nation UNION ALL SELECT 'customer' || c_custkey, 'lives', 'nation' || c_nationkey FROM customer
UNION ALL SELECT 'order' || o_orderkey, 'requires', 'customer' || o_custkey FROM orders)"""


def facts(spark, sf_dir):
    def of(t, a, key, p, b, other):
        return table(spark, sf_dir, t).select(
            F.concat(F.lit(a), F.col(key)).alias("s"), F.lit(p).alias("p"), F.concat(F.lit(b), F.col(other)).alias("o"), F.lit("observed").alias("kind"), F.lit(1.0).alias("confidence")
        )

    n = of("nation", "nation", "n_nationkey", "in", "region", "n_regionkey")
    return n.unionByName(of("customer", "customer", "c_custkey", "lives", "nation", "c_nationkey")).unionByName(of("orders", "order", "o_orderkey", "requires", "customer", "o_custkey"))


@query("triple_match_2hop", f"WITH {FACT_SQL} SELECT a.s AS x, b.o AS r FROM facts a JOIN facts b ON a.o = b.s WHERE a.p = 'lives' AND b.p = 'in'")
def triple_match_2hop(spark, sf_dir):
    return triples.homomorphisms(facts(spark, sf_dir), [("?x", "lives", "?n"), ("?n", "in", "?r")]).select("x", "r")


@query(
    "triple_homomorphisms",
    f"WITH {FACT_SQL} SELECT c.s AS o, a.s AS c, b.o AS r FROM facts c JOIN facts a ON c.o = a.s JOIN facts b ON a.o = b.s WHERE c.p = 'requires' AND a.p = 'lives' AND b.p = 'in'",
)
def triple_homomorphisms(spark, sf_dir):
    return triples.homomorphisms(facts(spark, sf_dir), [("?o", "requires", "?c"), ("?c", "lives", "?n"), ("?n", "in", "?r")]).select("o", "c", "r")


@query("transform_invert", f"WITH {FACT_SQL} SELECT DISTINCT o AS s, 'produces' AS p, s AS o, 0.8::DOUBLE AS confidence FROM facts WHERE p = 'requires'")
def transform_invert(spark, sf_dir):
    return triples.invert(facts(spark, sf_dir), "requires").drop("kind")


@query("transform_compose", f"WITH {FACT_SQL} SELECT DISTINCT a.s, 'within' AS p, b.o, 0.8::DOUBLE AS confidence FROM facts a JOIN facts b ON a.o = b.s WHERE a.p = 'lives' AND b.p = 'in'")
def transform_compose(spark, sf_dir):
    return triples.compose(facts(spark, sf_dir), "lives", "in", "within").drop("kind")


@query(
    "transform_substitute",
    f"WITH {FACT_SQL} SELECT DISTINCT CASE s WHEN 'nation1' THEN 'nation2' ELSE s END AS s, p, CASE o WHEN 'nation1' THEN 'nation2' ELSE o END AS o, 0.8::DOUBLE AS confidence FROM facts WHERE s = 'nation1' OR o = 'nation1'",
)
def transform_substitute(spark, sf_dir):
    return triples.substitute(facts(spark, sf_dir), "nation1", "nation2").drop("kind")


@query("transform_generalize", f"WITH {FACT_SQL} SELECT DISTINCT 'Any' AS s, p, o, 0.6::DOUBLE AS confidence FROM facts")
def transform_generalize(spark, sf_dir):
    return triples.generalize(facts(spark, sf_dir), "s").drop("kind")


@query("transform_analogize", f"WITH {FACT_SQL} SELECT DISTINCT 'land1' AS s, p, CASE o WHEN 'region1' THEN 'zone1' ELSE o END AS o, 0.6::DOUBLE AS confidence FROM facts WHERE s = 'nation1'")
def transform_analogize(spark, sf_dir):
    return triples.analogize(facts(spark, sf_dir), {"nation1": "land1", "region1": "zone1"}).drop("kind")


@query(
    "triples_derived_union",
    f"WITH {FACT_SQL}, d AS (SELECT DISTINCT o AS s, 'produces' AS p, s AS o FROM facts WHERE p = 'requires'), u AS (SELECT s, p, o, 'observed' AS kind FROM facts UNION ALL SELECT s, p, o, 'derived' FROM (SELECT * FROM d EXCEPT SELECT s, p, o FROM facts)) SELECT p, kind, count(*) AS n FROM u GROUP BY ALL",
)
def triples_derived_union(spark, sf_dir):
    f = facts(spark, sf_dir)
    return triples.union_new(f, triples.invert(f, "requires")).groupBy("p", "kind").agg(F.count("*").alias("n"))


@query(
    "constraint_violations",
    f"WITH {FACT_SQL}, k AS (SELECT 'nation' || n_nationkey AS s, 'in' AS p, 'region' || ((n_regionkey + n_nationkey % 2) % 5) AS o, n_name AS descr FROM nation) SELECT descr AS \"desc\", 'requires' AS kind FROM k LEFT JOIN facts f USING (s, p, o) WHERE f.s IS NULL",
)
def constraint_violations(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    k = n.select(
        F.concat(F.lit("nation"), F.col("n_nationkey")).alias("s"), F.lit("in").alias("p"), F.concat(F.lit("region"), ((F.col("n_regionkey") + F.col("n_nationkey") % 2) % 5).cast("string")).alias("o"),
        F.col("n_name").alias("desc"), F.lit("requires").alias("kind"),
    )
    return triples.violations(facts(spark, sf_dir), k)


@query("substitution_invariants", f"WITH {FACT_SQL} SELECT p, count(*) AS n FROM facts WHERE s NOT IN ('nation1', 'nation2') AND o NOT IN ('nation1', 'nation2') GROUP BY p")
def substitution_invariants(spark, sf_dir):
    out = ("nation1", "nation2")
    return facts(spark, sf_dir).where(~F.col("s").isin(*out) & ~F.col("o").isin(*out)).groupBy("p").agg(F.count("*").alias("n"))


@query(
    "transform_gates",
    f"""WITH {FACT_SQL}, d AS (SELECT DISTINCT o AS s, 'produces' AS p, s AS o FROM facts WHERE p = 'requires'), u AS (SELECT s, p, o FROM facts UNION SELECT * FROM d),
z AS (SELECT (SELECT count(*) FROM facts LEFT JOIN u USING (s, p, o) WHERE u.s IS NULL) AS lost, (SELECT count(*) FROM u WHERE p = 'precedes' AND s = o) AS self, (SELECT count(*) FROM u) AS facts,
(SELECT count(*) FROM (SELECT DISTINCT s, o FROM u WHERE p IN ('causes', 'enables')) JOIN (SELECT DISTINCT s, o FROM u WHERE p = 'contradicts') USING (s, o)) AS clash),
g AS (SELECT (lost = 0)::INT::DOUBLE AS empirical, 1.0::DOUBLE AS logical, (self = 0)::INT::DOUBLE AS temporal, (clash = 0)::INT::DOUBLE AS causal, 1.0::DOUBLE AS procedural, facts FROM z)
SELECT *, (empirical + logical + temporal + causal + procedural) / 5 AS composite, empirical = 1 AND (empirical + logical + temporal + causal + procedural) / 5 >= 0.5 AS accepted FROM g""",
)
def transform_gates(spark, sf_dir):
    f = facts(spark, sf_dir)
    return triples.gates(f, triples.union_new(f, triples.invert(f, "requires")))


NG_SQL = rf"""t AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS t FROM conversations),
g AS (SELECT n, array_to_string(t[i:i + n - 2], ' ') AS context, t[i + n - 1] AS next FROM (SELECT t, n, unnest(range(1, len(t) - n + 2)) AS i FROM t, range(1, 4) r(n) WHERE len(t) >= n)),
ng AS (SELECT n::INTEGER AS n, CASE WHEN n = 1 THEN '' ELSE context END AS context, next, count(*) AS cnt FROM g GROUP BY ALL)"""


def ng(spark, sf_dir):
    return ngram.counts(table(spark, sf_dir, "conversations").select(T.terms(F.col("text")).alias("t")), "t", 3)


@query("ngram_counts", f"WITH {NG_SQL} SELECT * FROM ng")
def ngram_counts(spark, sf_dir):
    return ng(spark, sf_dir)


#: Grams by unnested places of each length alone, so that no list of lengths is crossed with texts.
PRUNED_SQL = rf"""WITH t AS (SELECT list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS t FROM conversations), w AS (SELECT unnest(t) AS a, unnest(list_concat(t[2:], [NULL])) AS b, unnest(list_concat(t[3:], [NULL, NULL])) AS c FROM t),
g AS (SELECT 1 AS n, '' AS context, a AS next FROM w WHERE a IS NOT NULL UNION ALL SELECT 2, a, b FROM w WHERE a IS NOT NULL AND b IS NOT NULL UNION ALL SELECT 3, a || ' ' || b, c FROM w WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL),
k AS (SELECT n::INTEGER AS n, context, next, count(*) AS cnt FROM g GROUP BY ALL HAVING count(*) >= 2), v AS (SELECT next, row_number() OVER (ORDER BY cnt DESC, next) AS r FROM k WHERE n = 1)
SELECT k.n, k.context, k.next, k.cnt FROM k JOIN v ON v.next = k.next WHERE r <= 500"""


@query("ngram_pruned", PRUNED_SQL)
def ngram_pruned(spark, sf_dir):
    return ngram.prune(ng(spark, sf_dir), 2, 500).select("n", "context", "next", "cnt")


@query("ngram_top_next", f"WITH {NG_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY n, context ORDER BY cnt DESC, next)::INTEGER AS rank FROM ng) SELECT * FROM r WHERE rank <= 3")
def ngram_top_next(spark, sf_dir):
    return ngram.top_next(ng(spark, sf_dir), 3)


@query(
    "ngram_stats",
    f"""WITH {NG_SQL}, b AS (SELECT count(*) AS b FROM ng GROUP BY n, context) SELECT sum(cnt)::BIGINT AS entries, sum((n = 1)::INT)::BIGINT AS vocabulary, max(n) AS max_order, (SELECT max(b) FROM b) AS max_branching,
round(sum(cnt) / sum((n = 1)::INT), 6) AS entries_per_unigram FROM ng""",
)
def ngram_stats(spark, sf_dir):
    return ngram.stats(ng(spark, sf_dir))


PROB_SQL = f"""{NG_SQL}, tot AS (SELECT n, context, sum(cnt) AS total FROM ng GROUP BY ALL), z AS (SELECT sum(cnt) AS entries FROM ng),
q AS (SELECT DISTINCT t[i - 2] || ' ' || t[i - 1] AS c2, t[i - 1] AS c1, t[i] AS next FROM (SELECT t, unnest(range(3, len(t) + 1)) AS i FROM t)),
p AS (SELECT q.c2, q.next, CASE WHEN g3.cnt IS NOT NULL THEN g3.cnt / t3.total WHEN g2.cnt IS NOT NULL THEN (CASE WHEN t3.total IS NOT NULL THEN 0.4 ELSE 1 END) * g2.cnt / t2.total
  ELSE (CASE WHEN t3.total IS NOT NULL THEN 0.4 ELSE 1 END) * (CASE WHEN t2.total IS NOT NULL THEN 0.4 ELSE 1 END) * (coalesce(g1.cnt, 0) + 0.5) / (t1.total + 0.5 * entries) END AS p
  FROM q LEFT JOIN ng g3 ON g3.n = 3 AND g3.context = c2 AND g3.next = q.next LEFT JOIN tot t3 ON t3.n = 3 AND t3.context = c2 LEFT JOIN ng g2 ON g2.n = 2 AND g2.context = c1 AND g2.next = q.next
  LEFT JOIN tot t2 ON t2.n = 2 AND t2.context = c1 LEFT JOIN ng g1 ON g1.n = 1 AND g1.next = q.next LEFT JOIN tot t1 ON t1.n = 1, z)"""


@query("ngram_probability", f"WITH {PROB_SQL} SELECT c2 AS context, next, round(p, 6) AS p FROM p")
def ngram_probability(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").select(T.terms(F.col("text")).alias("t")).where(F.size("t") >= 3)
    i = t.select("t", F.explode(F.sequence(F.lit(3), F.size("t"))).alias("i"))
    q = i.select(F.slice("t", F.col("i") - 2, 2).alias("context"), F.element_at("t", F.col("i")).alias("next")).distinct()
    return ngram.probability(q, ng(spark, sf_dir), 3).select(F.array_join("context", " ").alias("context"), "next", F.round("p", 6).alias("p"))


SYM_SQL = """s AS (SELECT user_id, list(event_type ORDER BY event_id) AS t FROM events GROUP BY user_id),
c AS (SELECT n::INTEGER AS n, CASE WHEN n = 1 THEN '' ELSE array_to_string(t[i:i + n - 2], ' ') END AS context, t[i + n - 1] AS next FROM (SELECT t, n, unnest(range(1, len(t) - n + 2)) AS i FROM s, range(1, 4) r(n) WHERE len(t) >= n))"""


@query("ngram_structural", f"WITH {SYM_SQL} SELECT n, context, next, count(*) AS cnt FROM c GROUP BY ALL")
def ngram_structural(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id")
    # Windows over the events themselves: a user's sequence is never one array.
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("next"), F.lag("event_type", 1).over(w).alias("p1"), F.lag("event_type", 2).over(w).alias("p2"))
    rows = F.array(
        F.struct(F.lit(1).alias("n"), F.lit("").alias("context")), F.when(F.col("p1").isNotNull(), F.struct(F.lit(2).alias("n"), F.col("p1").alias("context"))),
        F.when(F.col("p2").isNotNull(), F.struct(F.lit(3).alias("n"), F.concat_ws(" ", "p2", "p1").alias("context"))),
    )
    return e.select("next", F.explode(rows).alias("g")).where("g IS NOT NULL").groupBy("g.n", "g.context", "next").agg(F.count("*").alias("cnt"))


@query("trajectory_labeled", """WITH c AS (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY c DESC, event_type) AS r, sum(c) OVER (PARTITION BY user_id) AS n FROM c),
top AS (SELECT user_id, max(n)::BIGINT AS n, max(event_type) FILTER (r = 1) AS a, max(event_type) FILTER (r = 2) AS b, max(c) FILTER (r = 1) AS n1, coalesce(max(c) FILTER (r = 2), 0) AS n2 FROM r GROUP BY user_id),
two AS (SELECT e.user_id, event_type <> lag(event_type) OVER w AS ch, row_number() OVER w AS pos FROM events e JOIN top t ON e.user_id = t.user_id AND event_type IN (a, b) WINDOW w AS (PARTITION BY e.user_id ORDER BY event_id)),
g AS (SELECT user_id, sum(coalesce(ch, false)::INT) + 1 AS runs, min(pos - 2) FILTER (ch)::INTEGER AS change_at FROM two GROUP BY user_id),
z AS (SELECT *, 2.0::DOUBLE * n1 * n2 * (2.0::DOUBLE * n1 * n2 - n1 - n2) / ((n1 + n2) * (n1 + n2) * (n1 + n2 - 1)) AS var, 2.0::DOUBLE * n1 * n2 / (n1 + n2) + 1 AS mu FROM top JOIN g USING (user_id)),
y AS (SELECT *, round(CASE WHEN n1 = 0 OR n2 = 0 OR var <= 0 THEN 0 ELSE (runs - mu) / sqrt(var) END, 6) AS z FROM z)
SELECT user_id, n, CASE WHEN n < 6 THEN 'too-few' WHEN b IS NULL OR n1 / n > 0.85 THEN 'stable' WHEN z <= -1.96 THEN 'becoming' ELSE 'split' END AS verdict, z, change_at FROM y""")
def trajectory_labeled(spark, sf_dir):
    return sequence.trajectory(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type")


MENTION_SQL = r"m AS (SELECT DISTINCT conv_id AS seq, turn AS pos, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: length(x) >= 8)) AS entity FROM conversations)"


def mentions(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("seq"), F.col("turn").alias("pos"), F.explode(F.filter(T.terms(F.col("text")), lambda x: F.length(x) >= 8)).alias("entity")).distinct()


@query(
    "transitions",
    f"WITH {MENTION_SQL}, s AS (SELECT seq, pos, pos - lag(pos) OVER (PARTITION BY seq, entity ORDER BY pos) AS since FROM m) SELECT seq, pos, CASE WHEN bool_or(since IS NULL) THEN 'emerge' WHEN min(since) > 6 THEN 'recur' ELSE 'persist' END AS label FROM s GROUP BY seq, pos",
)
def transitions(spark, sf_dir):
    return sequence.transitions(mentions(spark, sf_dir))


@query("antecedents", f"WITH {MENTION_SQL}, s AS (SELECT seq, pos, lag(pos) OVER (PARTITION BY seq, entity ORDER BY pos) AS b FROM m) SELECT seq, pos, max(b) AS antecedent FROM s GROUP BY seq, pos")
def antecedents(spark, sf_dir):
    return sequence.antecedents(mentions(spark, sf_dir))


@query(
    "ari_partitions",
    """WITH c AS (SELECT lang, source, count(*) AS c FROM documents GROUP BY ALL), s AS (SELECT sum(c) AS n, sum(c * (c - 1) / 2) AS ij FROM c),
i AS (SELECT sum(c * (c - 1) / 2) AS i FROM (SELECT sum(c) AS c FROM c GROUP BY lang)), j AS (SELECT sum(c * (c - 1) / 2) AS j FROM (SELECT sum(c) AS c FROM c GROUP BY source))
SELECT n::BIGINT AS n, round((ij - i * j / (n * (n - 1) / 2)) / ((i + j) / 2 - i * j / (n * (n - 1) / 2)), 6) AS ari FROM s, i, j""",
)
def ari_partitions(spark, sf_dir):
    return sequence.adjusted_rand(table(spark, sf_dir, "documents"), "lang", "source")


@query(
    "scaling_exponent",
    """WITH p AS (SELECT user_id, event_id::DOUBLE AS x, value AS y, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, round(regr_slope(y, x), 6) AS slope FROM p WHERE n < 4 OR r > n // 2 GROUP BY user_id""",
)
def scaling_exponent(spark, sf_dir):
    p = table(spark, sf_dir, "events").select("user_id", F.col("event_id").cast("double").alias("x"), F.col("value").alias("y"))
    return sequence.scaling_exponent(p, "user_id", "x", "y")


@query("bootstrap_ci")
def bootstrap_ci(spark, sf_dir):
    return sequence.bootstrap(table(spark, sf_dir, "events"), "value", "event_id")


@query(
    "process_deviations",
    """WITH k(metric, constraint_id, min_value, max_value) AS (VALUES ('view', 1, 10.0::DOUBLE, 90.0::DOUBLE), ('click', 2, 20.0, NULL), ('error', 3, NULL, 50.0)), x AS (SELECT event_id AS id, constraint_id, value,
CASE WHEN value < min_value THEN min_value WHEN value > max_value THEN max_value END AS expected, CASE WHEN min_value IS NOT NULL AND max_value IS NOT NULL THEN max_value - min_value ELSE 1.0 END AS span FROM events JOIN k ON event_type = metric)
SELECT id, constraint_id, expected, value AS actual, round(least(abs(value - expected) / span, 1), 6) AS severity FROM x WHERE expected IS NOT NULL""",
)
def process_deviations(spark, sf_dir):
    k = spark.createDataFrame([("view", 1, 10.0, 90.0), ("click", 2, 20.0, None), ("error", 3, None, 50.0)], "metric string, constraint_id int, min_value double, max_value double")
    m = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("metric"), "value")
    return process.deviations(m, k).withColumn("severity", F.round("severity", 6))


OBS_SQL = "o AS (SELECT event_id AS seq, floor(epoch(ts))::BIGINT AS start, floor(epoch(ts))::BIGINT + event_id % 60 AS stop FROM events)"


@query("observations_concurrent", f"WITH {OBS_SQL} SELECT a.seq AS a, b.seq AS b FROM o a JOIN o b ON a.seq < b.seq AND a.start <= b.stop AND b.start <= a.stop")
def observations_concurrent(spark, sf_dir):
    o = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("start")).withColumn("stop", F.col("start") + F.col("seq") % 60)
    return process.concurrent(o)


@query("observations_by_source", "SELECT event_type AS source, count(*) AS n, max(event_id) AS last_seq FROM events GROUP BY ALL")
def observations_by_source(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("source")).agg(F.count("*").alias("n"), F.max("event_id").alias("last_seq"))


@query("promote_observation", "SELECT 'obs:' || event_id AS cites, left(props, 200) AS claim, 'candidate' AS status FROM events")
def promote_observation(spark, sf_dir):
    return process.promote(table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("props").alias("body")))


@query("claims_cited", "SELECT DISTINCT o_orderkey AS claim_id, event_id AS seq FROM orders JOIN events ON event_id = o_orderkey")
def claims_cited(spark, sf_dir):
    claims = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("claim_id"), F.concat(F.lit("see obs:"), F.col("o_orderkey"), F.lit(" and obs:"), F.col("o_orderkey")).alias("text"))
    return process.cited(claims, table(spark, sf_dir, "events").select(F.col("event_id").alias("seq")))


@query("observation_log_tail", "SELECT event_id AS seq, event_type AS source FROM events ORDER BY event_id DESC LIMIT 100")
def observation_log_tail(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("source")).orderBy(F.col("seq").desc()).limit(100)


PATH_SQL = r"p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]+', ''), '[?#].*$', '') AS path FROM pages)"


@query("shape_kinds", PATH_SQL.join(["WITH ", r" SELECT page_id, path, len(list_filter(regexp_split_to_array(path, '/'), lambda x: x <> ''))::INTEGER AS depth, array_to_string(list_filter(regexp_split_to_array(lower(regexp_replace(path, '([a-z])([A-Z])', '\1 \2', 'g')), '[-_./ ]+'), lambda x: x <> ''), ' ') AS tokens FROM p"]))
def shape_kinds(spark, sf_dir):
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]+", ""), "[?#].*$", "")
    p = table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    return p.select("page_id", "path", F.size(F.filter(F.split("path", "/"), lambda x: x != "")).alias("depth"), F.array_join(T.name_tokens(F.col("path")), " ").alias("tokens"))


@query("facet_filter", "SELECT p_partkey, p_brand, p_size FROM part WHERE p_size = 10 OR (p_size = 20 AND p_brand IS NOT NULL)")
def facet_filter(spark, sf_dir):
    eq = lambda c, v: F.coalesce(F.col(c) == v, F.lit(False))  # noqa: E731  no value in the row isn't a match
    return table(spark, sf_dir, "part").where(eq("p_size", 10) | (eq("p_size", 20) & F.col("p_brand").isNotNull())).select("p_partkey", "p_brand", "p_size")


@query("composite_coherence", "SELECT doc_id, round((quality * 0.6 + (1 - toxic) * 0.4) / 1.0, 6)::DOUBLE AS composite FROM labels")
def composite_coherence(spark, sf_dir):
    dims = [(F.col("quality"), 0.6), (1 - F.col("toxic"), 0.4)]
    total = sum(w for _, w in dims)
    return table(spark, sf_dir, "labels").select("doc_id", F.round(sum((c * w for c, w in dims), F.lit(0.0)) / total, 6).alias("composite"))


@query(
    "coherence_snapshot",
    """WITH l AS (SELECT doc_id, CASE WHEN toxic = 1 THEN -1 WHEN quality = 1 THEN 1 ELSE 0 END AS v FROM labels) SELECT count(*) AS n, sum((v > 0.2)::INT)::BIGINT AS success, sum((v < -0.2)::INT)::BIGINT AS failure,
sum((v BETWEEN -0.2 AND 0.2)::INT)::BIGINT AS inert, round(coalesce(avg(v), 1), 6) AS asserted FROM l""",
)
def coherence_snapshot(spark, sf_dir):
    from sparrowgrid.operators import beliefs

    v = F.when(F.col("toxic") == 1, -1).when(F.col("quality") == 1, 1).otherwise(0)
    r = table(spark, sf_dir, "labels").select(v.alias("v"), beliefs.rating(v).alias("r"))
    n = lambda k: F.count_if(F.col("r") == k).alias(k)
    return r.agg(F.count("*").alias("n"), n("success"), n("failure"), n("inert"), F.round(F.coalesce(F.avg("v"), F.lit(1.0)), 6).alias("asserted"))


@query("node_register_dedupe", "SELECT md5(text) AS label, min(doc_id) AS node_id, count(*) AS copies FROM documents GROUP BY 1")
def node_register_dedupe(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("label")).agg(F.min("doc_id").alias("node_id"), F.count("*").alias("copies"))


@query("node_edit_overlay", "SELECT doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'labelled' ELSE lang END AS label FROM documents d LEFT JOIN labels l USING (doc_id)")
def node_edit_overlay(spark, sf_dir):
    shadow = table(spark, sf_dir, "labels").select("doc_id", F.lit("labelled").alias("shadow"))
    return table(spark, sf_dir, "documents").join(shadow, "doc_id", "left").select("doc_id", F.coalesce("shadow", "lang").alias("label"))


@query("node_delete_prefix", "SELECT lang, count(*) AS n FROM documents WHERE NOT starts_with(source, 'src1') GROUP BY lang")
def node_delete_prefix(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(~F.startswith("source", F.lit("src1"))).groupBy("lang").agg(F.count("*").alias("n"))
