"""Queries that go beyond one table: descriptors, hybrid retrieval, precedents, facets, retraction, dreams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparrowgrid.functions import vector as V
from sparrowgrid.functions import text as T
from sparrowgrid.operators import beliefs, classify, descriptors, direction, discovery, extract, graph, mutation, neighbours, retrieval, scoring, sequence
from sparrowgrid.plans.base import query
from sparrowgrid.plans.beliefs import HYP_SQL, evidence, fit, hypotheses, predictions, r6
from sparrowgrid.plans.facts import MENTION_SQL, mentions
from sparrowgrid.plans.texts import BM25_SQL, TERMS_SQL, bm25_index, bm25_ranked, bm25_scored, docs
from sparrowgrid.plans.vectors import E_SQL, PAIRS_SQL, RANKED_SQL, STRUCT_SQL, emb
from sparrowgrid.session import table

r = lambda c: F.round(c, 6)


@query("vec_zscore", f"WITH {E_SQL}, z AS (SELECT vec_id, list_transform(v, lambda x: (x - list_avg(v)) / greatest(list_stddev_pop(v), 1e-8)) AS z FROM e) SELECT vec_id, round(z[1], 6) AS first, round(z[-1], 6) AS last, round(list_max(z), 6) AS top, round(list_min(z), 6) AS low FROM z")
def vec_zscore(spark, sf_dir):
    z = emb(spark, sf_dir).where("embedding IS NOT NULL").select("vec_id", V.zscore(V.as_double(F.col("embedding"))).alias("z"))
    return z.select("vec_id", r(F.get("z", F.lit(0))).alias("first"), r(F.element_at("z", -1)).alias("last"), r(F.array_max("z")).alias("top"), r(F.array_min("z")).alias("low"))


@query("vec_distance", f"WITH {PAIRS_SQL} SELECT i, j, round(1 - s, 6) AS distance FROM pairs WHERE j = i + 1")
def vec_distance(spark, sf_dir):
    e = emb(spark, sf_dir).where("embedding IS NOT NULL").select(F.col("vec_id").alias("i"), V.as_double(F.col("embedding")).alias("a"))
    n = e.select((F.col("i") - 1).alias("i"), F.col("a").alias("b"))
    return e.join(n, "i").select("i", (F.col("i") + 1).alias("j"), r(V.distance(F.col("a"), F.col("b"))).alias("distance"))


@query(
    "classify_adaptive",
    f"""WITH {PAIRS_SQL}, sizes AS (SELECT label, count(*) AS n FROM e GROUP BY label), k AS (SELECT *, row_number() OVER (PARTITION BY i, lj ORDER BY s DESC, j) AS r FROM pairs),
m AS (SELECT i, lj, avg(s) AS s FROM k JOIN sizes ON label = lj WHERE r <= CASE WHEN n BETWEEN 1 AND 3 THEN 1 WHEN n BETWEEN 4 AND 10 THEN 2 WHEN n BETWEEN 11 AND 30 THEN 3 ELSE 4 END GROUP BY i, lj),
t AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY round(s, 9) DESC, lj) AS rank FROM m) SELECT i AS vec_id, lj::BIGINT AS cell, round(s, 6) AS score FROM t WHERE rank = 1""",
)
def classify_adaptive(spark, sf_dir):
    e = emb(spark, sf_dir)
    sizes = e.where("embedding IS NOT NULL").groupBy(F.col("label").cast("long").alias("lj")).agg(F.count("*").alias("n"))
    top = neighbours.label_top(e, "vec_id", "label", "embedding", 4).join(sizes, "lj").where(F.col("rank") <= classify.adaptive_k(F.col("n")))
    mean = top.groupBy("i", "lj").agg(F.avg("s").alias("s"))
    best = retrieval.ranked(mean, "i", F.round("s", 9), "lj").where("rank = 1")
    return best.select(F.col("i").alias("vec_id"), F.col("lj").alias("cell"), r("s").alias("score"))


@query(
    "facet_majority",
    """WITH f AS (SELECT source, unnest(['lang', 'size', 'cased']) AS axis, unnest([lang, CASE WHEN n_chars > 2000 THEN 'LONG' WHEN n_chars > 200 THEN 'MIDDLE' END, CASE WHEN regexp_matches(text, '^[A-Z]') THEN 'UPPER' ELSE 'LOWER' END]) AS value FROM documents),
c AS (SELECT source, axis, value, count(*) AS n FROM f WHERE value IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source, axis ORDER BY n DESC, value) AS r FROM c) SELECT source, axis, value, n FROM r WHERE r = 1""",
)
def facet_majority(spark, sf_dir):
    size = F.when(F.col("n_chars") > 2000, "LONG").when(F.col("n_chars") > 200, "MIDDLE")
    d = table(spark, sf_dir, "documents").select("source", "lang", size.alias("size"), F.when(F.col("text").rlike("^[A-Z]"), "UPPER").otherwise("LOWER").alias("cased"))
    return classify.majority(d, "source", ["lang", "size", "cased"])


@query(
    "descriptors_anchor",
    f"""WITH {E_SQL}, a AS (SELECT label, min(vec_id) AS anchor FROM e GROUP BY label),
s AS (SELECT e.vec_id, a.label, greatest(-1.0, least(1.0, list_inner_product(e.v, x.v) / (greatest(sqrt(list_inner_product(e.v, e.v)), 1e-8) * greatest(sqrt(list_inner_product(x.v, x.v)), 1e-8)))) AS s FROM e, a JOIN e x ON x.vec_id = a.anchor)
SELECT vec_id, label::BIGINT AS anchor, round((s - avg(s) OVER w) / greatest(stddev_pop(s) OVER w, 1e-8), 5) AS z FROM s WINDOW w AS (PARTITION BY vec_id)""",
)
def descriptors_anchor(spark, sf_dir):
    e = emb(spark, sf_dir).where("embedding IS NOT NULL").select("vec_id", "label", V.as_double(F.col("embedding")).alias("v"))
    anchors = e.groupBy("label").agg(F.min(F.struct("vec_id", "v")).alias("a")).select(F.col("label").cast("long").alias("anchor"), "a.v")
    return descriptors.anchor(e, anchors).select("vec_id", "anchor", F.round("z", 5).alias("z"))


@query(
    "descriptors_label",
    f"""WITH {PAIRS_SQL}, m AS (SELECT i, lj, avg(s) AS s FROM pairs GROUP BY i, lj)
SELECT i AS vec_id, lj::BIGINT AS label, round(s, 5) + 0.0::DOUBLE AS mean, round((s - avg(s) OVER w) / greatest(stddev_pop(s) OVER w, 1e-8), 4) + 0.0::DOUBLE AS z FROM m WINDOW w AS (PARTITION BY i)""",
)
def descriptors_label(spark, sf_dir):
    e = emb(spark, sf_dir).where("embedding IS NOT NULL").select("vec_id", F.col("label").cast("long").alias("label"), V.as_double(F.col("embedding")).alias("v"))
    return descriptors.by_label(e).select("vec_id", "label", (F.round("mean", 5) + 0.0).alias("mean"), (F.round("z", 4) + 0.0).alias("z"))


@query(
    "descriptors_structural",
    f"""WITH {RANKED_SQL}, k AS (SELECT i, j, s FROM ranked WHERE rank <= 5), g AS (SELECT a.i, a.j FROM k a JOIN k b ON a.i = b.j AND a.j = b.i), n AS (SELECT count(*) AS n FROM e),
d AS (SELECT e.vec_id AS i, count(g.j) AS deg FROM e LEFT JOIN g ON g.i = e.vec_id GROUP BY e.vec_id), nb AS (SELECT g.i, avg(d.deg) AS nb FROM g JOIN d ON d.i = g.j GROUP BY g.i),
tri AS (SELECT x.i, count(*) AS tri FROM g x JOIN g y ON x.i = y.i AND x.j < y.j JOIN g z ON z.i = x.j AND z.j = y.j GROUP BY x.i),
f AS (SELECT d.i, deg, coalesce(nb, 0) AS nb, CASE WHEN deg > 1 THEN coalesce(tri, 0) / (deg * (deg - 1) / 2) ELSE 0 END AS cl FROM d LEFT JOIN nb USING (i) LEFT JOIN tri USING (i)),
l AS (SELECT i, list(s ORDER BY rank) AS p FROM ranked WHERE rank <= 12 GROUP BY i),
v AS (SELECT i, deg, nb, cl, list_concat(p, [deg / n.n, nb / n.n, cl]) AS v FROM f JOIN l USING (i), n)
SELECT i AS vec_id, deg AS degree, round(nb, 6) AS neighbour_degree, round(cl, 6) AS clustering, round((v[1] - list_avg(v)) / greatest(list_stddev_pop(v), 1e-8), 4) AS first_z, round((v[-1] - list_avg(v)) / greatest(list_stddev_pop(v), 1e-8), 4) AS last_z FROM v""",
)
def descriptors_structural(spark, sf_dir):
    e = emb(spark, sf_dir).where("embedding IS NOT NULL")
    d = descriptors.structural(neighbours.top_k(e, e, "vec_id", "embedding", 12), 5, 12)
    z = lambda at: F.round(F.element_at("z", at), 4)
    return d.select(F.col("i").alias("vec_id"), "degree", r("neighbour_degree").alias("neighbour_degree"), r("clustering").alias("clustering"), z(1).alias("first_z"), z(-1).alias("last_z"))


COS_SQL = f"""{E_SQL}, cs AS (SELECT b.item_id, d.doc_id, round(greatest(-1.0, least(1.0, list_inner_product(x.v, y.v) / (greatest(sqrt(list_inner_product(x.v, x.v)), 1e-8) * greatest(sqrt(list_inner_product(y.v, y.v)), 1e-8)))), 9) AS score
  FROM benchmark b JOIN e x ON x.vec_id = b.item_id, documents d JOIN e y ON y.vec_id = d.doc_id),
cr AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM cs)"""


def cosine_sides(spark, sf_dir):
    """Vectors of items and of documents; the vector of a document or item is that of its id."""
    e = emb(spark, sf_dir)
    q = e.join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi")
    return q, e.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")


def cosine_ranked(spark, sf_dir):
    """Every document by cosine to each item: rank fusion takes all ranks."""
    q, d = cosine_sides(spark, sf_dir)
    s = neighbours.all_scores(q, d, "vec_id", "embedding").select(F.col("i").alias("query"), F.col("j").alias("doc"), F.col("s").alias("score"))
    return retrieval.ranked(s, "query", F.col("score"), "doc")


@query("cosine_ranking", f"WITH {COS_SQL} SELECT item_id, doc_id, round(score, 6) AS score, rank FROM cr WHERE rank <= 10")
def cosine_ranking(spark, sf_dir):
    top = neighbours.top_k(*cosine_sides(spark, sf_dir), "vec_id", "embedding", 10, skip_self=False)
    return top.select(F.col("i").alias("item_id"), F.col("j").alias("doc_id"), r("s").alias("score"), "rank")


HYBRID_SQL = f"""{BM25_SQL}, {COS_SQL}, hf AS (SELECT item_id, doc_id, round(sum(w), 9) AS score FROM (SELECT item_id, doc_id, 1.0::DOUBLE / (60 + rank) AS w FROM r UNION ALL SELECT item_id, doc_id, 1.0::DOUBLE / (60 + rank) FROM cr) GROUP BY ALL),
hr AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM hf)"""


@query("hybrid_ranking", f"WITH {HYBRID_SQL} SELECT item_id, doc_id, round(score, 6) AS score, rank FROM hr WHERE rank <= 10")
def hybrid_ranking(spark, sf_dir):
    f = retrieval.fuse([cosine_ranked(spark, sf_dir), bm25_ranked(spark, sf_dir)]).where("rank <= 10")
    return f.select(F.col("query").alias("item_id"), F.col("doc").alias("doc_id"), r("score").alias("score"), "rank")


@query(
    "hybrid_ship",
    f"""WITH {HYBRID_SQL}, v AS (SELECT t.item_id, (h.doc_id = t.item_id)::INT - (c.doc_id = t.item_id)::INT AS v FROM (SELECT DISTINCT item_id FROM cr) t JOIN hr h ON h.item_id = t.item_id AND h.rank = 1 JOIN cr c ON c.item_id = t.item_id AND c.rank = 1)
SELECT count(*) AS queries, sum((v = 1)::INT)::BIGINT AS gained, sum((v = -1)::INT)::BIGINT AS lost, sum(v)::BIGINT AS verdict, sum(v) > 0 AS ship FROM v""",
)
def hybrid_ship(spark, sf_dir):
    cos = cosine_ranked(spark, sf_dir)
    return retrieval.ship(cos, retrieval.fuse([cos, bm25_ranked(spark, sf_dir)]), cos.select("query", F.col("query").alias("target")).distinct())


@query("precedents", f"WITH {PAIRS_SQL}, a AS (SELECT doc_id, quality FROM labels WHERE quality IS NOT NULL) SELECT i AS hypothesis, j AS node, quality::BIGINT AS verdict, round(s, 6) AS sim FROM pairs JOIN a ON a.doc_id = j WHERE s > 0.4")
def precedents(spark, sf_dir):
    e = emb(spark, sf_dir)
    verdict = table(spark, sf_dir, "labels").where("quality IS NOT NULL").select(F.col("doc_id").alias("j"), F.col("quality").cast("long").alias("verdict"))
    p = neighbours.pairs_above(e, "vec_id", "embedding", 0.4)
    both = p.unionByName(p.select(F.col("j").alias("i"), F.col("i").alias("j"), "s"))
    return both.join(verdict, "j").select(F.col("i").alias("hypothesis"), F.col("j").alias("node"), "verdict", r("s").alias("sim"))


@query(
    "dream_hypotheses",
    f"""WITH {RANKED_SQL}, c AS (SELECT i, greatest(0, avg(s)) AS c FROM ranked WHERE rank <= 5 GROUP BY i)
SELECT 'Candidate hypothesis for the failure of node ' || i AS statement, 'candidate' AS status, round(c, 6) AS semantic, round(greatest(0, least(1, 0.2 * c + 0.15 * 0.5 + 0.15 * 0.5 + 0.25 * 0.2 + 0.25 * 0.5)), 6) AS fitness FROM c JOIN labels ON doc_id = i WHERE toxic = 1""",
)
def dream_hypotheses(spark, sf_dir):
    e = emb(spark, sf_dir).where("embedding IS NOT NULL")
    node = neighbours.density(neighbours.top_k(e, e, "vec_id", "embedding", 5), e, "vec_id")
    failed = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    d = beliefs.dream(node.join(failed, "id"))
    return d.select(F.concat(F.lit("Candidate hypothesis for the failure of node "), F.col("id")).alias("statement"), "status", r("semantic").alias("semantic"), r("fitness").alias("fitness"))


RETRACT_SQL = HYP_SQL.replace("FROM lineitem),\npr AS", "FROM lineitem WHERE l_suppkey <> 7),\npr AS", 1)


@query(
    "retraction_fitness",
    f"""WITH {HYP_SQL}, hit AS (SELECT DISTINCT h_id FROM ev WHERE source = 7), after AS (WITH {RETRACT_SQL} SELECT h_id, composite FROM fit)
SELECT h_id, floor(fit.composite * 1e6 + 0.5001) / 1e6 AS before, floor(after.composite * 1e6 + 0.5001) / 1e6 AS after FROM fit JOIN after USING (h_id) JOIN hit USING (h_id)""",
)
def retraction_fitness(spark, sf_dir):
    ev = evidence(spark, sf_dir)
    hit = ev.where("source = 7").select("h_id").distinct()
    after = beliefs.fitness(hypotheses(spark, sf_dir), ev.where("source <> 7"), predictions(spark, sf_dir)).select("h_id", r6("composite").alias("after"))
    return fit(spark, sf_dir).select("h_id", r6("composite").alias("before")).join(after, "h_id").join(hit, "h_id")


@query("asserted_failures", "WITH a AS (SELECT doc_id, CASE WHEN 2.0 * quality - 1 - toxic IS NOT NULL THEN greatest(-1, 2.0 * quality - 1 - toxic) END AS v FROM labels), f AS (SELECT doc_id, v AS verdict FROM a WHERE v < 0) SELECT doc_id, verdict::DOUBLE AS verdict, row_number() OVER (ORDER BY verdict, doc_id)::INTEGER AS place, round((SELECT avg(v) FROM a), 6) AS asserted_index FROM f")
def asserted_failures(spark, sf_dir):
    v = beliefs.clamp((2.0 * F.col("quality") - 1 - F.col("toxic")), -1.0)
    nodes = table(spark, sf_dir, "labels").select("doc_id", v.alias("verdict"))
    return classify.failures(nodes, "doc_id", "verdict").withColumn("asserted_index", r("asserted_index"))


@query("observations_newest", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC)::INTEGER AS place FROM events")
def observations_newest(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy(F.col("event_id").desc())
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.row_number().over(w).alias("place"))


@query("id_prefixes", "WITH i AS (SELECT DISTINCT event_id::VARCHAR AS id FROM events), p AS (SELECT DISTINCT left(id, 3) AS prefix FROM i), c AS (SELECT prefix, count(*) AS n, min(id) AS first, max((i.id = p.prefix)::INT) AS exact FROM p JOIN i ON starts_with(i.id, p.prefix) GROUP BY prefix) SELECT prefix, CASE WHEN exact = 1 THEN 'exact' WHEN n = 1 THEN 'unique' ELSE 'ambiguous' END AS state, n, CASE WHEN exact = 1 THEN prefix WHEN n = 1 THEN first END AS id FROM c")
def id_prefixes(spark, sf_dir):
    ids = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("id")).distinct()
    return beliefs.resolve(ids, ids.select(F.substring("id", 1, 3).alias("prefix")).distinct())


COHERENCE = "greatest(0, avg(s)) AS c FROM {} WHERE rank <= 5 GROUP BY i"


@query(
    "simulate_mutation",
    f"""WITH RECURSIVE {RANKED_SQL}, t AS (SELECT min(vec_id) AS t FROM e), k AS (SELECT i, j FROM ranked WHERE rank <= 5), g AS (SELECT a.i, a.j FROM k a JOIN k b ON a.i = b.j AND a.j = b.i),
w(node, hop) AS (SELECT t, 0 FROM t UNION SELECT g.j, w.hop + 1 FROM w JOIN g ON g.i = w.node WHERE w.hop < 5), wave AS (SELECT node, min(hop) AS hop FROM w GROUP BY node),
sp AS (SELECT i, j, CASE WHEN i = t OR j = t THEN -s ELSE s END AS s FROM pairs, t), sr AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY s DESC, j) AS rank FROM sp),
p AS (SELECT i, {COHERENCE.format("ranked")}), n AS (SELECT i, {COHERENCE.format("sr")})
SELECT node, hop::INTEGER AS hop, round(-pow(0.85, hop), 6) AS impact, round(p.c, 6) AS previous, round(n.c, 6) AS new,
CASE WHEN abs(n.c - p.c) < 1e-6 THEN 'unchanged' WHEN n.c > p.c THEN 'strengthened' WHEN n.c - p.c < -0.25 THEN 'invalidated' ELSE 'shifted' END AS delta FROM wave JOIN p ON p.i = node JOIN n ON n.i = node""",
)
def simulate_mutation(spark, sf_dir):
    """The first vector turned round, over the graph of vectors among each other's five best."""
    nodes = emb(spark, sf_dir).where("embedding IS NOT NULL").select(F.col("vec_id").alias("id"), V.as_double(F.col("embedding")).alias("v"))
    first = nodes.orderBy("id").first()
    m = neighbours.mutual(neighbours.top_k(nodes, nodes, "id", "v", 5))
    edges = m.select(F.col("i").alias("source"), F.col("j").alias("target")).union(m.select("j", "i"))
    d = mutation.evaluate(nodes, edges, first["id"], [-x for x in first["v"]])
    return d.select("node", "hop", r("impact").alias("impact"), r("previous").alias("previous"), r("new").alias("new"), "delta")


UNITS = r"list_filter(list_transform(regexp_split_to_array({}, '[.\n;]'), lambda x: trim(x, ' ')), lambda x: len(list_filter(regexp_split_to_array(x, '\s+'), lambda y: y <> '')) >= {})"
TERM_SET = r"list_distinct(list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda y: y <> ''))"
WORDS = r"list_filter(regexp_split_to_array({}, '\s+'), lambda y: y <> '')"
SIZE = r"greatest(1, coalesce(list_sum(list_transform(regexp_extract_all({0}, '[\p{{L}}\p{{N}}]+'), lambda w: 1 + greatest(0, length(w) - 6) // 4)), 0) + length(regexp_replace({0}, '[\p{{L}}\p{{N}}\s]', '', 'g')))"


def _retention_sql(name: str, result: str) -> str:
    """CTEs: the worst of the best cosines of units, for pairs ``p(conv_id, turn, a, b)`` and a result column."""
    return f"""{name}_u AS (SELECT conv_id, turn, u.unnest AS unit, u.ordinality AS k FROM p, unnest({UNITS.format("a", 3)}) WITH ORDINALITY u), {name}_x AS (SELECT conv_id, turn, unnest({UNITS.format(result, 1)}) AS x FROM p),
{name}_t AS (SELECT conv_id, turn, k, {TERM_SET.format("unit")} AS t FROM {name}_u), {name}_y AS (SELECT conv_id, turn, {TERM_SET.format("x")} AS y FROM {name}_x),
{name}_b AS (SELECT conv_id, turn, k, coalesce(max(CASE WHEN y IS NULL OR len(t) = 0 OR len(y) = 0 THEN 0 ELSE len(list_intersect(t, y)) / sqrt(len(t)::DOUBLE * len(y)) END), 0) AS best FROM {name}_t LEFT JOIN {name}_y USING (conv_id, turn) GROUP BY ALL),
{name} AS (SELECT conv_id, turn, min(best) AS r FROM {name}_b GROUP BY ALL)"""


@query(
    "direction_check",
    f"""WITH p0 AS (SELECT a.conv_id, a.turn, coalesce(a.text, '') AS a, coalesce(b.text, '') AS b FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
p AS (SELECT *, array_to_string(({WORDS.format("a")})[1:len({WORDS.format("b")})], ' ') AS null_text FROM p0), {_retention_sql("real", "b")}, {_retention_sql("cut", "null_text")}
SELECT p.conv_id, p.turn, {SIZE.format("b")} < {SIZE.format("a")} AS moved, round(coalesce(real.r, 0), 6) AS retention, round(coalesce(cut.r, 0), 6) AS null_retention,
{SIZE.format("b")} < {SIZE.format("a")} AND coalesce(real.r, 0) - coalesce(cut.r, 0) > 0.02 AS holds FROM p LEFT JOIN real USING (conv_id, turn) LEFT JOIN cut USING (conv_id, turn)""",
)
def direction_check(spark, sf_dir):
    """Each turn as a shortening of the one before."""
    t = table(spark, sf_dir, "conversations")
    n = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("after"))
    d = direction.check(t.select("conv_id", "turn", F.col("text").alias("before")).join(n, ["conv_id", "turn"]), "before", "after", "shorter")
    return d.select("conv_id", "turn", "moved", r("retention").alias("retention"), r("null_retention").alias("null_retention"), "holds")


def scored_texts(spark, sf_dir):
    """Texts (documents with a vector) with their best entry of another label: what an ontology of the other labels covers."""
    e = emb(spark, sf_dir)
    best = neighbours.label_best(e, "vec_id", "label", "embedding").where("li <> lj")
    top = best.groupBy(F.col("i").alias("id")).agg(F.max(F.struct("s", (-F.col("lj")).alias("lj"))).alias("t"))
    v = e.where("embedding IS NOT NULL").select(F.col("vec_id").alias("id"), V.as_double(F.col("embedding")).alias("v"))
    lab = -F.col("t.lj")
    text = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return v.join(top, "id").join(text, "id").select("id", "v", "text", F.col("t.s").alias("best"), F.floor(lab / 2).alias("domain"), (lab % 2).alias("mode"))


@query("discover_proposals")
def discover_proposals(spark, sf_dir):
    _, found = discovery.discover(scored_texts(spark, sf_dir))
    return found.select("leader", "size", r("coverage").alias("coverage"), "name", "domain", "mode", "hints", F.size("samples").alias("samples"))


@query("discover_report")
def discover_report(spark, sf_dir):
    report, found = discovery.discover(scored_texts(spark, sf_dir))
    return report.crossJoin(found.agg(F.count("*").alias("proposals")))


@query(
    "structural_map",
    f"""WITH {STRUCT_SQL}, z AS (SELECT root, count(*) AS size FROM cc GROUP BY root HAVING count(*) >= 2), f AS (SELECT *, 'r-' || lpad(row_number() OVER (ORDER BY root)::VARCHAR, 3, '0') AS id FROM z),
w AS (SELECT root, doc_id, unnest(list_distinct({TERMS_SQL})) AS term FROM cc JOIN z USING (root) JOIN documents ON doc_id = node), df AS (SELECT root, term, count(*) AS n FROM w WHERE length(term) > 3 GROUP BY ALL HAVING count(*) >= 2),
h AS (SELECT root, string_agg(term, ' ' ORDER BY n DESC, term) AS hints FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY n DESC, term) AS r FROM df) WHERE r <= 6 GROUP BY root),
c AS (SELECT label, list(x ORDER BY pos) AS c FROM (SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM e) GROUP BY label, pos) GROUP BY label),
d AS (SELECT i, m - s AS sep FROM nn, md WHERE m - s > 0.05),
dc AS (SELECT i, sep, c.label, row_number() OVER (PARTITION BY i ORDER BY round(list_inner_product(v, c) / (greatest(sqrt(list_inner_product(v, v)), 1e-8) * greatest(sqrt(list_inner_product(c, c)), 1e-8)), 6) DESC, c.label) AS r FROM d JOIN e ON vec_id = i, c)
SELECT 'repeat' AS kind, f.id AS id, f.size AS size, split_part(coalesce(text, ''), chr(10), 1) AS name, coalesce(hints, '') AS hints, NULL::DOUBLE AS separation FROM f LEFT JOIN h USING (root) LEFT JOIN documents ON doc_id = root
UNION ALL SELECT 'difference', i::VARCHAR, 1, 'cell ' || label, '', round(sep, 6) FROM dc WHERE r = 1""",
)
def structural_map(spark, sf_dir):
    """Families of alike texts with name and hints, and texts apart from all with their nearest cell, in one frame."""
    e = emb(spark, sf_dir).where("embedding IS NOT NULL")
    nn = graph.cut(neighbours.top_k(e, e, "vec_id", "embedding", 1).select("i", "s"))
    parts, median = neighbours.families(e, "vec_id", "embedding", nn)
    m = 2.0 if median is None else median
    text = docs(spark, sf_dir).select(F.col("doc_id").alias("node"), "text")
    terms = parts.join(text, "node").select("component", F.explode(F.array_distinct(T.terms(F.col("text")))).alias("term")).where(F.length("term") > 3)
    shared = retrieval.ranked(terms.groupBy("component", "term").agg(F.count("*").alias("n")).where("n >= 2"), "component", F.col("n"), "term").where("rank <= 6")
    hints = shared.groupBy("component").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), " ").alias("hints"))
    sizes = discovery.numbered(parts.groupBy("component").agg(F.count("*").alias("size")), F.col("component"))
    number = (F.col("at") + 1).cast("string")
    title = F.substring_index(F.coalesce("text", F.lit("")), "\n", 1)
    families = sizes.join(hints, "component", "left").join(text.withColumnRenamed("node", "component"), "component", "left").select(
        F.lit("repeat").alias("kind"), F.concat(F.lit("r-"), F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)).alias("id"), "size",
        title.alias("name"), F.coalesce("hints", F.lit("")).alias("hints"), F.lit(None).cast("double").alias("separation"),
    )
    # One centroid for each cell of the grid: a table of fixed size.
    c = neighbours.centroids(e, ["label"], "embedding").select("label", V.normalise(F.col("centroid")).alias("c"))
    apart = nn.where(F.lit(m) - F.col("s") > 0.05).join(e.select(F.col("vec_id").alias("i"), V.normalise(V.as_double(F.col("embedding"))).alias("v")), "i")
    near = retrieval.ranked(apart.join(F.broadcast(c)).withColumn("at", F.round(V.dot(F.col("v"), F.col("c")), 6)), "i", F.col("at"), "label").where("rank = 1")
    differences = near.select(F.lit("difference"), F.col("i").cast("string"), F.lit(1).cast("long"), F.concat(F.lit("cell "), F.col("label")), F.lit(""), r(F.lit(m) - F.col("s")))
    return families.union(differences)


@query("chain_report")
def chain_report(spark, sf_dir):
    """One row: what the map finds, what the context costs, what stays uncovered, and whether discovery's groups gain more than the same groups dealt by hash."""
    scored = graph.cut(scored_texts(spark, sf_dir))
    cfg = discovery.Config(alike=0.30)
    found = structural_map(spark, sf_dir).groupBy().agg(F.count_if(F.col("kind") == "repeat").alias("repeats"), F.count_if(F.col("kind") == "difference").alias("differences"))
    clash = extract.contradictions(docs(spark, sf_dir), "doc_id", "source", "text").agg(F.count("*").alias("contradictions"))
    d = docs(spark, sf_dir).select(F.col("doc_id").alias("doc"), T.token_estimate(F.col("text")).alias("tokens"), "text")
    at = bm25_index(spark, sf_dir)
    part = scoring.packable(at, 1500, 8) if at else None
    if part:
        # Scores are made twice from one index, and never rows.
        base, sure = scoring.top(at, 12), part[0].select("query", "doc", "score")
        packed = retrieval.pack_ranked(sure, at.rows.select("doc", "tokens"), 1500, 8, 0.0)
    else:
        base = bm25_ranked(spark, sf_dir).where("rank <= 12").select("doc").join(d.select("doc", "tokens"), "doc")
        packed = retrieval.pack_ranked(bm25_scored(spark, sf_dir), d, 1500, 8, 0.0)
    base, packed = base.agg(F.sum("tokens").alias("baseline_tokens")), packed.agg(F.sum("tokens").alias("context_tokens"))
    open_ = scored.where(F.col("best") < cfg.covered)
    led = graph.cut(discovery.vector_leaders(open_, "id", "v", cfg.alike))
    sizes = led.groupBy("leader").agg(F.count("*").alias("size")).where(F.col("size") >= cfg.least)
    members = graph.cut(led.join(sizes, "leader").select("id", "leader"))

    def lift(groups, name):
        cells = neighbours.centroids(open_.select("id", "v").join(groups, "id"), ["leader"], "v").select(F.col("leader").alias("id"), F.col("centroid").alias("v"))
        g = discovery.gains(open_.select("id", "v"), cells, open_.select("id", "best"))
        return g.agg(F.coalesce(F.avg("lift"), F.lit(0.0)).alias(name))

    real, null = lift(members, "mean_gain"), lift(discovery.regrouped(members), "null_gain")
    counts = open_.agg(F.count("*").alias("unplaced")).join(members.agg(F.countDistinct("leader").alias("candidates")))
    out = found.join(clash).join(base).join(packed).join(counts).join(real).join(null)  # single rows
    testable = (F.col("unplaced") > 0) & (F.col("candidates") > 0) & ((F.col("mean_gain") > 0) | (F.col("null_gain") > 0))
    return out.withColumn("testable", testable).withColumn("discriminates", testable & (F.col("mean_gain") - F.col("null_gain") > 0.02))


@query(
    "transition_accuracy",
    f"""WITH {MENTION_SQL}, s AS (SELECT seq, pos, pos - lag(pos) OVER (PARTITION BY seq, entity ORDER BY pos) AS since FROM m), t AS (SELECT seq, pos, CASE WHEN bool_or(since IS NULL) THEN 'emerge' WHEN min(since) > 6 THEN 'recur' ELSE 'persist' END AS gold,
CASE WHEN bool_or(since IS NULL) THEN 'emerge' WHEN min(since) > 2 THEN 'recur' ELSE 'persist' END AS label FROM s GROUP BY seq, pos), a AS (SELECT count(*) AS n, avg((gold = label)::INT) AS accuracy FROM t), g AS (SELECT gold, count(*) AS c, avg((gold = label)::INT) AS recall FROM t GROUP BY gold)
SELECT gold AS label, c AS n, round(recall, 6) AS recall, round(accuracy, 6) AS accuracy, round((SELECT max(c) FROM g) / a.n, 6) AS majority FROM g, a""",
)
def transition_accuracy(spark, sf_dir):
    m = mentions(spark, sf_dir)
    return sequence.transition_scores(sequence.transitions(m, 2), sequence.transitions(m))


@query("transition_null")
def transition_null(spark, sf_dir):
    m = mentions(spark, sf_dir)
    return sequence.transition_null(m, sequence.transitions(m), 20, gap=2)


@query("antecedent_scores", f"WITH {MENTION_SQL}, s AS (SELECT seq, pos, lag(pos) OVER (PARTITION BY seq, entity ORDER BY pos) AS b FROM m), a AS (SELECT seq, pos, max(b) AS b FROM s GROUP BY seq, pos) SELECT count(*) AS n, count(b) AS found, round(avg((b = pos - 1)::INT), 6) AS top1, round(avg((b >= pos - 3)::INT), 6) AS top3 FROM a")
def antecedent_scores(spark, sf_dir):
    """How often the latest place, or one of the latest three, is the antecedent."""
    gap = F.col("pos") - F.col("antecedent")
    a = sequence.antecedents(mentions(spark, sf_dir))
    return a.agg(F.count("*").alias("n"), F.count("antecedent").alias("found"), r(F.avg((gap == 1).cast("int"))).alias("top1"), r(F.avg((gap <= 3).cast("int"))).alias("top3"))


@query("antecedent_interval")
def antecedent_interval(spark, sf_dir):
    a = sequence.antecedents(mentions(spark, sf_dir)).where("antecedent IS NOT NULL")
    hit = a.select(F.xxhash64("seq", "pos").alias("id"), (F.col("pos") - F.col("antecedent") <= 3).cast("double").alias("hit"))
    return sequence.bootstrap(hit, "hit", "id")
