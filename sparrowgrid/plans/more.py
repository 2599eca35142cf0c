"""Further queries: cases, facets, mutations, controls, descriptors, claims, directions, shapes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparrowgrid.functions import text as T
from sparrowgrid.functions import vector as V
from sparrowgrid.operators import context, extract, graph, neighbours, ngram, overlap, retrieval, sequence
from sparrowgrid.plans import facts as P
from sparrowgrid.plans.base import query
from sparrowgrid.plans.beliefs import HYP_SQL, evidence, fit, r6
from sparrowgrid.plans.texts import BM25_SQL, bm25_index, bm25_ranked, bm25_scored
from sparrowgrid.plans.vectors import E_SQL, PAIRS_SQL, RANKED_SQL, SCORES_SQL, STRUCT_SQL, cell_scores, emb, structure_repeats
from sparrowgrid.session import table


@query("structure_hash", f"WITH {STRUCT_SQL}, z AS (SELECT root, count(*) AS size FROM cc GROUP BY root HAVING count(*) >= 2) SELECT md5(string_agg(node || ':' || root, ',' ORDER BY node)) AS hash, count(*) AS members FROM cc JOIN z USING (root)")
def structure_hash(spark, sf_dir):
    s = structure_repeats(spark, sf_dir)
    parts = F.transform(F.sort_array(F.collect_list(F.struct("vec_id", "family"))), lambda x: F.concat_ws(":", x["vec_id"].cast("string"), x["family"].cast("string")))
    return s.agg(F.md5(F.array_join(parts, ",")).alias("hash"), F.count("*").alias("members"))


def _cases(good):
    sql = f"""WITH {PAIRS_SQL}, a AS (SELECT i, j, s FROM pairs JOIN labels ON j = doc_id WHERE {"quality = 1 AND toxic = 0" if good else "toxic = 1"}),
r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY s DESC, j)::INTEGER AS rank FROM a) SELECT i AS vec_id, j AS similar, round(s, 6) AS sim, rank FROM r WHERE rank <= 3"""

    def run(spark, sf_dir):
        keep = (F.col("quality") == 1) & (F.col("toxic") == 0) if good else F.col("toxic") == 1
        cases = table(spark, sf_dir, "labels").where(keep).select(F.col("doc_id").alias("vec_id"))
        e = emb(spark, sf_dir)
        top = neighbours.top_k(e, e.join(cases, "vec_id", "left_semi"), "vec_id", "embedding", 3)
        return top.select(F.col("i").alias("vec_id"), F.col("j").alias("similar"), F.round("s", 6).alias("sim"), "rank")

    return sql, run


for _name, _good in (("similar_cases_succeeded", True), ("similar_cases_failed", False)):
    _sql, _run = _cases(_good)
    query(_name, _sql)(_run)


@query(
    "classify_soft_facets",
    f"WITH {SCORES_SQL}, f AS (SELECT i, domain, mode, floor(score * (0.5 + 0.5 * ((domain = 1)::INT + (mode = 0)::INT) / 2) * 1e6 + 0.5001) / 1e6 AS score FROM scores), rr AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, domain, mode)::INTEGER AS rank FROM f) SELECT i AS vec_id, domain, mode, score FROM rr WHERE rank = 1",
)
def classify_soft_facets(spark, sf_dir):
    hits = (F.col("domain") == 1).cast("int") + (F.col("mode") == 0).cast("int")
    f = cell_scores(spark, sf_dir).withColumn("score", r6(F.col("score") * (0.5 + 0.5 * hits / 2)))
    w = Window.partitionBy("i").orderBy(F.col("score").desc(), "domain", "mode")
    return f.withColumn("rank", F.row_number().over(w)).where("rank = 1").select(F.col("i").alias("vec_id"), "domain", "mode", "score")


@query("classify_with_metadata", f"WITH {SCORES_SQL} SELECT i AS vec_id, s.domain, s.mode, score FROM scores s JOIN documents d ON d.doc_id = i WHERE rank = 1 AND lang = 'en' AND source IS NOT NULL")
def classify_with_metadata(spark, sf_dir):
    allowed = table(spark, sf_dir, "documents").where("lang = 'en' AND source IS NOT NULL").select(F.col("doc_id").alias("i"))
    return cell_scores(spark, sf_dir).where("rank = 1").join(allowed, "i", "left_semi").select(F.col("i").alias("vec_id"), "domain", "mode", "score")


@query("metadata_filter", "SELECT doc_id FROM documents WHERE lang = 'de' AND contains(source, '1') AND contains(source, 'src')")
def metadata_filter(spark, sf_dir):
    tags = F.array(F.lit("1"), F.lit("src"))
    return table(spark, sf_dir, "documents").where((F.col("lang") == "de") & F.forall(tags, lambda t: F.contains("source", t))).select("doc_id")


@query("hypothesis_query", f"WITH {HYP_SQL}, l AS (SELECT status IN ('certified', 'confirmed') AS certified, composite FROM fit WHERE status NOT IN ('failed', 'inert', 'superseded')) SELECT certified, count(*) AS n, floor(max(composite) * 1e6 + 0.5001) / 1e6 AS best FROM l GROUP BY certified")
def hypothesis_query(spark, sf_dir):
    live = fit(spark, sf_dir).where(~F.col("status").isin("failed", "inert", "superseded"))
    return live.groupBy(F.col("status").isin("certified", "confirmed").alias("certified")).agg(F.count("*").alias("n"), r6(F.max("composite")).alias("best"))


@query("revision_history", f"WITH {HYP_SQL}, r AS (SELECT h_id, ord, source, supports, row_number() OVER (PARTITION BY h_id ORDER BY ord, source, supports) AS step, sum((NOT supports)::INT) OVER (PARTITION BY h_id ORDER BY ord, source, supports ROWS UNBOUNDED PRECEDING) AS con FROM ev) SELECT h_id, step::INTEGER AS step, CASE WHEN con > 0 THEN 'contradicted' ELSE 'supported' END AS status FROM r")
def revision_history(spark, sf_dir):
    w = Window.partitionBy("h_id").orderBy("ord", "source", "supports")
    r = evidence(spark, sf_dir).withColumns({"step": F.row_number().over(w), "con": F.sum((~F.col("supports")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    return r.select("h_id", "step", F.when(F.col("con") > 0, "contradicted").otherwise("supported").alias("status"))


@query(
    "retraction_cascade",
    f"""WITH {P.EDGE_SQL}, {HYP_SQL}, hit AS (SELECT DISTINCT 'o' || h_id AS node FROM ev WHERE source = 7), s1 AS (SELECT DISTINCT target AS node FROM edges JOIN hit ON source = node), s2 AS (SELECT DISTINCT target AS node FROM edges JOIN s1 ON source = node)
SELECT node, min(hop) AS hop FROM (SELECT node, 0 AS hop FROM hit UNION ALL SELECT node, 1 FROM s1 UNION ALL SELECT node, 2 FROM s2) GROUP BY node""",
)
def retraction_cascade(spark, sf_dir):
    hit = evidence(spark, sf_dir).where("source = 7").select(F.concat(F.lit("o"), F.col("h_id")).alias("node")).distinct()
    # One walk from all seeds at once: the least hop of a node is over any seed.
    seeds = hit.select(F.lit("all").alias("seed"), "node", F.lit(0).alias("hop"))
    front, seen, e = seeds, seeds, P.edges(spark, sf_dir)
    for h in (1, 2):
        front = front.join(e.select(F.col("source").alias("node"), "target"), "node").select("seed", F.col("target").alias("node")).distinct().join(seen, ["seed", "node"], "left_anti").withColumn("hop", F.lit(h))
        seen = seen.unionByName(front)
    return seen.select("node", "hop")


@query("ngram_score", f"WITH {P.PROB_SQL}, tk AS (SELECT conv_id, turn, t, unnest(range(3, len(t) + 1)) AS i FROM t) SELECT conv_id, turn, round(avg(ln(p)), 6) AS score FROM tk JOIN p ON p.c2 = t[i - 2] || ' ' || t[i - 1] AND p.next = t[i] GROUP BY conv_id, turn")
def ngram_score(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.terms(F.col("text")).alias("t")).where(F.size("t") >= 3)
    i = t.select("conv_id", "turn", "t", F.explode(F.sequence(F.lit(3), F.size("t"))).alias("i"))
    q = i.select("conv_id", "turn", F.slice("t", F.col("i") - 2, 2).alias("context"), F.element_at("t", F.col("i")).alias("next"))
    return ngram.probability(q, P.ng(spark, sf_dir), 3).groupBy("conv_id", "turn").agg(F.round(F.avg(F.log("p")), 6).alias("score"))


@query("ngram_cell_tables", "WITH w AS (SELECT event_type AS cell, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS context, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS next FROM events) SELECT cell, next, count(*) AS cnt, sum(count(*)) OVER (PARTITION BY cell)::BIGINT AS support FROM w WHERE next IS NOT NULL GROUP BY cell, next")
def ngram_cell_tables(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("cell"), F.lead("event_type").over(w).alias("next")).where("next IS NOT NULL")
    c = e.groupBy("cell", "next").agg(F.count("*").alias("cnt"))
    return c.withColumn("support", F.sum("cnt").over(Window.partitionBy("cell")))


@query("ngram_generate")
def ngram_generate(spark, sf_dir):
    words = ngram.generate(P.ng(spark, sf_dir), ["the"], 8, 3)
    return spark.createDataFrame([(i, w) for i, w in enumerate(words)], "pos int, token string")


@query(
    "runs_test",
    """WITH c AS (SELECT user_id, event_type = 'view' AS v, (event_type = 'view') <> lag(event_type = 'view') OVER (PARTITION BY user_id ORDER BY event_id) AS ch FROM events),
s AS (SELECT user_id, sum(v::INT)::DOUBLE AS a, sum((NOT v)::INT)::DOUBLE AS b, sum(coalesce(ch, false)::INT) + 1 AS r FROM c GROUP BY user_id), z AS (SELECT *, 2 * a * b * (2 * a * b - a - b) / ((a + b) * (a + b) * (a + b - 1)) AS var FROM s)
SELECT user_id, round(CASE WHEN a = 0 OR b = 0 OR a + b < 2 OR var <= 0 THEN 0 ELSE (r - (2 * a * b / (a + b) + 1)) / sqrt(var) END, 6) AS z FROM z""",
)
def runs_test(spark, sf_dir):
    v = F.col("event_type") == "view"
    c = table(spark, sf_dir, "events").select("user_id", v.alias("v"), (v != F.lag(v).over(Window.partitionBy("user_id").orderBy("event_id"))).alias("ch"))
    s = c.groupBy("user_id").agg(F.count_if("v").cast("double").alias("a"), F.count_if(~F.col("v")).cast("double").alias("b"), (F.count_if("ch") + 1).alias("r"))
    return s.select("user_id", F.round(sequence.runs_z(F.col("a"), F.col("b"), F.col("r")), 6).alias("z"))


@query(
    "sequence_deviations",
    f"""WITH {E_SQL}, u AS (SELECT vec_id, label, list_transform(v, lambda x: x / greatest(sqrt(list_inner_product(v, v)), 1e-8)) AS v FROM e), l AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM u),
m AS (SELECT label, pos, avg(x) AS x FROM l GROUP BY label, pos), c AS (SELECT label, list(x ORDER BY pos) AS c FROM m GROUP BY label),
s AS (SELECT vec_id, u.label, round(list_inner_product(v, c) / greatest(sqrt(list_inner_product(c, c)), 1e-8), 9) AS s FROM u JOIN c USING (label)), t AS (SELECT label, avg(s) - stddev_pop(s) AS t FROM s GROUP BY label)
SELECT vec_id, label::BIGINT AS label, round(s, 6) AS sim FROM s JOIN t USING (label) WHERE s < t""",
)
def sequence_deviations(spark, sf_dir):
    u = emb(spark, sf_dir).where("embedding IS NOT NULL").select("vec_id", F.col("label").cast("long").alias("label"), V.normalise(V.as_double(F.col("embedding"))).alias("v"))
    c = neighbours.centroids(u, ["label"], "v").select("label", V.normalise(F.col("centroid")).alias("c"))
    s = u.join(c, "label").select("vec_id", "label", F.round(V.dot(F.col("v"), F.col("c")), 9).alias("s"))
    t = s.groupBy("label").agg((F.avg("s") - F.stddev_pop("s")).alias("t"))
    return s.join(t, "label").where("s < t").select("vec_id", "label", F.round("s", 6).alias("sim"))


@query("arm_scores", f"WITH {RANKED_SQL} SELECT round(avg((rank = 1 AND lj = li)::INT), 6) * 3 AS top1, round(avg((lj = li)::INT), 6) AS top3_share FROM ranked WHERE rank <= 3")
def arm_scores(spark, sf_dir):
    e = emb(spark, sf_dir)
    lab = lambda c, n: e.select(F.col("vec_id").alias(c), F.col("label").alias(n))
    t = neighbours.top_k(e, e, "vec_id", "embedding", 3).join(lab("i", "li"), "i").join(lab("j", "lj"), "j")
    same = (F.col("li") == F.col("lj")).cast("int")
    return t.agg((F.round(F.avg(F.when(F.col("rank") == 1, same).otherwise(0)), 6) * 3).alias("top1"), F.round(F.avg(same), 6).alias("top3_share"))


@query("position_locality", f"WITH {RANKED_SQL}, n AS (SELECT count(*)::DOUBLE AS n FROM e) SELECT round(avg(abs(i - j)), 6) AS distance, round((max(n) * max(n) - 1) / (3 * max(n)), 6) AS null_distance FROM ranked, n WHERE rank <= 5")
def position_locality(spark, sf_dir):
    e = emb(spark, sf_dir).where("embedding IS NOT NULL")
    n = e.agg(F.count("*").cast("double").alias("n"))
    d = neighbours.top_k(e, e, "vec_id", "embedding", 5).agg(F.round(F.avg(F.abs(F.col("i") - F.col("j"))), 6).alias("distance"))
    return d.join(n).select("distance", F.round((F.col("n") * F.col("n") - 1) / (3 * F.col("n")), 6).alias("null_distance"))


@query("claim_identity_sweep", f"""WITH {PAIRS_SQL}, c AS (SELECT s, li = lj AS same FROM pairs WHERE i < j AND s >= 0.3), t AS (SELECT unnest([0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.95])::DOUBLE AS t), k AS (SELECT count(*) AS z FROM e a JOIN e b ON a.vec_id < b.vec_id AND a.label = b.label),
g AS (SELECT t, sum((s >= t AND same)::INT) AS tp, sum((s >= t AND NOT same)::INT) AS fp FROM c, t GROUP BY t)
SELECT t AS threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, round(tp / greatest(tp + fp, 1), 6) AS precision, round(tp / greatest(z, 1), 6) AS recall FROM g, k""")
def claim_identity_sweep(spark, sf_dir):
    e = emb(spark, sf_dir)
    lab = lambda c, n: e.select(F.col("vec_id").alias(c), F.col("label").alias(n))
    c = neighbours.pairs_above(e, "vec_id", "embedding", 0.3, strict=False).join(lab("i", "li"), "i").join(lab("j", "lj"), "j").select("s", (F.col("li") == F.col("lj")).alias("same"))
    # Pairs of equal labels, from label counts.
    n = e.where("embedding IS NOT NULL").groupBy("label").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("z"))
    at = list(extract.SWEEP)
    t = c.select("same", F.explode(F.filter(F.array(*[F.lit(x) for x in at]), lambda x: x <= F.col("s"))).alias("t")).groupBy("t").agg(F.count_if("same").alias("tp"), F.count_if(~F.col("same")).alias("fp"))
    every = spark.createDataFrame([(x,) for x in at], "t double").join(t, "t", "left").join(n)
    tp, fp = F.coalesce("tp", F.lit(0)), F.coalesce("fp", F.lit(0))
    one = F.lit(1)
    return every.select(F.col("t").alias("threshold"), tp.alias("tp"), fp.alias("fp"), F.round(tp / F.greatest(tp + fp, one), 6).alias("precision"), F.round(tp / F.greatest(F.col("z"), one), 6).alias("recall"))


@query(
    "direction_moved",
    r"""WITH w AS (SELECT conv_id, turn, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS n FROM conversations)
SELECT a.conv_id, a.turn, CASE WHEN b.n < a.n * 0.85 THEN 'shorter' WHEN b.n > a.n * 1.15 THEN 'longer' ELSE 'rephrased' END AS moved FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""",
)
def direction_moved(spark, sf_dir):
    w = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(F.filter(F.split("text", r"\s+"), lambda x: x != "")).alias("n"))
    b = w.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("n").alias("m"))
    moved = F.when(F.col("m") < F.col("n") * 0.85, "shorter").when(F.col("m") > F.col("n") * 1.15, "longer").otherwise("rephrased")
    return w.join(b, ["conv_id", "turn"]).select("conv_id", "turn", moved.alias("moved"))


@query("lexical_margin", f"WITH {BM25_SQL}, m AS (SELECT item_id, max(score) FILTER (rank = 1) AS s1, max(score) FILTER (rank = 2) AS s2 FROM r GROUP BY item_id) SELECT count(*) AS n, round(avg((s1 - s2) / s1), 6) AS margin, round(avg((s1 - s2) / s1), 6) < 0.15 AS entity_link FROM m WHERE s1 > 0 AND s2 > 0")
def lexical_margin(spark, sf_dir):
    r = bm25_ranked(spark, sf_dir)
    m = r.groupBy("query").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("s1"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("s2")).where("s1 > 0 AND s2 > 0")
    return m.agg(F.count("*").alias("n"), F.round(F.avg((F.col("s1") - F.col("s2")) / F.col("s1")), 6).alias("margin")).withColumn("entity_link", F.col("margin") < 0.15)


@query("branch_certify_isolate", f"WITH {RANKED_SQL}, c AS (SELECT i, greatest(0, avg(s)) AS c FROM ranked WHERE rank <= 5 GROUP BY i) SELECT CASE WHEN round(c, 9) > 0.7 THEN 'certified' WHEN round(c, 9) < 0.3 THEN 'isolated' ELSE 'open' END AS branch, count(*) AS nodes FROM c GROUP BY 1")
def branch_certify_isolate(spark, sf_dir):
    e = emb(spark, sf_dir)
    d = neighbours.density(neighbours.top_k(e, e, "vec_id", "embedding", 5), e.where("embedding IS NOT NULL"), "vec_id")
    c = F.round("coherence", 9)
    return d.groupBy(F.when(c > 0.7, "certified").when(c < 0.3, "isolated").otherwise("open").alias("branch")).agg(F.count("*").alias("nodes"))


@query("dream_failures", "SELECT doc_id, round(0.5 + 0.1 * quality, 6)::DOUBLE AS outcome, quality > 0 AS prevented, round(0.05 * abs(quality), 6)::DOUBLE AS delta FROM labels WHERE toxic = 1")
def dream_failures(spark, sf_dir):
    q = F.col("quality")
    return table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id", F.round(0.5 + 0.1 * q, 6).alias("outcome"), (q > 0).alias("prevented"), F.round(0.05 * F.abs(q), 6).alias("delta"))


@query("merge_entities", r"SELECT doc_id, list_sort(list_distinct(list_concat(regexp_extract_all(text, '[a-z]+-[a-z0-9]+'), regexp_extract_all(text, '[A-Z]{4,}')))) AS keys FROM documents")
def merge_entities(spark, sf_dir):
    a, b = (F.regexp_extract_all("text", F.lit(f"({p})"), 1) for p in ("[a-z]+-[a-z0-9]+", "[A-Z]{4,}"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_sort(F.array_union(a, b)).alias("keys"))


SHAPE_SQL = r"s AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, list_distinct(list_filter(regexp_split_to_array(lower(regexp_replace(url, '^[a-z]+://[^/]+', '')), '[^a-z0-9]+'), lambda x: x <> '')) AS t FROM pages)"


def shapes(spark, sf_dir):
    t = F.filter(F.split(F.lower(F.regexp_replace("url", "^[a-z]+://[^/]+", "")), "[^a-z0-9]+"), lambda x: x != "")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.array_distinct(t).alias("t"))


@query("shape_match", f"WITH {SHAPE_SQL}, o AS (SELECT page_id, host, len(t) AS n, unnest(t) AS k FROM s) SELECT a.page_id AS a, b.page_id AS b, round(count(*) / (a.n + b.n - count(*)), 6) AS score FROM o a JOIN o b ON a.host = b.host AND a.k = b.k AND a.page_id < b.page_id GROUP BY a.page_id, b.page_id, a.n, b.n HAVING count(*) / (a.n + b.n - count(*)) >= 0.5")
def shape_match(spark, sf_dir):
    sets = shapes(spark, sf_dir).select(F.col("host").alias("grp"), F.col("page_id").alias("id"), "t")
    return overlap.similar(sets, None, 0.5).select("a", "b", F.round(overlap.jaccard(), 6).alias("score"))


@query("shape_plan", f"WITH {SHAPE_SQL}, d AS (SELECT DISTINCT host, unnest(t) AS k FROM s WHERE page_id % 2 = 0), r AS (SELECT DISTINCT host, unnest(t) AS k FROM s WHERE page_id % 2 = 1) SELECT host, count(*) FILTER (r.k IS NOT NULL) AS keep, count(*) FILTER (r.k IS NULL) AS \"create\" FROM d LEFT JOIN r USING (host, k) GROUP BY host")
def shape_plan(spark, sf_dir):
    s = shapes(spark, sf_dir)
    d = s.where("page_id % 2 = 0").select("host", F.explode("t").alias("k")).distinct()
    r = s.where("page_id % 2 = 1").select("host", F.explode("t").alias("k")).distinct().withColumn("there", F.lit(True))
    j = d.join(r, ["host", "k"], "left")
    return j.groupBy("host").agg(F.count("there").alias("keep"), F.count_if(F.col("there").isNull()).alias("create"))


@query("compiled_context")
def compiled_context(spark, sf_dir):
    """Contexts without repeats of a family (of like embeddings) under a budget, against the best 12 documents without one."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), T.token_estimate(F.col("text")).alias("tokens"), "text")
    e = table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL")
    alike, _ = neighbours.families(e, "vec_id", "embedding", neighbours.top_k(e, e, "vec_id", "embedding", 1).select("i", "s"))
    at = bm25_index(spark, sf_dir)
    found = context.compiled(bm25_scored(spark, sf_dir) if at is None else at, d, alike, 1500, 8)
    return found.select(F.col("query").alias("item_id"), "baseline_tokens", "compiled_tokens", "saving", "picks", "removed", "truncated", F.sha2("context", 256).alias("context_sha256"))


@query("claims_opposed")
def claims_opposed(spark, sf_dir):
    return extract.opposed(extract.signatures(table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"), "id", "text"))


@query("components_of_orders", f"WITH {P.EDGE_SQL} SELECT count(*) AS regions FROM region WHERE 'r' || r_regionkey IN (SELECT target FROM edges)")
def components_of_orders(spark, sf_dir):
    """Orders hang together by region: as many components as regions with nations."""
    e = P.edges(spark, sf_dir)
    parts = graph.components(e.select(F.col("source").alias("u"), F.col("target").alias("v")))
    return parts.agg(F.countDistinct("component").alias("regions"))
