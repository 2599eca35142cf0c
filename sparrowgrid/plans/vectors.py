"""Queries over the embeddings table: similarity, neighbours, cells, coverage, recovery."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparrowgrid.functions import vector as V
from sparrowgrid.operators import classify, neighbours
from sparrowgrid.plans.base import query
from sparrowgrid.session import table

E_SQL = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL)"
PAIRS_SQL = f"""{E_SQL},
pairs AS (SELECT a.vec_id AS i, a.label AS li, b.vec_id AS j, b.label AS lj,
                 round(greatest(-1.0, least(1.0, list_inner_product(a.v, b.v)
                   / (greatest(sqrt(list_inner_product(a.v, a.v)), 1e-8) * greatest(sqrt(list_inner_product(b.v, b.v)), 1e-8)))), 9) AS s
          FROM e a JOIN e b ON a.vec_id <> b.vec_id)"""
RANKED_SQL = f"{PAIRS_SQL},\nranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY s DESC, j)::INTEGER AS rank FROM pairs)"
#: Cells of the fixture grid: label div 2 is the domain, label mod 2 the mode.
SCORES_SQL = f"""{PAIRS_SQL},
cell AS (SELECT i, (lj // 2)::BIGINT AS domain, (lj % 2)::BIGINT AS mode, max(s) AS s FROM pairs GROUP BY i, lj),
sizes AS (SELECT (label // 2)::BIGINT AS domain, (label % 2)::BIGINT AS mode, count(*) AS n FROM e GROUP BY label),
r AS (SELECT *, row_number() OVER (PARTITION BY i, domain ORDER BY s DESC, mode) AS r FROM cell),
d AS (SELECT *, avg(CASE WHEN r <= 2 THEN s END) OVER (PARTITION BY i, domain) AS d FROM r),
raw AS (SELECT i, domain, mode, (0.4 * d + 0.6 * s) * CASE WHEN n >= 10 THEN 1 + least(n / 100, 0.2) WHEN n <= 3 THEN 1 + (3 - n) / 10 ELSE 1.0 END AS raw
        FROM d JOIN sizes USING (domain, mode)),
scaled AS (SELECT i, domain, mode, round(CASE WHEN max(raw) OVER (PARTITION BY i) > 1 THEN raw / max(raw) OVER (PARTITION BY i) ELSE raw END, 6) AS score FROM raw),
scores AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, domain, mode)::INTEGER AS rank FROM scaled)"""


def emb(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


def cell_scores(spark, sf_dir):
    e = emb(spark, sf_dir)
    best = neighbours.label_best(e, "vec_id", "label", "embedding")
    grid = lambda c: [F.floor(F.col(c) / 2).alias("domain"), (F.col(c) % 2).cast("long").alias("mode")]
    sizes = e.where("embedding IS NOT NULL").groupBy("label").agg(F.count("*").alias("n")).select(*grid("label"), "n")
    return classify.score_cells(best.select("i", *grid("lj"), "s"), sizes)


@query(
    "self_recovery",
    f"""WITH {PAIRS_SQL}, best AS (SELECT i, li, lj, max(s) AS s FROM pairs GROUP BY i, li, lj),
pick AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY s DESC, lj) AS rn FROM best)
SELECT li::BIGINT AS label, count(*) AS n, sum(CASE WHEN lj = li THEN 1 ELSE 0 END)::BIGINT AS recovered,
       round(avg(CASE WHEN lj = li THEN 1.0 ELSE 0.0 END), 6) AS rate FROM pick WHERE rn = 1 GROUP BY li""",
)
def self_recovery(spark, sf_dir):
    return neighbours.self_recovery(emb(spark, sf_dir), "vec_id", "label", "embedding")


@query("vec_cosine_pairs_topk", f"WITH {RANKED_SQL} SELECT i, j, round(s, 6) AS sim, rank FROM ranked WHERE rank <= 5")
def vec_cosine_pairs_topk(spark, sf_dir):
    e = emb(spark, sf_dir)
    return neighbours.top_k(e, e, "vec_id", "embedding", 5).select("i", "j", V.six(F.col("s")).alias("sim"), "rank")


@query(
    "vec_dot_search",
    f"""WITH {E_SQL}, p AS (SELECT a.vec_id AS i, b.vec_id AS j, round(list_inner_product(a.v, b.v), 9) AS s FROM e a, e b),
r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY s DESC, j)::INTEGER AS rank FROM p) SELECT i, j, round(s, 6) AS score, rank FROM r WHERE rank <= 10""",
)
def vec_dot_search(spark, sf_dir):
    e = emb(spark, sf_dir)
    return neighbours.top_k(e, e, "vec_id", "embedding", 10, "dot", False).select("i", "j", V.six(F.col("s")).alias("score"), "rank")


@query(
    "vec_mutual_knn",
    f"""WITH {RANKED_SQL}, k AS (SELECT i, j, s FROM ranked WHERE rank <= 5)
SELECT a.i, a.j, round(a.s, 6) AS sim FROM k a JOIN k b ON a.i = b.j AND a.j = b.i WHERE a.i < a.j""",
)
def vec_mutual_knn(spark, sf_dir):
    e = emb(spark, sf_dir)
    return neighbours.mutual(neighbours.top_k(e, e, "vec_id", "embedding", 5)).select("i", "j", V.six(F.col("s")).alias("sim"))


@query(
    "vec_cell_centroids",
    f"""WITH {E_SQL}, l AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM e),
m AS (SELECT label, pos, avg(x) AS x, count(*) AS n FROM l GROUP BY label, pos),
c AS (SELECT label, max(n) AS n, list(x ORDER BY pos) AS c FROM m GROUP BY label)
SELECT (label // 2)::BIGINT AS domain, (label % 2)::BIGINT AS mode, n, round(sqrt(list_inner_product(c, c)), 6) AS length, round(c[1], 6) AS first,
       round(c[1] / greatest(sqrt(list_inner_product(c, c)), 1e-8), 6) AS unit_first FROM c""",
)
def vec_cell_centroids(spark, sf_dir):
    c = neighbours.centroids(emb(spark, sf_dir), ["label"], "embedding")
    unit = V.normalise(F.col("centroid"))
    return c.select(
        F.floor(F.col("label") / 2).alias("domain"), (F.col("label") % 2).cast("long").alias("mode"), "n", F.round(V.norm(F.col("centroid")), 6).alias("length"),
        F.round(F.col("centroid")[0], 6).alias("first"), F.round(unit[0], 6).alias("unit_first"),
    )


@query("classify_cells", f"WITH {SCORES_SQL} SELECT i AS vec_id, domain, mode, score, rank FROM scores")
def classify_cells(spark, sf_dir):
    return cell_scores(spark, sf_dir).withColumnRenamed("i", "vec_id")


@query(
    "classify_margin",
    f"""WITH {SCORES_SQL}, m AS (SELECT *, round(score - lead(score) OVER (PARTITION BY i ORDER BY rank), 6) AS lead FROM scores)
SELECT i AS vec_id, domain, mode, score, lead, CASE WHEN lead < 0.02 THEN 'tie' WHEN lead < 0.08 THEN 'weak' ELSE 'clear' END AS verdict FROM m WHERE rank = 1""",
)
def classify_margin(spark, sf_dir):
    return classify.margins(cell_scores(spark, sf_dir)).withColumnRenamed("i", "vec_id")


@query(
    "cell_linkage",
    f"""WITH {SCORES_SQL}, t AS (SELECT i, domain, mode FROM scores WHERE rank <= 2),
p AS (SELECT a.domain AS domain_a, a.mode AS mode_a, b.domain AS domain_b, b.mode AS mode_b FROM t a JOIN t b ON a.i = b.i AND (a.domain, a.mode) < (b.domain, b.mode))
SELECT *, count(*) AS n, domain_a <> domain_b AS cross_domain FROM p GROUP BY ALL""",
)
def cell_linkage(spark, sf_dir):
    return classify.linkage(cell_scores(spark, sf_dir))


@query(
    "grid_heatmap",
    """WITH g AS (SELECT d AS domain, m AS mode FROM range(5) a(d), range(9) b(m)),
n AS (SELECT (label // 2)::BIGINT AS domain, (label % 2)::BIGINT AS mode, count(*) AS n FROM embeddings GROUP BY label)
SELECT g.domain, g.mode, g.domain * 9 + g.mode AS cell, coalesce(n, 0) AS entries, round(coalesce(n, 0) * 0.1::DOUBLE, 6) AS activation FROM g LEFT JOIN n USING (domain, mode)""",
)
def grid_heatmap(spark, sf_dir):
    grid = spark.range(45).select(F.floor(F.col("id") / 9).alias("domain"), (F.col("id") % 9).alias("mode"), F.col("id").alias("cell"))
    n = emb(spark, sf_dir).groupBy(F.floor(F.col("label") / 2).alias("domain"), (F.col("label") % 2).cast("long").alias("mode")).agg(F.count("*").alias("n"))
    entries = F.coalesce("n", F.lit(0))
    return grid.join(F.broadcast(n), ["domain", "mode"], "left").select("domain", "mode", "cell", entries.alias("entries"), F.round(entries * 0.1, 6).alias("activation"))


@query(
    "propose_topk_cells",
    f"""WITH {E_SQL}, l AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM e),
m AS (SELECT label, pos, avg(x) AS x FROM l GROUP BY label, pos), c AS (SELECT label, list(x ORDER BY pos) AS c FROM m GROUP BY label),
s AS (SELECT vec_id, c.label, round(list_inner_product(v, c) / (greatest(sqrt(list_inner_product(v, v)), 1e-8) * greatest(sqrt(list_inner_product(c, c)), 1e-8)), 6) AS score FROM e, c),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label)::INTEGER AS rank FROM s)
SELECT vec_id, label::BIGINT AS cell, score, rank FROM r WHERE rank <= 3""",
)
def propose_topk_cells(spark, sf_dir):
    e = emb(spark, sf_dir).where("embedding IS NOT NULL").select("vec_id", V.as_double(F.col("embedding")).alias("v"))
    # One centroid for each cell of the grid: a table of fixed size.
    c = neighbours.centroids(emb(spark, sf_dir), ["label"], "embedding").select(F.col("label").cast("long").alias("cell"), V.normalise(F.col("centroid")).alias("c"))
    s = e.join(F.broadcast(c)).select("vec_id", "cell", F.round(V.dot(V.normalise(F.col("v")), F.col("c")), 6).alias("score"))
    w = Window.partitionBy("vec_id").orderBy(F.col("score").desc(), "cell")
    return s.withColumn("rank", F.row_number().over(w)).where("rank <= 3")


@query(
    "propose_cells_distance",
    f"""WITH {SCORES_SQL}, l AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM e),
m AS (SELECT label, pos, avg(x) AS x FROM l GROUP BY label, pos), c AS (SELECT label, list(x ORDER BY pos) AS c FROM m GROUP BY label)
SELECT i AS vec_id, domain, mode, score, round(list_distance(v, c), 6) AS distance FROM scores JOIN e ON i = vec_id JOIN c ON c.label = domain * 2 + mode WHERE rank <= 3""",
)
def propose_cells_distance(spark, sf_dir):
    c = neighbours.centroids(emb(spark, sf_dir), ["label"], "embedding").select("label", "centroid")
    s = cell_scores(spark, sf_dir).where("rank <= 3").withColumn("label", F.col("domain") * 2 + F.col("mode"))
    gap = F.zip_with(V.as_double(F.col("embedding")), "centroid", lambda x, y: x - y)
    j = s.join(F.broadcast(c), "label").join(emb(spark, sf_dir).select(F.col("vec_id").alias("i"), "embedding"), "i")
    return j.select(F.col("i").alias("vec_id"), "domain", "mode", "score", F.round(V.norm(gap), 6).alias("distance"))


@query("best_entry", f"WITH {RANKED_SQL} SELECT i AS vec_id, j AS entry, lj::BIGINT AS cell, round(s, 6) AS sim FROM ranked WHERE rank = 1")
def best_entry(spark, sf_dir):
    e = emb(spark, sf_dir)
    cells = e.select(F.col("vec_id").alias("j"), F.col("label").cast("long").alias("cell"))
    return neighbours.top_k(e, e, "vec_id", "embedding", 1).join(cells, "j").select(F.col("i").alias("vec_id"), F.col("j").alias("entry"), "cell", V.six(F.col("s")).alias("sim"))


@query(
    "coverage_uncovered",
    f"WITH {PAIRS_SQL}, b AS (SELECT i, max(s) AS s FROM pairs GROUP BY i) SELECT i AS vec_id, round(s, 6) AS best FROM b WHERE s < 0.4",
)
def coverage_uncovered(spark, sf_dir):
    e = emb(spark, sf_dir)
    return neighbours.top_k(e, e, "vec_id", "embedding", 1).where("s < 0.4").select(F.col("i").alias("vec_id"), V.six(F.col("s")).alias("best"))


@query(
    "coverage_rank",
    f"""WITH {PAIRS_SQL}, live AS (SELECT i, max(CASE WHEN lj < 5 THEN s END) AS now FROM pairs GROUP BY i),
g AS (SELECT lj AS candidate, i, max(s) AS s FROM pairs WHERE lj >= 5 GROUP BY lj, i)
SELECT candidate::BIGINT AS candidate, sum((coalesce(now, -1) < 0.4 AND s >= 0.4)::INT)::BIGINT AS newly_covered, round(sum(greatest(0, s - coalesce(now, -1))), 6) AS lift,
       sum((coalesce(now, -1) < 0.4 AND s >= 0.4)::INT) > 0 AS useful FROM g JOIN live USING (i) GROUP BY candidate""",
)
def coverage_rank(spark, sf_dir):
    best = neighbours.label_best(emb(spark, sf_dir), "vec_id", "label", "embedding")
    live = best.groupBy(F.col("i").alias("record")).agg(F.max(F.when(F.col("lj") < 5, F.col("s"))).alias("s"))
    sims = best.where("lj >= 5").select(F.col("i").alias("record"), F.col("lj").alias("candidate"), "s")
    return classify.gains(live, sims, 0.4)


@query(
    "node_coherence_full",
    f"WITH {RANKED_SQL} SELECT i AS vec_id, round(greatest(0, avg(s)), 6) AS coherence FROM ranked WHERE rank <= 5 GROUP BY i",
)
def node_coherence_full(spark, sf_dir):
    e = emb(spark, sf_dir)
    d = neighbours.density(neighbours.top_k(e, e, "vec_id", "embedding", 5), e.where("embedding IS NOT NULL"), "vec_id")
    return d.select(F.col("id").alias("vec_id"), F.round("coherence", 6).alias("coherence"))


@query(
    "node_coherence_incremental",
    f"""WITH {PAIRS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY s DESC, j) AS rank FROM pairs WHERE j < i)
SELECT vec_id, round(CASE WHEN m IS NULL THEN 1 ELSE greatest(0, m) END, 6) AS coherence FROM e LEFT JOIN (SELECT i, avg(s) AS m FROM r WHERE rank <= 5 GROUP BY i) ON i = vec_id""",
)
def node_coherence_incremental(spark, sf_dir):
    e = emb(spark, sf_dir).where("embedding IS NOT NULL")
    d = neighbours.density(neighbours.earlier_top_k(e, "vec_id", "embedding", 5), e, "vec_id")
    return d.select(F.col("id").alias("vec_id"), F.round("coherence", 6).alias("coherence"))


@query(
    "nearest_neighbour_median",
    f"""WITH {PAIRS_SQL}, b AS (SELECT i, max(s) AS s FROM pairs GROUP BY i), o AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS k, count(*) OVER () AS n FROM b)
SELECT round(max(CASE WHEN k = n // 2 THEN s END), 6) AS median, round(max(CASE WHEN k = n // 5 THEN s END), 6) AS tail20, round(avg(s), 6) AS mean, round(stddev_pop(s), 6) AS sd FROM o""",
)
def nearest_neighbour_median(spark, sf_dir):
    e = emb(spark, sf_dir)
    s = neighbours.top_k(e, e, "vec_id", "embedding", 1).select("s")
    stats = s.agg(F.round(F.avg("s"), 6).alias("mean"), F.round(F.stddev_pop("s"), 6).alias("sd"))
    return neighbours.order_statistics(s, "s", {"median": 0.5, "tail20": 0.2}).join(stats).select(F.round("median", 6).alias("median"), F.round("tail20", 6).alias("tail20"), "mean", "sd")


@query(
    "discover_stats",
    f"WITH {PAIRS_SQL}, b AS (SELECT i, max(s) AS s FROM pairs WHERE lj <> li GROUP BY i) SELECT count(*) AS n, round(min(s), 6) AS low, round(avg(s), 6) AS mean, round(max(s), 6) AS high FROM b",
)
def discover_stats(spark, sf_dir):
    b = neighbours.label_best(emb(spark, sf_dir), "vec_id", "label", "embedding").where("li <> lj").groupBy("i").agg(F.max("s").alias("s"))
    return b.agg(F.count("*").alias("n"), F.round(F.min("s"), 6).alias("low"), F.round(F.avg("s"), 6).alias("mean"), F.round(F.max("s"), 6).alias("high"))


@query(
    "consistency_conflicts",
    f"WITH {RANKED_SQL} SELECT i AS vec_id, j AS conflicts_with, round(1 - s, 6) AS gap FROM ranked WHERE rank = 1 AND s > 0.4",
)
def consistency_conflicts(spark, sf_dir):
    e = emb(spark, sf_dir)
    return neighbours.top_k(e, e, "vec_id", "embedding", 1).where("s > 0.4").select(F.col("i").alias("vec_id"), F.col("j").alias("conflicts_with"), V.six(1 - F.col("s")).alias("gap"))


STRUCT_SQL = f"""{RANKED_SQL}, nn AS (SELECT i, s FROM ranked WHERE rank = 1), md AS (SELECT s AS m FROM (SELECT s, row_number() OVER (ORDER BY s) - 1 AS k, count(*) OVER () AS n FROM nn) WHERE k = n // 2),
link AS (SELECT i, j FROM pairs, md WHERE s >= m - 0.02),
cc AS (WITH RECURSIVE w(node, label) AS (SELECT vec_id, vec_id FROM e UNION SELECT l.j, w.label FROM w JOIN link l ON l.i = w.node) SELECT node, min(label) AS root FROM w GROUP BY node)"""


@query("structure_repeats", f"WITH {STRUCT_SQL}, z AS (SELECT root, count(*) AS size FROM cc GROUP BY root HAVING count(*) >= 2) SELECT node AS vec_id, root AS family, size FROM cc JOIN z USING (root)")
def structure_repeats(spark, sf_dir):
    e = emb(spark, sf_dir)
    parts, _ = neighbours.families(e, "vec_id", "embedding", neighbours.top_k(e, e, "vec_id", "embedding", 1).select("i", "s"))
    sizes = parts.groupBy("component").agg(F.count("*").alias("size"))
    return parts.join(sizes, "component").select(F.col("node").alias("vec_id"), F.col("component").alias("family"), "size")


@query("structure_differences", f"WITH {STRUCT_SQL} SELECT i AS vec_id, round(m - s, 6) AS separation FROM nn, md WHERE m - s > 0.05")
def structure_differences(spark, sf_dir):
    e = emb(spark, sf_dir)
    nn = neighbours.top_k(e, e, "vec_id", "embedding", 1).select("i", "s")
    # The median is one row.
    m = neighbours.order_statistics(nn, "s", {"m": 0.5})
    return nn.join(F.broadcast(m)).where(F.col("m") - F.col("s") > 0.05).select(F.col("i").alias("vec_id"), F.round(F.col("m") - F.col("s"), 6).alias("separation"))


@query(
    "vec_normalize",
    f"""WITH {E_SQL} SELECT vec_id, round(v[1] / greatest(sqrt(list_inner_product(v, v)), 1e-8), 6) AS unit_first, round(sqrt(list_inner_product(v, v)), 6) AS length,
round((v[1] - list_avg(v)) / greatest(list_stddev_pop(v), 1e-8), 6) AS z_first FROM e""",
)
def vec_normalize(spark, sf_dir):
    v = V.as_double(F.col("embedding"))
    e = emb(spark, sf_dir).where("embedding IS NOT NULL")
    return e.select("vec_id", F.round(V.normalise(v)[0], 6).alias("unit_first"), F.round(V.norm(v), 6).alias("length"), F.round(V.zscore(v)[0], 6).alias("z_first"))


@query(
    "vec_blend",
    f"""WITH {E_SQL}, p AS (SELECT a.vec_id, a.v AS a, b.v AS b FROM e a JOIN e b ON b.vec_id = a.vec_id + 1),
w AS (SELECT vec_id, list_transform(range(1, len(a) + 1), lambda i: (a[i] + b[i]) / 2) AS m, list_inner_product(a, b) / greatest(sqrt(list_inner_product(a, a)) * sqrt(list_inner_product(b, b)), 1e-8) AS c FROM p)
SELECT vec_id, round(m[1] / sqrt(list_inner_product(m, m)), 6) AS blend_first, round(c, 6) AS cosine, round(1 - c, 6) AS distance FROM w""",
)
def vec_blend(spark, sf_dir):
    e = emb(spark, sf_dir).where("embedding IS NOT NULL").select("vec_id", V.as_double(F.col("embedding")).alias("a"))
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    c = V.cosine_unclamped(F.col("a"), F.col("b"))
    return e.join(n, "vec_id").select("vec_id", F.round(V.blend(F.col("a"), F.col("b"), 0.5)[0], 6).alias("blend_first"), F.round(c, 6).alias("cosine"), F.round(1 - c, 6).alias("distance"))
