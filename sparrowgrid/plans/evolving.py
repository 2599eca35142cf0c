"""Queries over what changes: states of sequences, cascades of retraction, layered edits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparrowgrid.functions import text as T
from sparrowgrid.functions import vector as V
from sparrowgrid.operators import cascade, descriptors, discovery, neighbours, ngram, sequence, transplant
from sparrowgrid.operators.graph import cut
from sparrowgrid.operators.overlay import Overlay
from sparrowgrid.plans.base import query
from sparrowgrid.plans.beliefs import evidence, hypotheses, predictions, r6
from sparrowgrid.plans.texts import TERMS_SQL
from sparrowgrid.plans.vectors import E_SQL, emb
from sparrowgrid.plans.wider import scored_texts
from sparrowgrid.session import table

#: Labels by their state, from places ``pl(seq, pos, text)``, mentions ``m(seq, pos, entity)`` and facts ``f(seq, pos, s, p, o)``.
STATES_SQL = f"""a AS (SELECT seq, pos, bool_or(since IS NULL) AS new, min(since) AS since FROM (SELECT *, pos - lag(pos) OVER (PARTITION BY seq, entity ORDER BY pos) AS since FROM m) GROUP BY seq, pos),
b AS (SELECT seq, pos, p, lag(pos) OVER (PARTITION BY seq, s, p, o ORDER BY pos) IS NOT NULL AS again, lag(p) OVER (PARTITION BY seq, s, o ORDER BY pos) AS before FROM f),
st AS (SELECT pl.seq, pl.pos, {" OR ".join(f"contains(lower(coalesce(text, '')), '{c}')" for c in sequence.GONE)} AS gone, coalesce(new, false) AS new, since IS NULL AND new IS NULL AS bare, coalesce(since > 6, false) AS stale, p, again, before
  FROM pl LEFT JOIN a ON a.seq = pl.seq AND a.pos = pl.pos LEFT JOIN b ON b.seq = pl.seq AND b.pos = pl.pos)
SELECT seq, pos, CASE WHEN gone THEN 'disappear' WHEN new THEN 'emerge' WHEN p IS NOT NULL AND again THEN CASE WHEN stale THEN 'recur' ELSE 'persist' END WHEN p IS NOT NULL AND before <> p THEN 'change'
  WHEN stale THEN 'recur' WHEN p IS NOT NULL THEN 'change' WHEN bare THEN 'none' ELSE 'persist' END AS label FROM st"""


@query(
    "transition_states",
    f"""WITH w AS (SELECT conv_id AS seq, turn AS pos, text, {TERMS_SQL} AS t FROM conversations), pl AS (SELECT seq, pos, text FROM w),
e AS (SELECT seq, pos, t, list_filter(t, lambda x: length(x) >= 6) AS e FROM w), m AS (SELECT DISTINCT seq, pos, unnest(e) AS entity FROM e),
f AS (SELECT seq, pos, e[1] AS s, t[list_position(t, e[1]) + 1] AS p, e[2] AS o FROM e WHERE len(e) >= 2),
{STATES_SQL}""",
)
def transition_states(spark, sf_dir):
    """Turns of conversations: long words are entities; the first two and the word after the first are the turn's fact."""
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("seq"), F.col("turn").alias("pos"), "text", T.terms(F.col("text")).alias("t"))
    t = t.withColumn("e", F.filter("t", lambda x: F.length(x) >= 6))
    two = t.where(F.size("e") >= 2)
    facts = two.select("seq", "pos", F.col("e")[0].alias("s"), F.expr("t[cast(array_position(t, e[0]) as int)]").alias("p"), F.col("e")[1].alias("o"))
    return sequence.states(t.select("seq", "pos", "text"), t.select("seq", "pos", F.explode("e").alias("entity")), facts)


@query(
    "transition_states_events",
    f"""WITH ev AS (SELECT user_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos, event_type, value, props FROM events),
pl AS (SELECT seq, pos, CASE WHEN event_type = 'error' AND value > 20 THEN 'it stops' ELSE event_type END AS text FROM ev),
m AS (SELECT seq, pos, props AS entity FROM ev WHERE event_type <> 'signup'), f AS (SELECT seq, pos, 'user' AS s, event_type AS p, props AS o FROM ev WHERE event_type IN ('click', 'purchase')),
{STATES_SQL}""",
)
def transition_states_events(spark, sf_dir):
    """Events of users: properties are entities, clicks and purchases facts, great errors what is gone; sign-ups name nothing."""
    here = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("seq"), here.alias("pos"), "event_type", "value", "props")
    text = F.when((F.col("event_type") == "error") & (F.col("value") > 20), "it stops").otherwise(F.col("event_type"))
    facts = e.where(F.col("event_type").isin("click", "purchase")).select("seq", "pos", F.lit("user").alias("s"), F.col("event_type").alias("p"), F.col("props").alias("o"))
    return sequence.states(e.select("seq", "pos", text.alias("text")), e.where("event_type <> 'signup'").select("seq", "pos", F.col("props").alias("entity")), facts)


@query("retraction_fixpoint")
def retraction_fixpoint(spark, sf_dir):
    """Supplier 7's evidence for orders is taken away: an order without support takes down its customer, a customer the supplier of the
    same number, whose evidence falls in turn; a customer depends on the next one, so that dependence has cycles."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    refs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("h_id"), F.col("o_custkey").alias("node"))
    depends = customers.select(F.col("k").alias("source"), (F.floor(F.col("k") / 10) * 10 + (F.col("k") + 1) % 10).cast("long").alias("target"))
    vouched = customers.select(F.col("k").alias("node"), F.col("k").alias("source"))
    touched, lost = cascade.retract(hypotheses(spark, sf_dir), evidence(spark, sf_dir), predictions(spark, sf_dir), refs, depends, vouched, spark.createDataFrame([(7,)], "source long"))
    rows = touched.join(refs, "h_id", "left").join(lost.withColumnRenamed("hop", "node_hop"), "node", "left")
    return rows.select("h_id", "node", "node_hop", "hop", "retracted", "status_before", "status_after", r6("fitness_before").alias("fitness_before"), r6("fitness_after").alias("fitness_after"))


@query(
    "overlay_read",
    """WITH p AS (SELECT d.doc_id, CASE WHEN g.doc_id IS NOT NULL THEN 'good' ELSE lang END AS lang, source FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) g USING (doc_id)),
k AS (SELECT * FROM p WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)), n AS (SELECT -1 - item_id AS doc_id, 'bench' AS lang, NULL AS source FROM benchmark)
SELECT * FROM k UNION ALL SELECT * FROM n""",
)
def overlay_read(spark, sf_dir):
    """Documents under four layers: good ones renamed, toxic ones dropped, benchmark items put, and layers of both folded to one."""
    base = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    labels = table(spark, sf_dir, "labels")
    items = table(spark, sf_dir, "benchmark").select((-1 - F.col("item_id")).alias("doc_id"), F.lit("bench").alias("lang"))
    edited = Overlay(base, "doc_id").patch(labels.where("quality = 1").select("doc_id", F.lit("good").alias("lang"))).drop(labels.where("toxic = 1"))
    return edited.put(items).flat().read()


@query(
    "sequence_deviation_kinds",
    f"""WITH {E_SQL}, u AS (SELECT vec_id, label, list_transform(v, lambda x: x / greatest(sqrt(list_inner_product(v, v)), 1e-8)) AS v FROM e), l AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM u),
m AS (SELECT label, pos, avg(x) AS x FROM l GROUP BY label, pos), c AS (SELECT label, list(x ORDER BY pos) AS c FROM m GROUP BY label),
s AS (SELECT vec_id, u.label, v, round(list_inner_product(v, c) / greatest(sqrt(list_inner_product(c, c)), 1e-8), 9) AS s FROM u JOIN c USING (label)), t AS (SELECT label, avg(s) - stddev_pop(s) AS t FROM s GROUP BY label HAVING count(*) >= 3),
o AS (SELECT s.* FROM s JOIN t USING (label) WHERE s < t)
SELECT o.vec_id, o.label::BIGINT AS label, round(o.s, 6) AS sim, CASE WHEN EXISTS (SELECT 1 FROM s x WHERE x.label = o.label AND x.vec_id > o.vec_id AND round(list_inner_product(o.v, x.v), 9) > x.s) THEN 'variation' ELSE 'mistake' END AS kind FROM o""",
)
def sequence_deviation_kinds(spark, sf_dir):
    """Vectors of a label in the order of ids: which stray from the label's centre, and whether later ones take it up."""
    d = sequence.deviations(emb(spark, sf_dir), "label", "vec_id", "embedding", "vec_id")
    return d.select(F.col("id").alias("vec_id"), F.col("key").alias("label"), F.round("sim", 6).alias("sim"), "kind")


#: Two spaces of the same vectors: their first and their second half.
HALVES_SQL = f"""{E_SQL}, h AS (SELECT vec_id AS id, v[1:len(v) // 2] AS a, v[len(v) // 2 + 1:len(v) // 2 * 2] AS b FROM e), n AS (SELECT id, list_transform(a, lambda x: x / greatest(sqrt(list_inner_product(a, a)), 1e-8)) AS a, list_transform(b, lambda x: x / greatest(sqrt(list_inner_product(b, b)), 1e-8)) AS b FROM h),
ca AS (SELECT i, j FROM (SELECT x.id AS i, y.id AS j, row_number() OVER (PARTITION BY x.id ORDER BY round(list_inner_product(x.a, y.a), 9) DESC, y.id) AS r FROM n x JOIN n y ON x.id <> y.id) WHERE r <= 5),
cb AS (SELECT i, j FROM (SELECT x.id AS i, y.id AS j, row_number() OVER (PARTITION BY x.id ORDER BY round(list_inner_product(x.b, y.b), 9) DESC, y.id) AS r FROM n x JOIN n y ON x.id <> y.id) WHERE r <= 5),
ga AS (SELECT p.i, p.j FROM ca p JOIN ca q ON p.i = q.j AND p.j = q.i WHERE p.i < p.j), gb AS (SELECT p.i, p.j FROM cb p JOIN cb q ON p.i = q.j AND p.j = q.i WHERE p.i < p.j),
f AS (SELECT i, j, r AS rank FROM (SELECT x.id AS i, y.id AS j, row_number() OVER (PARTITION BY x.id ORDER BY round(list_inner_product(x.a, y.b), 9) DESC, y.id) AS r FROM n x, n y) WHERE r <= 3)"""


def arm(spark, sf_dir):
    """Candidates of each first half among second halves, and both spaces' mutual neighbours."""
    v = emb(spark, sf_dir).where("embedding IS NOT NULL").select(F.col("vec_id").alias("id"), V.as_double(F.col("embedding")).alias("v"))
    half = F.floor(F.size("v") / 2).cast("int")
    a, b = v.select("id", F.slice("v", F.lit(1), half).alias("z")), v.select("id", F.slice("v", half + 1, half).alias("z"))
    graph = lambda x: neighbours.mutual(neighbours.top_k(x, x, "id", "z", 5))
    return descriptors.arm_score(descriptors.candidates(a, b, 3), graph(a), graph(b))


@query(
    "arm_preservation",
    f"""WITH {HALVES_SQL}, hit AS (SELECT i, max((rank = 1 AND j = i)::INT) AS h1, max((j = i)::INT) AS h3 FROM f GROUP BY i), m AS (SELECT i, j AS t FROM f WHERE rank = 1),
k AS (SELECT count(*) AS edges, count(gb.i) AS kept FROM ga JOIN m x ON x.i = ga.i JOIN m y ON y.i = ga.j LEFT JOIN gb ON gb.i = least(x.t, y.t) AND gb.j = greatest(x.t, y.t))
SELECT count(*) AS n, round(avg(h1), 6) AS top1, round(avg(h3), 6) AS top3, round(max(CASE WHEN edges > 0 THEN kept / edges ELSE 0 END), 6) AS preservation FROM hit, k""",
)
def arm_preservation(spark, sf_dir):
    return arm(spark, sf_dir).select("n", *[F.round(c, 6).alias(c) for c in ("top1", "top3", "preservation")])


@query("arm_interval")
def arm_interval(spark, sf_dir):
    return arm(spark, sf_dir).select("top1", "low", "high")


CELL_SQL = """s AS (SELECT user_id, list(event_type ORDER BY event_id) AS t FROM events GROUP BY user_id),
w AS (SELECT t[i] AS cell, t[greatest(1, i - 3):least(i + 1, len(t))] AS w FROM (SELECT t, unnest(range(1, len(t) + 1)) AS i FROM s)),
cg AS (SELECT cell, n::INTEGER AS n, CASE WHEN n = 1 THEN '' ELSE array_to_string(w[i:i + n - 2], ' ') END AS context, w[i + n - 1] AS next, count(*) AS cnt
  FROM (SELECT cell, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, range(1, 4) r(n) WHERE len(w) >= 2 AND len(w) >= n) GROUP BY ALL),
fg AS (SELECT n::INTEGER AS n, CASE WHEN n = 1 THEN '' ELSE array_to_string(t[i:i + n - 2], ' ') END AS context, t[i + n - 1] AS next, count(*) AS cnt
  FROM (SELECT t, n, unnest(range(1, len(t) - n + 2)) AS i FROM s, range(1, 4) r(n) WHERE len(t) >= n) GROUP BY ALL),
su AS (SELECT cell, count(*) AS support FROM w GROUP BY cell)"""


def cells(spark, sf_dir):
    return ngram.cell_tables(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type", 3)


@query(
    "ngram_cell_windows",
    f"WITH {CELL_SQL} SELECT cell, n, context, next, cnt, support FROM cg JOIN su USING (cell) UNION ALL SELECT '(flat)', n, context, next, cnt, NULL FROM fg",
)
def ngram_cell_windows(spark, sf_dir):
    """Both legs of the tables: each cell's, and the flat one that look-ups fall back to."""
    by_cell, flat, support = cells(spark, sf_dir)
    both = by_cell.join(support, "cell").select("cell", "n", "context", "next", "cnt", "support")
    return both.unionByName(flat.select(F.lit("(flat)").alias("cell"), "n", "context", "next", "cnt", F.lit(None).cast("long").alias("support")))


@query(
    "ngram_cell_next",
    f"""WITH {CELL_SQL}, q AS (SELECT user_id AS id, t[greatest(1, len(t) - 1):len(t)] AS c FROM s), lim AS (SELECT avg(support) AS a FROM su),
l AS (SELECT id, c[-1] AS cell, n, CASE WHEN n = 1 THEN '' ELSE array_to_string(c[len(c) - n + 2:len(c)], ' ') END AS context, support IS NOT NULL AND support >= floor(a) AS ok
  FROM q, lim, range(1, 4) r(n) LEFT JOIN su ON su.cell = c[-1] WHERE n <= len(c) + 1),
f AS (SELECT id, 'cell' AS source, l.n, next, cnt FROM l JOIN cg ON ok AND cg.cell = l.cell AND cg.n = l.n AND cg.context = l.context UNION ALL SELECT id, 'flat', l.n, next, cnt FROM l JOIN fg ON NOT ok AND fg.n = l.n AND fg.context = l.context),
m AS (SELECT * FROM f QUALIFY n = max(n) OVER (PARTITION BY id)), r AS (SELECT *, cnt / sum(cnt) OVER (PARTITION BY id) AS p, row_number() OVER (PARTITION BY id ORDER BY cnt DESC, next)::INTEGER AS rank FROM m)
SELECT id AS user_id, next, round(p, 6) AS p, rank, source FROM r WHERE rank <= 2""",
)
def ngram_cell_next(spark, sf_dir):
    """What comes after each user's last two events; cells of less than the mean support fall back to the flat table."""
    tables = cells(spark, sf_dir)
    w = Window.partitionBy("user_id").orderBy(F.col("event_id").desc())
    last = table(spark, sf_dir, "events").withColumn("r", F.row_number().over(w)).where("r <= 2")
    context = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("r")).alias("r"), "event_type"))), lambda x: x["event_type"])
    least = int(tables[2].agg(F.avg("support")).first()[0] or 0)
    found = ngram.cell_next(last.groupBy(F.col("user_id").alias("id")).agg(context.alias("context")), tables, 3, 2, least)
    return found.select(F.col("id").alias("user_id"), "next", F.round("p", 6).alias("p"), "rank", "source")


#: Folders and pages of a host: every prefix of a path is a node; donors are even pages, recipients odd ones. Nodes under the same folder are paired by place.
PLAN_SQL = r"""pg AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS project, list_filter(regexp_split_to_array(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]+', ''), '[?#].*$', ''), '/'), lambda x: x <> '') AS p FROM pages),
nd AS (SELECT DISTINCT page_id % 2 AS side, project, array_to_string(p[1:k], '/') AS path, p[k] AS name, CASE WHEN k = 1 THEN '' ELSE array_to_string(p[1:k - 1], '/') END AS parent FROM (SELECT *, unnest(range(1, len(p) + 1)) AS k FROM pg)),
tk AS (SELECT *, list_filter(regexp_split_to_array(lower(regexp_replace(name, '([a-z])([A-Z])', '\1 \2', 'g')), '[-_./ ]+'), lambda x: x <> '') AS tokens, row_number() OVER (PARTITION BY side, project, parent ORDER BY path) AS place FROM nd),
pr AS (SELECT a.project, a.path AS donor, b.path AS recipient, a.tokens AS dt, b.tokens AS rt FROM tk a JOIN tk b ON a.side = 0 AND b.side = 1 AND a.project = b.project AND a.parent = b.parent AND a.place = b.place),
fr AS (SELECT t.* FROM tk t WHERE side = 0 AND NOT EXISTS (SELECT 1 FROM pr WHERE pr.project = t.project AND donor = t.path))"""


@query(
    "transplant_plan",
    f"""WITH {PLAN_SQL} SELECT project, CASE WHEN dt = rt THEN 'keep' ELSE 'rewrite' END AS op, recipient AS path, CASE WHEN dt <> rt THEN donor END AS donor, CASE WHEN dt = rt THEN '' ELSE array_to_string(list_filter(dt, lambda x: NOT list_contains(rt, x)), ' ') END AS adaptations FROM pr
UNION ALL SELECT project, 'create', path, NULL, '' FROM fr t WHERE NOT EXISTS (SELECT 1 FROM fr f WHERE f.project = t.project AND starts_with(t.path, f.path || '/'))
UNION ALL SELECT project, 'unaligned', path, NULL, '' FROM tk t WHERE side = 1 AND NOT EXISTS (SELECT 1 FROM pr WHERE pr.project = t.project AND recipient = t.path)""",
)
def transplant_plan(spark, sf_dir):
    path = F.filter(F.split(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]+", ""), "[?#].*$", ""), "/"), lambda x: x != "")
    pages = table(spark, sf_dir, "pages").select((F.col("page_id") % 2).alias("side"), F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("project"), path.alias("p")).where(F.size("p") > 0)
    upto = F.transform(F.sequence(F.lit(1), F.size("p")), lambda k: F.struct(F.array_join(F.slice("p", 1, k), "/").alias("path"), F.element_at("p", k).alias("name"), F.array_join(F.slice("p", 1, k - 1), "/").alias("parent")))
    nodes = pages.select("side", "project", F.explode(upto).alias("n")).select("side", "project", "n.path", "n.name", "n.parent").distinct()
    nodes = nodes.withColumns({"tokens": T.name_tokens(F.col("name")), "place": F.row_number().over(Window.partitionBy("side", "project", "parent").orderBy("path"))})
    nodes = cut(nodes)
    donors, recipients = nodes.where("side = 0"), nodes.where("side = 1")
    at = ["project", "parent", "place"]
    pairs = donors.select(*at, F.col("path").alias("donor")).join(recipients.select(*at, F.col("path").alias("recipient")), at)
    return transplant.plan(donors, recipients, pairs).withColumn("adaptations", F.array_join("adaptations", " "))


def entry_fields(spark, sf_dir):
    """Entries of an ontology: documents with a vector, filed by their label, with their most frequent words as name and hints."""
    e = emb(spark, sf_dir).where("embedding IS NOT NULL").select(F.col("vec_id").alias("id"), F.floor(F.col("label") / 2).cast("long").alias("domain"), (F.col("label") % 2).cast("long").alias("mode"), V.as_double(F.col("embedding")).alias("v"))
    text = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    terms = e.select("id").join(text, "id").select("id", F.explode(T.content_terms(F.col("text"))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("n"))
    top = terms.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.col("n").desc(), "term"))).where("r <= 8")
    words = top.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "term"))), lambda x: x["term"]).alias("w"))
    e = e.join(words, "id", "left").withColumn("w", F.coalesce("w", F.array().cast("array<string>")))
    return e.select("id", "domain", "mode", "v", F.array_join(F.slice("w", 1, 2), " ").alias("name"), F.slice("w", 3, 6).alias("hints"))


@query("chain_placements")
def chain_placements(spark, sf_dir):
    """For each group of texts that no cell of another label covers: its name, and three cells to look at first, by words and vectors."""
    found = cut(discovery.clusters(cut(scored_texts(spark, sf_dir)), discovery.Config().covered, discovery.Config(alike=0.30)))
    s = discovery.shortlist(found.select(F.col("leader").alias("id"), F.col("centroid").alias("v"), "name", "hints"), entry_fields(spark, sf_dir), 3)
    s = s.join(found.select(F.col("leader").alias("id"), "name", "size"), "id")
    return s.select(F.col("id").alias("leader"), "name", "size", F.concat_ws("/", F.col("domain").cast("string"), F.col("mode").cast("string")).alias("cell"), "rank", F.round("score", 6).alias("score"))


@query("placement_shortlist")
def placement_shortlist(spark, sf_dir):
    """Three cells to look at first for every entry that its own label's words and vectors don't decide: all entries, as groups of one."""
    entries = cut(entry_fields(spark, sf_dir))
    s = discovery.shortlist(entries.select("id", "v", "name", "hints"), entries, 3)
    return s.select("id", F.concat_ws("/", F.col("domain").cast("string"), F.col("mode").cast("string")).alias("cell"), "rank", *[F.round(c, 6).alias(c) for c in ("score", "words", "near")])
