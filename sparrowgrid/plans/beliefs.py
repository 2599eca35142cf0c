"""Hypotheses over orders and line items, audit logs over events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparrowgrid.operators import audit, beliefs
from sparrowgrid.plans.base import query
from sparrowgrid.session import table

def r6(x):
    """Six digits, halves up: the same in both engines, which round halves in different ways."""
    return F.floor((F.col(x) if isinstance(x, str) else x) * 1e6 + 0.5001) / 1e6


#: An order is a hypothesis; its line items are evidence (R contradicts) and predictions (those that are F are resolved).
HYP_SQL = """h AS (SELECT o_orderkey AS h_id, (o_orderkey % 10) / 10.0::DOUBLE AS semantic_fit, (o_custkey % 10) / 10.0::DOUBLE AS ontological_fit, 0.5::DOUBLE AS logical_consistency,
  CASE o_orderstatus WHEN 'F' THEN 'certified' WHEN 'P' THEN 'supported' ELSE 'candidate' END AS status, o_orderdate AS made_at FROM orders),
ev AS (SELECT l_orderkey AS h_id, l_linenumber AS ord, l_returnflag <> 'R' AS supports, l_discount * 10 AS confidence, l_suppkey AS source FROM lineitem),
pr AS (SELECT l_orderkey AS h_id, l_linenumber AS idx, CASE WHEN l_linestatus = 'F' THEN l_tax < 0.04 END AS correct, l_shipdate AS made_at FROM lineitem),
e1 AS (SELECT h_id, count(*) AS n, sum(CASE WHEN supports THEN confidence ELSE -confidence END) AS net, sum((NOT supports)::INT) AS con, sum(supports::INT) AS sup FROM ev GROUP BY h_id),
p1 AS (SELECT h_id, count(correct) AS resolved, coalesce(sum(correct::INT), 0) AS hits FROM pr GROUP BY h_id),
f AS (SELECT h.*, CASE WHEN n IS NULL THEN 0.5 ELSE greatest(0, least(1, 0.5 + 0.5 * net / n)) END AS empirical, CASE WHEN coalesce(resolved, 0) = 0 THEN 0.5 ELSE hits / resolved END AS predictive,
  coalesce(sup, 0)::BIGINT AS sup, coalesce(con, 0)::BIGINT AS con, least(0.1 * coalesce(con, 0), 0.4)::DOUBLE AS cp, least(0.15 * (coalesce(resolved, 0) - coalesce(hits, 0)), 0.5)::DOUBLE AS mp
  FROM h LEFT JOIN e1 USING (h_id) LEFT JOIN p1 USING (h_id)),
fit AS (SELECT *, greatest(0, least(1, 0.2 * semantic_fit + 0.15 * ontological_fit + 0.15 * logical_consistency + 0.25 * empirical + 0.25 * predictive - cp - mp)) AS composite FROM f)"""


def hypotheses(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "certified").when(F.col("o_orderstatus") == "P", "supported").otherwise("candidate")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("h_id"), ((F.col("o_orderkey") % 10) / 10.0).alias("semantic_fit"), ((F.col("o_custkey") % 10) / 10.0).alias("ontological_fit"),
        F.lit(0.5).alias("logical_consistency"), status.alias("status"), F.col("o_orderdate").alias("made_at"),
    )


def evidence(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("h_id"), F.col("l_linenumber").alias("ord"), (F.col("l_returnflag") != "R").alias("supports"), (F.col("l_discount") * 10).alias("confidence"), F.col("l_suppkey").alias("source")
    )


def predictions(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("h_id"), F.col("l_linenumber").alias("idx"), F.when(F.col("l_linestatus") == "F", F.col("l_tax") < 0.04).alias("correct"), F.col("l_shipdate").alias("made_at")
    )


def fit(spark, sf_dir):
    return beliefs.fitness(hypotheses(spark, sf_dir), evidence(spark, sf_dir), predictions(spark, sf_dir))


@query("hypothesis_fitness", f"WITH {HYP_SQL} SELECT h_id, floor(empirical * 1e6 + 0.5001) / 1e6 AS empirical, floor(predictive * 1e6 + 0.5001) / 1e6 AS predictive, floor(composite * 1e6 + 0.5001) / 1e6 AS composite, sup, con FROM fit")
def hypothesis_fitness(spark, sf_dir):
    r = lambda c: r6(c).alias(c)
    return fit(spark, sf_dir).select("h_id", r("empirical"), r("predictive"), r("composite"), F.col("sup").cast("long"), F.col("con").cast("long"))


@query(
    "fitness_terms",
    f"""WITH {HYP_SQL}, t AS (SELECT h_id, unnest(['semantic', 'ontological', 'logical', 'empirical', 'predictive', 'contradictions', 'misses']) AS term,
unnest([0.2 * semantic_fit, 0.15 * ontological_fit, 0.15 * logical_consistency, 0.25 * empirical, 0.25 * predictive, -cp, -mp]) AS value FROM fit) SELECT h_id, term, floor(value * 1e6 + 0.5001) / 1e6 AS value FROM t""",
)
def fitness_terms(spark, sf_dir):
    return beliefs.fitness_terms(fit(spark, sf_dir)).withColumn("value", r6("value"))


@query(
    "retract_evidence",
    f"""WITH {HYP_SQL}, r AS (SELECT h_id, sum((source % 10 = 0)::INT) AS retracted, sum((source % 10 <> 0 AND supports)::INT) AS sup, sum((source % 10 <> 0 AND NOT supports)::INT) AS con FROM ev GROUP BY h_id)
SELECT h_id, coalesce(retracted, 0)::BIGINT AS retracted, CASE WHEN coalesce(retracted, 0) = 0 OR status = 'certified' THEN status WHEN r.con > 0 THEN 'contradicted' WHEN r.sup > 0 THEN 'supported' ELSE 'candidate' END AS status
FROM h LEFT JOIN r USING (h_id)""",
)
def retract_evidence(spark, sf_dir):
    return beliefs.retract(hypotheses(spark, sf_dir), evidence(spark, sf_dir), F.col("source") % 10 == 0)


@query("strongest_hypotheses", f"WITH {HYP_SQL} SELECT h_id, floor(composite * 1e6 + 0.5001) / 1e6 AS composite, floor(empirical * 1e6 + 0.5001) / 1e6 AS empirical FROM fit ORDER BY floor(composite * 1e6 + 0.5001) DESC, h_id LIMIT 20")
def strongest_hypotheses(spark, sf_dir):
    f = fit(spark, sf_dir).select("h_id", r6("composite").alias("composite"), r6("empirical").alias("empirical"))
    return f.orderBy(F.col("composite").desc(), "h_id").limit(20)


@query("failed_predictions", f"WITH {HYP_SQL} SELECT h_id, idx, made_at FROM pr WHERE correct = false ORDER BY made_at, h_id, idx LIMIT 50")
def failed_predictions(spark, sf_dir):
    return predictions(spark, sf_dir).where("correct = false").select("h_id", "idx", "made_at").orderBy("made_at", "h_id", "idx").limit(50)


@query("open_predictions", f"WITH {HYP_SQL} SELECT h_id, idx, made_at FROM pr WHERE correct IS NULL AND made_at < TIMESTAMP '1997-01-01'")
def open_predictions(spark, sf_dir):
    return predictions(spark, sf_dir).where("correct IS NULL AND made_at < TIMESTAMP '1997-01-01'").select("h_id", "idx", "made_at")


@query("prediction_outcomes", f"WITH {HYP_SQL} SELECT h_id, count(*) AS made, count(correct) AS resolved, coalesce(sum(correct::INT), 0)::BIGINT AS hits FROM pr GROUP BY h_id")
def prediction_outcomes(spark, sf_dir):
    return predictions(spark, sf_dir).groupBy("h_id").agg(F.count("*").alias("made"), F.count("correct").alias("resolved"), F.count_if("correct").alias("hits"))


@query("hypotheses_current", f"WITH {HYP_SQL} SELECT status, count(*) AS n, sum((status IN ('failed', 'inert', 'superseded'))::INT)::BIGINT AS dead FROM h GROUP BY status")
def hypotheses_current(spark, sf_dir):
    return hypotheses(spark, sf_dir).where("status <> 'superseded'").groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.col("status").isin("failed", "inert", "superseded")).alias("dead"))


@query(
    "route_transitions",
    f"""WITH {HYP_SQL}, d AS (SELECT h_id, status, abs(composite - 0.5) AS delta FROM fit)
SELECT h_id, CASE WHEN status = 'certified' THEN 'protected' WHEN round(delta, 9) > 0.40 THEN 'review' ELSE 'auto-apply' END AS route FROM d WHERE round(delta, 9) > 0.25""",
)
def route_transitions(spark, sf_dir):
    d = fit(spark, sf_dir).select("h_id", "status", F.round(F.abs(F.col("composite") - 0.5), 9).alias("delta")).where("delta > 0.25")
    return d.select("h_id", beliefs.route(F.col("status"), F.col("delta")).alias("route"))


@query(
    "why_believed",
    f"""WITH {HYP_SQL}, s AS (SELECT h_id, string_agg(source::VARCHAR, ',' ORDER BY ord, source) FILTER (supports) AS supporting, string_agg(source::VARCHAR, ',' ORDER BY ord, source) FILTER (NOT supports) AS against, max_by(source, ord * 1000000 + source) AS last_source FROM ev GROUP BY h_id)
SELECT h_id, status, floor(composite * 1e6 + 0.5001) / 1e6 AS composite, coalesce(supporting, '') AS supporting, coalesce(against, '') AS against, last_source FROM fit JOIN s USING (h_id)""",
)
def why_believed(spark, sf_dir):
    listed = lambda keep: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(keep, F.struct("ord", "source")))), lambda x: x["source"].cast("string")), ",")
    s = evidence(spark, sf_dir).groupBy("h_id").agg(listed(F.col("supports")).alias("supporting"), listed(~F.col("supports")).alias("against"), F.max_by("source", F.struct("ord", "source")).alias("last_source"))
    return fit(spark, sf_dir).join(s, "h_id").select("h_id", "status", r6("composite").alias("composite"), "supporting", "against", "last_source")


@query(
    "cited_intakes",
    f"WITH {HYP_SQL}, c AS (SELECT h_id, source, min(ord) AS ord FROM ev GROUP BY h_id, source) SELECT h_id, string_agg(source::VARCHAR, ',' ORDER BY ord, source) AS intakes FROM c GROUP BY h_id",
)
def cited_intakes(spark, sf_dir):
    c = evidence(spark, sf_dir).groupBy("h_id", "source").agg(F.min("ord").alias("ord"))
    return c.groupBy("h_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "source"))), lambda x: x["source"].cast("string")), ",").alias("intakes"))


@query("provenance_last", f"WITH {HYP_SQL} SELECT h_id, count(*) AS links, max_by(source, ord * 1000000 + source) AS last_source, round(max_by(confidence, ord * 1000000 + source + confidence / 100), 6) AS last_confidence FROM ev GROUP BY h_id")
def provenance_last(spark, sf_dir):
    return evidence(spark, sf_dir).groupBy("h_id").agg(F.count("*").alias("links"), F.max_by("source", F.struct("ord", "source")).alias("last_source"), F.round(F.max_by("confidence", F.struct("ord", "source", "confidence")), 6).alias("last_confidence"))


@query(
    "what_contradicts",
    f"WITH {HYP_SQL} SELECT a.h_id, a.ord AS supporting, b.ord AS against FROM ev a JOIN ev b ON a.h_id = b.h_id AND a.source = b.source AND a.supports AND NOT b.supports",
)
def what_contradicts(spark, sf_dir):
    e = evidence(spark, sf_dir)
    a, b = e.where("supports").select("h_id", "source", F.col("ord").alias("supporting")), e.where("NOT supports").select("h_id", "source", F.col("ord").alias("against"))
    return a.join(b, ["h_id", "source"]).select("h_id", "supporting", "against")


@query(
    "contradictions_resolved",
    """SELECT l_returnflag AS relation, l_returnflag = 'R' AS is_epistemic, count(*) AS n, sum((l_discount >= l_tax)::INT)::BIGINT AS won_by_a FROM lineitem GROUP BY ALL""",
)
def contradictions_resolved(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_returnflag").alias("relation"), (F.col("l_returnflag") == "R").alias("is_epistemic")).agg(F.count("*").alias("n"), F.count_if(F.col("l_discount") >= F.col("l_tax")).alias("won_by_a"))


#: An event is an audit record: the user is its subject, arrival is its number; value shifts its assertion time, type its state and validity.
AUD_SQL = """ev AS (SELECT event_id AS seq, user_id AS subject, ts AS arrival, CASE WHEN event_id % 3 = 0 THEN ts - to_minutes((event_id % 500)::INT) END AS asserted_at,
  CASE event_type WHEN 'signup' THEN 'candidate' WHEN 'view' THEN NULL WHEN 'click' THEN 'supported' WHEN 'error' THEN 'contradicted' WHEN 'purchase' THEN 'confirmed' END AS posterior,
  CASE WHEN event_id % 5 <> 0 THEN ts - INTERVAL 1 DAY END AS valid_from, CASE WHEN event_id % 4 = 0 THEN ts + INTERVAL 1 DAY END AS valid_until, event_id % 7 = 0 AS valid_unknown, event_type FROM events),
au AS (SELECT *, coalesce(asserted_at, arrival) AS att FROM ev), mid AS (SELECT min(ts) + (max(ts) - min(ts)) / 2 AS t FROM events)"""


def log(spark, sf_dir):
    kind = F.col("event_type")
    post = F.when(kind == "signup", "candidate").when(kind == "click", "supported").when(kind == "error", "contradicted").when(kind == "purchase", "confirmed")
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        i.alias("seq"), F.col("user_id").alias("subject"), F.col("ts").alias("arrival"), F.when(i % 3 == 0, F.expr("ts - make_interval(0, 0, 0, 0, 0, event_id % 500, 0)")).alias("asserted_at"),
        post.alias("posterior"), F.when(i % 5 != 0, F.expr("ts - INTERVAL 1 DAY")).alias("valid_from"), F.when(i % 4 == 0, F.expr("ts + INTERVAL 1 DAY")).alias("valid_until"),
        (i % 7 == 0).alias("valid_unknown"), "event_type",
    )


def middle(spark, sf_dir):
    """The middle of the log's time, a value that queries ask about."""
    t = table(spark, sf_dir, "events").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return F.lit(t.select(F.timestamp_micros(((F.unix_micros(F.col("a").cast("timestamp")) + F.unix_micros(F.col("b").cast("timestamp"))) / 2).cast("long")).alias("t")).first()["t"])


REPLAY_SQL = f"{AUD_SQL}, rp AS (SELECT subject, max_by(posterior, att::VARCHAR || lpad(seq::VARCHAR, 12, '0')) AS status FROM au, mid WHERE att <= t AND posterior IS NOT NULL GROUP BY subject)"


@query("audit_replay_at", f"WITH {REPLAY_SQL} SELECT * FROM rp")
def audit_replay_at(spark, sf_dir):
    return audit.replay(log(spark, sf_dir), middle(spark, sf_dir))


@query("replay_arrival_invariant", f"WITH {REPLAY_SQL} SELECT status, count(*) AS subjects FROM rp GROUP BY status")
def replay_arrival_invariant(spark, sf_dir):
    shuffled = log(spark, sf_dir).repartition(7, F.xxhash64("seq"))
    return audit.replay(shuffled, middle(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("subjects"))


BITEMP_SQL = f"""{AUD_SQL}, k AS (SELECT *, NOT valid_unknown AND (valid_from IS NULL OR valid_from <= t) AND (valid_until IS NULL OR t < valid_until) AS ok FROM au, mid WHERE att <= t),
bt AS (SELECT subject, max_by(posterior, att::VARCHAR || lpad(seq::VARCHAR, 12, '0')) FILTER (ok AND posterior IS NOT NULL) AS status, sum(ok::INT)::BIGINT AS n_support,
sum(valid_unknown::INT)::BIGINT AS n_unknown, sum((NOT valid_unknown AND NOT ok)::INT)::BIGINT AS n_excluded FROM k GROUP BY subject)"""


@query("audit_state_bitemporal", f"WITH {BITEMP_SQL} SELECT * FROM bt")
def audit_state_bitemporal(spark, sf_dir):
    t = middle(spark, sf_dir)
    return audit.bitemporal(log(spark, sf_dir), t, t)


@query(
    "audit_point_in_time",
    f"WITH {REPLAY_SQL}, w AS (SELECT subject, min(valid_from) AS f, max(valid_until) AS u FROM au GROUP BY subject) SELECT subject, CASE WHEN (f IS NULL OR f <= t) AND (u IS NULL OR t < u) THEN status END AS status FROM rp JOIN w USING (subject), mid",
)
def audit_point_in_time(spark, sf_dir):
    t, e = middle(spark, sf_dir), log(spark, sf_dir)
    w = e.groupBy("subject").agg(F.min("valid_from").alias("valid_from"), F.max("valid_until").alias("valid_until"), F.lit(False).alias("valid_unknown"))
    return audit.replay(e, t).join(w, "subject").select("subject", F.when(audit.valid_at(t), F.col("status")).alias("status"))


@query(
    "project_revisions",
    f"""WITH {AUD_SQL}, tr AS (SELECT subject, max(att) AS last FROM au WHERE event_type = 'purchase' GROUP BY subject),
rv AS (SELECT seq, subject, att, lag(posterior) OVER (PARTITION BY subject ORDER BY att, seq) AS previous, posterior AS new FROM au WHERE posterior IS NOT NULL)
SELECT rv.subject, seq, previous, new FROM rv LEFT JOIN tr USING (subject) WHERE previous <> new AND (last IS NULL OR att > last)""",
)
def project_revisions(spark, sf_dir):
    e = audit.asserted(log(spark, sf_dir))
    w = Window.partitionBy("subject").orderBy("at", "seq")
    r = e.where("posterior IS NOT NULL").select("seq", "subject", "at", F.lag("posterior").over(w).alias("previous"), F.col("posterior").alias("new"))
    return audit.project_revisions(r, e.where("event_type = 'purchase'")).select("subject", "seq", "previous", "new")


LATE_SQL = """e AS (SELECT event_id AS seq, user_id AS stream, ts - to_minutes((event_id % 97 * 31)::INT) AS episode FROM events),
i AS (SELECT *, max(seq) OVER w AS arrival_mark, max(episode) OVER w AS episode_mark, coalesce(episode < max(episode) OVER b, false) AS late FROM e
WINDOW w AS (PARTITION BY stream ORDER BY seq ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY stream ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def episodes(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("stream"), F.expr("ts - make_interval(0, 0, 0, 0, 0, event_id % 97 * 31, 0)").alias("episode"))


@query("intake_watermarks", f"WITH {LATE_SQL} SELECT stream, max(arrival_mark) AS arrival_mark, max(episode_mark) AS episode_mark FROM i GROUP BY stream")
def intake_watermarks(spark, sf_dir):
    return audit.intake(episodes(spark, sf_dir)).groupBy("stream").agg(F.max("arrival_mark").alias("arrival_mark"), F.max("episode_mark").alias("episode_mark"))


@query("late_episodes", f"WITH {LATE_SQL} SELECT seq, stream, late FROM i")
def late_episodes(spark, sf_dir):
    return audit.intake(episodes(spark, sf_dir)).select("seq", "stream", "late")


@query(
    "dream_proposals",
    f"""WITH {AUD_SQL}, s AS (SELECT subject, max(att) FILTER (posterior IN ('failed', 'superseded', 'inert')) AS retired, max(att) FILTER (posterior IN ('supported', 'confirmed')) AS seen FROM au GROUP BY subject), m AS (SELECT max(att) AS z FROM au)
SELECT subject, 'reactivate' AS proposal FROM s, m WHERE seen > retired AND seen >= z - INTERVAL 30 DAY
UNION ALL SELECT subject, 'retire' FROM au JOIN s USING (subject) WHERE posterior = 'contradicted' AND (seen IS NULL OR att > seen) GROUP BY subject HAVING count(*) >= 2""",
)
def dream_proposals(spark, sf_dir):
    return audit.proposals(log(spark, sf_dir), "30 DAYS")


@query(
    "validity_overlap",
    f"WITH {AUD_SQL}, p AS (SELECT *, lag(valid_from) OVER w AS pf, lag(valid_until) OVER w AS pu, lag(seq) OVER w AS ps FROM au WINDOW w AS (PARTITION BY subject ORDER BY seq)) SELECT seq, ps AS before FROM p WHERE ps IS NOT NULL AND (valid_from IS NULL OR pu IS NULL OR valid_from < pu) AND (pf IS NULL OR valid_until IS NULL OR pf < valid_until)",
)
def validity_overlap(spark, sf_dir):
    w = Window.partitionBy("subject").orderBy("seq")
    p = log(spark, sf_dir).withColumns({"pf": F.lag("valid_from").over(w), "pu": F.lag("valid_until").over(w), "ps": F.lag("seq").over(w)}).where("ps IS NOT NULL")
    return p.where(audit.overlaps(F.col("valid_from"), F.col("valid_until"), F.col("pf"), F.col("pu"))).select("seq", F.col("ps").alias("before"))


@query(
    "validity_narrowing",
    f"WITH {AUD_SQL}, f AS (SELECT subject, min(valid_from) AS f FROM au GROUP BY subject) SELECT subject, min(valid_until) AS valid_until, count(*) AS accepted FROM au JOIN f USING (subject) WHERE valid_until >= f GROUP BY subject",
)
def validity_narrowing(spark, sf_dir):
    e = log(spark, sf_dir)
    f = e.groupBy("subject").agg(F.min("valid_from").alias("f"))
    return e.join(f, "subject").where("valid_until >= f").groupBy("subject").agg(F.min("valid_until").alias("valid_until"), F.count("*").alias("accepted"))


@query("audit_dump", f"WITH {AUD_SQL} SELECT seq, subject || ' ' || event_type || ' ' || coalesce(posterior, '-') AS line FROM au")
def audit_dump(spark, sf_dir):
    return log(spark, sf_dir).orderBy("seq").select("seq", F.concat_ws(" ", F.col("subject").cast("string"), "event_type", F.coalesce("posterior", F.lit("-"))).alias("line"))


@query(
    "replay_vs_derived",
    f"""WITH {REPLAY_SQL}, d AS (SELECT subject, CASE WHEN sum((posterior = 'contradicted')::INT) > 0 THEN 'contradicted' WHEN sum((posterior IN ('supported', 'confirmed'))::INT) > 0 THEN 'supported' ELSE 'candidate' END AS derived FROM au GROUP BY subject)
SELECT subject, status, derived, status IS NOT DISTINCT FROM derived AS agree FROM d LEFT JOIN rp USING (subject)""",
)
def replay_vs_derived(spark, sf_dir):
    e = log(spark, sf_dir)
    d = e.groupBy("subject").agg(F.count_if(F.col("posterior") == "contradicted").alias("con"), F.count_if(F.col("posterior").isin("supported", "confirmed")).alias("sup"))
    d = d.select("subject", beliefs.derived_status(F.lit("candidate"), F.col("sup"), F.col("con")).alias("derived"))
    return d.join(audit.replay(e, middle(spark, sf_dir)), "subject", "left").select("subject", "status", "derived", F.col("status").eqNullSafe(F.col("derived")).alias("agree"))
