"""Queries without a SQL form: order-dependent, randomised or hashed algorithms. Tests hold them against brute force or invariants."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparrowgrid.functions import text as T
from sparrowgrid.operators import controls, discovery, embed, extract, greedy, neighbours, sequence
from sparrowgrid.plans.base import query
from sparrowgrid.session import table


@query("permutation_null")
def permutation_null(spark, sf_dir):
    return controls.permutation_null(table(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding")


@query("discover_gaps")
def discover_gaps(spark, sf_dir):
    """Leader clusters among vectors that no other covers."""
    e = table(spark, sf_dir, "embeddings")
    open_ = neighbours.top_k(e, e, "vec_id", "embedding", 1).where("s < 0.55").select(F.col("i").alias("id"))
    rows = e.select(F.col("vec_id").alias("id"), "embedding").join(open_, "id")
    led = discovery.vector_leaders(rows, "id", "embedding", 0.30)
    sizes = led.groupBy("leader").agg(F.count("*").alias("size"))
    return sizes.where("size >= 2")


@query("trajectory_vector")
def trajectory_vector(spark, sf_dir):
    return sequence.two_means(table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL"), "label", "vec_id", "embedding")


@query("random_projection_embed")
def random_projection_embed(spark, sf_dir):
    return embed.random_projection(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("word_vectors")
def word_vectors(spark, sf_dir):
    return embed.word_table(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("sentence_vectors")
def sentence_vectors(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 10_000 + F.col("turn")).alias("turn_id"), "text")
    words = embed.word_table(t, "turn_id", "text")
    return embed.sentences(t, words, "turn_id", "text")


@query("synthetic_embed")
def synthetic_embed(spark, sf_dir):
    return embed.synthetic(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("claim_identity")
def claim_identity(spark, sf_dir):
    """Claims are documents with a vector; those of one label and opposite polarity are what really contradicts."""
    e = table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v"))
    s = extract.signatures(table(spark, sf_dir, "documents"), "doc_id", "text")
    claims = e.join(s, "id")
    return extract.identity_sweep(claims, "label")


@query("claim_signature")
def claim_signature(spark, sf_dir):
    return extract.signatures(table(spark, sf_dir, "documents"), "doc_id", "text")


def _in(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_PLAIN = f"coalesce(NOT list_contains({_in(extract.DETERMINERS)}, {{0}}) AND NOT list_contains({_in(extract.COMMON)}, {{0}}) AND strlen({{0}}) >= 3 AND NOT (strlen({{0}}) >= 4 AND ({{0}} LIKE '%ing' OR {{0}} LIKE '%ed')), false)"
_NO_VERB = "NOT ({0} LIKE '%s' AND {0} NOT LIKE '%ss')"
PHRASE_SQL = rf"""WITH w AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\s+'), lambda x: regexp_replace(x, '^[^\p{{L}}\p{{N}}-]+|[^\p{{L}}\p{{N}}-]+$', '', 'g')), lambda x: x <> '') AS t FROM documents),
d AS (SELECT doc_id, t, unnest(list_filter(range(1, len(t) + 1), lambda i: list_contains({_in(extract.DETERMINERS)}, lower(t[i])) AND (i = 1 OR t[i] = lower(t[i])))) AS i FROM w),
p AS (SELECT doc_id, i, lower(t[i + 1]) AS a, lower(t[i + 2]) AS b, lower(t[i + 3]) AS c FROM d),
n AS (SELECT *, CASE WHEN NOT {_PLAIN.format("a")} THEN 0 WHEN NOT ({_PLAIN.format("b")} AND {_NO_VERB.format("b")}) THEN 1 WHEN NOT ({_PLAIN.format("c")} AND {_NO_VERB.format("c")}) THEN 2 ELSE 3 END AS n FROM p)
SELECT doc_id AS id, (i - 1)::INTEGER AS ord, CASE n WHEN 1 THEN a WHEN 2 THEN a || '-' || b ELSE a || '-' || b || '-' || c END AS phrase, CASE n WHEN 1 THEN a WHEN 2 THEN b ELSE c END AS head FROM n WHERE n > 0"""


@query("noun_phrases", PHRASE_SQL)
def noun_phrases(spark, sf_dir):
    return extract.phrases(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("shape_assign")
def shape_assign(spark, sf_dir):
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]+", ""), "[?#].*$", "")
    host = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)
    p = table(spark, sf_dir, "pages").select("page_id", host.alias("host"), F.filter(F.split(path, "/"), lambda x: x != "").alias("path"))
    name = T.name_tokens(F.coalesce(F.try_element_at("path", F.lit(-1)), F.lit("")))
    parent = F.array_join(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0))), "/")
    # Pages meet where host and kind are the same: others can't reach the floor by path and name alone.
    return greedy.assign_nodes(p.select(F.col("host").alias("group"), T.shape_kind(F.array_join("path", "/")).alias("kind"), (F.col("page_id") % 2).alias("side"), F.col("page_id").alias("id"), "path", name.alias("name"), parent.alias("parent")))
