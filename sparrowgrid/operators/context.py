"""Budgeted contexts: greedy picks that carry the room left and the repeat families used, against an unbounded baseline.

Picks depend on the picks before them, so they are rounds: a round takes one document of every query at once, and a query's
state is one row (room, families, picks). Before the rounds, candidates are cut to those that could ever be picked, which is a
bounded number for each query whatever the table: of documents with the same number of tokens, only the ``top_k`` best of
different families can be, as each of them fits wherever the rest fit and comes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparrowgrid.functions import text as T
from sparrowgrid.operators import neighbours, scoring
from sparrowgrid.operators.graph import cut, free

#: What is put between the texts of a context (fixed value), and the tokens that it counts.
SEPARATOR, SEPARATOR_TOKENS = "\n\n---\n\n", 3


def family(component: str = "component", doc: str = "doc") -> Column:
    """A document's family: its component, or itself where it is in none."""
    return F.coalesce(F.concat(F.lit("f"), F.col(component).cast("string")), F.concat(F.lit("d"), F.col(doc).cast("string")))


def able(scored: DataFrame, budget: int, top_k: int) -> DataFrame:
    """Rows of ``query, doc, score, tokens, family`` that greedy picks could take, and one more for each number of tokens.

    One more row, and rows over the budget kept by the same rule, tell whether anything was left out: a query has more rows here
    than picks just where it had more scored documents than picks. A limit by rank runs before the shuffle as after it.
    """
    size = F.least(F.col("tokens"), F.lit(budget + 1)).alias("size")
    rows = scored.select("*", size)
    best_first = [F.col("score").desc(), F.col("doc")]
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy("query", "size", "family").orderBy(*best_first))).where(F.col("_r") <= 2).drop("_r")
    # The second of a family is only there to be counted.
    one = Window.partitionBy("query", "size").orderBy(*best_first)
    return rows.withColumn("_r", F.row_number().over(one)).where(F.col("_r") <= 2 * top_k + 1).drop("_r", "size")


def greedy(scored: DataFrame, budget: int, top_k: int, counts: DataFrame | None = None) -> DataFrame:
    """``query, room, picks, families, truncated``: again and again the best document that fits the room left, of a family not used.

    ``scored`` has ``query, doc, score, tokens, family``; equal scores go to the lower id. ``picks`` are structs ``doc, score,
    tokens`` in the order of picking. ``truncated``: a scored document was left out. ``counts`` (``query, n``) says how many have a
    score, where ``scored`` has only those that could be picked.
    """
    rows = cut(able(scored, budget, top_k))
    free(scored.sparkSession)
    none = F.array().cast("array<struct<doc:bigint,score:double,tokens:bigint>>")
    counts = rows.groupBy("query").agg(F.count("*").alias("n")) if counts is None else counts
    state = counts.select("query", "n", F.lit(budget).cast("long").alias("room"), none.alias("picks"), F.array().cast("array<string>").alias("families"))
    able_rows = rows.where(F.col("tokens") <= budget)
    for k in range(top_k):
        fit = able_rows.join(state.select("query", "room", "families"), "query").where((F.col("tokens") <= F.col("room")) & ~F.array_contains("families", F.col("family")))
        won = fit.groupBy("query").agg(F.max(F.struct("score", (-F.col("doc")).alias("minus"), "tokens", "family")).alias("w"))
        pick = F.struct((-F.col("w.minus")).alias("doc"), F.col("w.score").alias("score"), F.col("w.tokens").alias("tokens"))
        more = F.col("w").isNotNull()
        before, state = state, cut(
            state.join(won, "query", "left").select(
                "query", "n", F.when(more, F.col("room") - F.col("w.tokens")).otherwise(F.col("room")).alias("room"),
                F.when(more, F.array_append("picks", pick)).otherwise(F.col("picks")).alias("picks"),
                F.when(more, F.array_append("families", F.col("w.family"))).otherwise(F.col("families")).alias("families"),
            )
        )
        if state.where(F.size("picks") == k + 1).isEmpty():
            break
    return state.select("query", "room", "picks", "families", (F.size("picks") < F.col("n")).alias("truncated"))


def assembled(tokens: Column, parts: Column) -> Column:
    """Tokens of texts joined by the separator."""
    return tokens + SEPARATOR_TOKENS * F.greatest(parts - 1, F.lit(0))


def compiled(scores: DataFrame | scoring.Index, docs: DataFrame, families: DataFrame, budget: int, top_k: int, baseline_k: int = 12) -> DataFrame:
    """A context for each query without repeats, beside the ``baseline_k`` best documents that a retrieval without budget takes.

    ``scores`` has ``query, doc, score`` (a query without scored documents has no row), ``docs`` ``doc, tokens, text``, ``families``
    ``node, component``. Gives ``query, baseline_tokens, compiled_tokens, saving, picks`` (ids as picked), ``removed`` (baseline
    documents, best first, that are left out because a text of their family is in), ``truncated`` and ``context``.
    Of an index, scores are made in tasks that keep only what can be among either.
    """
    known = families.select(F.col("node").alias("doc"), "component")
    part = scoring.packable(scores, max(budget, 64), top_k, families) if isinstance(scores, scoring.Index) else None
    if part is None:
        if isinstance(scores, scoring.Index):
            scores = scoring.pairs(scores)
        sized, counts = scores.join(docs.select("doc", "tokens"), "doc").join(known, "doc", "left"), None
    else:
        sized, counts = part
    scored = sized.select("query", "doc", "score", F.col("tokens").cast("long").alias("tokens"), family().alias("family"))
    if part is None:
        best = Window.partitionBy("query").orderBy(F.col("score").desc(), "doc")
        base = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= baseline_k)
    else:
        base = scoring.top(scores, baseline_k, 6).join(known, "doc", "left").withColumn("family", family())
    base = cut(base)
    free(docs.sparkSession)
    chosen = greedy(scored, max(budget, 64), top_k, counts)
    left = base.join(chosen.select("query", "families", F.transform("picks", lambda p: p["doc"]).alias("ids")), "query")
    left = left.where(F.array_contains("families", F.col("family")) & ~F.array_contains("ids", F.col("doc")))
    removed = left.groupBy("query").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "doc"))), lambda x: x["doc"]).alias("removed"))
    sizes = base.groupBy("query").agg(assembled(F.sum("tokens"), F.count("*")).alias("baseline_tokens"))
    picked = chosen.select("query", F.posexplode("picks").alias("at", "p")).select("query", "at", F.col("p.doc").alias("doc"), F.col("p.tokens").alias("tokens"))
    texts = picked.join(docs.select("doc", "text"), "doc").groupBy("query").agg(
        assembled(F.sum("tokens"), F.count("*")).alias("tokens"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), SEPARATOR).alias("context"),
    )
    out = sizes.join(chosen, "query").join(texts, "query", "left").join(removed, "query", "left")
    tokens = F.coalesce("tokens", F.lit(0).cast("long"))
    saving = F.greatest(F.lit(0.0), 1 - tokens / F.col("baseline_tokens"))
    return out.select(
        "query", "baseline_tokens", tokens.alias("compiled_tokens"), F.round(saving, 6).alias("saving"), F.transform("picks", lambda p: p["doc"]).alias("picks"),
        F.coalesce("removed", F.array().cast("array<bigint>")).alias("removed"), "truncated", F.coalesce("context", F.lit("")).alias("context"),
    )


def node_search(nodes: DataFrame, queries: DataFrame, budget: int = 600, most: int = 12) -> DataFrame:
    """``query, pick, node, score, tokens, truncated``: labelled nodes (``id, v, label``) nearest to each query (``id, v``) whose labels fit a budget of tokens.

    Nodes without a label take no part. Again and again the nearest node that fits is picked. Room only shrinks, so this is one walk
    through the nodes from the nearest on: a round takes the ``2 * most + 1`` nearest of those that fit the room each query has left (what was
    passed by doesn't fit any more), and queries go on to the next round until they have all picks or nothing fits.
    """
    sized = cut(nodes.where((F.trim("label") != "") & F.col("id").isNotNull() & F.col("v").isNotNull()).select("id", "v", T.token_estimate(F.col("label")).alias("tokens")))
    free(nodes.sparkSession)
    total, least = sized.agg(F.count("*"), F.min("tokens")).first()
    mine = sized.select("id", F.lit(1).alias("own"))
    start = queries.where("id IS NOT NULL AND v IS NOT NULL").select("id", "v").join(mine, "id", "left")
    none = F.array().cast("array<struct<doc:bigint,score:double,tokens:bigint>>")
    # Others that a query can take: all nodes but itself.
    state = cut(start.select("id", "v", (F.lit(total) - F.coalesce("own", F.lit(0))).alias("n"), F.lit(budget).cast("long").alias("room"), none.alias("picks")))
    while True:
        # All are taken where fewer are than could be picked.
        open_ = state.where((F.size("picks") < most) & (F.size("picks") < F.col("n")) & (F.col("room") >= F.lit(least)) & F.col("room").isNotNull())
        if total == 0 or open_.isEmpty():
            break
        near = neighbours.top_k(open_.select("id", "v", F.col("room").alias("tokens")), sized, "id", "v", 2 * most + 1, under="tokens")
        found = near.join(sized.select(F.col("id").alias("j"), "tokens"), "j").groupBy(F.col("i").alias("id")).agg(F.sort_array(F.collect_list(F.struct("rank", "j", "s", "tokens"))).alias("found"))

        def walk(so_far: Column, x: Column) -> Column:
            fresh = ~F.exists(so_far["picks"], lambda p: p["doc"] == x["j"])
            take = fresh & (x["tokens"] <= so_far["room"]) & (F.size(so_far["picks"]) < most)
            pick = F.struct(x["j"].alias("doc"), x["s"].alias("score"), x["tokens"].alias("tokens"))
            return F.struct(F.when(take, so_far["room"] - x["tokens"]).otherwise(so_far["room"]).alias("room"), F.when(take, F.array_append(so_far["picks"], pick)).otherwise(so_far["picks"]).alias("picks"))

        # A list that isn't full was all that fits: its query is done, without room.
        went = F.aggregate("found", F.struct("room", "picks"), walk)
        full = F.size("found") == 2 * most + 1
        moved = open_.join(found, "id", "left").select("id", "v", "n", F.when(full, went["room"]).alias("room"), F.coalesce(went["picks"], F.col("picks")).alias("picks"))
        state = cut(state.join(open_.select("id"), "id", "left_anti").unionByName(moved))
        free(nodes.sparkSession)
    found = state.select(F.col("id").alias("query"), (F.size("picks") < F.col("n")).alias("truncated"), F.posexplode("picks").alias("at", "p"))
    return found.select("query", (F.col("at") + 1).alias("pick"), F.col("p.doc").alias("node"), F.col("p.score").alias("score"), F.col("p.tokens").alias("tokens"), "truncated")
