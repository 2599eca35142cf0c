"""Scores that are made and reduced inside tasks are those of all pairs."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparrowgrid import registry
from sparrowgrid.operators import context, retrieval, scoring

DATA = Path("/root/testdata/sf0.001")
with_tables = pytest.mark.skipif(not DATA.is_dir(), reason="no test tables here")


def frames(spark, n=700, asked=6):
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(40)]
    text = lambda most: " ".join(rng.choice(words, rng.integers(1, most), p=np.arange(40, 0, -1) / 820))
    docs = [(3 * i - 900, text(25)) for i in range(n)] + [(5000, None), (5001, ""), (5002, "w0 " * 90)]
    queries = [(q, text(9)) for q in range(asked)] + [(99, "nowhere")]
    return spark.createDataFrame(docs, "id long, text string").repartition(5), spark.createDataFrame(queries, "query long, text string")


def plain(docs, queries):
    """Both measures of every pair by the joins."""
    bm = retrieval.bm25(docs, queries, "id", "text", "query", "text").withColumn("score", F.round("score", 9))
    words = F.explode(F.split("text", " ")).alias("term")
    p = docs.where("text <> ''").select(F.col("id").alias("doc"), F.explode(F.split(F.trim("text"), " ")).alias("term"))
    dl = p.groupBy("doc").agg(F.count("*").alias("dl"))
    ov = p.distinct().join(queries.select("query", words).distinct(), "term").groupBy("query", "doc").agg(F.count("*").alias("n")).join(dl, "doc")
    return bm, ov.select("query", "doc", F.round(F.col("n") / F.sqrt("dl"), 9).alias("score"))


@pytest.mark.parametrize("k", [1, 10])
def test_fused_ranks_are_those_of_all_pairs(spark, monkeypatch, k):
    monkeypatch.setattr(scoring, "CELLS", 500)
    docs, queries = frames(spark)
    bm, ov = (retrieval.ranked(s, "query", F.col("score"), "doc") for s in plain(docs, queries))
    whole = retrieval.fuse([bm, ov]).where(F.col("rank") <= k)
    place = lambda f, n: f.select("query", "doc", F.col("rank").alias(n))
    want = whole.join(place(bm, "first"), ["query", "doc"]).join(place(ov, "second"), ["query", "doc"])
    got = scoring.fused(scoring.index(docs, queries, "id", "text", "query", "text"), k)
    best = got.where((F.col("first") == 1) | (F.col("second") == 1)).select("query", "doc", "first", "second")
    cols = ["query", "doc", "first", "second", "score", "rank"]
    rows = lambda f, *c: sorted(map(tuple, f.select(*c).collect()))
    assert rows(got.where(F.col("rank") <= k), *cols) == rows(want, *cols) and want.count() == 6 * k
    both = place(bm, "first").join(place(ov, "second"), ["query", "doc"])
    assert rows(best, "query", "doc", "first", "second") == rows(both.where("first = 1 OR second = 1"), "query", "doc", "first", "second")
    assert got.count() <= 6 * 2 * (60 + 2 * k)


def test_packable_documents_give_the_picks_of_all(spark, monkeypatch):
    monkeypatch.setattr(scoring, "CELLS", 2000)
    docs, queries = frames(spark)
    families = docs.where("id % 2 = 0").select(F.col("id").alias("node"), F.pmod("id", F.lit(38)).alias("component"))
    at = scoring.index(docs, queries, "id", "text", "query", "text")
    texts = at.rows.select("doc", "tokens").join(docs.select(F.col("id").alias("doc"), "text"), "doc")
    scores = plain(docs, queries)[0].withColumn("score", F.round("score", 6))
    for budget, k in ((70, 4), (70, 12), (200, 3)):
        found, counts = scoring.packable(at, budget, k, families)
        assert found.count() < scores.count() / 4
        assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, scores.groupBy("query").count().collect()))
        got, want = (context.compiled(s, texts, families, budget, k) for s in (at, scores))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    top = retrieval.ranked(plain(docs, queries)[0], "query", F.col("score"), "doc").where("rank <= 12").select("query", "doc", "score", "rank")
    assert sorted(map(tuple, scoring.top(at, 12).select(*top.columns).collect())) == sorted(map(tuple, top.collect()))


def test_no_index_without_unique_ids_or_of_too_many_terms(spark, monkeypatch):
    docs, queries = frames(spark, 5)
    assert scoring.index(docs.union(docs), queries, "id", "text", "query", "text") is None
    monkeypatch.setattr(scoring, "FEW", 3)
    assert scoring.index(docs, queries, "id", "text", "query", "text") is None


@with_tables
@pytest.mark.parametrize("name", ["hybrid_verdict", "rrf_fusion", "compiled_context"])
def test_queries_make_no_row_for_each_pair(spark, monkeypatch, name):
    """every scored document of an item was a row, and was ranked in one window."""
    for f in ("bm25", "fuse"):
        monkeypatch.setattr(retrieval, f, None)
    assert registry.queries()[name](spark, str(DATA)).count() > 0
