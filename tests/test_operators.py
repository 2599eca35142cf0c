"""Behaviours without SQL: packs, tables with manifests, logs, streaming intake, greedy and randomised operators."""

import json
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparrowgrid.operators import audit, embed, extract, graph, greedy, ngram, process, retrieval, sequence, triples
from sparrowgrid.sources import packs, tables
from sparrowgrid.streaming import intake


def test_packs(spark, tmp_path):
    entry = lambda n, **k: {"name": n, "category": "c", "domain": "D", "mode": "M", "hints": ["h"]} | k
    (tmp_path / "a.json").write_text(json.dumps({"kind": "human", "domains": [entry("x", facets={"lifecycle": "fabricate"}), entry("y")]}))
    (tmp_path / "b.json").write_text(json.dumps({"kind": "extra", "domains": [entry("x", domain="E")]}))
    e = packs.load(spark, str(tmp_path))
    assert sorted(r.key for r in e.collect()) == ["extra:x", "x", "y"]
    assert [r.name for r in packs.by_facets(e, lifecycle="BUILD").collect()] == ["x"]
    assert [r.kind for r in packs.by_facets(e, domain="e").collect()] == ["extra"]
    over = packs.merge(e, e.where("key = 'y'").withColumn("domain", F.lit("Z")))
    assert {r.key: r.domain for r in over.collect()}["y"] == "Z" and over.count() == 3
    assert json.loads(packs.export(e.select("name", "hints", "domain", "mode"), "new").first().json)["kind"] == "new"


def test_tables_refuse_damage(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    tables.save(df, str(tmp_path), "t", tokenizer="ws")
    assert tables.load(spark, str(tmp_path), "t", tokenizer="ws").count() == 2
    with pytest.raises(ValueError, match="tokenizer"):
        tables.load(spark, str(tmp_path), "t", tokenizer="bpe")
    df.limit(1).write.mode("overwrite").parquet(str(tmp_path / "t" / "data"))
    with pytest.raises(ValueError, match="checksum"):
        tables.load(spark, str(tmp_path), "t")


def test_log_skips_torn_lines(spark, tmp_path):
    (tmp_path / "log.json").write_text('{"seq": 1, "source": "a"}\n{"seq": 2, "sou\n{"seq": 3, "source": "b"}\n')
    log = tables.observations(spark, str(tmp_path / "log.json"))
    assert [r.seq for r in tables.tail(log, 1).collect()] == [3] and log.count() == 2
    new = process.numbered(spark.createDataFrame([(f"s{i}",) for i in range(50)], "source string"), 3, ["source"])
    assert sorted(r.seq for r in new.collect()) == list(range(4, 54))


def test_streaming_intake_equals_batch(spark, tmp_path):
    rows = [(s, i, None if i % 7 == 0 else f"2024-01-0{1 + (i * 5 + s) % 9} 00:00:00") for i in range(1, 30) for s in (1, 2)]
    df = spark.createDataFrame(rows, "stream long, seq long, e string").withColumn("episode", F.to_timestamp("e")).drop("e")
    src = tmp_path / "in"
    for k in range(3):
        df.where((F.col("seq") > k * 10) & (F.col("seq") <= k * 10 + 10)).coalesce(1).write.mode("append").parquet(str(src))
    stream = intake.marks(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(src)))
    q = stream.writeStream.format("memory").queryName("marks").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.stream, r.seq, r.late) for r in spark.sql("SELECT * FROM marks").collect())
    want = sorted((r.stream, r.seq, r.late) for r in audit.intake(df).collect())
    assert got == want and any(x[2] for x in got)
    shutil.rmtree(src)


def test_components_and_walk(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (6, 5), (7, 7)], "u long, v long")
    assert {(r.node, r.component) for r in graph.components(links).collect()} == {(1, 1), (2, 1), (3, 1), (5, 5), (6, 5)}
    cycle = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "source string, target string")
    w = graph.walk(spark.createDataFrame([("a",)], "node string"), cycle)
    assert sorted((r.node, r.hop) for r in w.collect()) == [("a", 0), ("b", 1), ("c", 2)]


def test_trajectories(spark):
    rows = [("becoming", i, "a" if i < 6 else "b") for i in range(12)] + [("split", i, "ab"[i % 2]) for i in range(12)] + [("stable", i, "a") for i in range(12)] + [("few", i, "a") for i in range(5)]
    got = {r.key: r.verdict for r in sequence.trajectory(spark.createDataFrame(rows, "key string, at int, label string"), "key", "at", "label").collect()}
    assert got == {"becoming": "becoming", "split": "split", "stable": "stable", "few": "too-few"}
    vec = [(1, i, [1.0, 0.0] if i < 6 else [0.0, 1.0]) for i in range(12)] + [(2, i, [[1.0, 0.0], [0.0, 1.0]][i % 2]) for i in range(12)] + [(3, i, [1.0, 0.0]) for i in range(12)]
    got = {r.key: r.verdict for r in greedy.two_means(spark.createDataFrame(vec, "key long, at long, v array<double>"), "key", "at", "v").collect()}
    assert got == {1: "becoming", 2: "split", 3: "stable"}


def test_packing_keeps_the_budget(spark):
    rows = [(1, i, 1.0 / (i + 1), 40, ["a", "b"] if i < 3 else [f"t{i}"]) for i in range(8)]
    f = spark.createDataFrame(rows, "query long, doc long, score double, tokens long, terms array<string>")
    got = retrieval.pack(f, 130, 5, 0.0).orderBy("pick").collect()
    assert [r.doc for r in got] == [0, 1, 2] and got[0].truncated
    assert [r.doc for r in retrieval.pack(f, 130, 3, 1.0).orderBy("pick").collect()] == [0, 3, 4]


def test_leaders_and_assignment(spark):
    f = spark.createDataFrame([(0, i, v) for i, v in enumerate([[1.0, 0.0], [0.9, 0.1], [0.0, 1.0], [0.1, 0.9], [-1.0, 0.0]])], "g long, i long, v array<double>")
    assert sorted((r.leader, r.size) for r in greedy.leaders(f, "g", "i", "v").collect()) == [(0, 2), (2, 2)]
    s = spark.createDataFrame([("p", 1, 10, 0.9), ("p", 2, 10, 0.95), ("p", 2, 11, 0.6), ("p", 3, 11, 0.4)], "group string, donor long, recipient long, score double")
    assert sorted((r.donor, r.recipient) for r in greedy.assign(s, "group").collect()) == [(1, 10), (2, 11)]


def test_claims_and_phrases(spark):
    assert extract.signature("Caching does not improve latency")[0] == -1 and extract.signature("Caching improves latency")[0] == 1
    assert extract.signature(None) == (0, [])
    texts = [
        "the quick brown fox jumped over a lazy dog", "the coolant pump feeds the line", "The parts, this (Big) glass-cover; is its end", "it is The Big one, an", "the press was thing a ox", None,
    ]
    got = extract.phrases(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "id", "t").orderBy("id", "ord").collect()
    want = [
        (0, 0, "quick-brown-fox", "fox"), (0, 6, "lazy-dog", "dog"), (1, 0, "coolant-pump", "pump"), (1, 4, "line", "line"), (2, 0, "parts", "parts"), (2, 2, "big-glass-cover", "glass-cover"),
        (2, 6, "end", "end"), (4, 0, "press", "press"),
    ]
    assert [tuple(r) for r in got] == want


def test_triples_refuse_cartesian(spark):
    f = spark.createDataFrame([("a", "p", "b", "observed", 1.0), ("b", "q", "c", "observed", 1.0)], "s string, p string, o string, kind string, confidence double")
    assert triples.homomorphisms(f, [("?x", "p", "?y"), ("?y", "q", "?z")]).count() == 1
    with pytest.raises(ValueError, match="shares no variable"):
        triples.homomorphisms(f, [("?x", "p", "?y"), ("?a", "q", "?z")])


def test_ngram_generation_and_embeddings(spark):
    t = ngram.counts(spark.createDataFrame([(["a", "b", "c"],), (["a", "b", "d"],), (["a", "b", "c"],)], "t array<string>"), "t", 3)
    assert ngram.generate(t, ["a"], 2, 3) == ["a", "b", "c"]
    d = spark.createDataFrame([(1, "same text"), (2, "same text"), (3, "zzz qqq"), (4, None)], "id long, text string")
    v = {r.id: np.array(r.embedding) for r in embed.random_projection(d, "id", "text", 16).collect()}
    assert np.allclose(v[1], v[2]) and v[1] @ v[3] < 0.9 and all(abs(np.linalg.norm(x) - 1) < 1e-9 for x in v.values())
    b = sequence.bootstrap(spark.range(200).select("id", (F.col("id") % 10).cast("double").alias("x")), "x", "id", 100).first()
    assert b.low < b.mean < b.high
