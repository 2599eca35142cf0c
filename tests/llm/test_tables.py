"""WARC archives, top-k search and the pipeline against brute force."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparrowgrid.llm import topk, warc


def test_warc_round_trip(spark, tmp_path):
    big, small = "<p>" + "é" * 900, "tiny"
    rows = [(1, "http://a/x y", big), (2, "http://b", big), (3, None, small), (4, "u", small), (5, "v", None), (6, "w", ""), (7, "z", "q" * 100_000), (None, "n", big), (8, "s", big), (8, "s", big)]
    pages = spark.createDataFrame([(*r, "c", "d") for r in rows], "page_id long, url string, html string, digest string, first string")
    path = f"file://{tmp_path}/w"
    warc.archive(pages, path)
    got = warc.read(spark, path).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.record_id, []).append(r)
    assert by["1"][0].record_type == by["2"][0].record_type == "revisit" and by["1"][0].refers_to == "8" and by["1"][0].http_length == len(big.encode())
    assert [r.record_type for r in by["8"]] == ["response", "response"]
    assert by["1"][0].target_uri == "http://a/x y" and by["3"][0].target_uri is None
    for i, _, html in rows:
        r = by[None if i is None else str(i)][0]
        data = (html or "").encode()
        assert r.payload_digest == hashlib.sha1(data).hexdigest()
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == data
    some = warc.read(spark, path).where("record_type = 'revisit' AND target_uri LIKE 'http://%'")
    assert sorted(r.record_id for r in some.collect()) == ["1", "2"]
    bare = warc.read(spark, path, payload="false").where(F.col("record_id").isin("3", "7")).collect()
    assert sorted((r.record_id, r.payload, r.http_length) for r in bare) == [("3", None, 4), ("7", None, 100_000)]
    warc.archive(pages.limit(0), f"file://{tmp_path}/none")
    assert warc.read(spark, f"file://{tmp_path}/none").count() == 0


def test_warc_plain_files_and_damage(spark, tmp_path):
    data = warc.record("9", "response", "u", hashlib.sha1(b"hello").hexdigest(), b"hello", None)
    other = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(other + data)
    got = warc.read(spark, f"file://{tmp_path}/a.warc").orderBy("record_type").collect()
    assert [(r.record_type, bytes(r.payload)) for r in got] == [("response", b"hello"), ("warcinfo", b"abc")]
    (tmp_path / "b.warc").write_bytes(data.replace(b"hello", b"jello"))
    with pytest.raises(Exception, match="another digest"):
        warc.read(spark, f"file://{tmp_path}/b.warc").collect()


def brute(rows, k):
    usable = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in usable:
        if i % 2 == 0:
            s = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in usable if j != i)[:k]
            out += [(i, r, j, -x) for r, (x, j) in enumerate(s, 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [8192, 7])
def test_top_k_is_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "QUERIES", 5)
    monkeypatch.setattr(topk, "HEAD", 9)
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=6) * rng.choice([0.1, 1, 30])).tolist()) for i in range(60)]
    rows += [(60, rows[3][1]), (61, rows[3][1]), (62, None), (63, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (64, [float("nan")] * 6), (65, [float("inf")] * 6), (66, []), (None, [1.0] * 6), (68, [0.0] * 6)]
    df = spark.createDataFrame([(i, v, "a", 1) for i, v in rows], "vec_id long, embedding array<float>, id string, block int")
    f32 = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = topk.search(df, F.col("id") % 2 == 0, k=4).collect()
    assert sorted(map(tuple, got)) == brute(f32, 4)
    assert topk.search(df.limit(0), F.col("id") % 2 == 0).count() == 0


def test_pipeline_stages_do_their_work(spark):
    import corpus_pipeline as p
    from sparrowgrid.llm import decontaminate, ngramjoin, quality, toxicity
    from sparrowgrid.llm.shared import table

    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents").withColumn("component_id", F.lit("clash"))
    for name, stage in p.STAGES:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        out = stage(spark, docs, sf)
        if name != p.STAGES[-1][0]:
            assert out.columns == docs.columns
        after = {r.doc_id for r in out.select("doc_id").collect()}
        if name == "quality classifier":
            ranker = quality.train(docs, table(spark, sf, "labels"), F.lit(False))
            assert after == {r.doc_id for r in quality.score(docs, ranker).where("score >= 0.7").collect()}
        elif name == "toxicity":
            lexicon = toxicity.learn(docs, table(spark, sf, "labels"), F.lit(False))
            assert after == {r.doc_id for r in toxicity.score(docs, lexicon).where("score < 0.5").collect()}
        elif name == "n-gram Jaccard join":
            assert after == {r.component_id for r in ngramjoin.join(docs)[0].collect()}
        elif name == "benchmark decontamination":
            assert before - after == {r.doc_id for r in decontaminate.contaminated(docs, table(spark, sf, "benchmark")).collect()}
        else:
            assert after == before
        docs = out
