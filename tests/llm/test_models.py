"""Toxicity against a naive matcher, held-out accuracy, columns of the registered queries, and pipeline stages on odd tables."""

import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparrowgrid.llm import quality, registry, toxicity
from sparrowgrid.llm.features import NAMES, features
from sparrowgrid.llm.shared import table

SF = "/root/testdata/sf0.001"


def naive_sums(lexicon, text):
    """Weight, matches and words, by looking for every entry at every place."""
    line = " " + toxicity.fold([text.encode()])[0].decode("latin-1").strip(" \x01") + " "
    spans = [(i, i + len(p) + 1) for p in (" " + toxicity.folded(x) for x in lexicon.exceptions) for i in range(len(line)) if line.startswith(p, i)]
    weight = matches = 0
    for term, w in lexicon.weights.items():
        t = " " + term
        for i in range(len(line)):
            if line.startswith(t, i) and not any(a <= i and i + len(t) <= b + 1 for a, b in spans):
                weight, matches = weight + w, matches + 1
    return weight, matches, len([w for w in line.split(" ") if w])


def test_matches_are_those_of_a_naive_search():
    rng = random.Random(11)
    lexicon = toxicity.Lexicon({"trash ": 2.0, "grum": 3.5, "cIown".lower().replace("l", "i"): 1.0, "ba": 0.25}, ("trash can", "class clown"))
    parts = ["trash", "TRA5H", "tr@sh", "can", "clown", "c1own", "class", "cІass", "grumble", "GRUМ", "9rum", "ba", "8a", "bat", "no", "!", "tr!", "日本", "é", "x" * 300]
    for _ in range(300):
        text = "".join(rng.choice(parts) + rng.choice([" ", "  ", "\n", "-", ""]) for _ in range(rng.randint(0, 14)))
        got = lexicon.sums([text.encode(), b"", text.encode()])
        assert got[0].tolist() == got[2].tolist() == pytest.approx(naive_sums(lexicon, text)) and got[1].tolist() == [0, 0, 0]


def accuracy(scores, labels, held, column, cut):
    got = scores.join(labels.where(F.col(column).isNotNull()), "doc_id").where(held)
    return got.agg(F.avg(((F.col("score") >= cut).cast("int") == F.col(column)).cast("int"))).first()[0]


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = quality.fold(2, 4)
    assert accuracy(quality.score(docs, quality.train(docs, labels, held)), labels, held, "quality", 0.7) > 0.9
    held = quality.fold(0, 5)
    assert accuracy(toxicity.score(docs, toxicity.learn(docs, labels, held)), labels, held, "toxic", 0.5) > 0.9


def test_held_out_toxic_documents_are_found(spark):
    """Recall and false alarms, not accuracy alone: most documents are clean."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = quality.fold(0, 5)
    scored = toxicity.score(docs, toxicity.learn(docs, labels, held)).join(labels.where("toxic IS NOT NULL"), "doc_id").where(held)
    n = {(r.toxic, r.said): r["count"] for r in scored.groupBy("toxic", (F.col("score") >= 0.5).alias("said")).count().collect()}
    assert n[1, True] / (n[1, True] + n.get((1, False), 0)) >= 0.9 and n.get((0, True), 0) <= 0.01 * n[0, False]


def test_quality_model_is_the_same_on_any_layout(spark):
    """Rows that share a labelled id have unlike texts: the model doesn't depend on which comes first."""
    rng = random.Random(3)
    rows = [(i % 30, " ".join(rng.choice(["word", "###", "A$$$", "1234", "plain", "LOUD!!"][: 3 + i % 4]) for _ in range(rng.randint(3, 40)))) for i in range(90)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    got = []
    for n, order in ((1, 1), (3, -1), (5, 1)):
        df = spark.createDataFrame(rows[::order], "doc_id long, text string").repartition(n)
        got.append(quality.train(df, labels, F.lit(False)))
    assert all((g.weights == got[0].weights).all() and g.threshold == got[0].threshold for g in got)


def test_quality_fit_equals_a_minimiser_over_all_pairs():
    """Sampled pairs give the weights that plain gradient steps over every pair come to; the threshold has the fewest errors of any cut."""
    rng = np.random.default_rng(2)
    f = np.abs(rng.normal(size=(60, len(NAMES))))
    truth = rng.normal(size=len(NAMES))
    y = (f @ truth + rng.normal(size=60) > np.median(f @ truth)).astype(int)
    ranker = quality.fit(f, y, pairs=400)
    x = quality.expand(f)
    scale = np.maximum(x.std(0), 1e-6)
    d = np.array([(x[a] - x[b]) / scale for a in np.flatnonzero(y == 1) for b in np.flatnonzero(y == 0)])
    w = np.zeros(d.shape[1])
    for _ in range(30_000):
        w -= 0.2 * (-(d / (1 + np.exp(d @ w))[:, None]).mean(0) + 1e-3 * w)
    s, t = x @ ranker.weights, x @ (w / scale)
    assert np.corrcoef(s, t)[0, 1] > 0.99
    wrong = lambda cut: (s[y == 1] < cut).mean() + (s[y == 0] >= cut).mean()
    assert wrong(ranker.threshold) == min(wrong(c) for c in [*s, np.inf])
    assert np.allclose(ranker.score(f), 1 / (1 + np.exp(-(s - ranker.threshold + np.log(0.7 / 0.3)))))


def test_quality_fit_keeps_no_differences_of_pairs():
    """18,000 of 20,000 are good: 360,000 pairs of 32 numbers are 92 MB, of which a driver shouldn't hold a single copy."""
    rng = np.random.default_rng(4)
    f, y = rng.random((20_000, len(NAMES))), np.zeros(20_000, int)
    y[np.argsort(f[:, 0] + rng.normal(size=20_000))[2_000:]] = 1
    tracemalloc.start()
    try:
        ranker = quality.fit(f, y)
        assert tracemalloc.get_traced_memory()[1] < 64e6
    finally:
        tracemalloc.stop()
    s = ranker.raw(f)
    assert s[y == 1].mean() > s[y == 0].mean()


def test_features_equal_plain_counts():
    texts = ["Hello WORLD!! ### 12 12 12", "", "a a b\nline\nline", "x" * 50, "é ü!", "p|q p|q\tz"]
    got = features([t.encode() for t in texts])
    assert all((features([t.encode()])[0] == row).all() for t, row in zip(texts, got, strict=True))
    for t, row in zip(texts, got, strict=True):
        b, words = t.encode(), t.encode().split()
        used = len(b) - sum(c in b" \t\n\r\x0b\x0c" for c in b)
        letters = sum(65 <= c <= 90 or 97 <= c <= 122 or c > 127 for c in b)
        want = {
            "log_words": np.log1p(len(words)), "word_bytes": min(len(b) / max(len(words), 1), 30), "upper": sum(65 <= c <= 90 for c in b) / max(letters, 1), "exclaim": b.count(b"!") / max(used, 1),
            "pipes": b.count(b"|") / max(used, 1), "digits": sum(48 <= c <= 57 for c in b) / max(used, 1), "high_bytes": sum(c > 127 for c in b) / max(used, 1),
            "repeats": sum(x == y for x, y in zip(words, words[1:])) / max(len(words), 1), "distinct": len(set(words)) / max(len(words), 1),
            "top_word": max((words.count(x) for x in words), default=0) / max(len(words), 1),
        }
        for name, value in want.items():
            assert row[NAMES.index(name)] == pytest.approx(value), (t, name)


def test_models_on_odd_tables(spark):
    docs = spark.createDataFrame([(None, "a"), (1, None), (1, None), (2, ""), (3, "word " * 200_000)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, 0), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    ranker, lexicon = quality.train(docs, labels, F.lit(False)), toxicity.learn(docs, labels, F.lit(False))
    for got in (quality.score(docs, ranker), toxicity.score(docs, lexicon)):
        rows = got.collect()
        assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows) and len({r.score for r in rows if r.doc_id in (1, 2)}) == 1
    assert quality.score(docs.limit(0), ranker).count() == toxicity.score(docs.limit(0), lexicon).count() == 0
    assert quality.train(docs.limit(0), labels.limit(0), F.lit(False)).constant == 0.5


COLUMNS = {
    "op1_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op2_ngram_join": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op3_bpe_roundtrip": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op4_token_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
    "op5_decontaminate": {"doc_id": "bigint", "item_id": "bigint"},
    "op6_topk_search": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
    "op7_warc_archive": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op8_quality_rank": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op9_brown_score": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op10_chat_format": {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string", "formatted_chars": "bigint"},
}


@pytest.mark.parametrize("name", list(COLUMNS))
def test_query_returns_its_columns(spark, name):
    got = registry.queries()[name](spark, SF)
    kinds = dict(got.dtypes)
    assert {c: kinds.get(c) for c in COLUMNS[name]} == COLUMNS[name]
    if "doc_id" in kinds and name != "op5_decontaminate":
        docs = table(spark, SF, "documents")
        assert sorted(r.doc_id for r in got.select("doc_id").collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    else:
        assert got.limit(1).count() == 1


def odd_tables(spark, folder, labels):
    docs = table(spark, SF, "documents")
    extra = docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")).union(docs.limit(1).withColumn("text", F.lit(None).cast("string"))).union(docs.limit(2))
    docs.union(extra).withColumn("component_id", F.lit("clash")).write.parquet(f"{folder}/documents.parquet")
    (table(spark, SF, "labels") if labels else table(spark, SF, "labels").limit(0)).write.parquet(f"{folder}/labels.parquet")
    table(spark, SF, "benchmark").limit(0).write.parquet(f"{folder}/benchmark.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_pipeline_stages_on_odd_tables(spark, tmp_path):
    import corpus_pipeline as p

    folder = str(tmp_path / "odd")
    docs = odd_tables(spark, folder, labels=False)
    stages = dict(p.STAGES)
    n = docs.count()
    # Without labels there is nothing to decide by: no document may go.
    assert stages["quality classifier"](spark, docs, folder).count() == n
    assert stages["toxicity"](spark, docs, folder).count() == n
    assert stages["benchmark decontamination"](spark, docs, folder).count() == n
    near = stages["n-gram Jaccard join"](spark, docs, folder)
    assert near.columns == docs.columns and near.where("doc_id IS NULL").count() == 1
    assert stages["BPE encoding and decoding"](spark, docs, folder).count() == n
    for _, stage in p.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0


