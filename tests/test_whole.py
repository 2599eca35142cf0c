"""Queries do the whole job: small tables against brute force in plain Python."""

import math
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from sparrowgrid import registry
from sparrowgrid.functions import text as T
from sparrowgrid.operators import extract, retrieval
from sparrowgrid.plans import texts as texts_plans

QUERIES = registry.queries()


def documents(spark, path, texts):
    rows = [(i, t, "en", f"src{i % 2}") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_entities_of_four_letters_in_two_documents(spark, tmp_path):
    texts = ["pump fails with Rome near pump", "a pump with cold air", "rare word here. Then unit-7 with tin", "tin cold"]
    d = documents(spark, tmp_path, texts)
    words = [[(w, w.strip(".").lower()) for w in t.split(" ")] for t in texts]
    df = Counter(k for ws in words for k in {k for _, k in ws})
    want = set()
    for i, ws in enumerate(words):
        found = []
        for n, (w, k) in enumerate(ws):
            hit = re.fullmatch("[a-z]+-[a-z0-9]+", k) or n and w[0].isupper() and not re.search(r"[.!?]", ws[n - 1][0]) or len(k) >= 4 and df[k] >= 2 and k not in extract.COMMON
            if hit and k not in found:
                found.append(k)
        want |= {(i, k, o) for o, k in enumerate(found, 1)}
    assert {(0, "pump", 1), (1, "cold", 2), (3, "cold", 1)} <= want
    assert {(r.doc_id, r.key, r.ord) for r in QUERIES["entity_extract"](spark, d).collect()} == want
    r = QUERIES["entity_prf"](spark, d).first()
    assert (r.tp, r.fp, r.fn) == (1, len(want) - 1, 0)


def test_ppmi_keeps_rare_pairs(spark, tmp_path):
    texts = ["a b c a", "b c d e", "", "e a b b d"]
    d = documents(spark, tmp_path, texts)
    n = Counter()
    for t in texts:
        ws = t.split()
        n.update((w, c) for i, w in enumerate(ws) for j, c in enumerate(ws) if 0 < abs(i - j) <= 2 and w != c)
    side, z = Counter(), sum(n.values())
    for (w, _), k in n.items():
        side[w] += k
    ppmi = {(w, c): (k, math.log(k * z / (side[w] * side[c]))) for (w, c), k in n.items()}
    want = {(w, c, k, round(x, 6)) for (w, c), (k, x) in ppmi.items() if x > 0}
    assert want and {(r.w, r.c, r.n, r.ppmi) for r in QUERIES["ppmi_table"](spark, d).collect()} == want


def test_packing_goes_over_all_scored_documents(spark, tmp_path):
    # Thirty long documents come first by BM25; short ones and near copies fit.
    texts = [f"apple pear {'apple pear ' * 1200}x{i}" for i in range(30)] + [f"apple plum {'w ' * (5 * i)}" for i in range(12)] + ["apple lime kiwi fig"] * 3
    d = documents(spark, tmp_path, texts)
    spark.createDataFrame([(1, "apple pear"), (2, "plum fig"), (3, "nothing")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("doc"), T.token_estimate(F.col("text")).alias("tokens"), F.array_distinct(T.terms(F.col("text"))).alias("terms"))
    every = texts_plans.bm25_ranked(spark, d).select("query", "doc", F.round("score", 6).alias("score")).join(docs, "doc").cache()
    take = lambda f: sorted((r.query, r.pick, r.doc, r.score, r.tokens, r.truncated) for r in f.collect())
    got = take(QUERIES["budgeted_context"](spark, d))
    assert got == take(retrieval.pack(every, 2000, 8, 0.3))
    assert sum(r[0] == 1 for r in got) == 8 and {r[0] for r in got} == {1, 2}
    packed = defaultdict(int)
    for r in retrieval.pack(every, 1500, 8, 0.0).collect():
        packed[r.query] += r.tokens
    picks = Counter(r.query for r in retrieval.pack(every, 1500, 8, 0.0).collect())
    # No document has a vector, so none repeats another; three tokens part the texts of a context.
    spark.createDataFrame([(1000, 0, [1.0, 0.0]), (1001, 0, [0.0, 1.0])], "vec_id long, label int, embedding array<double>").write.parquet(f"{d}/embeddings.parquet")
    assert {r.item_id: r.compiled_tokens for r in QUERIES["compiled_context"](spark, d).collect()} == {q: n + 3 * (picks[q] - 1) for q, n in packed.items()}


def test_labels_hold_the_whole_text(spark, tmp_path):
    texts = ["  a common opening of texts: one ", "a common opening of texts: two", "   ", "x" * 5000, "x" * 5001, "short"]
    want = {(i, f"src{i % 2}: {t.strip()}") for i, t in enumerate(texts) if 1 <= len(t.strip()) <= 5000}
    assert {(r.doc_id, r.label) for r in QUERIES["scan_labels"](spark, documents(spark, tmp_path, texts)).collect()} == want


def test_embeddings_are_of_documents(spark, tmp_path):
    d = documents(spark, tmp_path, ["ab cd ab", "cd ef gh", "ab cd ab"])
    rows = {r.doc_id: r.embedding for r in QUERIES["random_projection_embed"](spark, d).collect()}
    assert sorted(rows) == [0, 1, 2] and {len(v) for v in rows.values()} == {64} and rows[0] == rows[2] != rows[1]
    assert {r.w for r in QUERIES["word_vectors"](spark, d).collect()} == {"ab", "cd", "ef", "gh"}
