"""Ranked search against a plain scan of all documents, in many parts and slices, and on odd tables."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from sparrowgrid.llm import lexical

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, k=10):
    held = [(i, Counter(t), len(t)) for i, text in docs if (t := terms(text))]
    n, total = len(held), sum(x for _, _, x in held)
    df = Counter(t for _, c, _ in held for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for t, x in df.items()}
    asked = defaultdict(Counter)
    for i, text in items:
        asked[i].update(terms(text))
    out = []
    for i, want in asked.items():
        found = []
        for doc, c, size in held:
            m = 100 - 75 + (75 * size * n) // total
            s = sum(x * weight[t] * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t, x in want.items() if t in c)
            if s > 0:
                found.append((-s, doc is None, doc or 0, doc))
        out += [(i, rank, f[3], -f[0]) for rank, f in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def tables(seed, n=120, m=25):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Öl", "öl", "A-b", "x_y", "é1", "日本"]
    chance = 1 / np.arange(1, len(vocabulary) + 1)
    text = lambda low, high: " ".join(rng.choice(vocabulary, rng.integers(low, high), p=chance / chance.sum()))
    docs = [(i, text(0, 40)) for i in range(n)]
    docs += [(i + n, docs[i][1]) for i in range(0, n, 3)]  # ties
    items = [(i, text(0, 25)) for i in range(m)] + [(3, "w1 w50"), (90, docs[0][1]), (91, "none such"), (92, "w0 " * 300)]
    return docs, items


@pytest.mark.parametrize("block, part, cells, partitions", [(4 << 20, 1 << 17, 1 << 22, 3), (600, 40, 150, 5), (1, 7, 1, 2)])
def test_search_equals_brute_force(spark, monkeypatch, block, part, cells, partitions):
    docs, items = tables(block)
    docs += [(7, None), (None, "w1 w2 w50"), (None, None), (11, docs[11][1]), (11, docs[11][1]), (500, "W1\x00w2,W50"), (501, "")]
    items += [(None, "w3"), (None, "w4 Öl"), (93, None), (94, "")]
    for name, x in (("BLOCK_BYTES", block), ("PART_ROWS", part), ("CELLS", cells), ("BROADCAST_BYTES", 32 << 20 if block > 1000 else 0)):
        monkeypatch.setattr(lexical, name, x)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(partitions)
    q = spark.createDataFrame(items, "item_id long, text string").repartition(partitions)
    assert sorted(map(tuple, lexical.search(d, q).collect()), key=repr) == brute(docs, items)


@pytest.mark.parametrize("block", [4 << 20, 500])
def test_hot_term_and_large_table(spark, monkeypatch, block):
    monkeypatch.setattr(lexical, "BLOCK_BYTES", block)
    docs, items = tables(5, 1500, 15)
    docs += [(10_000 + i, "hot " * (1 + i % 3) + docs[i][1]) for i in range(700)]
    items += [(200, "hot"), (201, "hot w1 w55"), (202, docs[40][1] + " hot")]
    got = lexical.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), k=4)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, items, 4)


def test_pruning_prunes(monkeypatch):
    """Terms that can't reach the threshold make no candidates, and the threshold rises."""
    part = lexical.Part(
        {"items": [5], "threshold": np.array([100], np.int64).tobytes(), "rest": np.array([30], np.int64).tobytes(), "item": np.zeros(2, np.int64).tobytes(),
         "term": np.array([1, 2], np.uint64).tobytes(), "share": np.array([1, 1], np.int64).tobytes(), "essential": b"\x00\x01"}, 1,
    )

    class Block:
        ids = [10, 11, 12]

        def postings(self, asked):
            return np.array([0, 0, 1, 1]), np.array([0, 1, 1, 2]), np.array([30, 25, 90, 80])

    seen = []
    real = lexical.Part._keep
    monkeypatch.setattr(lexical.Part, "_keep", lambda self, block, item, doc, *rest: (seen.extend(doc.tolist()), real(self, block, item, doc, *rest)))
    part.meet(Block())
    assert seen == [1, 2] and part.threshold.tolist() == [115] and part.best[3].tolist() == [11]


def test_clashing_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", 4, 5, 6)], "doc_id long, text string, term int, part int, item_id int")
    items = spark.createDataFrame([(1, "b", 4, 5)], "item_id long, text string, doc_id int, score int")
    one = lexical.search(docs.unionAll(docs.selectExpr("2", "'c d'", "1", "1", "1")), items).collect()
    assert [tuple(r)[:3] for r in one] == [(1, 1, 1)] and one[0].score > 0
    for d, q in ((docs.limit(0), items), (docs, items.limit(0)), (docs.limit(0), items.limit(0))):
        assert lexical.search(d, q).collect() == []


def test_very_long_texts(spark):
    docs = [(1, "k " * 300_000 + "z"), (2, "z"), (3, "k z"), (4, "y")]
    items = [(1, "z k"), (2, " ".join(f"t{i}" for i in range(50_000)) + " z")]
    got = lexical.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, items)
