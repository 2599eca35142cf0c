"""What findings of round 3 changed: the same rows by less work."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparrowgrid import registry
from sparrowgrid.functions import text as T
from sparrowgrid.operators import context, extract, neighbours, retrieval

DATA = Path("/root/testdata/sf0.001")
with_tables = pytest.mark.skipif(not DATA.is_dir(), reason="no test tables here")


@pytest.mark.parametrize("few", [0, 100])
def test_known_terms_meet_the_vocabulary_in_a_join(spark, monkeypatch, few):
    """every term was looked for along a whole map."""
    monkeypatch.setattr(retrieval, "FEW", few)
    texts = spark.createDataFrame([(1, 0, "The b, a B c"), (1, 1, None), (2, 0, ""), (2, 1, "zz"), (3, 0, "c c")], "k long, turn int, text string")
    words = spark.createDataFrame([("b",), ("c",), ("the",), ("q",)], "term string")
    got = sorted(map(tuple, retrieval.known(texts, ["k", "turn"], "text", words).collect()))
    assert got == [(1, 0, 4, "the b b c"), (1, 1, 0, ""), (2, 0, 0, ""), (2, 1, 0, ""), (3, 0, 2, "c c")]


@with_tables
def test_tokens_decoded_looks_along_no_map(spark, monkeypatch):
    monkeypatch.setattr(T, "encode", None)
    assert registry.queries()["tokens_decoded"](spark, str(DATA)).count() > 0


def test_gold_by_a_condition_is_counted_without_a_join(spark):
    """what was found was made twice and joined with itself."""
    docs = spark.createDataFrame([(1, "we saw x-1 and Bob near x-1"), (2, "bare bare words near"), (3, None), (4, "near e-mail")], "id long, text string")
    found = extract.entities(docs, "id", "text").select("doc", "key")
    gold = F.contains("key", F.lit("-"))
    one, two = extract.micro_prf(found, gold), extract.micro_prf(found, found.where(gold))
    assert one.schema == two.schema and one.collect() == two.collect() and one.first().tp == 2 and one.first().fp > 2
    assert extract.micro_prf(found.limit(0), gold).collect() == extract.micro_prf(found.limit(0), found.limit(0)).collect()
    assert "Join" not in str(extract.micro_prf(found.select("doc", "key").localCheckpoint(), gold)._jdf.queryExecution().optimizedPlan())


def test_node_search_walks_in_rounds(spark, monkeypatch):
    """the nearest of every number of tokens left the tasks."""
    rounds, top_k = [], neighbours.top_k
    monkeypatch.setattr(neighbours, "label_top", None)
    monkeypatch.setattr(neighbours, "top_k", lambda *a, **k: rounds.append(1) or top_k(*a, **k))
    rng = np.random.default_rng(5)
    v = rng.normal(size=(400, 4))
    v[100:160] = v[7]  # equal similarities
    size = rng.choice([1, 2, 30, 31, 32, 33, 34, 35], 400, p=[0.01, 0.01, *[0.98 / 6] * 6])
    f = spark.createDataFrame
    nodes = f([(i, v[i].tolist(), " ".join(["w"] * size[i])) for i in range(400)], "id long, v array<double>, label string")
    asked = [1, 7, 50, 399, 1000]
    queries = f([(i, v[i % 400].tolist()) for i in asked], "id long, v array<double>")
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    for budget, most in ((67, 5), (40, 3), (5, 6), (10_000, 2), (0, 3)):
        got = context.node_search(nodes, queries, budget, most).collect()
        for q in asked:
            s = np.round(np.clip(unit @ unit[q % 400], -1, 1), 9)
            room, want = budget, []
            for j in sorted(set(range(400)) - {q}, key=lambda j: (-s[j], j)):
                if size[j] <= room and len(want) < most:
                    want.append(j)
                    room -= size[j]
            mine = sorted((r for r in got if r["query"] == q), key=lambda r: r.pick)
            assert [r.node for r in mine] == want and all(r.truncated for r in mine)
    assert len(rounds) > 4
    few = context.node_search(nodes.where("id < 3"), queries, 500, 12).collect()
    assert sorted((r["query"], r.truncated) for r in few) == sorted([(1, False)] * 2 + [(q, False) for q in (7, 50, 399, 1000) for _ in range(3)])
