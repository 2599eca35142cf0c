"""The context compiler and packing against plain greedy picks, and links that span like vectors."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparrowgrid import registry
from sparrowgrid.operators import context, graph, neighbours, retrieval

DATA = "/root/testdata/sf0.001"


def plain(scored, budget, top_k):
    """Greedy picks by their definition, over every scored row: ``query -> (picked ids, left out)``."""
    out = {}
    for q in {r[0] for r in scored}:
        left = sorted((r for r in scored if r[0] == q), key=lambda r: (-r[2], r[1]))
        picks, room, used = [], budget, set()
        while len(picks) < top_k:
            fit = [r for r in left if r[3] <= room and r[4] not in used and r not in picks]
            if not fit:
                break
            picks.append(fit[0])
            room -= fit[0][3]
            used.add(fit[0][4])
        out[q] = ([p[1] for p in picks], len(picks) < len(left))
    return out


def rows_of(seed, n=150):
    rng = np.random.default_rng(seed)
    return [(q, d, float(rng.integers(1, 30)), int(rng.integers(1, 40)), f"f{rng.integers(0, 12)}" if rng.random() < 0.6 else f"d{d}") for q in range(3) for d in range(n)]


SCHEMA = "query long, doc long, score double, tokens long, family string"


@pytest.mark.parametrize("seed, budget, top_k", [(1, 60, 5), (2, 25, 8), (3, 1000, 4), (4, 0, 3)])
def test_greedy_equals_plain_picks(spark, seed, budget, top_k):
    rows = rows_of(seed) + [(9, 1, 1.0, 5, "f1"), (9, 2, 1.0, 5, "f1")]
    want = plain(rows, budget, top_k)
    for n in (1, 7):
        got = context.greedy(spark.createDataFrame(rows, SCHEMA).repartition(n), budget, top_k)
        assert {r.query: ([p.doc for p in r.picks], r.truncated) for r in got.collect()} == want


def test_able_rows_are_bounded(spark):
    rows = [(1, d, 1.0 + d % 7, 1 + d % 5, f"d{d}") for d in range(3000)]
    assert context.able(spark.createDataFrame(rows, SCHEMA), 4, 2).count() <= 5 * 5


def test_family_of_ten_copies_gives_one_pick(spark):
    docs = spark.createDataFrame([(i, 10, f"copy {i}") for i in range(10)] + [(10, 10, "other"), (11, 500, "long")], "doc long, tokens long, text string")
    scores = spark.createDataFrame([(1, i, 100.0 - i) for i in range(12)] + [(2, 11, 1.0)], "query long, doc long, score double")
    families = spark.createDataFrame([(i, 0) for i in range(10)], "node long, component long")
    got = {r["query"]: r for r in context.compiled(scores, docs, families, 100, 8).collect()}
    one = got[1]
    assert one.picks == [0, 10] and one.removed == list(range(1, 10)) and one.context == "copy 0\n\n---\n\nother" and one.truncated
    assert one.baseline_tokens == 110 + 500 + 3 * 11 and one.compiled_tokens == 23 and one.saving == round(1 - 23 / 643, 6)
    assert (got[2].picks, got[2].compiled_tokens, got[2].saving, got[2].context) == ([], 0, 1.0, "")
    assert context.compiled(scores.limit(0), docs, families, 100, 8).collect() == []


def test_spanning_links_join_what_all_pairs_join(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    rows = [(i, [float(x) for x in centres[i % 6] + rng.normal(size=8) * (0.02 if i % 3 else 0.6)]) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    all_pairs = graph.components(neighbours.pairs_above(df, "id", "v", 0.95, strict=False).select(F.col("i").alias("u"), F.col("j").alias("v")))
    links = neighbours.links_above(df, "id", "v", 0.95)
    assert links.count() < neighbours.pairs_above(df, "id", "v", 0.95, strict=False).count() / 3
    assert sorted(map(tuple, graph.components(links).collect())) == sorted(map(tuple, all_pairs.collect()))


@pytest.mark.parametrize("diversity", [0.0, 0.3, 0.9])
def test_ranked_packing_drops_no_possible_pick(spark, diversity):
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(list("abcdefghij"), rng.integers(1, 8))) for _ in range(120)]
    docs = spark.createDataFrame([(i, 1 + i % 3 if i % 9 else 90, t) for i, t in enumerate(texts)], "doc long, tokens long, text string")
    scored = [(q, i, float(rng.integers(1, 12))) for q in range(2) for i in range(120)]
    scores = spark.createDataFrame(scored, "query long, doc long, score double")
    got = retrieval.pack_ranked(scores, docs, 9, 4, diversity)
    sets = F.array_distinct(F.split("text", " "))
    want = retrieval.pack(scores.join(docs, "doc").select("query", "doc", "score", "tokens", sets.alias("terms")), 9, 4, diversity)
    cols = ["query", "pick", "doc", "tokens", "truncated"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))


@pytest.mark.skipif(not Path(DATA).is_dir(), reason="no test tables here")
def test_compiled_context_query(spark):
    got = registry.queries()["compiled_context"](spark, DATA).collect()
    assert got and all(r.compiled_tokens <= 1500 + 3 * 7 and len(set(r.picks)) == len(r.picks) <= 8 and not set(r.picks) & set(r.removed) for r in got)


def test_node_search_packs_labels(spark):
    rng = np.random.default_rng(12)
    nodes = [(i, [float(x) for x in rng.normal(size=5)], " ".join(["word"] * int(rng.integers(1, 9))) if i % 7 else [" ", None][i % 2]) for i in range(200)]
    queries = [(i, nodes[i][1]) for i in (3, 50, 51)]
    f = spark.createDataFrame
    got = context.node_search(f(nodes, "id long, v array<double>, label string"), f(queries, "id long, v array<double>"), 20, 6).collect()
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    scored = [(q, i, round(float(unit(v) @ unit(w)), 9), len(label.split()), str(i)) for q, v in queries for i, w, label in nodes if label and label.strip() and i != q]
    want = plain(scored, 20, 6)
    picks = {q: [r.node for r in sorted(got, key=lambda r: r.pick) if r["query"] == q] for q, _ in queries}
    assert {q: (picks[q], True) for q in picks} == want and all(r.truncated for r in got)
