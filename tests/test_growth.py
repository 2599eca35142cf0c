"""Queries stay whole and bounded as tables grow: what is moved, broadcast or made is held against small limits."""

import random
import tracemalloc
from collections import Counter
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparrowgrid import registry
from sparrowgrid.operators import discovery, embed, extract, greedy, neighbours, ngram, overlap

QUERIES = registry.queries()
DATA = Path("/root/testdata/sf0.001")
with_tables = pytest.mark.skipif(not DATA.is_dir(), reason="no test tables here")


@contextmanager
def setting(spark, key, value):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def backoff(grams, context, word, order, entries):
    f = 1.0
    for n in range(min(order, len(context) + 1), 1, -1):
        c = " ".join(context[len(context) - n + 1 :])
        total = sum(k for (m, d, _), k in grams.items() if (m, d) == (n, c))
        if (n, c, word) in grams:
            return f * grams[n, c, word] / total
        f *= ngram.ALPHA if total else 1.0
    t1 = sum(k for (m, _, _), k in grams.items() if m == 1)
    return f * (grams.get((1, "", word), 0) + ngram.ADD_K) / (t1 + ngram.ADD_K * entries)


def test_probability_backs_off_for_each_query(spark):
    texts = ["a b c a b d", "b c a a", "d"]
    grams = Counter()
    for t in texts:
        w = t.split()
        grams.update((n, " ".join(w[i : i + n - 1]), w[i + n - 1]) for n in (1, 2, 3) for i in range(len(w) - n + 1))
    table = ngram.counts(spark.createDataFrame([(t.split(),) for t in texts], "t array<string>"), "t", 3)
    asked = [(["a", "b"], "c"), (["a", "b"], "a"), (["x", "b"], "c"), (["x", "y"], "a"), (["b", "c"], "zz"), (["a"], "b"), ([], "d"), (["a", "b"], "c")]
    got = ngram.probability(spark.createDataFrame([(i, *q) for i, q in enumerate(asked)], "id long, context array<string>, next string"), table, 3).collect()
    want = {i: backoff(grams, c, w, 3, sum(grams.values())) for i, (c, w) in enumerate(asked)}
    assert len(got) == len(asked) and {r.id: round(r.p, 9) for r in got} == {i: round(p, 9) for i, p in want.items()}


@with_tables
def test_ngram_probability_broadcasts_no_table(spark):
    # The table of n-grams is many times what the file's size says: only rows of a fixed number may go to the driver.
    with setting(spark, "spark.sql.maxBroadcastTableSize", "10k"):
        assert len(QUERIES["ngram_probability"](spark, str(DATA)).collect()) > 1000


@with_tables
def test_ngram_score_broadcasts_no_table(spark):
    with setting(spark, "spark.sql.maxBroadcastTableSize", "10k"):
        assert len(QUERIES["ngram_score"](spark, str(DATA)).collect()) > 10


def test_sets_of_many_blocks_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(overlap, "SKETCHES", 16)
    rng = random.Random(5)
    sets = {i: (i % 2, sorted({f"w{rng.randrange(40 if i % 3 else 400)}" for _ in range(rng.randrange(0, 60))})) for i in range(140)}
    for i in range(140, 160):
        sets[i] = (sets[i - 140][0], sets[i - 140][1][: max(1, len(sets[i - 140][1]) * 2 // 3)])
    for i in range(160, 200):
        sets[i] = (sets[i - 160][0], sets[i - 160][1][1:])
    df = spark.createDataFrame([(g, i, t) for i, (g, t) in sets.items()], "grp int, id int, t array<string>").repartition(3)
    for threshold in (0.3, 0.5, 0.9):
        want = set()
        for i, (g, x) in sets.items():
            for j, (h, y) in sets.items():
                n = len(set(x) & set(y))
                if i < j and g == h and x and y and n / (len(x) + len(y) - n) >= threshold:
                    want.add((i, j, n, len(x), len(y)))
        got = overlap.similar(df, None, threshold).select("a", "b", "n", "na", "nb").collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want and len(want) > 10
    got = overlap.similar(df.where("id >= 80"), df.where("id < 80"), 0.3).collect()
    assert {(r.b, r.a) for r in got} == {p[:2] for p in overlap.similar(df, None, 0.3).select("a", "b").collect() if p[0] < 80 <= p[1]}


@pytest.mark.parametrize("threshold", [0.5, 0.9])
def test_an_id_of_several_groups_meets_in_each(spark, threshold):
    rows = [("x", 1, ["a", "b"]), ("y", 1, ["c", "d"]), ("x", 2, ["a", "b"]), ("y", 2, ["e", "f"]), ("z", 1, ["a", "b"])]
    got = overlap.similar(spark.createDataFrame(rows, "grp string, id long, t array<string>"), None, threshold).collect()
    assert [tuple(r) for r in got] == [(1, 2, 2, 2, 2)]


def test_copies_are_compared_once_for_contradictions(spark, monkeypatch):
    seen, texts = [], ["pump valve motor works fine today"] * 60 + ["pump valve motor works not fine today"] * 40 + ["nothing alike here"] * 5
    docs = spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "doc_id long, source string, text string")
    real = extract.similar

    def watched(left, right, threshold):
        seen.append(left.count())
        return real(left, right, threshold)

    monkeypatch.setattr(extract, "similar", watched)
    got = extract.contradictions(docs, "doc_id", "source", "text").collect()
    assert seen == [3]
    assert {(r.a, r.b) for r in got} == {(i, j) for i in range(60) for j in range(60, 100)} and len(got) == 2400
    assert all(r.negation_clash and not r.number_clash for r in got)


def test_benchmark_clusters_twice_and_compares_copies_once(spark, tmp_path, monkeypatch):
    texts = ["pump valve motor works fine today"] * 30 + ["night shift records parcel counts"] * 20 + ["garden crew plants maple seedlings", "a b", "a b", None]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    seen, real = [], overlap.similar

    def watched(left, right, threshold):
        seen.append(left.count())
        return real(left, right, threshold)

    monkeypatch.setattr(overlap, "similar", watched)
    r = QUERIES["benchmark_run"](spark, str(tmp_path)).first()
    assert (r.documents, r.families, r.recovered, r.deterministic) == (53, 3, 2, True)
    assert seen == [3, 3]


def test_vectors_lead_without_their_pairs(spark, monkeypatch):
    # Every pair of 3,000 like vectors would be a row; leaders need none of them.
    rng = np.random.default_rng(4)
    m = np.concatenate([rng.normal(size=(150, 3)), np.tile([[1.0, 2.0, 3.0]], (60, 1)), np.zeros((2, 3))])
    m = m[rng.permutation(len(m))]
    df = spark.createDataFrame([(7 * i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, v array<double>")
    pairs = neighbours.pairs_above(df, "id", "v", 0.6)
    want = {r.id: r.leader for r in discovery.leaders(df.select("id"), pairs).collect()}
    monkeypatch.setattr(neighbours, "pairs_above", None)
    monkeypatch.setattr(discovery, "FRONT", 40)
    assert {r.id: r.leader for r in discovery.vector_leaders(df, "id", "v", 0.6).collect()} == want


def test_copies_and_ties_among_the_best(spark, monkeypatch):
    rng = np.random.default_rng(5)
    m = np.concatenate([np.round(rng.normal(size=(90, 2)), 1), np.tile([[1.0, 0.0]], (40, 1)), [[np.nan, 1.0]]])
    m = m[rng.permutation(len(m))]
    df = spark.createDataFrame([(3 * i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, v array<double>")
    u = neighbours.unit(m)
    s = np.round(np.clip(u @ u.T, -1, 1), 9)
    np.fill_diagonal(s, np.nan)
    want = {(3 * i, 3 * j, r + 1) for i in range(len(m)) for r, j in enumerate([j for j in np.lexsort((np.arange(len(m)), -s[i])) if np.isfinite(s[i, j])][:3])}
    for name, value in (("LEAST", 11), ("BLOCK", 30), ("STRIP", 4), ("TILE", 13)):
        monkeypatch.setattr(neighbours, name, value)
    assert {(r.i, r.j, r["rank"]) for r in neighbours.top_k(df, df, "id", "v", 3).collect()} == want
    some = df.where("id % 9 = 0")
    assert {(r.i, r.j, r["rank"]) for r in neighbours.top_k(some, df, "id", "v", 3).collect()} == {w for w in want if w[0] % 9 == 0}


def test_a_table_meets_itself_once_and_as_floats(spark):
    # What is moved: each block of floats as often as there are blocks (it was twice that, in doubles).
    df = spark.range(3000).select("id", F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.rand(1).cast("float") + i * 0).alias("v"))
    packed, n = neighbours.blocks(df, "id", "v")
    met = neighbours.against((b := (packed, n)), b, lambda x, y, itself: [{"i": np.array([len(x.raw.tobytes()) + (0 if itself else len(y.raw.tobytes()))])}], "i long", whole=True)
    assert sum(r.i for r in met.collect()) == n * 3000 * 64 * 4


def test_assignment_makes_no_pairs(spark, monkeypatch):
    rng = random.Random(8)
    rows = []
    for i in range(240):
        path = [rng.choice(["a", "b", "c"]) for _ in range(rng.randint(0, 2))] + [rng.choice(["x-1", "y-2", f"n{i}", f"z-{i % 7}.html"])]
        rows.append((rng.choice(["g", "h"]), rng.choice(["doc", "code"]), i % 2, i, path, path[-1].replace(".", "-").split("-"), "/".join(path[:-1])))
    rows.append((None, "doc", 1, 999, ["a"], ["a"], ""))
    df = spark.createDataFrame(rows, "group string, kind string, side int, id long, path array<string>, name array<string>, parent string")
    side = lambda k, one, who: df.where(F.col("side") == k).select("group", "kind", F.col("id").alias(who), *[F.col(c).alias(f"{one}_{c}") for c in ("path", "name", "parent")])
    pairs = side(0, "a", "donor").join(side(1, "b", "recipient"), ["group", "kind"])
    args = [F.col("a_path"), F.col("a_name"), F.col("a_parent"), F.col("kind"), F.col("b_path"), F.col("b_name"), F.col("b_parent"), F.col("kind")]
    scored = pairs.select(F.concat_ws("|", "group", "kind").alias("group"), "donor", "recipient", F.round(greedy.evidence(*args), 6).alias("score"))
    want = {tuple(r)[1:] for r in greedy.assign(scored, "group").collect()}
    assert want and {tuple(r)[1:] for r in greedy.assign_nodes(df).collect()} == want
    # 5,000 by 5,000 pages of one place were 25 million rows.
    many = spark.range(10_000).select(F.lit("g").alias("group"), F.lit("doc").alias("kind"), (F.col("id") % 2).alias("side"), "id", F.array(F.lit("en"), F.col("id").cast("string")).alias("path"), F.array(F.col("id").cast("string")).alias("name"), F.lit("en").alias("parent"))
    got = greedy.assign_nodes(many).collect()
    assert [(r.donor, r.recipient) for r in sorted(got, key=lambda r: r.donor)] == [(i, i + 1) for i in range(0, 10_000, 2)]
    assert sum(not r.tie for r in got) == 1


def test_nearest_sets_meet_once_in_few_bytes(spark, monkeypatch):
    rng = random.Random(6)
    sets = [(i, "g" if i % 5 else "h", sorted({f"w{int(rng.expovariate(0.05))}" for _ in range(rng.randint(0, 30))})) for i in range(160)]
    df = spark.createDataFrame(sets, "id long, grp string, t array<string>")
    want = {}
    for i, g, t in sets:
        best = max((len(set(t) & set(u)) / max(len(set(t) | set(u)), 1) for j, h, u in sets if h == g and j != i), default=0)
        if best > 0:
            want[i] = round(best, 9)
    for name, value in (("BLOCK", 20), ("MOST", 20)):
        monkeypatch.setattr(overlap, name, value)
    assert {r.id: round(r.j, 9) for r in overlap.nearest(df).collect()} == want
    # Twelve bytes a term and two for each set that has it; it was eight for each.
    import pyarrow as pa

    part = pa.table({"grp": ["g"] * 500, "block": [0] * 500, "blocks": [1] * 500, "id": list(range(500)), "t": [list(range(40))] * 500})
    row = overlap._pack(part).to_pylist()[0]
    assert len(row["terms"]) + len(row["counts"]) + len(row["places"]) == 40 * 12 + 500 * 40 * 2


def test_tiles_keep_no_block_in_doubles():
    """60,000 vectors of 64 floats are 15 MB: beside them a task holds their unit vectors in floats, and doubles of some rows only."""
    rng = np.random.default_rng(3)
    x, y = (neighbours.Block(np.arange(n), rng.normal(size=(n, 64)).astype(np.float32), np.full(n, np.nan)) for n in (512, 60_000))
    want = np.round(neighbours.unit(x.raw[:4].astype(float)) @ neighbours.unit(y.raw.astype(float)).T, 9)
    tracemalloc.start()
    try:
        got = [exact(np.repeat(np.arange(4), s.shape[1]), np.tile(np.arange(s.shape[1]), 4)).reshape(4, -1) for _, _, s, _, exact in neighbours.tiles(x, y)]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert np.allclose(np.concatenate(got, 1), want, atol=2e-9) and peak < 40e6


def test_word_vectors_join_no_pairs_with_signs(spark):
    words = ["a", "naïve", "Ünder", "x" * 70, "語", "the", "42"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for dim in (32, 37):
        got = {r.w: [(s.slot, s.sign) for s in r.s] for r in df.select("w", embed.signature_of(F.col("w"), dim).alias("s")).collect()}
        assert got == {w: embed.signature(w, dim) for w in words}
    docs = spark.createDataFrame([(1, "red fox jumps over the red dog"), (2, "blue dog naps"), (3, None)], "id long, text string")
    table = embed.word_table(docs, "id", "text", 8)
    assert "MapInPandas" not in table._jdf.queryExecution().toString()
    want = {}
    for p in extract.ppmi(docs, "id", "text", 2).collect():
        v = want.setdefault(p.w, np.zeros(8))
        for slot, sign in embed.signature(p.c, 8):
            v[slot] += p.ppmi * sign
    got = {r.w: np.array(r.embedding) for r in table.collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[w], v / max(np.linalg.norm(v), 1e-8)) for w, v in want.items())
