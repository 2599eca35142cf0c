"""Discovery, mutation, set joins and blocks against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparrowgrid.operators import beliefs, classify, descriptors, direction, discovery, graph, mutation, neighbours, overlap, retrieval, sequence


def vectors(spark, m, **more):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, v array<double>")


def unit(m):
    return m / np.maximum(np.linalg.norm(m, axis=1), 1e-8)[:, None]


def test_leaders_are_the_sequential_ones(spark):
    rng = np.random.default_rng(3)
    u = unit(rng.normal(size=(60, 4)))
    s = u @ u.T
    want, taken = {}, set()
    for i in range(60):
        if i not in taken:
            want[i] = i
            for j in range(i + 1, 60):
                if j not in taken and s[i, j] > 0.7:
                    taken.add(j)
                    want[j] = i
    pairs = spark.createDataFrame([(i, j) for i in range(60) for j in range(i + 1, 60) if s[i, j] > 0.7], "i long, j long")
    assert {r.id: r.leader for r in discovery.leaders(spark.range(60), pairs).collect()} == want


def scored(spark, best):
    rows = [(i, [1.0, 0.1 * (i % 3)], f"apple pear text{i}", float(b), 1, 2) for i, b in enumerate(best)]
    return spark.createDataFrame(rows, "id long, v array<double>, text string, best double, domain long, mode long")


def test_discovery_retunes(spark):
    report, found = discovery.discover(scored(spark, [0.1, 0.2, 0.9]))
    assert (report.first().threshold, report.first().retuned, report.first().unmapped) == (0.55, False, 2)
    row = found.first()
    assert (row.size if isinstance(row.size, int) else row["size"]) == 2 and row.name == "Apple & Pear" and row.samples == ["apple pear text0", "apple pear text1"]
    report, found = discovery.discover(scored(spark, [0.6, 0.7, 0.8, 0.9]))
    # Only the maximum leaves two texts open.
    assert report.first().retuned and report.first().threshold == pytest.approx(0.9) and found.first()["size"] == 3
    assert not discovery.discover(scored(spark, [0.6, 0.7]), discovery.Config(retune=False))[0].first().retuned
    empty, none = discovery.discover(scored(spark, []))
    assert empty.first().total == 0 and none.count() == 0


def test_regrouping_keeps_sizes(spark):
    members = spark.createDataFrame([(i, i // 7) for i in range(40)], "id long, leader long")
    got = discovery.regrouped(members).collect()
    assert sorted(r.id for r in got) == list(range(40))
    assert sorted(np.bincount([r.leader for r in got]).tolist()) == sorted(np.bincount([i // 7 for i in range(40)]).tolist())
    assert {r.id: r.leader for r in got} != {i: i // 7 for i in range(40)}


def test_mutation_is_brute_force(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(14, 3))
    links = [(i, i + 1) for i in range(12)]
    edges = spark.createDataFrame([*links, *[(b, a) for a, b in links]], "source long, target long")
    new = [float(x) for x in -m[2]]
    got = {r.node: r for r in mutation.evaluate(vectors(spark, m), edges, 2, new).collect()}
    hops = {i: abs(i - 2) for i in range(13) if abs(i - 2) <= 5}
    assert {n: r.hop for n, r in got.items()} == hops

    def coherence(x, i):
        c = np.sort(np.delete(unit(x) @ unit(x)[i], i))[::-1][:5]
        return max(0.0, c.mean())

    shadow = m.copy()
    shadow[2] = new
    for n, r in got.items():
        assert r.impact == pytest.approx(-(0.85 ** r.hop), abs=1e-6)
        assert r.previous == pytest.approx(coherence(m, n), abs=1e-6) and r.new == pytest.approx(coherence(shadow, n), abs=1e-6)
        d = r.new - r.previous
        assert r.delta == ("unchanged" if abs(d) < 1e-6 else "strengthened" if d > 0 else "invalidated" if d < -0.25 else "shifted")
    assert mutation.evaluate(vectors(spark, m), edges, 2, [float(x) for x in m[2]]).count() == 0
    assert mutation.evaluate(vectors(spark, m), edges, 99, new).count() == 0
    deltas = spark.createDataFrame([(1, 0.9, 0.1), (2, 0.5, 0.45)], "node long, previous double, new double")
    h = spark.createDataFrame([("a", 1, "certified"), ("b", 1, "candidate"), ("c", 2, "supported"), ("d", 1, "supported")], "h_id string, ref long, status string")
    out = {r.h_id: (r.contradicted, r.route) for r in mutation.revise(deltas, h).collect()}
    assert out == {"a": (True, "protected"), "b": (False, None), "c": (False, None), "d": (True, "review")}
    only = spark.createDataFrame([(2,)], "node long")
    assert [r.h_id for r in mutation.revise(deltas, h, only).collect()] == ["c"]


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8])
def test_set_joins_are_brute_force(spark, threshold):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(25)]
    rows = [(k % 3, k, sorted(set(rng.choices(words, k=rng.randint(0, 9))))) for k in range(90)]
    df = spark.createDataFrame(rows, "grp long, id long, t array<string>")
    jac = lambda a, b: len(set(a) & set(b)) / max(len(set(a) | set(b)), 1)
    want = {(i, j) for g, i, a in rows for h, j, b in rows if g == h and i < j and a and b and jac(a, b) >= threshold}
    assert {(r.a, r.b) for r in overlap.similar(df, None, threshold).collect()} == want
    left, right = df.where("id < 40"), df.where("id >= 40")
    assert {(r.a, r.b) for r in overlap.similar(left, right, threshold).collect()} == {(i, j) for i, j in want if i < 40 <= j}
    best = {i: max([jac(a, b) for h, j, b in rows if h == g and j != i], default=0) for g, i, a in rows}
    assert {r.id: round(r.j, 9) for r in overlap.nearest(df).collect()} == {i: round(x, 9) for i, x in best.items() if x > 0}


def test_blocks_of_any_size_agree(spark, monkeypatch):
    rng = np.random.default_rng(9)
    m = np.round(rng.normal(size=(70, 3)), 1)
    df = vectors(spark, m).withColumn("label", F.when(F.col("id") % 5 > 0, F.col("id") % 3))
    take = lambda: [
        sorted(map(tuple, f.collect()), key=repr)
        for f in (neighbours.top_k(df, df, "id", "v", 4), neighbours.label_best(df, "id", "label", "v"), neighbours.pairs_above(df, "id", "v", 0.9), neighbours.earlier_top_k(df, "id", "v", 3), neighbours.label_top(df, "id", "label", "v", 2))
    ]
    one = take()
    monkeypatch.setattr(neighbours, "LEAST", 9)
    monkeypatch.setattr(neighbours, "BLOCK", 9)
    monkeypatch.setattr(neighbours, "STRIP", 4)
    assert take() == one
    s = np.round(np.clip(unit(m) @ unit(m).T, -1, 1), 9)
    want = [(i, j, s[i, j], k + 1) for i in range(70) for k, j in enumerate(sorted((j for j in range(70) if j != i), key=lambda j: (-s[i, j], j))[:4])]
    assert [(r[0], r[1], round(r[2], 9), r[3]) for r in one[0]] == sorted(((i, j, round(float(x), 9), k) for i, j, x, k in want), key=repr)


def test_direction(spark):
    source = "the pump station keeps water level steady. night shift records parcel counts; crew plants maple seedlings"
    rows = [(source, "pump station keeps water level. night shift parcel counts. maple seedlings"), (source, "the pump station keeps water level steady"), ("", "x"), (None, None)]
    df = spark.createDataFrame(rows, "a string, b string")
    got = direction.check(df, "a", "b", "shorten").collect()
    assert got[0].moved and got[0].holds and got[0].retention > got[0].null_retention
    assert got[1].moved and not got[1].holds and got[1].retention == 0 and not got[2].holds and not got[3].holds
    assert direction.parse(" Expand ") == "longer"
    with pytest.raises(ValueError):
        direction.parse("sideways")
    longer = df.limit(1).select(direction.null(F.col("a"), F.lit(30), "longer").alias("x"), direction.null(F.col("a"), F.lit(3), "rephrased").alias("y")).first()
    assert len(longer.x.split()) == 30 and sorted(longer.y.split()) == sorted(source.split()) != longer.y.split()
    assert direction.check(df.limit(1), "a", "b", "rephrase", whole=True).first().retention > 0.5


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (7, 7)], "u long, v long")
    assert {r.node: r.component for r in graph.components(links).collect()} == {k: 0 for k in range(61)} | {100: 100, 101: 100}


def test_candidates_and_random_ones(spark):
    rng = np.random.default_rng(2)
    z = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(20)], "id long, z array<double>")
    assert all(r.j == r.i for r in descriptors.candidates(z, z, 3).where("rank = 1").collect())
    got = descriptors.random_candidates(z, 3).collect()
    assert len(got) == 60 and all(len({r.j for r in got if r.i == i}) == 3 for i in range(20))


def test_facets_prefixes_failures_and_shipping(spark):
    rows = spark.createDataFrame([("a", "x", None), ("a", "y", None), ("a", "x", None), ("b", "y", "q"), ("b", "x", None)], "g string, p string, q string")
    assert {(r.g, r.axis, r.value, r.n) for r in classify.majority(rows, "g", ["p", "q"]).collect()} == {("a", "p", "x", 2), ("b", "p", "x", 1), ("b", "q", "q", 1)}
    ids, some = (spark.createDataFrame([(x,) for x in xs], f"{c} string") for xs, c in ((["ab1", "ab2", "cd", "c"], "id"), (["ab", "c", "cd", "z"], "prefix")))
    assert {(r.prefix, r.state, r.id) for r in beliefs.resolve(ids, some).collect()} == {("ab", "ambiguous", None), ("c", "exact", "c"), ("cd", "exact", "cd"), ("z", "unknown", None)}
    v = spark.createDataFrame([(1, -0.5), (2, None), (3, -0.9), (4, 1.0), (5, -0.5)], "id long, verdict double")
    assert [(r.id, r.place) for r in sorted(classify.failures(v, "id", "verdict").collect(), key=lambda r: r.place)] == [(3, 1), (1, 2), (5, 3)]
    rank = lambda *ps: spark.createDataFrame([(q, d, 1) for q, d in ps], "query long, doc long, rank int")
    targets = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "query long, target long")
    assert tuple(retrieval.ship(rank((1, 9), (2, 2), (3, 9)), rank((1, 1), (2, 2), (3, 3)), targets).first()) == (3, 2, 0, 2, True)


def test_transition_null_leaves_the_order_of_round_0(spark):
    rng = random.Random(1)
    m = spark.createDataFrame(sorted({(s, p, f"e{rng.randint(0, 6)}") for s in range(6) for p in range(12) for _ in range(2)}), "seq long, pos long, entity string")
    gold = sequence.transitions(m)
    r = sequence.transition_null(m, gold, 10).first()
    assert r.accuracy == 1.0 and 0 < r.null_mean < 1 and r.z > 0 and math.isfinite(r.z)
    scores = sequence.transition_scores(sequence.transitions(m, 2), gold).collect()
    assert sum(x.n for x in scores) == gold.count() and all(0 <= x.recall <= 1 for x in scores)


def test_every_query_without_sql_gives_rows(spark):
    from sparrowgrid import registry

    queries, sql = registry.queries(), registry.oracle_sql()
    empty = {n for n in set(queries) - set(sql) if not queries[n](spark, "/root/testdata/sf0.001").collect()}
    # These find nothing in the smallest tables.
    assert empty <= {"claims_opposed", "shape_assign", "discover_gaps", "discover_proposals"}
