"""Transplant plans, shortlists, arm scores, cell tables and deviations against plain computations."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from sparrowgrid.operators import descriptors, discovery, ngram, sequence, transplant


def test_plan_keeps_rewrites_creates_and_lists(spark):
    f = spark.createDataFrame
    node = lambda p: ("x", p, p.rsplit("/", 1)[-1].replace(".", "_").split("_"))
    donors = [node(p) for p in ("src", "src/pump_core.rs", "src/valve.rs", "docs", "docs/deep", "docs/deep/er", "docs/deep/er/a.md", "docs2", "z/lone.md")]
    recipients = [node(p) for p in ("src", "src/pump.rs", "src/valve.rs", "old", "old/b.rs")]
    pairs = [("x", "src", "src"), ("x", "src/pump_core.rs", "src/pump.rs"), ("x", "src/valve.rs", "src/valve.rs"), ("x", "src/valve.rs", "src/valve.rs"), ("x", "gone", "src")]
    schema = "project string, path string, tokens array<string>"
    got = transplant.plan(f(donors, schema), f(recipients, schema), f(pairs, "project string, donor string, recipient string")).collect()
    kept = [("keep", "src"), ("keep", "src/valve.rs"), ("rewrite", "src/pump.rs")]
    assert sorted((r.op, r.path) for r in got) == [("create", "docs"), ("create", "docs2"), ("create", "z/lone.md"), *kept, ("unaligned", "old"), ("unaligned", "old/b.rs")]
    assert {(r.donor, tuple(r.adaptations)) for r in got if r.op != "rewrite"} == {(None, ())} and [r.donor for r in got if r.op == "rewrite"] == ["src/pump_core.rs"]
    assert {tuple(r.adaptations) for r in got if r.op == "rewrite"} == {("core",)}


def test_shortlist_equals_brute_force(spark):
    rng = random.Random(5)
    words = ["pump", "valve", "rotor", "garden", "maple", "ledger", "invoice", "audit"]
    entries = [(rng.randint(0, 2), rng.randint(0, 2), [rng.gauss(0, 1) for _ in range(4)], " ".join(rng.sample(words, 2)), rng.sample(words, 2)) for _ in range(20)]
    groups = [(i, [rng.gauss(0, 1) for _ in range(4)], " ".join(rng.sample(words, 2)), rng.sample(words, 3)) for i in range(8)] + [(9, [1.0, 0.0, 0.0, 0.0], "Unknown & word", None)]
    f = spark.createDataFrame
    got = discovery.shortlist(f(groups, "id long, v array<double>, name string, hints array<string>"), f(entries, "domain long, mode long, v array<double>, name string, hints array<string>"), 3).collect()

    def field(name, hints):
        out = {w: 0.5 for h in hints or [] for w in h.split()}
        return out | {w.lower(): 1.0 for w in name.split() if w != "&"}

    cells = defaultdict(list)
    for e in entries:
        cells[e[:2]].append(e)
    index = {c: {w: max(field(e[3], e[4]).get(w, 0) for e in es) for w in words} for c, es in cells.items()}
    unit = lambda x: x / np.linalg.norm(x)
    want = []
    for i, v, name, hints in groups:
        near = {c: round(float(unit(np.array(v)) @ unit(np.mean([e[2] for e in es], 0))), 9) for c, es in cells.items()}
        said = {}
        for c, has in index.items():
            shared = [w for w in field(name, hints) if has.get(w)]
            if shared:
                said[c] = round(sum(field(name, hints)[w] * has[w] * math.log(1 + len(cells) / sum(1 for h in index.values() if h.get(w))) for w in shared), 9)
        a = {c: k for k, c in enumerate(sorted(near, key=lambda c: (-near[c], c)), 1)}
        b = {c: k for k, c in enumerate(sorted(said, key=lambda c: (-said[c], c)), 1)}
        score = {c: round(1 / (60 + a[c]) + (1 / (60 + b[c]) if c in b else 0), 9) for c in cells}
        want += [(i, *c, k) for k, c in enumerate(sorted(cells, key=lambda c: (-score[c], c))[:3], 1)]
    assert sorted((r.id, r.domain, r.mode, r["rank"]) for r in got) == sorted(want)


def test_arm_score_counts_preserved_edges(spark):
    f = spark.createDataFrame
    found = f([(0, 0, 1), (0, 1, 2), (1, 2, 1), (1, 1, 2), (2, 1, 1), (2, 3, 2), (3, 0, 1), (3, 2, 3)], "i long, j long, rank int")
    left, right = f([(0, 1), (1, 0), (1, 2), (2, 3), (3, 9)], "i long, j long"), f([(2, 0), (2, 1)], "i long, j long")
    r = descriptors.arm_score(found, left, right).first()
    # 0-1 maps to 0-2 (there), 1-2 to 2-1 (there), 2-3 to 1-0 (not), 3-9 to 0-9 (not).
    assert (r.n, r.top1, r.top3, r.preservation) == (4, 0.25, 0.5, 0.5) and 0 <= r.low <= 0.25 <= r.high <= 1
    empty = descriptors.arm_score(found.limit(0), left.limit(0), right).first()
    assert (empty.n, empty.top1, empty.preservation) == (0, 0.0, 0.0)


@pytest.mark.parametrize("order", [2, 3])
def test_cell_tables_and_look_ups(spark, order):
    rng = random.Random(order)
    seqs = {s: [rng.choice("abc" if s else "abcd") for _ in range(rng.randint(1, 14))] for s in range(12)}
    steps = spark.createDataFrame([(s, i, x) for s, t in seqs.items() for i, x in enumerate(t)], "seq long, pos long, symbol string")
    cells, flat, support = Counter(), Counter(), Counter()
    grams = lambda t: [(n, " ".join(t[i : i + n - 1]), t[i + n - 1]) for n in range(1, order + 1) for i in range(len(t) - n + 1)]
    for t in seqs.values():
        flat.update(grams(t))
        for i, x in enumerate(t):
            support[x] += 1
            w = t[max(0, i - order) : i + 2]
            if len(w) > 1:
                cells.update((x, *g) for g in grams(w))
    tables = ngram.cell_tables(steps, "seq", "pos", "symbol", order)
    assert {(r.cell, r.n, r.context, r.next): r.cnt for r in tables[0].collect()} == cells
    assert {(r.n, r.context, r.next): r.cnt for r in tables[1].collect()} == flat and {r.cell: r.support for r in tables[2].collect()} == support
    contexts = [(0, []), (1, ["a"]), (2, ["b", "d"]), (3, ["c", "a", "b"]), (4, ["zz"]), (5, ["zz", "a"]), (6, ["d", "d", "d"])]
    least = sorted(support.values())[1]
    want = set()
    for i, c in contexts:
        use = c and support[c[-1]] >= least
        for n in range(min(len(c) + 1, order), 0, -1):
            end = " ".join(c[len(c) + 1 - n :])
            have = {k[3]: v for k, v in cells.items() if k[:3] == (c[-1], n, end)} if use else {k[2]: v for k, v in flat.items() if k[:2] == (n, end)}
            if have:
                best = sorted(have, key=lambda x: (-have[x], x))[:2]
                want |= {(i, x, round(have[x] / sum(have.values()), 9), k, "cell" if use else "flat") for k, x in enumerate(best, 1)}
                break
    got = ngram.cell_next(spark.createDataFrame(contexts, "id long, context array<string>"), tables, order, 2, least).collect()
    assert {(r.id, r.next, round(r.p, 9), r["rank"], r.source) for r in got} == want


def test_deviations_are_taken_up_or_not(spark):
    rng = np.random.default_rng(9)
    rows, centres = [], rng.normal(size=(3, 6)) * 3
    for i in range(150):
        v = centres[i % 3] + rng.normal(size=6)
        if i % 11 == 0:
            v = -centres[i % 3] + rng.normal(size=6) * (0.1 if i > 60 else 2)
        rows.append((i, i % 3, 1000 - i, [float(x) for x in v]))
    rows += [(500, 7, 1, [1.0] * 6), (501, 7, 2, [-1.0] * 6), (502, 0, 5, None), (503, None, 5, [1.0] * 6)]
    want = {}
    for key in range(3):
        mine = sorted((r for r in rows if r[1] == key and r[3]), key=lambda r: r[2])
        u = np.array([r[3] for r in mine])
        u /= np.linalg.norm(u, axis=1)[:, None]
        c = u.mean(0) / np.linalg.norm(u.mean(0))
        s = u @ c
        for i in np.flatnonzero(s < s.mean() - s.std()):
            want[mine[i][0]] = "variation" if any(u[i] @ u[j] > s[j] for j in range(i + 1, len(mine))) else "mistake"
    got = sequence.deviations(spark.createDataFrame(rows, "id long, key long, at long, v array<double>"), "key", "at", "v", "id")
    assert {r.id: r.kind for r in got.collect()} == want and set(want.values()) == {"variation", "mistake"}


@pytest.mark.parametrize("block", [7, 100, 10_000])
def test_leaders_of_chains_and_random_pairs(spark, block, monkeypatch):
    rng = random.Random(block)
    rounds = []
    real = discovery.cut
    monkeypatch.setattr(discovery, "cut", lambda df: rounds.append(1) or real(df))
    n = 2000 if block >= 100 else 40
    chain = [(10 * k, 10 * k + 10) for k in range(n)]
    some = [tuple(sorted(rng.sample(range(10 * n + 1000, 10 * n + 1300, 3), 2))) for _ in range(300)]
    ids = sorted({x for p in chain + some for x in p} | {10 * n + 5000})
    by = defaultdict(set)
    for i, j in chain + some:
        by[j].add(i)
    want = {}
    for j in ids:
        want[j] = next((i for i in sorted(by[j]) if want[i] == i), j)
    f = spark.createDataFrame
    got = discovery.leaders(f([(i,) for i in ids], "id long"), f(chain + some, "i long, j long").repartition(3), block)
    assert {r.id: r.leader for r in got.collect()} == want
    # A round for each block that a chain runs through, at most.
    assert len(rounds) <= 6 + 2 * (-(-len(ids) // block))


def test_two_means_by_sums_equal_those_of_one_task(spark):
    from sparrowgrid.operators import greedy

    rng = np.random.default_rng(4)
    rows = []
    for key in range(8):
        centres = rng.normal(size=(2, 5))
        n = [3, 6, 40, 40, 60, 25, 30, 12][key]
        for i in range(n):
            which = [0, i % 2, i >= n // 2, i % 2, i % 7 == 0, 0, (i // 5) % 2, 0][key]
            rows.append((key, 100 - i, [float(x) for x in (centres[int(which)] + rng.normal(size=5) * 0.2 if key != 7 else np.ones(5))]))
    df = spark.createDataFrame(rows, "key long, at long, v array<double>")
    take = lambda f: sorted((r.key, r.n, r.verdict, round(r.separation, 5), round(r.z, 5)) for r in f.collect())
    got = take(sequence.two_means(df.repartition(3), "key", "at", "v"))
    assert got == take(greedy.two_means(df, "key", "at", "v")) and {r[2] for r in got} == {"too-few", "stable", "becoming", "split"}


def test_permutation_null_tells_groups_from_noise(spark):
    from sparrowgrid.operators import controls

    rng = np.random.default_rng(1)
    centres = rng.normal(size=(4, 6))
    grouped = [(i, i % 4, [float(x) for x in centres[i % 4] + rng.normal(size=6) * 0.1]) for i in range(120)]
    noise = [(i, int(rng.integers(0, 4)), [float(x) for x in rng.normal(size=6)]) for i in range(120)]
    a, b = (controls.permutation_null(spark.createDataFrame(r, "id long, label long, v array<double>"), "id", "label", "v", 20).first() for r in (grouped, noise))
    assert a.fitness == 1.0 and a.above_null and a.z > 5 and 0.1 < a.null_mean < 0.4
    # Nearest others of noise have its label by chance; each permutation deals every label as often as it is there.
    assert abs(b.z) < 4 and b.fitness < 0.5
