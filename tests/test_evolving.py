"""States of sequences, cascades and overlays against plain walks over rows."""

import random

import pytest

from sparrowgrid.operators import cascade, overlay, sequence


def plain_states(rows, gap):
    """``(pos, text, entities, fact)`` in order to labels, with the state carried along."""
    last, facts, pairs, out = {}, set(), {}, []
    for pos, text, entities, fact in rows:
        since = [pos - last[e] for e in entities if e in last]
        stale = bool(since) and min(since) > gap
        if any(c in (text or "").lower() for c in sequence.GONE):
            label = "disappear"
        elif any(e not in last for e in entities):
            label = "emerge"
        elif fact:
            if fact in facts:
                label = "recur" if stale else "persist"
            elif pairs.get((fact[0], fact[2]), fact[1]) != fact[1]:
                label = "change"
            else:
                label = "recur" if stale else "change"
        else:
            label = "recur" if stale else "persist" if entities else "none"
        out.append(label)
        last.update(dict.fromkeys(entities, pos))
        if fact:
            facts.add(fact)
            pairs[fact[0], fact[2]] = fact[1]
    return out


@pytest.mark.parametrize("gap", [2, 6])
def test_states_equal_a_walk_with_state(spark, gap):
    rng = random.Random(gap)
    places, mentions, facts, want = [], [], [], {}
    for seq in range(25):
        rows = []
        for pos in range(30):
            entities = rng.sample("abcd", rng.randint(0, 2))
            fact = (rng.choice("ab"), rng.choice(["needs", "feeds"]), rng.choice("cd")) if rng.random() < 0.5 else None
            text = rng.choice(["The pump STOPS now", "all is well", "", None]) if rng.random() < 0.2 else "it runs"
            rows.append((pos, text, entities, fact))
            places.append((seq, pos, text))
            mentions += [(seq, pos, e) for e in entities] * 2
            facts += [(seq, pos, *fact)] if fact else []
        want |= {(seq, r[0]): x for r, x in zip(rows, plain_states(rows, gap), strict=True)}
    assert set(want.values()) == {"emerge", "persist", "change", "recur", "disappear", "none"}
    f = spark.createDataFrame
    got = sequence.states(f(places, "seq long, pos long, text string"), f(mentions, "seq long, pos long, entity string"), f(facts, "seq long, pos long, s string, p string, o string"), gap)
    assert {(r.seq, r.pos): r.label for r in got.collect()} == want


def fitness(h, ev, preds):
    sup, con = [e for e in ev if e[1]], [e for e in ev if not e[1]]
    clamp = lambda x: min(1.0, max(0.0, x))
    empirical = clamp(0.5 + 0.5 * (sum(e[2] for e in sup) - sum(e[2] for e in con)) / len(ev)) if ev else 0.5
    known = [p for p in preds if p is not None]
    predictive = sum(known) / len(known) if known else 0.5
    total = 0.2 * h[1] + 0.15 * h[2] + 0.15 * h[3] + 0.25 * empirical + 0.25 * predictive
    return clamp(total - min(0.1 * len(con), 0.4) - min(0.15 * (len(known) - sum(known)), 0.5))


def plain_cascade(hyps, evidence, preds, refs, depends, vouched, sources):
    left = {h[0]: [e for e in evidence if e[0] == h[0]] for h in hyps}
    kinds = {h[0]: h for h in hyps}
    tally = {k: ([(0, s, c) for _, s, c, _ in v]) for k, v in left.items()}
    touched, lost, fallen, gone = {}, {}, set(), set(sources)
    front, last, hop = set(sources), set(), 0
    while True:
        down = set()
        for h, ev in left.items():
            if hit := [e for e in ev if e[3] in front]:
                left[h] = [e for e in ev if e[3] not in front]
                touched.setdefault(h, hop)
                had = any(e[0] == h and e[1] for e in evidence)
                if had and not any(e[1] for e in left[h]) and kinds[h][4] != "certified" and h not in fallen:
                    down.add(h)
                assert hit
        fallen |= down
        nodes = {n for h, n in refs if h in down} | {s for s, t in depends if t in last}
        last = nodes - set(lost)
        if not last:
            break
        hop += 1
        lost |= dict.fromkeys(last, hop)
        front = {s for n, s in vouched if n in last} - gone
        gone |= front
    out = {}
    for h, first in touched.items():
        ev = [(0, s, c) for _, s, c, _ in left[h]]
        old = kinds[h][4]
        new = old if old == "certified" else "contradicted" if any(not e[1] for e in ev) else "supported" if ev else "candidate"
        p = [x for i, x in preds if i == h]
        out[h] = (first, len(tally[h]) - len(ev), old, new, round(fitness(kinds[h], tally[h], p), 9), round(fitness(kinds[h], ev, p), 9))
    return out, lost


@pytest.mark.parametrize("seed", [4, 21, 23])
def test_cascade_equals_a_plain_walk_on_cyclic_graphs(spark, seed):
    rng = random.Random(seed)
    n = 40
    hyps = [(i, rng.random(), rng.random(), rng.random(), rng.choice(["supported", "supported", "contradicted", "certified"])) for i in range(n)]
    evidence = [(i, rng.random() < 0.8, round(rng.random(), 3), f"s{rng.randint(0, 14)}") for i in range(n) for _ in range(rng.randint(0, 2))]
    preds = [(i, rng.choice([0, 1, None])) for i in range(n) for _ in range(rng.randint(0, 2))]
    refs = [(i, rng.randint(0, 19)) for i in range(n) for _ in range(rng.randint(0, 2))]
    # A ring, and edges into it: dependence has cycles.
    depends = [(k, (k + 1) % 4) for k in range(4)] + [(rng.randint(4, 19), rng.randint(0, 19)) for _ in range(8)]
    vouched = [(k, f"s{k}") for k in range(0, 20, 2)]
    want, lost_want = plain_cascade(hyps, evidence, preds, refs, depends, vouched, {"s1", "s3", "s5", "s7"})
    f = spark.createDataFrame
    frames = (
        f(hyps, "h_id long, semantic_fit double, ontological_fit double, logical_consistency double, status string"),
        f([(h, k, s, c, x) for k, (h, s, c, x) in enumerate(evidence)], "h_id long, ord long, supports boolean, confidence double, source string"),
        f([(h, k, None if c is None else bool(c)) for k, (h, c) in enumerate(preds)], "h_id long, idx long, correct boolean"),
        f(refs, "h_id long, node long"), f(depends, "source long, target long"), f(vouched, "node long, source string"), f([("s1",), ("s3",), ("s5",), ("s7",), ("s3",), (None,)], "source string"),
    )
    touched, lost = cascade.retract(*frames)
    got = {r.h_id: (r.hop, r.retracted, r.status_before, r.status_after, round(r.fitness_before, 9), round(r.fitness_after, 9)) for r in touched.collect()}
    assert got == want and {r.node: r.hop for r in lost.collect()} == lost_want
    assert max(lost_want.values(), default=0) >= 4
    nothing, none_lost = cascade.retract(*frames[:-1], f([("nobody",)], "source string"))
    assert nothing.count() == 0 and none_lost.count() == 0


def test_stacked_overlays_read_like_a_rewritten_copy(spark):
    # With this setting, Spark 4.1 pairs the wrong partitions of a union; operators turn it off.
    spark.conf.set("spark.sql.unionOutputPartitioning", "true")
    rng = random.Random(4)
    copy = {i: (f"l{i}", float(i)) for i in range(60)}
    f, schema = spark.createDataFrame, "id long, label string, x double"
    base = f([(i, *v) for i, v in copy.items()], schema)
    whole = dict(copy)
    layered = overlay.Overlay(base, "id")
    for step in range(7):
        keys = rng.sample(range(80), 15)
        if step % 3 == 0:
            rows = [(k, f"p{step}", None if k % 2 else 0.5) for k in keys]
            layered = layered.put(f(rows, schema))
            whole |= {k: (a, b) for k, a, b in rows}
        elif step % 3 == 1:
            rows = [(k, None if k % 2 else f"q{step}", float(step) if k % 3 else None) for k in keys]
            layered = layered.patch(f(rows, schema))
            for k, a, b in rows:
                if k in whole:
                    whole[k] = (a if a is not None else whole[k][0], b if b is not None else whole[k][1])
        else:
            layered = layered.drop(f([(k,) for k in keys], "id long"))
            whole = {k: v for k, v in whole.items() if k not in keys}
        plain = {r.id: (r.label, r.x) for r in layered.read().collect()}
        assert plain == whole
        if step == 3:
            layered = layered.flat()
            assert len(layered.layers) == 1 and {r.id: (r.label, r.x) for r in layered.read().collect()} == whole
    some = f([(3,), (61,), (61,), (999,)], "id long")
    assert {r.id for r in layered.read(some).collect()} == {3, 61, 999} & set(whole)
    assert {r.id: (r.label, r.x) for r in base.collect()} == copy and overlay.Overlay(base, "id").read().count() == 60
    with pytest.raises(ValueError):
        layered.put(f([(1, 2)], "id long, other int"))


def test_layers_with_repeated_and_null_keys(spark):
    base = spark.createDataFrame([(1, "a"), (None, "n")], "id long, label string")
    rows = spark.createDataFrame([(1, "b"), (1, "c"), (None, "z")], "id long, label string")
    assert sorted(map(tuple, overlay.Overlay(base, "id").put(rows).read().collect()), key=repr) == [(1, "c"), (None, "n")]


def test_longest_chains_end(spark):
    """A chain of dependence is walked to its end; nothing is lost twice."""
    f = spark.createDataFrame
    hyps = f([(0, 0.5, 0.5, 0.5, "supported")], "h_id long, semantic_fit double, ontological_fit double, logical_consistency double, status string")
    ev = f([(0, 0, True, 1.0, "s")], "h_id long, ord long, supports boolean, confidence double, source string")
    preds = f([], "h_id long, idx long, correct boolean")
    chain = f([(k + 1, k) for k in range(6)] + [(0, 6)], "source long, target long")
    touched, lost = cascade.retract(hyps, ev, preds, f([(0, 0)], "h_id long, node long"), chain, f([(6, "s")], "node long, source string"), f([("s",)], "source string"))
    assert {r.node: r.hop for r in lost.collect()} == {k: k + 1 for k in range(7)}
    assert [tuple(r)[1:5] for r in touched.collect()] == [(0, 1, "supported", "candidate")]


def test_nodes_are_registered_edited_and_deleted(spark):
    from sparrowgrid.operators import nodes

    f, schema = spark.createDataFrame, "id long, label string, v array<double>"
    old = f([(1, "a", [1.0, 0.0]), (2, "b", [0.0, 1.0]), (3, "b → x", [1.0, 1.0]), (4, None, [1.0, 0.0])], schema)
    new = f([(10, "a", [0.0, 1.0]), (11, "c", [1.0, 0.0]), (12, "c", [0.0, 1.0]), (13, None, [0.0, -1.0])], schema)
    got = {r.id: (r.node, r.fresh, r.coherence if r.coherence is None else round(r.coherence, 6)) for r in nodes.register(old, new).collect()}
    # 11 is near 1, 4 (1), 3 (0.707107), 2 and 13 (0); 13 has nothing near it.
    assert got == {10: (1, False, None), 11: (11, True, round((1 + 1 + 0.5**0.5) / 5, 6)), 12: (11, False, None), 13: (13, True, 0.0)}
    now, changed = nodes.edit(old, f([(2, "z", [1.0, 0.0]), (99, "no", None)], schema))
    assert {r.id: (r.label, r.v) for r in now.read().collect()}[2] == ("z", [1.0, 0.0]) and [(r.id, round(r.coherence, 6)) for r in changed.collect()] == [(2, round((1 + 1 + 0.5**0.5) / 3, 6))]
    assert sorted(r.id for r in nodes.delete(old, "b").read().collect()) == [1, 4]


def test_antecedent_scores_have_their_interval(spark):
    m = spark.createDataFrame([(s, p, e) for s in range(30) for p, es in enumerate(["ab", "c", "ab", "ac", "abc"]) for e in es], "seq long, pos long, entity string")
    r = sequence.antecedent_scores(sequence.by_shared(m), sequence.antecedents(m)).first()
    # Place 2 shares a, b with 0; 3 is nearest to 2 (a) as to 1 (c): equal, the nearer first; 4 shares two with 3 and with 2: the nearer first.
    assert (r.queries, r.top1, r.top3) == (90, 1.0, 1.0) and r.low == r.high == 1.0
    none = sequence.antecedent_scores(sequence.by_shared(m.limit(0)), sequence.antecedents(m.limit(0))).first()
    assert (none.queries, none.top1) == (0, 0.0)


def test_predictions_take_their_first_outcome(spark):
    from sparrowgrid.operators import journal

    p = spark.createDataFrame([("a", 0, None), ("a", 1, True), ("b", 0, None)], "h_id string, idx int, correct boolean")
    o = spark.createDataFrame([("a", 0, False, 2), ("a", 0, True, 5), ("a", 0, None, 1), ("a", 1, False, 1), ("a", 7, True, 1), ("z", 0, True, 1)], "h_id string, idx int, correct boolean, at int")
    now, refused = journal.resolve_predictions(p, o)
    assert sorted((r.h_id, r.idx, r.correct, r.observed_at) for r in now.collect()) == [("a", 0, False, 2), ("a", 1, True, None), ("b", 0, None, None)]
    why = "already resolved", "no such prediction", "no outcome"
    assert sorted((r.h_id, r.idx, r.at, r.why) for r in refused.collect()) == [("a", 0, 1, why[2]), ("a", 0, 5, why[0]), ("a", 1, 1, why[0]), ("a", 7, 1, why[1]), ("z", 0, 1, why[1])]
