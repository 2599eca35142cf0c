"""The n-gram Jaccard join over real texts, its hot shingles and shuffled paths, and components, against brute force."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sparrowgrid.llm import components, ngramjoin


def shingle_set(text):
    w = [x for x in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def least_reachable(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in links:
        i, j = root(i), root(j)
        parent[max(i, j)] = min(i, j)
    return {i: root(i) for i in parent}


def all_links(rows):
    """Every link, by counting the shared shingles of all pairs."""
    sets = {i: shingle_set(t) for i, t in rows}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    both = Counter()
    for who in holders.values():
        both.update((i, j) for k, i in enumerate(who) for j in who[k + 1 :])
    return sets, [(i, j) for (i, j), c in both.items() if 100 * c >= 75 * (len(sets[i]) + len(sets[j]) - c)]


@pytest.mark.parametrize("how", ["as set", "hot", "shuffled"])
def test_no_link_of_real_documents_is_lost(spark, monkeypatch, how):
    if how == "hot":
        monkeypatch.setattr(ngramjoin, "SAMPLE", 1)
        monkeypatch.setattr(ngramjoin, "HOT", 6)
    if how == "shuffled":
        monkeypatch.setattr(ngramjoin, "BROADCAST_IDS", 0)
    if how != "as set":
        monkeypatch.setattr(ngramjoin, "RANGE", 20_000)
        monkeypatch.setattr(ngramjoin, "DEAL", 30_000)
        monkeypatch.setattr(ngramjoin, "VERIFY_BYTES", 1 << 16)
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 3000")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    sets, links = all_links(rows)
    assert len(rows) == 3000 and len(links) > 100
    members, found = ngramjoin.join(docs)
    got = members.collect()
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(s) for i, s in sets.items()}
    assert {r.doc_id: r.component_id for r in got} == least_reachable(sets, links)
    assert {(r.u, r.v) for r in found.collect()} <= {(min(p), max(p)) for p in links} | {(max(p), min(p)) for p in links}


def test_partners_share_a_passage_but_no_link(spark):
    """Many unlike documents about one passage: none may link, whatever the passage's share of a prefix."""
    rng = random.Random(3)
    passage = " ".join(f"p{k}" for k in range(60))
    own = lambda k, n: " ".join(f"d{k}x{j}y{rng.randrange(9)}" for j in range(n))
    rows = [(k, f"{own(k, 30)} {passage}") for k in range(150)] + [(200 + k, f"{passage} {own(0, 6)} z{k}") for k in range(40)]
    _, links = all_links(rows)
    got = ngramjoin.join(spark.createDataFrame(rows, "doc_id long, text string"))[0].collect()
    assert {r.doc_id: r.component_id for r in got} == least_reachable([i for i, _ in rows], links)


def test_long_text_and_repeats(spark):
    long = " ".join(f"w{k}" for k in range(60_000))
    rows = [(5, long), (6, long + " tail"), (7, "short"), (7, long.upper()), (8, None), (8, "short"), (None, long)]
    members, links = ngramjoin.join(spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, class string, n int"))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in members.collect()), key=str)
    assert got == sorted([(5, 59_996, 5), (6, 59_997, 5), (7, 1, 5), (7, 59_996, 5), (8, 0, 8), (8, 1, 5), (None, 59_996, None)], key=str)


@pytest.mark.parametrize("partitions", [1, 20])
def test_components_of_chains_and_stars(spark, partitions):
    rng = random.Random(8)
    ids = list(range(400))
    rng.shuffle(ids)
    links = [(ids[k], ids[k + 1]) for k in range(199)] + [(ids[200], ids[k]) for k in range(201, 300)] + [(ids[300], ids[300]), (ids[301], ids[302]), (ids[302], ids[301])]
    got = components.components(spark.createDataFrame([*links, (None, 3), (4, None)], "u long, v long").repartition(partitions))
    want = least_reachable(ids, links)
    assert {r.node: r.component for r in got.collect()} == {i: want[i] for p in links if p[0] != p[1] for i in p}
    assert components.components(got.limit(0).select(F.col("node").alias("u"), F.col("component").alias("v"))).count() == 0
