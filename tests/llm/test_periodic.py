"""Periodic runs against a search of every stretch, on any partitions, by any way of dealing lags, and on odd tables."""

import hashlib
import re
import zlib
from pathlib import Path

import numpy as np
import pytest

from sparrowgrid.llm import periodic, registry

DATA = Path("/root/testdata/sf0.001")


def brute_runs(w):
    """Every maximal stretch by its definition: grown word by word from each pair of equal words."""
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        s = 0
        while s + q < n:
            e = s
            while e + q < n and w[e] == w[e + q]:
                e += 1
            if e - s + q >= max(6, 4 * q):
                part = w[s : e + q]
                if not any(all(part[i] == part[i + p] for i in range(len(part) - p)) for p in range(1, q)):
                    out.append((s, e - s + q, q))
            s = e + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute(doc_id, text, tile=False):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if tile and h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    drop = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in drop)))


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def texts():
    rng = np.random.default_rng(13)
    out = ["", " ", "a", "a a a a a", "a a a a a a", "A a a a a a a", "é é é é é é é", "a b a b a b a b", "a b a b a b a", "x\ta\x0ba\x0ca\ra\na a"]
    for _ in range(150):
        w = list(rng.choice(list("abc"), rng.integers(0, 60)))
        for _ in range(rng.integers(0, 4)):
            unit = list(rng.choice(list("abcd"), rng.integers(1, 6)))
            w += (unit * 9)[: rng.integers(1, 9 * len(unit))] + list(rng.choice(list("ab"), rng.integers(0, 4)))
        out.append(" ".join(w))
    return out


def test_kernels_equal_brute_force():
    words = [np.array([hash(x) & (2**63 - 1) for x in t.split()], np.uint64) for t in texts()]
    want = [brute_runs(list(w)) for w in words]
    assert sum(map(len, want)) > 100
    assert periodic.block_runs(words) == want
    assert [periodic.primitive(periodic.lag_runs(w, 1, len(w))) for w in words] == want
    for width in (1, 3, 7):
        cut = [periodic.primitive([r for low in range(1, len(w) + 1, width) for r in periodic.lag_runs(w, low, low + width)]) for w in words]
        assert cut == want
    assert periodic.block_runs([]) == [] and periodic.block_runs([np.empty(0, np.uint64)]) == [[]]


@pytest.mark.parametrize("long_bytes, work", [(1 << 16, 1 << 32), (30, 64), (0, 1 << 32)])
def test_detect_equals_brute_force(spark, long_bytes, work):
    rows = list(enumerate(texts())) + [(1, "a a a a a a"), (1, "a a a a a a"), (None, "b b b b b b b"), (7, None), (None, None), (900, "k " * 2500), (901, " ".join(str(i % 377) for i in range(3000)))]
    want = sorted(map(repr, (brute(*r) for r in rows)))
    for n in (1, 5):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(n)
        got = periodic.detect(df, texts=False, long_bytes=long_bytes, range_work=work).select(*COLUMNS)
        assert sorted(repr(tuple(r)) for r in got.collect()) == want


def test_clashing_columns_texts_and_empty_tables(spark):
    odd = spark.createDataFrame([(1, "b a a a a a a c", 5, "k", 3)], "doc_id long, text string, id long, key string, start int")
    r = periodic.detect(odd).first()
    assert (r.doc_id, r.runs, r.collapsed, r.n_words) == (1, "1,6,1\n", "b a c", 8)
    r = periodic.detect(odd, long_bytes=0).first()
    assert (r.runs, r.collapsed) == ("1,6,1\n", "b a c")
    assert periodic.detect(odd.limit(0)).collect() == []


def test_very_long_text_in_ranges(spark):
    text = "x " + "lorem ipsum dolor " * 20000 + " ".join(str(i) for i in range(20000)) + " y" * 9
    df = spark.createDataFrame([(5, text)], "doc_id long, text string")
    a, b = (periodic.detect(df, long_bytes=n).first() for n in (1 << 30, 1 << 16))
    assert a == b and a.runs == "1,60000,3\n80001,9,1\n" and (a.start, a.length, a.period) == (1, 60000, 3)


def test_query_equals_brute_force(spark):
    if not DATA.is_dir():
        pytest.skip("no test tables here")
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    # The search of every stretch takes the square of a text; the longest are left to the tests above.
    want = {d.doc_id: brute(d.doc_id, d.text, True) for d in docs if len(d.text or "") < 6000}
    got = {r.doc_id: tuple(r) for r in registry.op13_periodic_runs(spark, str(DATA)).collect()}
    assert len(got) == len(docs) and {k: got[k] for k in want} == want and sum(v[1] > 0 for v in want.values()) > 5
