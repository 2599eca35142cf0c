"""Appended archives, urls and damage of WARC; repeated queries of the search; results that must not depend on partitions."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparrowgrid.llm import brown, decontaminate, quality, topk, warc

from .test_tables import brute


def test_warc_appends_and_overwrites(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    page = lambda *ids: spark.createDataFrame([(i, f"http://a/{i}", "text") for i in ids], "page_id long, url string, html string")
    warc.archive(page(1), path)
    warc.archive(page(2, 3), path)
    assert sorted(r.record_id for r in warc.read(spark, path).collect()) == ["1", "2", "3"]
    warc.archive(page(4), path, mode="overwrite")
    assert [r.record_id for r in warc.read(spark, path).collect()] == ["4"]
    assert len([f for f in (tmp_path / "w").iterdir() if f.name.endswith(".gz")]) == 1


def test_warc_keeps_urls(spark, tmp_path):
    urls = ["http://a/x%20y", "http://a/x y?q=%C3%A9&é=1", "%", "http://a/#<>\"{}|\\^`", "a:b", ""]
    path = f"file://{tmp_path}/u"
    warc.archive(spark.createDataFrame([(i, u, "x") for i, u in enumerate([*urls, " a\nb "])], "page_id long, url string, html string"), path)
    got = {r.record_id: r.target_uri for r in warc.read(spark, path).collect()}
    assert [got[str(i)] for i in range(len(urls))] == urls and got[str(len(urls))] == "%20a%0Ab%20"


def test_warc_reports_damage(spark, tmp_path):
    whole = warc.record("9", "response", "u", None or "da39a3ee5e6b4b0d3255bfef95601890afd80709", b"", None)
    for name, data, said in [
        ("a", whole.replace(b"Content-Length: 78", b"X: 78"), "no Content-Length"),
        ("b", whole[:-30], "ends inside"),
        ("c", whole.replace(b"WARC-Type: response\r\n", b""), None),
    ]:
        (tmp_path / f"{name}.warc").write_bytes(data)
        rows = warc.read(spark, f"file://{tmp_path}/{name}.warc", payload="false")
        if said:
            with pytest.raises(Exception, match=said):
                rows.collect()
        else:
            assert [r.record_type for r in rows.collect()] == [None]


def test_search_with_repeated_queries(spark):
    rows = [(2, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0]), (5, [0.0, 2.0])]
    want = [(2, 1, 5, 8192), (2, 2, 3, 0)]
    for n in (1, 3, 7):
        df = spark.createDataFrame(rows[::-1] if n == 3 else rows, "vec_id long, embedding array<double>").repartition(n)
        assert sorted(map(tuple, topk.search(df, F.col("id") % 2 == 0, k=2).collect())) == want


def test_search_sends_few_blocks(spark, monkeypatch):
    """Vectors of falling lengths: a block of short ones reaches no query, and isn't sent."""
    for name, n in (("BLOCK", 50), ("QUERIES", 20), ("HEAD", 30)):
        monkeypatch.setattr(topk, name, n)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=4) * 1.05**-i * 1e3]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.search(df, F.col("id") % 2 == 0, k=3)
    assert "CartesianProduct" not in got._jdf.queryExecution().toString()
    assert sorted(map(tuple, got.collect())) == brute(rows, 3)


def test_brown_is_the_same_on_any_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = [{r.doc_id: (r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in brown.score(docs.repartition(n), quality.fold(0, 10), context=200, rounds=1).collect()} for n in (1, 7, 200)]
    assert got[0] == got[1] == got[2]


def plain_brown(rows, context, rounds, exchanges):
    """Scores by the definition, with every word in one dictionary: seeds by the library's exchange, other words by a loop over classes."""
    train = [t.split() for _, t, held in rows if not held]
    counts = Counter(w for t in train for w in t)
    code = {w: int(np.uint64(brown.words([w.encode()])[3][0]).view(np.int64)) for w in counts}
    order = sorted(counts, key=lambda w: (-counts[w], code[w]))
    seeds, others = order[:context], order[context:]
    of = {w: k % brown.CLASSES for k, w in enumerate(seeds)}
    kind = lambda w: of.get(w, brown.OTHER)

    def contexts():
        before, after = ({w: np.zeros(brown.KINDS) for w in counts} for _ in range(2))
        moves = np.zeros((brown.KINDS, brown.KINDS))
        for t in train:
            k = [brown.END, *map(kind, t), brown.END]
            for i, w in enumerate(t, 1):
                before[w][k[i - 1]] += 1
                after[w][k[i + 1]] += 1
            np.add.at(moves, (k[:-1], k[1:]), 1)
        return before, after, moves

    def exchange(before, after, into=0.0, out=0.0):
        got = brown.exchange(*(np.array([x[w] for w in seeds]) for x in (before, after)), np.array([of[w] for w in seeds]), into, out)
        of.update(zip(seeds, got[0].tolist(), strict=True))
        return got[1:]

    for _ in range(rounds):
        into, out = exchange(*contexts()[:2])
    before, after, _ = contexts()
    size = np.log(into.sum(0) + 0.5)
    gain = {w: before[w] @ (np.log(into + 0.5) - size) + after[w] @ (np.log(out + 0.5) - size) for w in others}
    of.update({w: int(np.argmax(g)) for w, g in gain.items()})
    for _ in range(exchanges):
        before, after, moves = contexts()
        rest = lambda x, base: base - sum(np.outer(x[w], np.eye(brown.CLASSES)[of[w]]) for w in seeds)
        into, out = exchange(before, after, rest(before, moves[:, : brown.CLASSES]), rest(after, moves[: brown.CLASSES].T))
        new = {}
        for w in others:
            a, b, n = before[w], after[w], counts[w]
            gains = []
            for k in range(brown.CLASSES):
                own = k == of[w]
                x, y = into[:, k] - own * a, out[:, k] - own * b
                gains.append(a @ np.log(x + 0.5) + b @ np.log(y + 0.5) - 2 * n * np.log(into[:, k].sum() - own * n + 0.5))
            new[w] = int(np.argmax(gains))
        of.update(new)
    moves = np.zeros((3, brown.KINDS, brown.KINDS), np.int64)
    for t in train:
        k, once = [brown.END, *map(kind, t), brown.END], [False, *[counts[w] == 1 for w in t], False]
        for i in range(1, len(k)):
            moves[0][k[i - 1], k[i]] += 1
            moves[1][k[i - 1], k[i]] += once[i]
            moves[2][k[i - 1], k[i]] += once[i - 1]
    table, size = brown.transitions(moves), Counter()
    for w, n in counts.items():
        size[of[w]] += n
    fresh = -np.log10(sum(n == 1 for n in counts.values()) + 1)
    out = {}
    for i, t, _ in rows:
        k = [brown.END, *map(kind, t.split()), brown.END]
        out[i] = sum(table[a, b] for a, b in zip(k, k[1:])) + sum(np.log10(counts[w] / size[of[w]]) if w in counts else fresh for w in t.split())
    return out, of


@pytest.mark.parametrize("context, exchanges", [(100, 2), (4, 2), (1, 3), (6, 0)])
def test_brown_score_is_that_of_its_classes(spark, context, exchanges):
    """Words outside the seeds are many times more than those inside, and more than any bucket's; every word is exchanged."""
    rng = np.random.default_rng(6)
    vocabulary = [f"w{k}" for k in range(40)]
    chance = 1 / np.arange(1, 41)
    rows = [(i, " ".join(rng.choice(vocabulary, rng.integers(0, 12), p=chance / chance.sum())) + (f" rare{i}" if i % 9 == 0 else ""), i % 10 == 0) for i in range(120)]
    want, of = plain_brown(rows, context, 2, exchanges)
    seen = []
    df = spark.createDataFrame(rows, "doc_id long, text string, held boolean").repartition(5)
    got = {r.doc_id: r.score for r in brown.score(df, F.col("held"), context=context, rounds=2, exchanges=exchanges, seen=seen).collect()}
    assert got == pytest.approx(want, abs=1e-6) and len(set(of.values())) > 1
    assert len(seen[1]) == min(context, len(of))


def naive_tiles(a, b, least):
    """Greedy string tiling by the definition: mark all longest matches that are still free, then look again."""
    marked_a, marked_b, out = [False] * len(a), [False] * len(b), []
    while True:
        best, found = least, []
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not marked_a[i + n] and not marked_b[j + n]:
                    n += 1
                if n > best:
                    best, found = n, []
                if n == best:
                    found.append((i, j))
        if not found:
            return out
        for i, j in found:
            if not any(marked_a[i : i + best]) and not any(marked_b[j : j + best]):
                marked_a[i : i + best] = marked_b[j : j + best] = [True] * best
                out.append((i, j, best))


def test_tiles_are_greedy_string_tiling():
    rng = np.random.default_rng(5)
    for _ in range(300):
        a, b = (rng.integers(0, 4, rng.integers(1, n)).tolist() for n in (22, 34))
        assert sorted(n for _, _, n in decontaminate.tiles(a, b, 3)) == sorted(n for _, _, n in naive_tiles(a, b, 3))


def test_brown_table_does_not_depend_on_the_split(spark):
    # "every" is the most frequent word of all, but under the cut in each part.
    texts = [" ".join(f"{w}{k}" for w in ("own", "other", "third") for _ in range(4)) + " every x every y every" for k in range(4)]
    rows = spark.createDataFrame([(i, t, i == 8) for i, t in enumerate([*texts, *texts, "own1 every third2"])], "doc_id long, text string, held boolean")
    take = lambda parts: {r.doc_id: round(r.score, 9) for r in brown.score(rows.repartitionByRange(parts, F.col("doc_id") % 4), F.col("held"), context=3).collect()}
    assert take(1) == take(4)
