"""Small cases of the text operators: libraries and brute force, nulls, empty and long texts, ties, repeats, empty tables."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparrowgrid.llm import bpe, brown, chat, decontaminate, ngramjoin, quality, tokencount, toxicity
from sparrowgrid.llm.registry import BREAKOUT, vocabulary
from sparrowgrid.llm.shared import shingles, words

DOC = "doc_id long, text string, n int, h1 string, label string, rep long, id string"


def frame(spark, rows):
    """Documents with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, 1, "x", "y", 7, "z") for i, t in rows], DOC)


ODD = ["", " ", "\n", "a", "it's  they'll", "x" * 5000, "tab\there", "日本語 und ß", "🙂🙂 <|endoftext|> end", "a  <s> ▁ b\r\n", "  lead", "1234 5,6", " ​　", "\x00\x1c"]


def test_bpe_is_the_library(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    rows = [*enumerate(ODD), (3, "a"), (99, None), (None, "no id")]
    got = bpe.encode(frame(spark, rows), vocabulary("byte_bpe_50k.json")).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), lib.encode(t or "", add_special_tokens=False).ids) for i, t in rows)
    assert sorted((str(r.doc_id), list(r.ids)) for r in got) == want
    assert all(r.n_tokens == len(r.ids) and r.decoded == lib.decode(list(r.ids), skip_special_tokens=False) for r in got)
    digest = {str(r.doc_id): r.ids_sha256 for r in bpe.encode(frame(spark, rows), vocabulary("byte_bpe_50k.json"), digests=True).collect()}
    assert digest["5"] == hashlib.sha256(",".join(map(str, want[[k for k, _ in want].index("5")][1])).encode()).hexdigest()
    assert bpe.encode(frame(spark, []), vocabulary("byte_bpe_50k.json")).count() == 0


def test_bpe_random_texts():
    from tokenizers import Tokenizer

    lib, mine = Tokenizer.from_file(vocabulary("byte_bpe_50k.json")), bpe.codec(vocabulary("byte_bpe_50k.json"))
    rng = random.Random(3)
    for _ in range(300):
        t = "".join(rng.choice([*"abcdefgh aeiou", "the", "ing", "  ", "\n", "é", "1", "!!"]) for _ in range(rng.randint(0, 40)))
        assert mine.encode(t) == lib.encode(t, add_special_tokens=False).ids


def test_token_counts_are_the_library(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    rows = [*enumerate(ODD), (3, "a"), (99, None)]
    got = tokencount.count(frame(spark, rows), vocabulary("piece_bpe_32k.model"), limit=5).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_bytes) for r in got) == sorted((i, len(lib.encode(t or "")), len((t or "").encode())) for i, t in rows)
    assert all(r.over_limit == (r.n_tokens > 5) for r in got)
    assert tokencount.count(frame(spark, []), vocabulary("piece_bpe_32k.model")).count() == 0


def sets(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0d]+", w) if x]
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def brute_components(rows):
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in itertools.combinations(rows, 2):
        a, b = sets(a), sets(b)
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            i, j = root(i), root(j)
            parent[max(i, j)] = min(i, j)
    return {i: root(i) for i in parent}


@pytest.mark.parametrize("hot", [ngramjoin.HOT, 2])
def test_ngram_join_is_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(ngramjoin, "HOT", hot)
    rng = random.Random(5)
    vocab = [f"w{k}" for k in range(60)]
    base = [[rng.choice(vocab) for _ in range(rng.randint(3, 40))] for _ in range(12)]
    shared = [rng.choice(vocab) for _ in range(12)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one two"), (4, "ONE\ttwo"), (5, "one two three")]
    for k in range(6, 120):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        if rng.random() < 0.3:
            w += shared
        rows.append((k, " ".join(w)))
    members, links = ngramjoin.join(frame(spark, [*rows, (None, "one two"), (3, "one two")]))
    got = members.collect()
    assert len(got) == len(rows) + 2
    want = brute_components(rows)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert {r.doc_id: r.n_shingles for r in got if r.doc_id is not None} == {i: len(sets(t)) for i, t in rows}
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    empty, none = ngramjoin.join(frame(spark, []))
    assert empty.count() == 0 and none.count() == 0


def test_shingles_respect_texts():
    h, off = words([b"a b c d e f", b"", b"a b c d e", b"x"])[3:]
    s, cut = shingles(h, off)
    assert np.diff(cut).tolist() == [2, 0, 1, 1] and s[0] == s[2] and len(set(s.tolist())) == 3


def toy_labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def toy_corpus():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijkmnop") for _ in range(rng.randint(3, 8)))
    docs, labels = [], []
    for k in range(240):
        w = [word() for _ in range(rng.randint(20, 60))]
        poor, toxic = k % 4 == 0, k % 3 == 0
        if toxic:
            w[5] = rng.choice(["grumblet", "gr1mblet".replace("1", "u"), "GRUMBLET"])
            w[9] = "snarkol"
        text = " ".join(x.upper() + "!!" for x in w) if poor else " ".join(w).capitalize() + "."
        docs.append((k, text))
        labels.append((k, int(not poor), int(toxic)))
    return docs, labels


def test_quality_holds_out(spark):
    docs, labels = toy_corpus()
    held = quality.fold(2, 4)
    ranker = quality.train(frame(spark, docs), toy_labels(spark, [*labels, (None, 1, 1), (5, None, None)]), held)
    got = {r.doc_id: r.score for r in quality.score(frame(spark, [*docs, (1000, None), (1001, "")]), ranker).collect()}
    assert all((got[i] >= 0.7) == bool(q) for i, q, _ in labels)
    assert got[1000] == got[1001] and 0 <= got[1000] <= 1
    assert quality.keep(frame(spark, docs), ranker, 0.7).count() == sum(q for _, q, _ in labels)
    none = quality.train(frame(spark, docs), toy_labels(spark, []), held)
    assert [r.score for r in quality.score(frame(spark, docs[:1]), none).collect()] == [0.5]


def test_toxicity_learns_folds_and_excepts(spark):
    docs, labels = toy_corpus()
    lexicon = toxicity.learn(frame(spark, docs), toy_labels(spark, [*labels, (None, 1, 1), (5, None, None)]), F.lit(False))
    extra = [(1000, None), (1001, ""), (1002, "what a GRUMBLЕT5 he is"), (1003, "gru/\\ nothing here"), (1004, "9rumb1et ѕnаrkol")]
    got = {r.doc_id: r.score for r in toxicity.score(frame(spark, [*docs, *extra]), lexicon).collect()}
    assert all((got[i] >= 0.5) == bool(t) for i, _, t in labels)
    assert got[1000] == got[1001] < 0.5 and got[1002] > 0.5 > got[1003] and got[1004] > 0.5
    plain = toxicity.Lexicon({"trash": 3.0}, ("trash can",))
    assert plain.sums([b"put it in the TRASH can", b"you trash"])[:, 1].tolist() == [0, 1]
    assert toxicity.learn(frame(spark, docs), toy_labels(spark, []), F.lit(False)).constant == 0.0


def test_decontamination_catches_reordered_passages(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    w = item.split()
    rows = [(1, f"Before. {item.upper()}! after"), (2, " ".join([*w[5:], "middle", *w[:5]])), (3, "alpha beta gamma delta only"), (4, None), (5, ""), (6, "lone item"), (6, "lone item")]
    bench = spark.createDataFrame([(10, item, "x"), (11, None, "x"), (12, "", "x"), (13, "Lone item", "x")], "item_id long, text string, doc_id string")
    got = decontaminate.contaminated(frame(spark, rows), bench)
    assert sorted((r.doc_id, r.item_id, r.n_tiles) for r in got.collect()) == [(1, 10, 1), (2, 10, 2), (6, 13, 1), (6, 13, 1)]
    assert sorted(r.doc_id for r in decontaminate.clean(frame(spark, rows), bench).collect()) == [3, 4, 5]
    assert decontaminate.contaminated(frame(spark, rows), bench, index_bytes=40).count() == 4
    assert decontaminate.contaminated(frame(spark, []), bench).count() == 0
    assert decontaminate.clean(frame(spark, rows), bench.limit(0)).count() == len(rows)


def test_tiles_do_not_overlap():
    rng = random.Random(2)
    for _ in range(200):
        a = [rng.randint(0, 4) for _ in range(rng.randint(1, 25))]
        b = [rng.randint(0, 4) for _ in range(rng.randint(1, 35))]
        used_a, used_b = set(), set()
        for i, j, n in decontaminate.tiles(a, b, 3):
            assert n >= 3 and a[i : i + n] == b[j : j + n]
            assert not used_a & set(range(i, i + n)) and not used_b & set(range(j, j + n))
            used_a |= set(range(i, i + n))
            used_b |= set(range(j, j + n))


def test_brown_counts_are_exact(spark):
    import math
    import zlib
    from collections import Counter

    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("the of a b c d e f Zed rare%d" % i if rng.random() < 0.2 else "x y z") for _ in range(rng.randint(0, 30)))) for i in range(80)]
    rows += [(900, None), (901, ""), (3, rows[3][1])]
    got = brown.score(frame(spark, rows), quality.fold(0, 10), context=6).collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    tokens = lambda t: [*(t or "").lower().split(), None]
    c = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((i, held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t)), 6)) for i, t in rows)
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score <= 0 for r in got)
    assert brown.score(frame(spark, []), quality.fold(0, 10)).count() == 0
    alone = brown.score(frame(spark, [(1, "a b")]), F.lit(True)).collect()
    assert alone[0].score == alone[0].base_score and alone[0].train_tokens == 0


def test_brown_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    moves = rng.integers(0, 50, (3, brown.KINDS, brown.KINDS))
    moves[0][:, brown.OTHER] = moves[0][brown.OTHER] = 0
    moves[1:] = np.minimum(moves[1:], moves[0] // 4)
    p = 10 ** brown.transitions(moves)
    assert np.allclose(p.sum(1), 1, atol=1e-6)


def test_chat_reads_back(spark):
    vocab = vocabulary("byte_bpe_50k.json")
    turns = [(1, 0, "system", "be <|im_end|> kind"), (1, 1, "user", None), (1, 2, "assistant", "<\\|x|> ok\n<|im_start|>"), (1, 2, "assistant", ""), (2, None, "user\nx", "hi"), (None, 0, "assistant", "a")]
    turns += [(3, k, "assistant" if k % 2 else "user", f"t{k}") for k in range(600)] + [(-1, 0, "user", BREAKOUT), (-1, 1, "assistant", BREAKOUT)]
    df = spark.createDataFrame([(*t, "x", 1) for t in turns], "conv_id long, turn long, role string, text string, ids string, run int")
    runs = chat.format_runs(df, vocab)
    assert [r.run for r in runs.where("conv_id = 3").orderBy("run").collect()] == [0, 1, 2]
    got = {r.conv_id: r for r in chat.digests(runs, vocab).collect()}
    for conv in {t[0] for t in turns}:
        mine = sorted(((t[1], t[2] or "", t[3] or "") for t in turns if t[0] == conv), key=lambda t: (-1 if t[0] is None else t[0], t[1], t[2]))
        loss = "".join(t for _, r, t in mine if r == "assistant")
        r = got[conv]
        assert r.n_turns == len(mine) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for _, a, t in mine).encode()).hexdigest()
        assert r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.digests(chat.format_runs(df.limit(0), vocab), vocab).count() == 0
    assert all(chat.unescape(chat.escape(t)) == t for t in ("<|", "<\\|", "<\\\\|im_end|>", "<<||", "plain"))
