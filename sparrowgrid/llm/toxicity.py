"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding: A-Z to lower case, look-alike letters of other scripts to Latin ones, digits and signs that stand for letters
to those letters (``$``, ``!`` and ``@`` only before a letter, so that punctuation stays punctuation), l to i as ``1``
stands for either, and everything that is no letter to single spaces. Lexicon entries are beginnings of words or whole
words. A match inside an exception phrase doesn't count. The sum of the matched weights, as it is and over the number
of words, goes through a logistic function.

``learn`` makes the lexicon from a bounded sample of labelled documents: beginnings and whole words whose document
frequencies in toxic and other documents differ by more than chance explains for that many candidates, weighted by
log odds. Entries that begin each other are one entry. Of copies and most near copies of a text (one least shingle hash) one counts.

Nulls: a null text is the empty text; it has no match and so the score of a document without one. A null label is not
used. Without a toxic or a clean document in the sample the lexicon is empty and the score is the share of toxic ones
(0 for an empty sample). Ties get equal scores; repeated rows stay; further columns are left out. An empty table gives
an empty table.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrowgrid.llm.features import logistic, sample_ids
from sparrowgrid.llm.shared import batches, chunks, lean, release, shingles, signed, small_batches, texts_of, words, written

#: Labelled documents that are learnt from at most.
MOST = 20_000
#: Lengths of beginnings of words, in letters.
SHORTEST, LONGEST = 3, 12
#: Phrases in which a matched word is harmless.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "circus clown", "class clown", "rodeo clown")

#: Digits and signs that stand for letters (fixed values).
DIGITS = {"0": "o", "1": "i", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g"}
SIGNS = {"$": "s", "!": "i", "@": "a", "|": "i"}
#: Letters of other scripts by the Latin letter that they look like (fixed values).
LOOKALIKES = {
    "a": "аαɑ", "b": "ьЬВβ", "c": "сϲ", "d": "ԁ", "e": "еєεɛ", "g": "ɡ", "h": "һнН", "i": "іιıɪӏ", "j": "јϳ", "k": "кκ", "m": "мМ", "n": "ոηп",
    "o": "оοσօ", "p": "рρ", "q": "ԛ", "r": "гԻ", "s": "ѕꜱ", "t": "тτ", "u": "υսц", "v": "ѵν", "w": "ԝω", "x": "хχ", "y": "уүγ", "z": "ᴢ",
}


def _letters() -> dict[int, str]:
    out = {}
    for latin, others in LOOKALIKES.items():
        for c in others:
            out[ord(c)] = out[ord(c.upper()) if len(c.upper()) == 1 else ord(c)] = latin
    for i in range(26):
        out[0xFF21 + i] = out[0xFF41 + i] = chr(97 + i)
    return out


FOREIGN = _letters()
#: First bytes of the UTF-8 forms of those letters; a text without any of them needs no second look.
LEADS = frozenset(chr(c).encode()[0] for c in FOREIGN)


def _table() -> bytes:
    out = bytearray(range(256))
    for i in range(128):
        c = chr(i)
        low = c.lower() if c.isalpha() else DIGITS.get(c, c if c in SIGNS else " ")
        out[i] = ord("i" if low == "l" else low)
    return bytes(out)


TABLE = _table()
_IS_LETTER = np.array([97 <= i <= 122 or i >= 128 for i in range(256)])
_SIGN = np.zeros(256, np.uint8)
for _s, _l in SIGNS.items():
    _SIGN[ord(_s)] = ord(_l)
_LEAD = np.zeros(256, bool)
_LEAD[list(LEADS)] = True


def fold(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    """The folded texts, each between spaces and parted by a byte 1, and where each begins (one more than texts)."""
    parts = []
    for t in texts:
        if not t.isascii() and _LEAD[np.frombuffer(t, np.uint8)].any():
            t = t.decode("utf-8", "replace").translate(FOREIGN).encode()
        parts.append(t.translate(TABLE))
    buf = np.frombuffer(b" \x01 " + b" \x01 ".join(parts) + b" \x01", np.uint8).copy()
    sign = np.flatnonzero(_SIGN[buf])
    before = _IS_LETTER[buf[sign + 1]]
    buf[sign] = np.where(before, _SIGN[buf[sign]], 32)
    space = buf == 32
    keep = np.ones(len(buf), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    buf = buf[keep]
    return buf.tobytes(), np.flatnonzero(buf == 1)


def folded(phrase: str) -> str:
    """A phrase as it stands in folded text, without the outer spaces."""
    return fold([phrase.encode()])[0].strip(b" \x01").decode("latin-1")


@dataclass
class Lexicon:
    """Weights by entry (folded; a space at the end: a whole word), exception phrases, and the logistic function's weights."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = ()
    curve: np.ndarray = field(default_factory=lambda: np.array([-4.0, 2.0, 1.0, 1.0]))
    constant: float | None = None
    _automaton: object = None

    def automaton(self):
        if self._automaton is None:
            a = ahocorasick.Automaton()
            for term, w in self.weights.items():
                a.add_word(" " + term, (len(term) + 1, w))
            for phrase in self.exceptions:
                a.add_word(" " + folded(phrase), (len(folded(phrase)) + 1, None))
            a.make_automaton()
            self._automaton = a
        return self._automaton

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def sums(self, texts: list[bytes]) -> np.ndarray:
        """Matched weight, matches and words of each text."""
        out = np.zeros((len(texts), 3))
        for at, some in chunks(texts):
            data, edge = fold(some)
            buf = np.frombuffer(data, np.uint8)
            gaps = np.concatenate(([0], np.cumsum(buf == 32)))
            out[at : at + len(some), 2] = np.maximum(gaps[edge[1:]] - gaps[edge[:-1]] - 1, 0)
            if not self.weights:
                continue
            found = [(end + 1 - size, end + 1, w) for end, (size, w) in self.automaton().iter(data.decode("latin-1"))]
            harmless = [(a, b) for a, b, w in found if w is None]
            hits = [f for f in found if f[2] is not None and not any(a <= f[0] and f[1] <= b + 1 for a, b in harmless)]
            if hits:
                doc = np.searchsorted(edge, [h[0] for h in hits]) - 1
                np.add.at(out[:, 0], at + doc, [h[2] for h in hits])
                np.add.at(out[:, 1], at + doc, 1)
        return out

    def score(self, sums: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(sums), self.constant)
        return 1 / (1 + np.exp(-np.clip(inputs(sums) @ self.curve, -40, 40)))


def inputs(sums: np.ndarray) -> np.ndarray:
    """What the logistic function weighs: a constant, any match, the weight, and the weight over the text's length."""
    return np.stack([np.ones(len(sums)), sums[:, 1] > 0, np.log1p(sums[:, 0]), np.log1p(100 * sums[:, 0] / (sums[:, 2] + 20))], 1)


def candidates(text: bytes) -> set[str]:
    """Beginnings and whole words (with a space at the end) of a text, folded."""
    out = set()
    # Split at spaces alone: bytes of other letters may look like white space.
    for w in set(fold([text])[0].strip(b" \x01").decode("latin-1").split(" ")):
        if len(w) >= SHORTEST:
            out.update(w[:n] for n in range(SHORTEST, min(len(w), LONGEST) + 1))
            out.add(w[:40] + " " if len(w) <= 40 else w[:LONGEST])
    return out


def choose(toxic: Counter, clean: Counter, n_toxic: int, n_clean: int) -> dict[str, float]:
    """Entries and weights from document frequencies."""
    base = n_toxic / (n_toxic + n_clean)
    enough = math.log(max(len(toxic), 1)) + 1
    ranked = []
    for term, a in toxic.items():
        b = clean.get(term, 0)
        odds = math.log((a + 0.5) / (n_toxic + 1)) - math.log((b + 0.5) / (n_clean + 1))
        gain = a * math.log(a / ((a + b) * base)) + (b * math.log(b / ((a + b) * (1 - base))) if b else 0)
        if odds >= 3 and gain >= enough:
            ranked.append((-round(gain, 9), -len(term.rstrip()), term, odds))
    out: dict[str, float] = {}
    for _, _, term, odds in sorted(ranked):
        whole = term.rstrip()
        related = [whole[:n] for n in range(1, len(whole) + 1)]
        if not any(r in out or r + " " in out for r in related) and not any(t.startswith(whole) for t in out):
            out[term] = odds
    return out


def learn(docs: DataFrame, labels: DataFrame, held_out: Column, label_col: str = "toxic", most: int = MOST, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """Lexicon and curve from a bounded sample of labelled documents; ``held_out`` is a condition on ``doc_id``."""
    small_batches(docs.sparkSession)
    ids = sample_ids(labels, label_col, held_out, most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    keyed = rows.select("doc_id", "label", "text").mapInArrow(lean(_keyed), "doc_id long, label int, text string, key long")
    one = keyed.groupBy("key").agg(F.min(F.struct("doc_id", "label", "text")).alias("r")).select("r.label", "r.text")
    sample = written(one, "toxic-sample")
    n = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    if not n_toxic or not n_clean:
        return Lexicon({}, exceptions, constant=1.0 if n_toxic else 0.0)
    least = max(3, min(n_toxic // 500, 50))
    counted = pa.schema([("term", pa.string()), ("n", pa.int64())])

    def count(only: frozenset | None):
        def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: Counter = Counter()
            for b in frames:
                for t in texts_of(b.column(0)):
                    found = candidates(t)
                    total.update(found if only is None else found & only)
                    if len(total) > 50_000:
                        yield batches({"term": list(total), "n": list(total.values())}, counted)
                        total.clear()
            yield batches({"term": list(total), "n": list(total.values())}, counted)

        return run

    def tally(label: int, only: frozenset | None) -> Counter:
        out = sample.where(F.col("label") == label).select("text").mapInArrow(lean(count(only)), "term string, n long")
        out = out.groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n") >= (least if only is None else 1))
        return Counter(dict(zip(*out.toArrow().to_pydict().values(), strict=True)))

    toxic = tally(1, None)
    clean = tally(0, frozenset(toxic))
    lexicon = Lexicon(choose(toxic, clean, n_toxic, n_clean), exceptions)
    got = sample.select("label", "text").mapInArrow(lean(_summer(lexicon)), "label long, weight double, matches double, words double").toArrow()
    sums = np.stack([got.column(c).to_numpy() for c in ("weight", "matches", "words")], 1)
    y = got.column("label").to_numpy().astype(float)
    order = np.lexsort((*sums.T, y))
    lexicon.curve = logistic(inputs(sums[order]), y[order], l2=1e-4)
    del toxic, clean, got, sums
    release()
    return lexicon


def _keyed(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the least shingle hash of each text: copies and most near copies share it."""
    for b in frames:
        keys = []
        for _, some in chunks(texts_of(b.column(2))):
            h, at = shingles(*words(some)[3:])
            keys += [int(signed(h[i:j]).min()) if j > i else 0 for i, j in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.int64())], names=["doc_id", "label", "text", "key"])


def _summer(lexicon: Lexicon):
    schema = pa.schema([("label", pa.int64()), ("weight", pa.float64()), ("matches", pa.float64()), ("words", pa.float64())])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            s = lexicon.sums(texts_of(b.column(1)))
            yield batches({"label": b.column(0).cast(pa.int64()), "weight": s[:, 0], "matches": s[:, 1], "words": s[:, 2]}, schema)

    return run


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score, n_matches, n_words`` of every whole text."""
    schema = pa.schema([("id", pa.int64()), ("score", pa.float64()), ("n_matches", pa.int64()), ("n_words", pa.int64())])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            s = lexicon.sums(texts_of(b.column(1)))
            yield batches({"id": b.column(0), "score": lexicon.score(s), "n_matches": s[:, 1].astype(np.int64), "n_words": s[:, 2].astype(np.int64)}, schema)

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lean(run), "id long, score double, n_matches long, n_words long").withColumnRenamed("id", id_col)


def keep(docs: DataFrame, lexicon: Lexicon, below: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose whole text scores under ``below``; columns and rows are otherwise as they were."""
    small_batches(docs.sparkSession)
    place = docs.columns.index(text_col)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            yield b.filter(pa.array(lexicon.score(lexicon.sums(texts_of(b.column(place)))) < below))

    return docs.mapInArrow(lean(run), docs.schema)
