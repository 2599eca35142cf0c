"""Benchmark decontamination by greedy string tiling.

Words are runs of letters, digits and underscores, in lower case. Seeds (runs of ``LEAST`` words of an item; all of a
shorter item) are joined with those of every document. Where the words of an item that shared seeds can cover reach the
threshold, tiling decides: of the matches between item and document the longest are marked first, matches may not
overlap marked words, and running Karp-Rabin finds them by rolling hashes at falling lengths. As tiles may stand in any
order, a reordered passage is covered too. A document is contaminated by an item of which tiles cover ``THRESHOLD``.

A tile lies inside a run of shared seeds, so tiling only looks at those runs, from whole texts. The items' index is
broadcast in parts of ``INDEX_BYTES`` at most (a single longer item is a part), each part with a scan of its own.

Nulls: null texts and items have no words and no result; a null id stays null. Ties: of equally long matches the first in
the item, then in the document, is marked first. Repeated rows give repeated results; further columns are left out.
Empty tables give an empty table.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowgrid.llm.shared import batches, chunks, shingles, lean, small_batches, spans, span_hashes, texts_of

LEAST, THRESHOLD = 4, 0.5
INDEX_BYTES = 64 << 20
PRIME = (1 << 61) - 1
RADIX = 1_000_003
#: ASCII by itself, in lower case; what is no word becomes a space. Bytes of other letters stay (punctuation beyond ASCII is found by str).
TABLE = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i == 95 or i >= 128 else 32 for i in range(256))

OUT = pa.schema(
    [("doc_id", pa.int64()), ("item_id", pa.int64()), ("item_words", pa.int64()), ("covered_words", pa.int64())]
    + [("coverage", pa.float64()), ("n_tiles", pa.int64()), ("longest_tile", pa.int64())]
)


def _plain(text: bytes) -> bytes:
    if text.isascii():
        return text.translate(TABLE)
    low = text.decode("utf-8", "replace").lower()
    return "".join([c if c.isalnum() or c == "_" else " " for c in low]).encode() if _odd(low) else low.encode().translate(TABLE)


def _odd(low: str) -> bool:
    """Whether a text has characters beyond ASCII that are no letters or digits."""
    return not "".join(set(low) - _ASCII).replace("_", "").isalnum() if not set(low) <= _ASCII else False


_ASCII = {chr(i) for i in range(128)}


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a run of texts, and offsets by text."""
    plain = [_plain(t) for t in texts]
    joined = b" " + b" ".join(plain)
    buf = np.frombuffer(joined, np.uint8)
    start, end = spans(buf, buf == 32)
    edges = np.concatenate(([1], 1 + np.cumsum([len(t) + 1 for t in plain])))
    return span_hashes(buf, start, end), np.searchsorted(start, edges)


def tiles(item: list[int], text: list[int], least: int) -> list[tuple[int, int, int]]:
    """(start in item, start in text, length) of greedy tiles of ``least`` words or more. A word of None matches nothing."""
    taken_i, taken_t = [w is None for w in item], [w is None for w in text]
    out: list[tuple[int, int, int]] = []
    length = max(least, min(len(item), 24))
    while True:
        longest, found = _matches(item, text, taken_i, taken_t, length)
        if longest > 2 * length:
            length = longest  # such a match first, alone
            continue
        for size, i, t in sorted(found, key=lambda m: (-m[0], m[1], m[2])):
            if any(taken_i[i : i + size]) or any(taken_t[t : t + size]):
                # What marks have left of it is found again at this or a lesser length.
                continue
            taken_i[i : i + size] = [True] * size
            taken_t[t : t + size] = [True] * size
            out.append((i, t, size))
        if found and _matches(item, text, taken_i, taken_t, length)[0]:
            continue
        if length == least:
            return out
        length = max(least, length // 2 if length > 2 * least else least)


def _rolled(words: list[int], taken: list[bool], length: int) -> Iterator[tuple[int, int]]:
    """(start, hash) of every run of ``length`` words that aren't taken."""
    power = pow(RADIX, length - 1, PRIME)
    h = run = 0
    for k, w in enumerate(words):
        if taken[k]:
            h = run = 0
            continue
        if run >= length:
            h = (h - (words[k - length] % PRIME) * power) % PRIME
        h = (h * RADIX + w) % PRIME
        run += 1
        if run >= length:
            yield k - length + 1, h


def _matches(item: list[int], text: list[int], taken_i: list[bool], taken_t: list[bool], length: int) -> tuple[int, list[tuple[int, int, int]]]:
    """Longest size, and (size, start in item, start in text) of matches of at least ``length`` words."""
    there = defaultdict(list)
    for i, h in _rolled(item, taken_i, length):
        there[h].append(i)
    longest, found = 0, []
    for t, h in _rolled(text, taken_t, length):
        for i in there.get(h, ()):
            if item[i : i + length] != text[t : t + length]:
                continue
            if i and t and not taken_i[i - 1] and not taken_t[t - 1] and item[i - 1] == text[t - 1]:
                continue  # it is part of the match that begins a word earlier
            size = length
            while i + size < len(item) and t + size < len(text) and not taken_i[i + size] and not taken_t[t + size] and item[i + size] == text[t + size]:
                size += 1
            longest = max(longest, size)
            found.append((size, i, t))
    return longest, found


class Index:
    """Items with their words and their seeds, by the seed's width."""

    def __init__(self, items: list[tuple[int | None, str | None]], least: int, threshold: float):
        self.least, self.threshold = least, threshold
        self.ids = [i for i, _ in items]
        h, at = word_hashes([(t or "").encode() for _, t in items]) if items else (np.empty(0, np.uint64), np.zeros(1, np.int64))
        self.words = [h[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        by = defaultdict(list)
        for k, w in enumerate(self.words):
            if len(w):
                by[min(least, len(w))].append(k)
        for width, some in by.items():
            own = np.concatenate([self.words[k] for k in some])
            off = np.concatenate(([0], np.cumsum([len(self.words[k]) for k in some])))
            s, cut = shingles(own, off, width)
            which = np.repeat(np.array(some), np.diff(cut))
            place = np.arange(len(s)) - np.repeat(cut[:-1], np.diff(cut))
            order = np.argsort(s, kind="stable")
            self.seeds[width] = s[order], which[order], place[order]
        self.memo: dict = {}

    def found(self, h: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, tuple]]:
        """(text, (item, words, covered, tiles, longest)) of a run of texts."""
        for width, (seed, which, place) in self.seeds.items():
            n = np.diff(at)
            s, cut = shingles(h, at, width)
            left = np.searchsorted(seed, s)
            hit = np.flatnonzero(seed[np.minimum(left, len(seed) - 1)] == s)
            if not len(hit):
                continue
            doc = np.searchsorted(cut, hit, side="right") - 1
            for d in np.unique(doc):
                if n[d] < width:
                    continue
                mine = hit[doc == d]
                start = mine - cut[d]
                low, high = left[mine], np.searchsorted(seed, s[mine], side="right")
                shared: dict[int, list[tuple[int, int]]] = defaultdict(list)
                for p, a, b in zip(start.tolist(), low.tolist(), high.tolist(), strict=True):
                    for j in range(a, b):
                        shared[int(which[j])].append((p, int(place[j])))
                for k, pairs in shared.items():
                    covered = set()
                    for q in {q for _, q in pairs}:
                        covered.update(range(q, q + width))
                    if len(covered) < self.threshold * len(self.words[k]):
                        continue
                    runs: list[int | None] = []
                    last = -1
                    base = int(at[d])
                    for p in sorted({p for p, _ in pairs}):
                        if p > last:
                            runs.append(None)
                        runs += h[base + max(p, last) : base + p + width].tolist()
                        last = p + width
                    key = (k, tuple(runs))
                    if key not in self.memo:
                        if len(self.memo) > 20_000:
                            self.memo.clear()
                        t = tiles(self.words[k].tolist(), runs, width)
                        self.memo[key] = (k, len(self.words[k]), sum(x[2] for x in t), len(t), max((x[2] for x in t), default=0))
                    got = self.memo[key]
                    if got[2] >= self.threshold * got[1]:
                        yield int(d), got

    def __getstate__(self):
        return self.__dict__ | {"memo": {}}


def _indexes(benchmark: DataFrame, least: int, threshold: float, index_bytes: int) -> Iterator[Index]:
    """The items' index in parts, each of as many items as fit ``index_bytes`` when built: 8 bytes a word and 24 a seed."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    held: list[tuple[int | None, str]] = []
    size = 0
    for r in items.orderBy("item_id", "text").toLocalIterator():
        built = 32 * len(_plain(r["text"].encode()).split()) + 64
        if held and size + built > index_bytes:
            yield Index(held, least, threshold)
            held, size = [], 0
        held.append((r["item_id"], r["text"]))
        size += built
    yield Index(held, least, threshold)


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, threshold: float = THRESHOLD, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """``doc_id, item_id, item_words, covered_words, coverage, n_tiles, longest_tile`` of every contaminated pair."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for part in _indexes(benchmark, least, threshold, index_bytes):
        index = docs.sparkSession.sparkContext.broadcast(part)

        def run(frames: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            ix = index.value
            for b in frames:
                ids, found = b.column(0).to_pylist(), []
                for at, some in chunks(texts_of(b.column(1))):
                    for d, (k, n, covered, count, longest) in ix.found(*word_hashes(some)):
                        found.append((ids[at + d], ix.ids[k], n, covered, covered / n, count, longest))
                yield batches({f.name: [r[i] for r in found] for i, f in enumerate(OUT)}, OUT)

        one = rows.mapInArrow(lean(run), "doc_id long, item_id long, item_words long, covered_words long, coverage double, n_tiles long, longest_tile long")
        out = one if out is None else out.unionByName(one)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, threshold: float = THRESHOLD, index_bytes: int = INDEX_BYTES, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that no item contaminates; columns and rows are otherwise as they were."""
    small_batches(docs.sparkSession)
    place = docs.columns.index(text_col)
    out = docs
    for part in _indexes(benchmark, least, threshold, index_bytes):
        index = docs.sparkSession.sparkContext.broadcast(part)

        def run(frames: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in frames:
                good = np.ones(b.num_rows, bool)
                for at, some in chunks(texts_of(b.column(place))):
                    good[[at + d for d, _ in index.value.found(*word_hashes(some))]] = False
                yield b.filter(pa.array(good))

        out = out.mapInArrow(lean(run), docs.schema)
    return out
