"""Brown class-based bigram scores: exchange clustering assigns words to classes, then class transitions and word emissions.

    p(text) = product over tokens of p(class | class before) * p(word | class),  a text's end being a token and a class

1. Seeds: the ``CONTEXT`` most frequent training words start in classes dealt by rank. Each of ``ROUNDS`` scans counts, for each of
   them, the classes of the words before and after it, over all training texts; exchange sweeps then move one seed after another to
   the class that raises the class bigram likelihood most.
2. One scan codes every text by blocks of documents. Every other word goes, with its training count and the classes
   around its training occurrences in the block, to the bucket of its hash. A bucket sums them over all blocks, puts each
   word into its best class by the same criterion, and answers each block with counts and classes.
3. Exchange over all words, ``EXCHANGES`` times: blocks know the classes of all their words by now, and send the classes around each
   word anew. Seeds, whose counts are a table of fixed size, are moved one after another; every other word is moved in its bucket,
   against the class tables that this leaves, without its own counts where it is. So every word of the corpus has its exact
   count and is exchanged as often as any other, no table of all words is ever in one place, and a frequent word is no hot key.
4. Blocks turn into class sequences; class bigrams are summed over training texts; the scores are read off.

Counts of a fixed size that many tasks have are summed in a tree, ``FAN`` at a time; the driver gets its root.

Smoothing: p(class | before) backs off to the class's share with weight ``BACKOFF``. Words not in training are a class of
their own: its probability after a class is the share of words there that occur once in training, spread over as many
types as occur once, plus one. ``base_score`` is the given unigram score. log10 throughout; words are compared by 64-bit hashes.

Nulls: a null text is the empty text (one token, the end). A null id is in training (it is in no fold). Without training
texts the score is the base score. Long texts are whole; repeated rows stay; further columns are left out. An empty
table gives an empty table.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrowgrid.llm.shared import batches, chunks, discard, lean, release, small_batches, texts_of, words, written

CLASSES, CONTEXT, ROUNDS, EXCHANGES, SWEEPS = 32, 32_768, 2, 2, 2
BACKOFF = 5.0
#: Documents and bytes of text that make a block, whichever comes first; words of a bucket.
BLOCK_DOCS, BLOCK_BYTES, BUCKET = 1000, 8 << 20, 700_000
#: Packed counts that one task sums, and parts that a large array of counts is packed in.
FAN, SEGMENTS = 32, 8
#: Classes after the words' own: the end (and start) of a text; as context in clustering, any other word; when scoring, words not in training.
END, OTHER = CLASSES, CLASSES + 1
KINDS = CLASSES + 2


class Words:
    """Place of each known hash in a table with open addressing."""

    def __init__(self, hashes: np.ndarray):
        self.n = len(hashes)
        self.bits = max(8, int(np.ceil(np.log2(max(self.n, 1) * 8))))
        self.key = np.zeros(1 << self.bits, np.uint64)
        self.value = np.full(1 << self.bits, -1, np.int32)
        for i, h in enumerate(hashes.tolist()):
            at = h >> (64 - self.bits)
            while self.value[at] >= 0:
                at = (at + 1) % len(self.key)
            self.key[at], self.value[at] = h, i

    def codes(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash, or -1."""
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.full(len(h), -1, np.int32)
        left = np.arange(len(h))
        while len(left):
            value = self.value[at]
            same = (self.key[at] == h[left]) & (value >= 0)
            out[left[same]] = value[same]
            more = ~same & (value >= 0)
            left, at = left[more], (at[more] + 1) % len(self.key)
        return out


def with_ends(codes: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """One sequence of all texts, an end before the first and after each; and where each text's tokens begin in it."""
    n = np.diff(offsets)
    out = np.full(len(codes) + len(n) + 1, end, codes.dtype)
    out[np.arange(len(codes)) + np.repeat(np.arange(len(n)), n) + 1] = codes
    return out, offsets + np.arange(len(n) + 1) + 1


def _counted():
    """Counts of all words of a task, by hash; a word can come in several rows, which are to be summed."""
    schema = pa.schema([("h", pa.int64()), ("n", pa.int64())])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            h, n = (np.concatenate([x[i] for x in held]) for i in (0, 1))
            key, which = np.unique(h, return_inverse=True)
            return key, np.bincount(which, weights=n).astype(np.int64)

        def rows(h: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for k in range(0, len(h), 100_000):
                yield batches({"h": h[k : k + 100_000].view(np.int64), "n": n[k : k + 100_000]}, schema)

        for b in frames:
            for _, some in chunks(texts_of(b.column(0)), 4 << 20):
                held.append(np.unique(words(some)[3], return_counts=True))
                size += len(held[-1][0])
                if size > 3_000_000:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > 1_500_000:
                        yield from rows(*held[0])
                        held, size = [], 0
        if held:
            yield from rows(*merged())

    return run


def _contexts(known: Words, classes: np.ndarray):
    """Counts of (word, class before) and (word, class after) over a task's texts, packed in segments."""
    size = known.n * KINDS

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, size), np.int64)
        of = np.concatenate((classes, [END, OTHER])).astype(np.int64)
        any_text = False
        for b in frames:
            for _, some in chunks(texts_of(b.column(0)), 8 << 20):
                h, off = words(some)[3:]
                codes = known.codes(h)
                codes[codes < 0] = known.n + 1
                seq, _ = with_ends(codes, off, known.n)
                kind = of[seq]
                word = np.flatnonzero(seq < known.n)
                base = seq[word].astype(np.int64) * KINDS
                total[0] += np.bincount(base + kind[word - 1], minlength=size)
                total[1] += np.bincount(base + kind[word + 1], minlength=size)
                any_text = True
        if any_text:
            yield packed_counts(total.reshape(-1), SEGMENTS)

    return run


def light(f, two: bool = False):
    """A function of groups (of two frames: ``two``) that gives freed memory back after each: workers live on beside an executor that needs the room."""

    def one_frame(part: pa.Table) -> pa.Table:
        out = f(part)
        release()
        return out

    def two_frames(left: pa.Table, right: pa.Table) -> pa.Table:
        out = f(left, right)
        release()
        return out

    return two_frames if two else one_frame


COUNTS = pa.schema([("k", pa.int64()), ("segment", pa.int32()), ("counts", pa.binary())])
COUNTS_DDL = "k long, segment int, counts binary"


def packed_counts(total: np.ndarray, segments: int = 1) -> pa.RecordBatch:
    """Counts of a task in parts; ``k`` is the task's number."""
    parts = np.array_split(total.astype(np.int64), segments)
    return batches({"k": [TaskContext.get().partitionId()] * segments, "segment": range(segments), "counts": [_pack(p) for p in parts]}, COUNTS)


def _sum(part: pa.Table) -> pa.Table:
    total = None
    for c in part.column("counts"):
        x = _unpack(c.as_py(), np.int64)
        total = x.copy() if total is None else total + x
    return pa.table({"k": part.column("to")[:1], "segment": part.column("segment")[:1], "counts": pa.array([_pack(total)], pa.binary())})


def summed(rows: DataFrame, many: int, size: int) -> np.ndarray:
    """Element-wise sum of packed counts of rows ``k, segment, counts`` with at most ``many`` numbers k: a tree of sums of ``FAN``, of which the driver gets the root."""
    while many > 1:
        many = -(-many // FAN)
        rows = rows.withColumn("to", F.pmod(F.col("k"), F.lit(many))).groupBy("to", "segment").applyInArrow(light(_sum), COUNTS_DDL)
    parts: dict[int, np.ndarray] = {}
    for r in rows.collect():
        x = _unpack(r["counts"], np.int64)
        parts[r["segment"]] = parts[r["segment"]] + x if r["segment"] in parts else x
    return np.concatenate([parts[k] for k in sorted(parts)]) if parts else np.zeros(size, np.int64)


def exchange(before: np.ndarray, after: np.ndarray, classes: np.ndarray, rest_into=0.0, rest_out=0.0, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Move each word to its best class, one after another, most frequent first.

    ``rest_into, rest_out``: what words that aren't moved here add to the class tables. Returns classes and the tables
    that they give: counts by (class before, class) and by (class after, class).
    """
    classes = classes.copy()
    into, out = np.zeros((KINDS, CLASSES)) + rest_into, np.zeros((KINDS, CLASSES)) + rest_out
    for k in range(CLASSES):
        into[:, k] += before[classes == k].sum(0)
        out[:, k] += after[classes == k].sum(0)
    size = into.sum(0)
    li, lo, ls = log(into), log(out), log(size)
    for _ in range(sweeps):
        moved = 0
        for w in range(len(classes)):
            a, b, old = before[w], after[w], classes[w]
            n = a.sum()
            if not n:
                continue
            # Without the word's own counts where it is now.
            gain = a @ li + b @ lo - 2 * n * ls
            gain[old] = a @ log(into[:, old] - a) + b @ log(out[:, old] - b) - 2 * n * log(size[old] - n)
            new = int(np.argmax(gain))
            if new != old:
                for k, sign in ((old, -1), (new, 1)):
                    into[:, k] += sign * a
                    out[:, k] += sign * b
                    size[k] += sign * n
                    li[:, k], lo[:, k], ls[k] = log(into[:, k]), log(out[:, k]), log(size[k])
                classes[w] = new
                moved += 1
        if not moved:
            break
    return classes, into, out


def log(x: np.ndarray) -> np.ndarray:
    return np.log(x + 0.5)


CODED = pa.schema(
    [("kind", pa.int32()), ("block", pa.int64()), ("bucket", pa.int32()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_()))]
    + [("counts", pa.binary()), ("low", pa.binary()), ("high", pa.binary()), ("h", pa.binary()), ("before", pa.binary()), ("after", pa.binary())]
)


def _pack(x: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(x).tobytes(), 1)


def _unpack(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(zlib.decompress(x), kind)


def bucket_of(h: np.ndarray, n_buckets: int) -> np.ndarray:
    """Buckets are ranges of hashes, so that sorted hashes come in the order of buckets."""
    return ((h >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)


def _coded(known: Words, classes: np.ndarray, n_buckets: int):
    """Blocks of coded texts (kind 0) and their other words by bucket (kind 1). Block numbers are drawn at random; the table they are written to keeps one attempt of each task."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = np.concatenate((classes, [END])).astype(np.uint8)

        def block(ids: list, held: list, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
            h, off = words(texts)[3:]
            codes = known.codes(h).astype(np.int64)
            other = np.flatnonzero(codes < 0)
            mine, local = np.unique(h[other], return_inverse=True)
            codes[other] = known.n + 1 + local
            number = uuid.uuid4().int >> 65
            seq, _ = with_ends(codes, off, known.n)
            n = np.diff(off)
            flat = codes.astype(np.uint32)
            row = {"kind": [0], "block": [number], "bucket": [None], "ids": [ids], "held": [held], "counts": [_pack(n)], "low": [_pack(flat.astype(np.uint16))]}
            yield batches(row | {"high": [_pack((flat >> 16).astype(np.uint16))], "h": [None], "before": [None], "after": [None]}, CODED)
            # Training occurrences of other words with the classes around them.
            doc = np.repeat(np.arange(len(n)), n)
            place = np.arange(len(codes)) + doc + 1
            use = other[~np.array(held, bool)[doc[other]]] if len(other) else other
            which = codes[use] - known.n - 1
            order = np.argsort(which, kind="stable")
            kind = np.where(seq <= known.n, of[np.minimum(seq, known.n)], OTHER).astype(np.uint8)
            before, after = kind[place[use] - 1][order], kind[place[use] + 1][order]
            count = np.bincount(which, minlength=len(mine)).astype(np.int32)
            edge = np.searchsorted(bucket_of(mine, n_buckets), np.arange(n_buckets + 1))
            at = np.concatenate(([0], np.cumsum(count)))
            rows: dict[str, list] = {f.name: [] for f in CODED}
            for k in np.flatnonzero(np.diff(edge)).tolist():
                a, b = edge[k], edge[k + 1]
                for c, v in zip(rows, (1, number, k, None, None, _pack(count[a:b]), None, None, mine[a:b].tobytes(), before[at[a] : at[b]].tobytes(), after[at[a] : at[b]].tobytes()), strict=True):
                    rows[c].append(v)
            yield batches(rows, CODED)

        ids, held, texts, size = [], [], [], 0
        for b in frames:
            for i, x, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts_of(b.column(2)), strict=True):
                ids.append(i)
                held.append(x)
                texts.append(t)
                size += len(t)
                if len(ids) >= BLOCK_DOCS or size >= BLOCK_BYTES:
                    yield from block(ids, held, texts)
                    ids, held, texts, size = [], [], [], 0
        if ids:
            yield from block(ids, held, texts)

    return run


ANSWERS = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("counts", pa.binary()), ("classes", pa.binary()), ("places", pa.binary()), ("sums", pa.binary())])
ANSWERS_DDL = "block long, bucket int, counts binary, classes binary, places binary, sums binary"


def _rows_of(total: np.ndarray, best: np.ndarray, bucket: int) -> dict[str, list]:
    """Answers of a bucket that begin with its own row: the classes of its words and sums by class."""
    sums = np.concatenate((np.bincount(best, weights=total, minlength=KINDS), [(total > 0).sum(), (total == 1).sum()])).astype(np.int64)
    return {"block": [None], "bucket": [bucket], "counts": [None], "classes": [_pack(best)], "places": [None], "sums": [_pack(sums)]}


def _answered(into: np.ndarray, out: np.ndarray):
    """A bucket's words over all blocks: exact training counts, and the best class for each word that has none yet."""
    size = log(into.sum(0))
    li, lo = (log(into) - size).astype(np.float32), (log(out) - size).astype(np.float32)

    def run(part: pa.Table) -> pa.Table:
        get = lambda c: part.column(c).to_pylist()
        hs = [np.frombuffer(x, np.uint64) for x in get("h")]
        counts = np.concatenate([_unpack(x, np.int32) for x in get("counts")])
        before = np.frombuffer(b"".join(get("before")), np.uint8)
        after = np.frombuffer(b"".join(get("after")), np.uint8)
        distinct, which = np.unique(np.concatenate(hs), return_inverse=True)
        total = np.bincount(which, weights=counts, minlength=len(distinct)).astype(np.int64)
        owner = np.repeat(which, counts)
        order = np.argsort(owner, kind="stable")
        owner, before, after = owner[order], before[order], after[order]
        best = np.full(len(distinct), OTHER, np.uint8)
        edge = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else np.empty(0, np.int64)
        step = 50_000
        for i in range(0, len(edge), step):
            some = edge[i : i + step]
            stop = edge[i + step] if i + step < len(edge) else len(owner)
            gain = li[before[some[0] : stop]] + lo[after[some[0] : stop]]
            best[owner[some]] = np.argmax(np.add.reduceat(gain, some - some[0], axis=0), 1)
        rows = _rows_of(total, best, get("bucket")[0])
        at = 0
        for block, bucket, h in zip(get("block"), get("bucket"), hs, strict=True):
            mine = which[at : at + len(h)]
            at += len(h)
            # Hashes of a block are sorted, so places among the bucket's words rise.
            for c, v in zip(rows, (block, bucket, _pack(total[mine]), _pack(best[mine]), _pack(np.diff(mine, prepend=0).astype(np.uint32)), None), strict=True):
                rows[c].append(v)
        return pa.table(rows, schema=ANSWERS)

    return run


def moved(before: np.ndarray, after: np.ndarray, old: np.ndarray, into: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Best class of each word (rows of counts by class before and after it) against fixed tables, its own counts left out of its old class."""
    size = into.sum(0)
    n = before.sum(1)
    gain = before @ log(into) + after @ log(out) - 2 * n[:, None] * log(size)
    own = (before * log(into.T[old] - before)).sum(1) + (after * log(out.T[old] - after)).sum(1) - 2 * n * log(size[old] - n)
    gain[np.arange(len(old)), old] = own
    return np.argmax(gain, 1)


def _exchanged(into: np.ndarray, out: np.ndarray):
    """A bucket's words moved to their best classes; its own row (no block) has the classes so far."""

    def run(part: pa.Table) -> pa.Table:
        state = part.filter(pc.is_null(part.column("block")))
        part = part.filter(pc.is_valid(part.column("block")))
        get = lambda c: part.column(c).to_pylist()
        best = _unpack(state.column("classes")[0].as_py(), np.uint8).copy()
        places = [np.cumsum(_unpack(x, np.uint32).astype(np.int64)) for x in get("places")]
        counts = np.concatenate([np.empty(0, np.int64), *[_unpack(x, np.int32).astype(np.int64) for x in get("counts")]])
        which = np.concatenate([np.empty(0, np.int64), *places])
        total = np.bincount(which, weights=counts, minlength=len(best)).astype(np.int64)
        owner = np.repeat(which, counts)
        before, after = (np.concatenate([np.empty(0, np.uint8), *[_unpack(x, np.uint8) for x in get(c)]]).astype(np.int64) for c in ("before", "after"))
        order = np.argsort(owner, kind="stable")
        owner, before, after = owner[order], before[order], after[order]
        words_ = np.flatnonzero(total)
        for i in range(0, len(words_), 20_000):
            some = words_[i : i + 20_000]
            a, b = np.searchsorted(owner, some[0]), np.searchsorted(owner, some[-1], side="right")
            row = np.searchsorted(some, owner[a:b]) * KINDS
            table = lambda kind: np.bincount(row + kind[a:b], minlength=len(some) * KINDS).reshape(-1, KINDS).astype(float)  # noqa: B023, E731
            best[some] = moved(table(before), table(after), best[some].astype(np.int64), into, out)
        rows = _rows_of(total, best, state.column("bucket")[0].as_py())
        for block, bucket, mine, kept in zip(get("block"), get("bucket"), places, get("places"), strict=True):
            for c, v in zip(rows, (block, bucket, _pack(total[mine]), _pack(best[mine]), kept, None), strict=True):
                rows[c].append(v)
        return pa.table(rows, schema=ANSWERS)

    return run


AGAIN = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("bucket", pa.int32())] + [(c, pa.binary()) for c in ("places", "counts", "before", "after", "moves")])
AGAIN_DDL = "kind int, block long, bucket int, places binary, counts binary, before binary, after binary, moves binary"


def _sparse(x: np.ndarray) -> tuple[bytes, bytes]:
    key, n = np.unique(x, return_counts=True)
    return _pack(np.diff(key, prepend=0).astype(np.uint32)), _pack(n.astype(np.uint32))


def _recontexts(n_known: int, word_class: np.ndarray):
    """Blocks with their answers to the classes around each training occurrence: other words by bucket (kind 1), seeds and class bigrams (kind 2)."""

    def run(coded: pa.Table, answers: pa.Table) -> pa.Table:
        rows: dict[str, list] = {f.name: [] for f in AGAIN}
        said = answers.sort_by("bucket").to_pylist()
        others = [_unpack(r["classes"], np.uint8) for r in said]
        classes = np.concatenate([word_class, [END], *others]).astype(np.uint8)
        edge = np.concatenate(([0], np.cumsum([len(x) for x in others]))).astype(np.int64)
        for r in coded.to_pylist():
            size = _unpack(r["counts"], np.int64)
            codes = _unpack(r["low"], np.uint16).astype(np.int32) | _unpack(r["high"], np.uint16).astype(np.int32) << 16
            seq, _ = with_ends(codes, np.concatenate(([0], np.cumsum(size))), n_known)
            del codes
            kind = classes[seq]
            train = np.flatnonzero(np.concatenate(([False], np.repeat(~np.array(r["held"], bool), size + 1)))).astype(np.int32)
            moves = np.bincount(kind[train - 1].astype(np.int16) * KINDS + kind[train], minlength=KINDS * KINDS)
            seed = train[seq[train] < n_known]
            one, two = _sparse(seq[seed] * KINDS + kind[seed - 1]), _sparse(seq[seed] * KINDS + kind[seed + 1])
            del seed
            for c, v in zip(rows, (2, r["block"], None, one[0], one[1], two[0], two[1], _pack(moves)), strict=True):
                rows[c].append(v)
            use = train[seq[train] > n_known]
            which = seq[use] - n_known - 1
            use = use[np.argsort(which, kind="stable")]
            count = np.bincount(which, minlength=int(edge[-1])).astype(np.int32)
            before, after = kind[use - 1], kind[use + 1]
            at = np.concatenate(([0], np.cumsum(count, dtype=np.int64)))
            for x, a, b in zip(said, edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                mine = slice(at[a], at[b])
                for c, v in zip(rows, (1, r["block"], x["bucket"], x["places"], _pack(count[a:b]), _pack(before[mine]), _pack(after[mine]), None), strict=True):
                    rows[c].append(v)
        return pa.table(rows, schema=AGAIN)

    return run


def _seed_sums(n_known: int):
    """Seeds' counts by class before and after, and class bigrams, of a task's blocks."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = n_known * KINDS
        total = np.zeros(2 * size + KINDS * KINDS, np.int64)
        for b in frames:
            for r in b.to_pylist():
                for at, key, n in ((0, "places", "counts"), (size, "before", "after")):
                    total[at + np.cumsum(_unpack(r[key], np.uint32).astype(np.int64))] += _unpack(r[n], np.uint32)
                total[2 * size :] += _unpack(r["moves"], np.int64)
        yield packed_counts(total, SEGMENTS)

    return run


CLASSED = pa.schema(
    [("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("n", pa.binary()), ("known", pa.binary())]
    + [("base", pa.binary()), ("emitted", pa.binary()), ("classes", pa.binary()), ("k", pa.int64()), ("segment", pa.int32()), ("counts", pa.binary())]
)


def _classed(n_known: int, word_count: np.ndarray, word_class: np.ndarray, ends: int, n: int, v: int, class_size: np.ndarray, once: int):
    """Blocks with their answers to class sequences, base scores and emissions; and the block's training class bigrams."""
    rest = np.log10(n + 0.1 * (v + 1))

    def run(coded: pa.Table, answers: pa.Table) -> pa.Table:
        rows: dict[str, list] = {f.name: [] for f in CLASSED}
        said = answers.sort_by("bucket")
        empty = [np.empty(0, np.int64)]
        counts = np.concatenate([word_count, [ends], *([_unpack(x, np.int64) for x in said.column("counts").to_pylist()] or empty)])
        classes = np.concatenate([word_class, [END], *[_unpack(x, np.uint8) for x in said.column("classes").to_pylist()]]).astype(np.int64)
        for r in coded.to_pylist():
            size = _unpack(r["counts"], np.int64)
            codes = _unpack(r["low"], np.uint16).astype(np.int64) | _unpack(r["high"], np.uint16).astype(np.int64) << 16
            seq, at = with_ends(codes, np.concatenate(([0], np.cumsum(size))), n_known)
            c, k = counts[seq], classes[seq]
            k[c == 0] = OTHER
            k[seq == n_known] = END
            with np.errstate(divide="ignore"):
                emitted = np.where(k == END, 0.0, np.where(k == OTHER, -np.log10(once + 1), np.log10(c / class_size[k])))
            cut = at[:-1]
            per = lambda x: np.add.reduceat(x, cut)
            train = np.concatenate(([False], np.repeat(~np.array(r["held"], bool), size + 1)))
            to = np.flatnonzero(train)
            moves = np.zeros((3, KINDS, KINDS), np.int64)
            np.add.at(moves[0], (k[to - 1], k[to]), 1)
            single = (c == 1) & (seq != n_known)
            new = to[single[to]]
            np.add.at(moves[1], (k[new - 1], k[new]), 1)
            new = to[single[to - 1]]
            np.add.at(moves[2], (k[new - 1], k[new]), 1)
            row = (r["block"], r["ids"], r["held"], _pack(size + 1), _pack(per((c > 0).astype(np.int64))), _pack(per(np.log10(c + 0.1) - rest)), _pack(per(emitted)))
            for name, x in zip(rows, (*row, _pack(k.astype(np.uint8)), r["block"], 0, _pack(moves)), strict=True):
                rows[name].append(x)
        return pa.table(rows, schema=CLASSED)

    return run


def transitions(moves: np.ndarray) -> np.ndarray:
    """log10 p(class | class before), from counts of moves, of moves to words that occur once, and of moves from such."""
    all_moves, to_once, from_once = (m.astype(float) for m in moves)
    all_moves[OTHER] = from_once.sum(0)
    share = all_moves[:OTHER].sum(0)
    share = (share + 1e-3) / (share + 1e-3)[: OTHER].sum()
    fresh = (to_once.sum() + 0.5) / (all_moves[:OTHER].sum() + 1)
    n = all_moves.sum(1)
    unknown = (np.append(to_once.sum(1)[:OTHER], fresh * n[OTHER]) + BACKOFF * fresh) / (n + BACKOFF)
    p = (1 - unknown)[:, None] * (all_moves + BACKOFF * share) / (n + BACKOFF)[:, None]
    p[:, OTHER] = unknown
    return np.log10(p)


SCORED = pa.schema(
    [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64())]
    + [("base_score", pa.float64()), ("score", pa.float64())]
)


def _scored(table: np.ndarray, n: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            for r in b.to_pylist():
                size, k = _unpack(r["n"], np.int64), _unpack(r["classes"], np.uint8).astype(np.int64)
                base = _unpack(r["base"], np.float64)
                moved = np.add.reduceat(table[k[:-1], k[1:]], np.concatenate(([0], np.cumsum(size)[:-1]))) if n else base
                score = moved + _unpack(r["emitted"], np.float64) if n else base
                rows = {"doc_id": r["ids"], "held_out": r["held"], "n_tokens": size, "n_known": _unpack(r["known"], np.int64)}
                yield batches(rows | {"train_tokens": [n] * len(size), "base_score": base, "score": score}, SCORED)

    return run


def score(
    docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", context: int = CONTEXT, rounds: int = ROUNDS, exchanges: int = EXCHANGES, seen: list | None = None
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every whole text; texts that aren't held out train.

    ``context`` words are seeds; ``exchanges`` is how often every word, seeds and others, is exchanged. ``seen``, where given, gets
    the seeds' hashes and classes.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held"), F.col(text_col).alias("text"))
    train = rows.where(~F.col("held")).select("text")
    top = train.mapInArrow(lean(_counted()), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    top = top.orderBy(F.col("n").desc(), "h").limit(context).toArrow()
    known = Words(top.column("h").to_numpy().view(np.uint64))
    classes = (np.arange(known.n) % CLASSES).astype(np.int64)
    into = out = np.zeros((KINDS, CLASSES))
    word_count = top.column("n").to_numpy().astype(np.int64)
    size, tasks = known.n * KINDS, train.rdd.getNumPartitions()
    for _ in range(rounds if known.n else 0):
        kept = spark.sparkContext.broadcast((known, classes))
        got = summed(train.mapInArrow(lean(lambda f, kept=kept: _contexts(*kept.value)(f)), COUNTS_DDL), tasks, 2 * size).reshape(2, known.n, KINDS)
        classes, into, out = exchange(got[0].astype(float), got[1].astype(float), classes)
        kept.unpersist()

    tokens = rows.select(F.sum(F.octet_length("text")).alias("b"), F.sum((~F.col("held")).cast("long")).alias("d")).first()
    ends = int(tokens["d"] or 0)
    # Other words are a part of all tokens; a token has 2 bytes at least, usually 6.
    n_buckets = int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), (tokens["b"] or 0) // 30 // BUCKET + 1))
    kept = spark.sparkContext.broadcast((known, classes))
    schema = "kind int, block long, bucket int, ids array<long>, held array<boolean>, counts binary, low binary, high binary, h binary, before binary, after binary"
    coded = written(rows.mapInArrow(lean(lambda f: _coded(*kept.value, n_buckets)(f)), schema), "coded")
    other = coded.where("kind = 1").select("block", "bucket", "counts", "h", "before", "after")
    answers = written(other.groupBy("bucket").applyInArrow(light(_answered(into, out)), ANSWERS_DDL), "answers")
    kept.unpersist()
    blocks = coded.where("kind = 0").select("block", "ids", "held", "counts", "low", "high")
    n_blocks = blocks.count()
    for _ in range(exchanges if known.n else 0):
        to_blocks = answers.where("block IS NOT NULL").select("block", "bucket", "classes", "places")
        step = light(_recontexts(known.n, classes.astype(np.uint8)), two=True)
        again = written(blocks.groupBy("block").cogroup(to_blocks.groupBy("block")).applyInArrow(step, AGAIN_DDL), "contexts")
        seeds = again.where("kind = 2").select("places", "counts", "before", "after", "moves")
        got = summed(seeds.mapInArrow(lean(_seed_sums(known.n)), COUNTS_DDL), seeds.rdd.getNumPartitions(), 2 * size + KINDS * KINDS).astype(float)
        before, after, moves = got[:size].reshape(-1, KINDS), got[size : 2 * size].reshape(-1, KINDS), got[2 * size :].reshape(KINDS, KINDS)
        of = np.eye(CLASSES)[classes]
        classes, into, out = exchange(before, after, classes, moves[:, :CLASSES] - before.T @ of, moves[:CLASSES].T - after.T @ of)
        parts = again.where("kind = 1").select("block", "bucket", "places", "counts", "before", "after", F.lit(None).cast("binary").alias("classes"))
        none = F.lit(None).cast("binary")
        parts = parts.unionByName(answers.where("block IS NULL").select("block", "bucket", none.alias("places"), none.alias("counts"), none.alias("before"), none.alias("after"), "classes"))
        new = written(parts.groupBy("bucket").applyInArrow(light(_exchanged(into, out)), ANSWERS_DDL), "answers")
        discard(again, answers)
        answers = new
    if seen is not None:
        seen += [known, classes]

    own = answers.where("block IS NULL").select(F.col("bucket").cast("long").alias("k"), F.lit(0).alias("segment"), F.col("sums").alias("counts"))
    sums = summed(own, n_buckets, KINDS + 2)
    class_size = np.bincount(classes, weights=word_count, minlength=KINDS) + sums[:KINDS]
    once = int(sums[-1] + (word_count == 1).sum())
    n = int(class_size[:CLASSES].sum()) + ends
    v = int(sums[-2] + (word_count > 0).sum() + (ends > 0))
    class_size = np.maximum(class_size, 1)
    step = light(_classed(known.n, word_count, classes.astype(np.uint8), ends, n, v, class_size, once), two=True)
    kind = "block long, ids array<long>, held array<boolean>, n binary, known binary, base binary, emitted binary, classes binary, k long, segment int, counts binary"
    said = answers.where("block IS NOT NULL").select("block", "bucket", "counts", "classes")
    classed = written(blocks.groupBy("block").cogroup(said.groupBy("block")).applyInArrow(step, kind), "classed")
    discard(coded, answers)
    moves = summed(classed.select("k", "segment", "counts"), n_blocks, 3 * KINDS * KINDS).reshape(3, KINDS, KINDS)
    result = classed.select("ids", "held", "n", "known", "base", "emitted", "classes").mapInArrow(
        _scored(transitions(moves), n),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
    return result.withColumnRenamed("doc_id", id_col)
