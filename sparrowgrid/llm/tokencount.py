"""Token counts without token ids: pieces are counted once for each distinct pre-token of the corpus.

Merges of a SentencePiece BPE model never cross from another character into a white space mark, nor a line break (no
piece of the vocabulary holds either inside; this is checked when the model is loaded). So a text falls into pre-tokens
that are counted alone: a run of spaces with what follows up to the next space or line break, and each line break.

1. A scan deals texts in blocks. A block's row holds, for each document, its pre-tokens (by their place among the block's
   distinct ones, sorted by hash) with their frequencies; its distinct pre-tokens go by ranges of their 64-bit hash, spelt out.
2. A range meets each distinct pre-token of the corpus once, counts its pieces with the library, and answers each block.
   Blocks' rows pass through some range, so that one scan and no stored table serves both.
3. Blocks join their answers and sum frequency times pieces by document.

Nulls: a null text is the empty text (0 tokens). Long texts are counted whole; a text over a block's size is a block.
Repeated rows stay; further columns of the input are left out. An empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowgrid.llm.shared import batches, lean, mix, packed, runs, small_batches, span_hashes, texts_of, unpacked

MARK = "▁".encode()
#: Bytes of text of a block, and bytes of corpus for each range of hashes.
BLOCK_BYTES, RANGE_BYTES = 8 << 20, 64 << 20
#: A block's documents (kind 0) and its distinct pre-tokens of a range (kind 1): ``lengths`` and ``spelt``, in the order of hashes.
DEALT = pa.schema(
    [("kind", pa.int32()), ("block", pa.int64()), ("range", pa.int64()), ("ids", pa.list_(pa.int64())), ("n_bytes", pa.list_(pa.int64()))]
    + [("sizes", pa.binary()), ("places", pa.binary()), ("counts", pa.binary()), ("lengths", pa.binary()), ("spelt", pa.binary())]
)
#: The blocks' documents, or (range is set) the pieces of a block's pre-tokens of a range.
ANSWERS = pa.schema([("block", pa.int64()), ("range", pa.int64()), *list(DEALT)[3:8], ("pieces", pa.binary())])
OUT = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


class Counter:
    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        mark = MARK.decode()
        if any("\n" in p or mark in p.lstrip(mark) for p in pieces) or self.model.encode("a", out_type=str) != [mark + "a"]:
            raise ValueError(f"{path}: its pieces cross word borders, or it adds no leading space")
        self.lead = len(self.model.encode("\n"))

    def pieces(self, pre_tokens: list[bytes]) -> np.ndarray:
        """Pieces of pre-tokens, each counted alone. A leading space is the one that the model adds itself; where there is none, a line break keeps it away."""
        led = [p[:1] == b" " for p in pre_tokens]
        ask = [(p[1:] if x else b"\n" + p).decode("utf-8", "replace") for p, x in zip(pre_tokens, led, strict=True)]
        got = self.model.encode(ask, num_threads=1)
        # A pre-token of one space: the library gives nothing for an empty text, but a piece for the mark alone.
        return np.array([(len(g) if p != b" " else 1) if x else len(g) - self.lead for p, x, g in zip(pre_tokens, led, got, strict=True)], np.int64)


class PreTokens:
    """The pre-tokens of a run of texts: document and hash of each, and the distinct ones sorted by hash."""

    def __init__(self, texts: list[bytes]):
        # Every text that isn't empty starts with the space that the model adds; texts are parted by a zero byte.
        ready = [b" " + t.replace(MARK, b" ") if t else b"" for t in texts]
        joined = b"\0".join(ready) + b"\0"
        buf = np.frombuffer(joined, np.uint8)
        end = np.cumsum([len(t) + 1 for t in ready])
        cut = np.zeros(len(buf) + 1, bool)
        space, line = buf == 32, buf == 10
        cut[:-1] = space
        cut[1:-1] &= ~space[:-1]  # a run of spaces belongs to what follows
        cut[:-1] |= line
        cut[1:] |= line
        border = end - 1
        cut[border] = cut[end] = True
        cut[0] = True
        edges = np.flatnonzero(cut)
        start, stop = edges[:-1], edges[1:]
        real = np.ones(len(start), bool)
        real[np.searchsorted(start, border)] = False
        start, stop = start[real], stop[real]
        self.joined, self.start, self.stop = joined, start, stop
        self.doc = np.searchsorted(border, start, side="right")
        self.hashes, self.first, self.place = np.unique(span_hashes(buf, start, stop), return_index=True, return_inverse=True)

    def spelt(self, i: int) -> bytes:
        return self.joined[self.start[self.first[i]] : self.stop[self.first[i]]]


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One counter for each worker process."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def tight(x: np.ndarray) -> bytes:
    return zlib.compress(packed(x), 1)


def _deal(n_ranges: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24

        def block(ids: list, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
            p = PreTokens(texts)
            n = len(p.hashes)
            # Frequencies of (document, pre-token), in that order.
            key, count = np.unique(p.doc * max(n, 1) + p.place, return_counts=True)
            doc, place = key // max(n, 1), key % max(n, 1)
            step = np.diff(place, prepend=0)
            step[runs(doc)[0]] = place[runs(doc)[0]]
            rows: dict[str, list] = {f.name: [None] for f in DEALT}
            own = {"kind": 0, "block": number, "range": int(mix(np.array([number], np.uint64))[0] % np.uint64(n_ranges)), "ids": ids, "n_bytes": [len(t) for t in texts]}
            own |= {"sizes": packed(np.bincount(doc, minlength=len(texts)).astype(np.uint32)), "places": tight(step.astype(np.uint32)), "counts": tight(count.astype(np.uint32))}
            for name, x in own.items():
                rows[name] = [x]
            where = ((p.hashes >> np.uint64(32)) * np.uint64(n_ranges) >> np.uint64(32)).astype(np.int64)
            cut = runs(where)[0].tolist()
            for a, b in zip(cut, [*cut[1:], n], strict=True):
                spelt = [p.spelt(i) for i in range(a, b)]
                mine = {"kind": 1, "block": number, "range": int(where[a]), "lengths": packed(np.array([len(x) for x in spelt], np.uint32)), "spelt": zlib.compress(b"".join(spelt), 1)}
                for f in DEALT:
                    rows[f.name].append(mine.get(f.name))
            yield batches(rows, DEALT)

        ids, texts, size = [], [], 0
        for b in frames:
            for i, t in zip(b.column(0).to_pylist(), texts_of(b.column(1)), strict=True):
                ids.append(i)
                texts.append(t)
                size += len(t) + 1
                if size >= BLOCK_BYTES:
                    yield from block(ids, texts)
                    number += 1
                    ids, texts, size = [], [], 0
        if ids:
            yield from block(ids, texts)

    return run


def _answered(model: str):
    def run(part: pa.Table) -> pa.Table:
        """Pieces of each block's pre-tokens in a range; each distinct one is counted once. Rows of documents pass through."""
        own = part.filter(pc.equal(part.column("kind"), 0))
        rows = {c: own.column(c).to_pylist() for c in ("block", "ids", "n_bytes", "sizes", "places", "counts")} | {"range": [None] * len(own), "pieces": [None] * len(own)}
        part = part.filter(pc.equal(part.column("kind"), 1))
        if len(part):
            size = [unpacked(x.as_py(), np.uint32).astype(np.int64) for x in part.column("lengths")]
            data = b"".join(zlib.decompress(x.as_py()) for x in part.column("spelt"))
            end = np.cumsum(np.concatenate(size))
            start = np.concatenate(([0], end[:-1]))
            _, first, which = np.unique(span_hashes(np.frombuffer(data, np.uint8), start, end), return_index=True, return_inverse=True)
            pieces = counter(model).pieces([data[start[i] : end[i]] for i in first])[which]
            cut = np.cumsum([len(x) for x in size])[:-1]
            rows["block"] += part.column("block").to_pylist()
            rows["range"] += part.column("range").to_pylist()
            rows["pieces"] += [packed(x.astype(np.uint32)) for x in np.split(pieces, cut)]
            for c in ("ids", "n_bytes", "sizes", "places", "counts"):
                rows[c] += [None] * len(part)
        return pa.table({f.name: pa.array(rows[f.name], f.type) for f in ANSWERS})

    return run


def _summed(part: pa.Table) -> pa.Table:
    """Tokens of each document of a block: frequency times pieces, summed."""
    said = part.filter(pc.is_null(part.column("sizes"))).sort_by("range")
    pieces = np.concatenate([np.empty(0, np.int64), *[unpacked(x.as_py(), np.uint32) for x in said.column("pieces")]])
    rows: dict[str, list] = {f.name: [] for f in OUT}
    for r in part.filter(pc.is_valid(part.column("sizes"))).select(["ids", "n_bytes", "sizes", "places", "counts"]).to_pylist():
        size = unpacked(r["sizes"], np.uint32).astype(np.int64)
        step, count = (unpacked(zlib.decompress(r[c]), np.uint32).astype(np.int64) for c in ("places", "counts"))
        # Places are steps within each document.
        total = np.concatenate(([0], np.cumsum(step)))
        place = total[1:] - np.repeat(total[np.cumsum(size) - size], size)
        doc = np.repeat(np.arange(len(size)), size)
        rows["id"] += r["ids"]
        rows["n_bytes"] += r["n_bytes"]
        rows["n_tokens"] += np.bincount(doc, weights=count * pieces[place].astype(np.int64), minlength=len(size)).astype(np.int64).tolist()
    return pa.table({f.name: pa.array(rows[f.name], f.type) for f in OUT})


def count(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit`` of every whole text, without begin, end or other added tokens."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_ranges = int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_bytes // RANGE_BYTES + 1))
    docs_of = "ids array<long>, n_bytes array<long>, sizes binary, places binary, counts binary"
    dealt = rows.mapInArrow(lean(_deal(n_ranges)), f"kind int, block long, range long, {docs_of}, lengths binary, spelt binary")
    said = dealt.groupBy("range").applyInArrow(_answered(model), f"block long, range long, {docs_of}, pieces binary")
    out = said.groupBy("block").applyInArrow(_summed, "id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit).withColumnRenamed("id", id_col)
