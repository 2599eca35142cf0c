"""Ranked lexical search: for each item the k documents of the highest impact-weighted term overlap, exactly.

A document that holds a term of weight w tf times, in a text of n terms, gets ``w * ((1000000000 * tf) div (1000 * tf + 8 * m))``
with ``m = 25 + (75 * n * N) div L``; its score is the sum over an item's terms, repeats included. All else is whole numbers.

1. A scan writes an inverted index in blocks: a row holds some megabytes of texts as sorted term hashes with their documents
   and occurrences. N, L and lengths come from the same rows.
2. Terms that items ask for meet the blocks in parts; a task keeps, for each term, its documents' number and the k highest
   impacts. Their union gives a term's weight, greatest impact and k-th impact: k documents score at least the k-th impact of
   any one term, so the greatest of these over an item's terms is a threshold of the item.
3. An item's terms in the order of their greatest share: the first ones, as long as they add up to less than the threshold,
   can lift no document to it by themselves. They are pruned: candidates come from the other terms.
4. Blocks meet items in parts. In a task, candidates are documents whose essential terms and the sum of what the pruned ones can
   add reach the threshold, which rises to the item's k-th score so far in the task; they are scored exactly. Each task gives
   its k best for each item, and the best of these stay.

Terms are maximal runs of ASCII letters and digits (A-Z as a-z) and characters over 0x7F, compared by 64-bit hash. Nulls: a null
text has no terms; rows of ``items`` that share an id (or have none) are one item with the terms of all; each row of ``docs`` is
a document of its own, whatever its id, and a null id comes after others in a tie. Items without a match give no rows. Other
columns are left out whatever their names. Empty tables give an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparrowgrid.llm.shared import batches, chunks, discard, gaps, lean, packed, release, runs, small_batches, texts_of, unpacked, words, written

#: Letters and digits of ASCII, in lower case, and all bytes of other characters; the rest parts terms.
TERM = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i > 127 else 32 for i in range(256))
#: Bytes of text of an index block, rows of (item, term) or terms of a part, and (document, item) cells that are scored at once.
BLOCK_BYTES, PART_ROWS, CELLS = 4 << 20, 1 << 17, 1 << 22
#: Bytes of packed parts up to which they are broadcast.
BROADCAST_BYTES = 32 << 20
INDEX = pa.schema(
    [("block", pa.int64()), ("n_docs", pa.int64()), ("n_terms", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.binary())]
    + [(c, pa.binary()) for c in ("terms", "df", "places", "counts")]
)
INDEX_DDL = "block long, n_docs long, n_terms long, ids array<long>, sizes binary, terms binary, df binary, places binary, counts binary"


def counted(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of each text: how many; and by hash, then text: hash, text and occurrences of the distinct ones."""
    size, parts = [], []
    for at, some in chunks(texts):
        _, _, _, h, edges = words(some, TERM)
        n = np.diff(edges)
        size.append(n)
        doc = np.repeat(np.arange(at, at + len(some)), n)
        order = np.lexsort((doc, h))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        parts.append((h[first], doc[first], np.diff(np.append(first, len(h)))))
    h, doc, tf = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, np.uint64), *(np.empty(0, np.int64),) * 2)
    order = np.argsort(h, kind="stable")  # texts rise within a chunk and from chunk to chunk
    return np.concatenate(size) if size else np.empty(0, np.int64), h[order], doc[order], tf[order]


def _tight(x: np.ndarray) -> bytes:
    return zlib.compress(packed(x), 1)


def _loose(data: bytes, kind) -> np.ndarray:
    return unpacked(zlib.decompress(data), kind)


def _indexed(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32

    def block(ids: list, texts: list[bytes]) -> pa.RecordBatch:
        size, h, doc, tf = counted(texts)
        first = runs(h)[0]
        step = np.diff(doc, prepend=0)
        step[first] = doc[first]
        row = {
            "block": number, "n_docs": int((size > 0).sum()), "n_terms": int(size.sum()), "ids": ids, "sizes": _tight(size.astype(np.uint32)), "terms": _tight(gaps(h[first])),
            "df": _tight(np.diff(np.append(first, len(h))).astype(np.uint32)), "places": _tight(step.astype(np.uint32)), "counts": _tight(tf.astype(np.uint32)),
        }
        return batches({k: [v] for k, v in row.items()}, INDEX)

    ids, texts, size = [], [], 0
    for b in frames:
        for i, t in zip(b.column(0).to_pylist(), texts_of(b.column(1)), strict=True):
            ids.append(i)
            texts.append(t)
            size += len(t) + 1
            if size >= BLOCK_BYTES:
                yield block(ids, texts)
                number += 1
                ids, texts, size = [], [], 0
    if ids:
        yield block(ids, texts)


class Block:
    """A row of the index: postings of the terms that are asked for, with whole-number impacts per unit of weight."""

    def __init__(self, row: dict, n_docs: int, n_terms: int):
        size = _loose(row["sizes"], np.uint32)
        self.ids = row["ids"]
        # Whole numbers of any size, one for each document.
        self.m = np.array([25 + 75 * n * n_docs // max(n_terms, 1) for n in size.tolist()], np.int64)
        self.terms = np.cumsum(_loose(row["terms"], np.uint64))
        self.df = _loose(row["df"], np.uint32).astype(np.int64)
        self.start = np.cumsum(self.df) - self.df
        self.step, self.tf = (_loose(row[c], np.uint32).astype(np.int64) for c in ("places", "counts"))

    def postings(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For sorted hashes: place among them, document and impact of each posting, by place and document."""
        at = np.minimum(np.searchsorted(self.terms, asked), max(len(self.terms) - 1, 0))
        which = np.flatnonzero(self.terms[at] == asked) if len(self.terms) else np.empty(0, np.int64)
        at = at[which]
        df = self.df[at]
        begin = np.cumsum(df) - df
        i = np.arange(df.sum()) - np.repeat(begin, df) + np.repeat(self.start[at], df)
        total = np.concatenate(([0], np.cumsum(self.step[i])))
        doc = total[1:] - np.repeat(total[begin], df)
        tf = self.tf[i]
        return np.repeat(which, df), doc, 1_000_000_000 * tf // (1000 * tf + 8 * self.m[doc])


def _best(k: int, by: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Places of the first k of each group, in the order of groups, then of ``keys``."""
    order = np.lexsort((*keys[::-1], by))
    first, group = runs(by[order])
    return order[np.arange(len(order)) - first[group] < k]


STATS = pa.schema([("term", pa.int64()), ("df", pa.int64()), ("highest", pa.list_(pa.int64()))])


def _term_stats(k: int, n_docs: int, n_terms: int):
    """Rows of the index with a part of the asked terms to each term's documents and k highest impacts of the task."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[int, list] = {}
        for b in frames:
            for row in b.to_pylist():
                asked = np.frombuffer(row["asked"], np.uint64)
                term, _, impact = Block(row, n_docs, n_terms).postings(asked)
                mine = have.setdefault(row["part"], [asked, np.zeros(len(asked), np.int64), np.empty(0, np.int64), np.empty(0, np.int64)])
                mine[1] += np.bincount(term, minlength=len(asked))
                term, impact = np.concatenate((mine[2], term)), np.concatenate((mine[3], impact))
                some = _best(k, term, -impact)
                mine[2:] = term[some], impact[some]
        for asked, df, term, impact in have.values():
            seen = np.flatnonzero(df)
            ends = np.cumsum(np.bincount(term, minlength=len(asked))[seen])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(impact))
            yield pa.RecordBatch.from_arrays([pa.array(asked[seen].view(np.int64)), pa.array(df[seen]), lists], schema=STATS)

    return run


PART = pa.schema([("part", pa.int64()), ("items", pa.list_(pa.int64())), ("threshold", pa.binary()), ("item", pa.binary()), ("term", pa.binary()), ("share", pa.binary()), ("essential", pa.binary()), ("rest", pa.binary())])


def _packed_part(part: pa.Table) -> pa.Table:
    """Items of a part: per item its id, threshold and what its pruned terms can add; per (term, item), by term, the weight."""
    item = part.column("number").to_numpy()
    distinct, first, place = np.unique(item, return_index=True, return_inverse=True)
    term, share, top = part.column("term").to_numpy().view(np.uint64), part.column("share").to_numpy(), part.column("top").to_numpy()
    essential = part.column("essential").to_numpy(zero_copy_only=False).astype(np.uint8)
    rest = np.zeros(len(distinct), np.int64)
    np.add.at(rest, place, np.where(essential, 0, share * top))
    ids = part.column("item").to_pylist()
    order = np.lexsort((place, term))
    row = {
        "part": part.column("part")[0].as_py(), "items": [ids[i] for i in first], "threshold": part.column("threshold").to_numpy()[first].tobytes(), "rest": rest.tobytes(),
        "item": place[order].astype(np.int64).tobytes(), "term": term[order].tobytes(), "share": share[order].tobytes(), "essential": essential[order].tobytes(),
    }
    return pa.table({f.name: pa.array([row[f.name]], f.type) for f in PART})


class Part:
    """Items with their terms, and the k best documents of each so far."""

    def __init__(self, row: dict, k: int):
        self.k, self.ids = k, row["items"]
        self.threshold, self.rest = np.frombuffer(row["threshold"], np.int64).copy(), np.frombuffer(row["rest"], np.int64)
        item, share = np.frombuffer(row["item"], np.int64), np.frombuffer(row["share"], np.int64)
        self.terms, term = np.unique(np.frombuffer(row["term"], np.uint64), return_inverse=True)
        essential = np.frombuffer(row["essential"], np.uint8) == 1
        # Essential terms by term, so that postings find their items; pruned ones by item, so that candidates find their terms.
        self.term, self.item, self.share = term[essential], item[essential], share[essential]
        pruned = np.flatnonzero(~essential)
        pruned = pruned[np.argsort(item[pruned], kind="stable")]
        self.more_term, self.more_share = term[pruned], share[pruned]
        self.more = np.searchsorted(item[pruned], np.arange(len(self.ids) + 1))
        self.best = tuple(np.empty(0, np.int64) for _ in range(4))  # item, score, id is null, id

    def meet(self, block: Block) -> None:
        place, doc, impact = block.postings(self.terms)
        n = len(block.ids)
        key = place * n + doc  # sorted
        # Items are taken in slices that keep the table of scores small.
        width = max(1, CELLS // max(n, 1))
        for low in range(0, len(self.ids), width):
            high = min(len(self.ids), low + width)
            mine = np.flatnonzero((self.item >= low) & (self.item < high))
            at, to = np.searchsorted(place, self.term[mine]), np.searchsorted(place, self.term[mine], side="right")
            score = np.zeros((high - low) * n, np.int64)
            for some in np.array_split(np.arange(len(mine)), int((to - at).sum()) // CELLS + 1):
                count = (to - at)[some]
                i = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(at[some], count)
                np.add.at(score, np.repeat(self.item[mine][some] - low, count) * n + doc[i], np.repeat(self.share[mine][some], count) * impact[i])
            cell = np.flatnonzero(score)
            item = cell // n + low
            able = score[cell] + self.rest[item] >= self.threshold[item]
            cell, item = cell[able], item[able]
            if len(cell):
                self._keep(block, item, cell % n, score[cell], key, impact, n)

    def _keep(self, block: Block, item: np.ndarray, doc: np.ndarray, score: np.ndarray, key: np.ndarray, impact: np.ndarray, n: int) -> None:
        """Adds what the pruned terms give to each candidate, and keeps each item's best."""
        size = self.more[item + 1] - self.more[item]
        for some in np.array_split(np.arange(len(item)), int(size.sum()) // CELLS + 1):
            count = size[some]
            i = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.more[item[some]], count)
            want = self.more_term[i] * n + np.repeat(doc[some], count)
            at = np.minimum(np.searchsorted(key, want), len(key) - 1)
            np.add.at(score, np.repeat(some, count), np.where(key[at] == want, self.more_share[i] * impact[at], 0))
        good = np.flatnonzero((score >= self.threshold[item]) & (score > 0))
        ids = [block.ids[d] for d in doc[good].tolist()]
        null = np.array([x is None for x in ids], np.int64)
        new = (item[good], score[good], null, np.array([0 if x is None else x for x in ids], np.int64))
        both = tuple(np.concatenate(x) for x in zip(self.best, new, strict=True))
        order = _best(self.k, both[0], -both[1], both[2], both[3])
        self.best = tuple(x[order] for x in both)
        # k documents of this task score at least the k-th score here.
        first, group = runs(self.best[0])
        last = np.flatnonzero(np.arange(len(group)) - first[group] == self.k - 1)
        self.threshold[self.best[0][last]] = np.maximum(self.threshold[self.best[0][last]], self.best[1][last])


FOUND = pa.schema([("item", pa.int64()), ("score", pa.int64()), ("id", pa.int64())])


def _scored(k: int, n_docs: int, n_terms: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, Part] = {}
        for b in frames:
            for row in b.to_pylist():
                if row["part"] not in parts:
                    parts[row["part"]] = Part(row, k)
                parts[row["part"]].meet(Block(row, n_docs, n_terms))
        for part in parts.values():
            item, score, null, doc = part.best
            columns = {"item": [part.ids[i] for i in item.tolist()], "score": score, "id": [None if x else d for x, d in zip(null.tolist(), doc.tolist(), strict=True)]}
            yield batches(columns, FOUND)
        release()

    return run


def _meeting(index: DataFrame, parts: DataFrame, n_parts: int) -> DataFrame:
    """Every block beside every part, by number. Parts of a checked size are broadcast; larger ones are copied for each of
    ``salts`` and shuffled, so that a part's blocks are not one group."""
    blocks = index.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_parts - 1).cast("long"))))
    binary = [F.octet_length(c) for c, kind in parts.dtypes if kind == "binary"]
    if (parts.agg(F.sum(sum(binary, F.lit(0)))).first()[0] or 0) <= BROADCAST_BYTES:
        return blocks.join(F.broadcast(parts), "part")
    salts = F.lit(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))).cast("long")
    parts = parts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)))
    return blocks.withColumn("salt", F.pmod(F.xxhash64("block"), salts)).join(parts, ["part", "salt"]).drop("salt")


def _first(rows: DataFrame, k: int, by: list[str], order: list) -> DataFrame:
    """The first k rows of each group with their rank, by way of groups that are salted."""
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(64)))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by, "_salt").orderBy(*order))).where(F.col("rank") <= k).drop("_salt", "rank")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def _asked(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item, term, c``: distinct terms of each item with their occurrences."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("item", pa.int64()), ("term", pa.int64()), ("c", pa.int64())])
        for b in frames:
            ids = b.column(0).to_pylist()
            _, h, doc, tf = counted(texts_of(b.column(1)))
            yield batches({"item": [ids[d] for d in doc.tolist()], "term": h.view(np.int64), "c": tf}, schema)

    rows = items.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).alias("text")).mapInArrow(run, "item long, term long, c long")
    return rows.groupBy("item", "term").agg(F.sum("c").alias("c"))


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_col, rank, id_col, score``: each item's k documents of the highest score over 0 (all, if fewer); equal scores by id."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    index = written(rows.mapInArrow(lean(_indexed), INDEX_DDL), "lexical-index")
    n_docs, n_terms = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    asked = written(_asked(items, item_col, text_col), "asked")

    def packed_terms(part: pa.Table) -> pa.Table:
        terms = np.sort(part.column("term").to_numpy().view(np.uint64))
        return pa.table({"part": part.column("part")[:1], "asked": pa.array([terms.tobytes()], pa.binary())})

    vocabulary = asked.select("term").distinct()
    n_parts = vocabulary.count() // PART_ROWS + 1
    terms = vocabulary.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(n_parts)))
    terms = written(terms.groupBy("part").applyInArrow(packed_terms, "part long, asked binary"), "asked-terms")
    stats = _meeting(index, terms, n_parts).mapInArrow(lean(_term_stats(k, n_docs, n_terms)), "term long, df long, highest array<long>")
    stats = written(stats, "term-parts")
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    df = stats.groupBy("term").agg(F.sum("df").alias("df")).select("term", weight.alias("w"))
    highest = _first(stats.select("term", F.explode("highest").alias("impact")), k, ["term"], [F.desc("impact")])
    highest = highest.groupBy("term").agg(F.max("impact").alias("top"), F.coalesce(F.max(F.when(F.col("rank") == k, F.col("impact"))), F.lit(0)).alias("kth"))
    # What a term can add to a document's score of the item, smallest first; the first sums under the threshold prune.
    bounds = asked.join(df, "term").join(highest, "term").withColumn("share", F.col("c") * F.col("w"))
    mine = Window.partitionBy("item")
    bounds = bounds.withColumn("threshold", F.max(F.col("share") * F.col("kth")).over(mine))
    so_far = F.sum(F.col("share") * F.col("top")).over(mine.orderBy(F.col("share") * F.col("top"), "term").rowsBetween(Window.unboundedPreceding, 0))
    bounds = bounds.withColumn("essential", so_far >= F.col("threshold")).withColumn("number", F.xxhash64(F.col("item").isNull(), "item"))
    n_parts = asked.count() // PART_ROWS + 1
    parts = bounds.select(F.pmod("number", F.lit(n_parts)).alias("part"), "number", "item", "term", "share", "top", "threshold", "essential")
    ddl = "part long, items array<long>, threshold binary, item binary, term binary, share binary, essential binary, rest binary"
    parts = written(parts.groupBy("part").applyInArrow(_packed_part, ddl), "asked-items")
    found = _meeting(index, parts, n_parts).mapInArrow(_scored(k, n_docs, n_terms), "item long, score long, id long")
    out = written(_first(found, k, ["item"], [F.desc("score"), F.asc_nulls_last("id")]), "lexical-found")
    discard(index, asked, terms, stats, parts)
    return out.select(F.col("item").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
