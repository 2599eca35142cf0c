"""Language of a text by prediction by partial matching: the language whose frozen byte contexts give the shortest code.

Training counts, for each language, which byte follows each context of up to ``ORDER`` bytes, over every labelled text.
Contexts are a tree: a context's counts are at most those of its suffix. A byte is coded in the longest context that the
tree holds: with n occurrences of q distinct followers, a follower seen c times has probability c / (n + q), and escape to
the next shorter context has q / (n + q). Followers of the longer context are left out of the shorter one's counts (full
exclusion), so every context's probabilities sum to one over the 256 bytes; below the empty context the bytes that are left
are equally likely. As statistics are frozen, what was left out depends on the two contexts alone and is stored beside them.
The code length of a text is the sum over all its bytes; at its start contexts are shorter.

1. A scan counts, per task and language, each byte with its longest context (``ORDER`` + 1 bytes in one number); Spark sums
   them and derives the shorter contexts by cutting these numbers.
2. Contexts stay that occur at least so often that the tree has no more than ``NODES`` followers; how often is read off a
   histogram by powers of two, for each language. Suffixes occur no less, so what stays is a tree. This bounds what is broadcast.
3. A scan codes every text: each distinct (context, byte) of a chunk is scored once for all languages, and remembered.

Nulls: a null or empty text, or a null language, teaches nothing; a text that is null or has no letter (Unicode category L)
is ``und`` with score 0, as are all texts where nothing was learnt. Equal code lengths go to the smaller name. Repeated rows
each give a row and count each; other columns are left out whatever their names. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrowgrid.llm.shared import batches, chunks, discard, lean, runs, small_batches, texts_of, written

#: Bytes of the longest context.
ORDER = 4
#: Followers that the trees of all languages hold together.
NODES = 1 << 20
#: Distinct grams that a task sums, or remembers the code lengths of, before it lets go of them.
KEPT = 1 << 21
#: A gram is its length above its bytes, the last byte lowest.
TAG = 8 * (ORDER + 1)
UNKNOWN = "und"
COUNTS = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])
OUT = pa.schema([("id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("bits", pa.float64()), ("n_bytes", pa.int64())])


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For every byte the gram of it and up to ORDER bytes before it in its text; offsets of the texts."""
    buf = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64)
    size = np.array([len(t) for t in texts], np.int64)
    at = np.concatenate(([0], np.cumsum(size)))
    code = buf.copy()
    for k in range(1, ORDER + 1):
        code[k:] |= buf[:-k] << np.uint64(8 * k)
    code |= np.uint64((ORDER + 1) << TAG)
    for k in range(ORDER):
        # The k-th byte of a text has a gram of k + 1 bytes.
        i = at[:-1][size > k] + k
        code[i] = code[i] & np.uint64((1 << 8 * (k + 1)) - 1) | np.uint64((k + 1) << TAG)
    return code, at


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    code, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    first = runs(code)[0]
    return code[first], np.add.reduceat(n, first)


def _counted(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grams of each language's texts with their counts, summed over the task."""
    have: dict[str, list] = {}
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        for lang, parts in have.items():
            code, n = _summed(parts)
            for i in range(0, len(code), 1 << 16):
                some = code[i : i + (1 << 16)].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(some), pa.array(n[i : i + (1 << 16)])], schema=COUNTS)

    for b in frames:
        by: dict[str, list[bytes]] = {}
        for lang, t in zip(b.column(0).to_pylist(), texts_of(b.column(1)), strict=True):
            by.setdefault(lang, []).append(t)
        for lang, texts in by.items():
            for _, some in chunks(texts):
                code, n = np.unique(grams(some)[0], return_counts=True)
                have.setdefault(lang, []).append((code, n.astype(np.int64)))
                size += len(code)
        if size > KEPT:
            have = {lang: [_summed(parts)] for lang, parts in have.items()}
            size = sum(len(p[0][0]) for p in have.values())
            if size > KEPT // 2:
                yield from out()
                have, size = {}, 0
    yield from out()


@dataclass
class Tree:
    """Contexts and followers of one language, sorted by gram; a context is a gram too, of 0 to ORDER bytes."""

    gram: np.ndarray  # context and follower
    count: np.ndarray
    context: np.ndarray
    n: np.ndarray
    q: np.ndarray
    #: Occurrences, in the context's suffix, of the followers that the context has.
    out: np.ndarray

    @staticmethod
    def grown(gram: np.ndarray, count: np.ndarray) -> Tree:
        order = np.argsort(gram)
        gram, count = gram[order], count[order].astype(np.int64)
        above = shorter(gram)
        by = np.argsort(above, kind="stable")
        first = runs(above[by])[0]
        suffix = cut(gram, np.maximum(length(gram).astype(np.int64) - 1, 1))
        at = np.searchsorted(gram, suffix)
        return Tree(gram, count, above[by][first], np.add.reduceat(count[by], first), np.diff(np.append(first, len(gram))), np.add.reduceat(count[at][by], first))

    def bits(self, code: np.ndarray) -> np.ndarray:
        """Bits that code the last byte of each gram after the bytes before it."""
        total = np.zeros(len(code))
        left = np.arange(len(code))  # not coded yet
        # What the longer context, if the tree holds it, has taken: occurrences here of its followers, and these.
        taken_n, taken_q = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
        have = length(code).astype(np.int64)
        for order in range(ORDER, -1, -1):
            i = left[have[left] > order]
            here = cut(code[i], order + 1)
            above = shorter(here)
            at = np.minimum(np.searchsorted(self.context, above), len(self.context) - 1)
            seen = self.context[at] == above
            i, here, at = i[seen], here[seen], at[seen]
            n, q = self.n[at] - taken_n[i], self.q[at] - taken_q[i]
            k = np.minimum(np.searchsorted(self.gram, here), len(self.gram) - 1)
            known = self.gram[k] == here
            # A context whose followers are all left out is escaped from for certain.
            some = q > 0
            total[i[known]] += np.log2((n[known] + q[known]) / self.count[k[known]])
            away = some & ~known
            total[i[away]] += np.log2((n[away] + q[away]) / q[away])
            taken_n[i], taken_q[i] = self.out[at], self.q[at]
            coded = np.zeros(len(code), bool)
            coded[i[known]] = True
            left = left[~coded[left]]
        # Bytes that the language never showed share what is left.
        total[left] += np.log2(256 - taken_q[left])
        return total


def length(gram: np.ndarray) -> np.ndarray:
    return gram >> np.uint64(TAG)


def cut(gram: np.ndarray, size) -> np.ndarray:
    """The last ``size`` bytes of each gram."""
    size = np.asarray(size, np.uint64)
    return gram & ((np.uint64(1) << (size * np.uint64(8))) - np.uint64(1)) | (size << np.uint64(TAG))


def shorter(gram: np.ndarray) -> np.ndarray:
    """The context of each gram: all bytes but the last."""
    return ((gram & np.uint64((1 << TAG) - 1)) >> np.uint64(8)) | ((length(gram) - np.uint64(1)) << np.uint64(TAG))


@dataclass
class Trees:
    langs: list[str]
    trees: list[Tree]

    def code(self, texts: list[bytes], memory: dict) -> np.ndarray:
        """Code lengths in bits, a row for each text and a column for each language."""
        out = np.zeros((len(texts), len(self.langs)))
        for at, some in chunks(texts):
            code, edges = grams(some)
            distinct, place = np.unique(code, return_inverse=True)
            bits = self._remembered(distinct, memory)
            full = np.flatnonzero(np.diff(edges))
            if len(full):
                out[at + full] = np.add.reduceat(bits[place], edges[:-1][full], axis=0)
        return out

    def _remembered(self, distinct: np.ndarray, memory: dict) -> np.ndarray:
        known, table = memory.get("gram", np.empty(0, np.uint64)), memory.get("bits", np.empty((0, len(self.langs))))
        at = np.minimum(np.searchsorted(known, distinct), max(len(known) - 1, 0))
        new = distinct[known[at] != distinct] if len(known) else distinct
        if len(new):
            if len(known) > KEPT // len(self.langs):
                known, table, new = known[:0], table[:0], distinct
            both = np.concatenate((known, new))
            order = np.argsort(both, kind="stable")
            known, table = both[order], np.concatenate((table, np.stack([t.bits(new) for t in self.trees], 1)))[order]
            memory["gram"], memory["bits"] = known, table
        return table[np.searchsorted(known, distinct)]


def learn(docs: DataFrame, held_out: Column, lang_col: str = "lang", text_col: str = "text", nodes: int = NODES) -> Trees:
    """Trees of every language of the rows that aren't held out. ``nodes`` bounds the followers that all trees hold."""
    small_batches(docs.sparkSession)
    rows = docs.where(~F.coalesce(held_out, F.lit(False)) & F.col(lang_col).isNotNull() & (F.octet_length(text_col) > 0))
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.lower(text_col).alias("text"))
    counted = rows.mapInArrow(lean(_counted), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    size = F.shiftright("gram", TAG).cast("int")
    parts = counted.withColumn("size", F.explode(F.sequence(F.lit(1), size)))
    low = F.expr(f"(gram & (shiftleft(1L, 8 * size) - 1)) | shiftleft(cast(size as bigint), {TAG})")
    table = written(parts.groupBy("lang", low.alias("gram")).agg(F.sum("n").alias("n")), "grams")
    above = F.expr(f"shiftright(gram & (shiftleft(1L, {TAG}) - 1), 8) | shiftleft(shiftright(gram, {TAG}) - 1, {TAG})")
    followers = table.withColumn("above", above)
    contexts = followers.groupBy("lang", "above").agg(F.sum("n").alias("often"), F.count("*").alias("q"))
    # Followers by how often their context occurs: a row for each power of two.
    seen = contexts.groupBy("lang", F.floor(F.log2("often")).cast("int").alias("power")).agg(F.sum("q").alias("q")).collect()
    langs = sorted({r.lang for r in seen})
    share = nodes // max(len(langs), 1)
    least = []
    for lang in langs:
        total, power = 0, 64
        for r in sorted((r for r in seen if r.lang == lang), key=lambda r: -r.power):
            total += r.q
            if total > share and power < 64:
                break
            power = r.power
        least.append((lang, 1 << power))
    if not langs:
        discard(table)
        return Trees([], [])
    bounds = docs.sparkSession.createDataFrame(least, "lang string, least long")
    stay = contexts.join(F.broadcast(bounds), "lang").where(F.col("often") >= F.col("least")).select("lang", "above")
    kept = followers.join(stay, ["lang", "above"], "left_semi").select("lang", "gram", "n").toArrow()
    discard(table)
    names = np.array(kept.column("lang").to_pylist(), object)
    gram, n = kept.column("gram").to_numpy().view(np.uint64), kept.column("n").to_numpy()
    return Trees(langs, [Tree.grown(gram[names == x], n[names == x]) for x in langs])


def score(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, lang_pred, score, bits, n_bytes``: the language of the shortest code, its share of the languages' probability
    of the text, the code's length, and the bytes coded (of the text in lower case)."""
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(trees)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, memory = model.value, {}
        for b in frames:
            texts = texts_of(b.column(1))
            if trees.langs:
                bits = trees.code(texts, memory)
                best = bits.argmin(1)
                least = bits[np.arange(len(texts)), best]
                share = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
            columns = {"id": b.column(0).to_pylist(), "n_bytes": [len(t) for t in texts], "lang_pred": [], "score": [], "bits": []}
            for i, letter in enumerate(b.column(2).to_pylist()):
                known = bool(letter) and bool(trees.langs)
                columns["lang_pred"].append(trees.langs[best[i]] if known else UNKNOWN)
                columns["score"].append(float(share[i]) if known else 0.0)
                columns["bits"].append(float(least[i]) if known else None)
            yield batches(columns, OUT)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.lower(text_col).alias("text"), F.col(text_col).rlike(r"\p{L}").alias("letter"))
    return rows.mapInArrow(lean(run), "id long, lang_pred string, score double, bits double, n_bytes long").withColumnRenamed("id", id_col)
