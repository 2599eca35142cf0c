"""Lexical scores made and reduced inside the task that holds the documents: pairs of queries and documents are never rows.

Queries of a bounded number of terms go to every task; documents are read once and kept as numbers of the terms that queries ask
for. A task scores its documents by both measures (BM25, and shared terms over the root of the length) and lets go only of what
can still be among the first ones.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparrowgrid.functions import text as T
from sparrowgrid.operators.graph import cut, free
from sparrowgrid.operators.retrieval import FEW, K1, B

#: Scores that are made at once, texts whose terms are counted at once, and numbers of a task's bars at most.
CELLS, ROWS, GROUPS = 1 << 20, 1024, 4_000_000


@dataclass(frozen=True)
class Index:
    """``rows``: ``doc, tokens, dl, term array<int>, tf array<int>``; term t is asked for by ``query[start[t] : start[t + 1]]``, places in ``ids``."""

    rows: DataFrame
    ids: np.ndarray
    start: np.ndarray
    query: np.ndarray
    idf: np.ndarray
    avg_dl: float


def index(docs: DataFrame, queries: DataFrame, id_col: str, text_col: str, query_id: str, query_text: str) -> Index | None:
    """None where queries have more than ``FEW`` terms, or where ids are null or not unique."""
    spark = docs.sparkSession
    rows = cut(queries.select(F.col(query_id).cast("long").alias("query"), F.explode(F.array_distinct(T.terms(F.col(query_text)))).alias("term")).distinct())
    if not 0 < rows.count() <= FEW:
        return None
    asked = rows.orderBy("term", "query").toArrow()  # at most FEW rows
    if asked.column("query").null_count:
        return None
    known = asked.column("term").combine_chunks().dictionary_encode()
    # Rows are in the order of terms, so numbers of terms ascend.
    number, words = known.indices.to_numpy(), spark.sparkContext.broadcast(known.dictionary)
    ids, query = np.unique(asked.column("query").to_numpy(), return_inverse=True)
    start = np.searchsorted(number, np.arange(len(known.dictionary) + 1))

    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(k, ROWS) for whole in frames for k in range(0, whole.num_rows, ROWS)):
            lists = b.column("t")
            dl = pc.list_value_length(lists)  # none without a text, which counts as a document all the same
            n = pc.fill_null(dl, 0).to_numpy()
            found = lists.flatten().dictionary_encode()
            code = pc.fill_null(pc.index_in(found.dictionary, value_set=words.value), -1).to_numpy().astype(np.int64)[found.indices.to_numpy()]
            key, tf = np.unique((np.repeat(np.arange(len(n)), n) << 32 | code)[code >= 0], return_counts=True)
            edge = pa.array(np.searchsorted(key >> 32, np.arange(len(n) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(edge, pa.array(x.astype(np.int32))) for x in (key & 0xFFFFFFFF, tf)]
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("tokens"), dl.cast(pa.int64()), *lists], names=["doc", "tokens", "dl", "term", "tf"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc"), T.token_estimate(F.col(text_col)).alias("tokens"), T.terms(F.col(text_col)).alias("t"))
    kept = cut(texts.mapInArrow(count, "doc long, tokens long, dl long, term array<int>, tf array<int>"))
    n, distinct, avg_dl = kept.agg(F.count("*"), F.count_distinct("doc"), F.greatest(F.avg("dl"), F.lit(1e-6))).first()
    if n != distinct:
        return None
    held = kept.select(F.explode("term").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toArrow()  # at most a row for each term asked for
    free(spark)
    df = np.zeros(len(known.dictionary))
    df[held.column("term").to_numpy()] = held.column("df").to_numpy()
    return Index(kept, ids, start, query.astype(np.int64), np.log((n - df + 0.5) / (df + 0.5) + 1), avg_dl or 1e-6)


def rounded(x: np.ndarray, places: int) -> np.ndarray:
    return np.floor(x * 10.0**places + 0.5) / 10.0**places


class Scores:
    """Scores of a batch of documents, a part at a time."""

    def __init__(self, at: Index):
        self.start, self.query, self.idf, self.avg_dl, self.queries = at.start, at.query, at.idf, at.avg_dl, len(at.ids)

    def __call__(self, b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """``row, query, bm25, overlap`` of every pair that shares a term: rows of the batch, places of queries, scores to nine digits."""
        lists = b.column("term")
        edge = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy())))
        term, tf = lists.flatten().to_numpy().astype(np.int64), b.column("tf").flatten().to_numpy()
        dl = pc.fill_null(b.column("dl"), 0).to_numpy()
        many = self.start[term + 1] - self.start[term]
        met = np.concatenate(([0], np.cumsum(many)))[edge]
        # Cells: those of the parts' table of scores, and postings met.
        most = max(1, CELLS // self.queries)
        low = 0
        while low < len(dl):
            high = max(low + 1, min(low + most, int(np.searchsorted(met, met[low] + CELLS, "right")) - 1))
            part = slice(edge[low], edge[high])
            yield self._part(low, dl[low:high], np.diff(edge[low : high + 1]), term[part], tf[part], many[part])
            low = high

    def _part(self, low: int, dl: np.ndarray, n: np.ndarray, term: np.ndarray, tf: np.ndarray, many: np.ndarray):
        row = np.repeat(np.arange(len(n)), n)
        weight = self.idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[row] / self.avg_dl))
        at = np.repeat(self.start[term] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        key = np.repeat(row * self.queries, many) + self.query[at]
        shared = np.bincount(key, minlength=len(n) * self.queries)
        score = np.bincount(key, np.repeat(weight, many), minlength=len(shared))
        hit = np.flatnonzero(shared)
        row = hit // self.queries
        return row + low, hit % self.queries, rounded(score[hit], 9), rounded(shared[hit] / np.sqrt(dl[row]), 9)


class First:
    """The k greatest scores of each group so far, with what belongs to them; equal scores go to the smaller id."""

    def __init__(self, groups: int, k: int):
        self.k, self.bar, self.parts, self.size = k, np.full(groups, -np.inf), [], 0

    def take(self, group: np.ndarray, score: np.ndarray, doc: np.ndarray, *more: np.ndarray) -> None:
        keep = np.flatnonzero(score >= self.bar[group])
        self.parts.append([x[keep] for x in (group, score, doc, *more)])
        self.size += len(keep)
        if self.size > CELLS // 4:
            self._cut()

    def _cut(self) -> None:
        rows = [np.concatenate(x) for x in zip(*self.parts, strict=True)]
        order = np.lexsort((rows[2], -rows[1], rows[0]))
        group = rows[0][order]
        place = np.arange(len(order)) - np.searchsorted(group, group)
        rows, place = [x[order[place < self.k]] for x in rows], place[place < self.k]
        last = place == self.k - 1
        self.bar[rows[0][last]] = rows[1][last]
        self.parts, self.size = [rows], 0

    def found(self) -> list[np.ndarray] | None:
        if not self.parts:
            return None
        self._cut()
        return self.parts[0]


class Packable:
    """Documents of each query that greedy picks of ``k`` under a budget could take.

    One can't be picked after k others of different families that score better (or as well, with a smaller id) and have no more
    tokens: each fits wherever it does, and comes first. Nor can one after such a one of its own family.
    """

    def __init__(self, queries: int, budget: int, k: int):
        self.budget, self.k, self.bar, self.parts, self.size = budget, k, np.full((queries, budget + 1), -np.inf), [], 0

    def take(self, query: np.ndarray, score: np.ndarray, doc: np.ndarray, tokens: np.ndarray, *family: np.ndarray) -> None:
        keep = np.flatnonzero((tokens <= self.budget) & (score >= self.bar[query, np.minimum(tokens, self.budget)]))
        self.parts.append([x[keep] for x in (query, score, doc, tokens, *family)])
        self.size += len(keep)
        if self.size > CELLS // 16:
            self._cut()

    def _cut(self) -> None:
        rows = [np.concatenate(x) for x in zip(*self.parts, strict=True)]
        order = np.lexsort((rows[2], -rows[1], rows[0]))
        rows = [x[order] for x in rows]
        kept, query = [], None
        for i, (q, s, t, family) in enumerate(zip(rows[0].tolist(), rows[1].tolist(), rows[3].tolist(), zip(rows[4].tolist(), rows[5].tolist(), strict=True), strict=True)):
            if q != query:
                # The least tokens of each family so far, and all of them in order.
                query, least, small = q, {}, []
            full = len(small) >= self.k
            if full and t >= small[self.k - 1] or t >= least.get(family, t + 1):
                continue
            kept.append(i)
            if family in least:
                small.remove(least[family])
            least[family] = t
            before = small[self.k - 1] if full and len(small) >= self.k else self.budget + 1
            insort(small, t)
            if len(small) >= self.k and small[self.k - 1] < before:
                new = self.bar[q, small[self.k - 1] : before]
                np.maximum(new, s, out=new)
        self.parts, self.size = [[x[kept] for x in rows]], 0

    found = First.found


def top(at: Index, k: int, places: int = 9) -> DataFrame:
    """``query, doc, score, tokens, rank``: the k best documents of each query by BM25 to so many digits; ties by smaller id."""
    score, ids, n = Scores(at), at.ids, len(at.ids)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = First(n, k)
        for b in frames:
            doc, tokens = b.column("doc").to_numpy(), b.column("tokens").to_numpy()
            for row, query, s, _ in score(b):
                best.take(query, rounded(s, places), doc[row], tokens[row])
        if rows := best.found():
            yield pa.RecordBatch.from_arrays([pa.array(ids[rows[0]]), *[pa.array(x) for x in (rows[2], rows[1], rows[3])]], names=["query", "doc", "score", "tokens"])

    found = at.rows.mapInArrow(run, "query long, doc long, score double, tokens long")
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), "doc")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def pairs(at: Index) -> DataFrame:
    """``query, doc, score`` of every pair, to six digits: for what can't be reduced in a task."""
    score, ids = Scores(at), at.ids

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            doc = b.column("doc").to_numpy()
            for row, query, s, _ in score(b):
                yield pa.RecordBatch.from_arrays([pa.array(ids[query]), pa.array(doc[row]), pa.array(rounded(s, 6))], names=["query", "doc", "score"])

    return at.rows.mapInArrow(run, "query long, doc long, score double")


def packable(at: Index, budget: int, k: int, families: DataFrame | None = None) -> tuple[DataFrame, DataFrame] | None:
    """``query, doc, score, tokens, component`` that greedy picks could take (``Packable``; BM25 to six digits), and ``query, n``: how many documents have a score.

    ``families``: ``node, component``; others are families of their own. None where a task would hold too many numbers.
    """
    score, ids, n = Scores(at), at.ids, len(at.ids)
    if n * (budget + 1) > GROUPS:
        return None
    if families is None:
        rows = at.rows.withColumn("component", F.lit(None).cast("long"))
    else:
        rows = at.rows.join(families.select(F.col("node").alias("doc"), F.col("component").cast("long").alias("component")), "doc", "left")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, scored = Packable(n, budget, k), np.zeros(n, np.int64)
        for b in frames:
            doc, tokens = b.column("doc").to_numpy(), b.column("tokens").to_numpy()
            alone = pc.is_null(b.column("component")).to_numpy(zero_copy_only=False)
            family = np.where(alone, doc, pc.fill_null(b.column("component"), 0).to_numpy())
            for row, query, s, _ in score(b):
                scored += np.bincount(query, minlength=n)
                best.take(query, rounded(s, 6), doc[row], tokens[row], family[row], alone[row])
        names = ["query", "doc", "score", "tokens", "component"]
        if found := best.found():
            query, s, doc, tokens, family, alone = found
            yield pa.RecordBatch.from_arrays([pa.array(ids[query]), pa.array(doc), pa.array(s), pa.array(tokens), pa.array(family, mask=alone)], names=names)
        # Counts are rows without a score.
        none = np.ones(n, bool)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids, mask=none), pa.array(np.zeros(n), mask=none), pa.array(scored), pa.array(ids, mask=none)], names=names)

    found = cut(rows.select("doc", "tokens", "dl", "term", "tf", "component").mapInArrow(run, "query long, doc long, score double, tokens long, component long"))
    counts = found.where("score IS NULL").groupBy("query").agg(F.sum("tokens").alias("n")).where("n > 0")
    return found.where("score IS NOT NULL"), counts


def fused(at: Index, k: int, constant: int = 60) -> DataFrame | None:
    """``query, doc, first, second, score, rank``: the k best by reciprocal rank fusion of all ranks by BM25 (``first``) and by overlap (``second``),
    with the best of either; None where a query's candidates are too many.

    Both measures rank the same documents. One among the k best by BM25 fuses to more than ``1 / (constant + k)``, so one behind
    place ``constant + 2 k`` of both can't be among the k best. Candidates are those up to there; their ranks are counted, not
    sorted: each task tells how many of its documents come between one candidate and the next.
    """
    depth = constant + 2 * k
    score, ids, n = Scores(at), at.ids, len(at.ids)
    if 2 * depth * n > FEW * 4:
        return None

    def leading(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [First(n, depth), First(n, depth)]
        for b in frames:
            doc = b.column("doc").to_numpy()
            for row, query, s, o in score(b):
                best[0].take(query, s, doc[row], o)
                best[1].take(query, o, doc[row], s)
        for side, f in enumerate(best):
            if rows := f.found():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows[0]), side)), pa.array(rows[0]), pa.array(rows[2]), pa.array(rows[1 + 2 * side]), pa.array(rows[3 - 2 * side])], names=["side", "query", "doc", "s", "o"])

    found = at.rows.mapInArrow(leading, "side long, query long, doc long, s double, o double")
    w = Window.partitionBy("side", "query").orderBy(F.when(F.col("side") == 0, F.col("s")).otherwise(F.col("o")).desc(), "doc")
    found = found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= depth).select("query", "doc", "s", "o").distinct().toArrow()  # at most 2 * depth of a query
    query, doc, both = found.column("query").to_numpy(), found.column("doc").to_numpy(), [found.column(c).to_numpy() for c in ("s", "o")]
    orders = [np.lexsort((doc, -x, query)) for x in both]
    docs = np.unique(doc)
    keys = []
    for x, order in zip(both, orders, strict=True):
        main = query[order] - 1j * x[order]
        # Among equal scores, an id's place: that of a candidate is odd, of one between two even.
        low = np.searchsorted(main, main, "left")
        keys.append((main, low + 1j * (2 * np.searchsorted(docs, doc[order]) + 1)))
    end = np.searchsorted(np.sort(query), np.arange(n), "right")

    def between(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(query) + 1, np.int64) for _ in keys]
        for b in frames:
            mine = b.column("doc").to_numpy()
            place = 2 * np.searchsorted(docs, mine, "left") + np.isin(mine, docs)
            for row, q, s, o in score(b):
                for c, (main, tie), x in zip(counts, keys, (s, o), strict=True):
                    key = q - 1j * x
                    at = np.searchsorted(main, key, "left")
                    same = np.flatnonzero((at < len(main)) & (main[np.minimum(at, len(main) - 1)] == key))
                    at[same] = np.searchsorted(tie, at[same] + 1j * place[row[same]], "right")
                    # What comes before no candidate of its query doesn't count.
                    c += np.bincount(at[at < end[q]], minlength=len(c))
        for side, c in enumerate(counts):
            there = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(there), side)), pa.array(there), pa.array(c[there])], names=["side", "at", "n"])

    counted = at.rows.mapInArrow(between, "side long, at long, n long").groupBy("side", "at").agg(F.sum("n").alias("n")).toArrow()
    ranks = []
    for side, order in enumerate(orders):
        mine = counted.column("side").to_numpy() == side
        c = np.zeros(len(query) + 1, np.int64)
        c[counted.column("at").to_numpy()[mine]] = counted.column("n").to_numpy()[mine]
        upto = np.cumsum(c)[:-1]
        begin = np.searchsorted(query[order], query[order], "left")
        rank = np.empty(len(query), np.int64)
        rank[order] = 1 + upto - np.where(begin > 0, upto[begin - 1], 0)
        ranks.append(rank)
    spark: SparkSession = at.rows.sparkSession
    rows = spark.createDataFrame(pa.table({"query": ids[query], "doc": doc, "first": ranks[0], "second": ranks[1]}), "query long, doc long, first long, second long")
    total = F.round(1.0 / (constant + F.col("first")) + 1.0 / (constant + F.col("second")), 9)
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), "doc")
    return rows.withColumn("score", total).withColumn("rank", F.row_number().over(w))
