"""Exact top-k inner products over integer vectors, pruned by norms.

Components are floor(64 * x); inner products are integers, so results are exact and ties are real ties.

1. The Gram matrix of all vectors (its size is the dimension's square) is summed over tasks; its eigenvectors are the
   right singular vectors of the table. They rotate vectors so that the first coordinates carry most of an inner product.
2. Vectors and queries are sorted by descending length into blocks of their own by range partitioning. The longest vectors
   (``HEAD`` rows, a fixed number) give every query a first k-th score, and a block of queries a length that a vector must
   have for any of its queries to reach that score (Cauchy-Schwarz): only blocks that hold such vectors are sent to meet it.
3. In a block of vectors, taken in order of descending length, a query stops where |q| |x| can't reach its k-th score; of
   the rest, the product of the first rotated coordinates plus the product of the lengths of the other coordinates bounds the score, and
   only vectors whose bound reaches the k-th score get their integer product. Bounds have slack for rounding.

Vectors that are null, empty, or hold null or non-finite components take no part, as queries or candidates; nor do rows without an
id. Vectors must have one dimension (others raise). Ties go to the smaller id; rows that repeat an id are candidates of
their own, except a query's own id; of query rows that repeat an id, the least vector asks. Components must fit 31 bits after scaling. Further columns are left out. An empty
table gives an empty table.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparrowgrid.llm.shared import batches, written

K, SCALE = 20, 64.0
#: Longest vectors that give first thresholds, queries of a block, and vectors of a block.
HEAD, QUERIES, BLOCK = 2048, 4096, 8192
#: Rotated coordinates of the partial sums, as a share of the dimension.
LEADING = 0.25

PACKED = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("vectors", pa.binary()), ("dim", pa.int32()), ("longest", pa.float64())])
ASKED = pa.schema([*PACKED, ("bars", pa.binary()), ("x_blocks", pa.list_(pa.int64()))])
FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def integers(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id, v array<long>`` of usable rows, and the square of the length."""
    scaled = F.transform(F.col(vec_col).cast("array<double>"), lambda x: F.floor(x * F.lit(SCALE)))
    finite = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & (F.size(vec_col) > 0)).where(finite)
    v = rows.select(F.col(id_col).cast("long").alias("id"), scaled.alias("v"))
    return v.withColumn("square", F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def _matrix(column: pa.Array) -> np.ndarray:
    sizes = np.unique(np.diff(column.offsets.to_numpy()))
    if len(sizes) > 1:
        raise ValueError("vectors have several dimensions")
    flat = column.flatten().to_numpy()
    if len(flat) and np.abs(flat).max() >= 2**31:
        raise ValueError("components don't fit 31 bits after scaling")
    return flat.reshape(len(column), -1)


def _gram(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for b in frames:
        if b.num_rows:
            m = _matrix(b.column(0)).astype(float)
            total = m.T @ m if total is None else total + m.T @ m
    if total is not None:
        yield batches({"gram": [total.reshape(-1)]}, pa.schema([("gram", pa.list_(pa.float64()))]))


def _packer(size: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, held = [], [], 0
        for b in itertools.chain(frames, [None]):
            if b is not None and b.num_rows:
                ids.append(b.column(0).to_numpy())
                rows.append(_matrix(b.column(1)).astype(np.int32))
                held += b.num_rows
            while held and (held >= size or b is None):
                i, m = np.concatenate(ids), np.concatenate(rows)
                out = {"block": [uuid.uuid4().int >> 65], "ids": [i[:size].tobytes()], "vectors": [m[:size].tobytes()], "dim": [m.shape[1]]}
                yield batches(out | {"longest": [np.sqrt((m[:size].astype(float) ** 2).sum(1).max())]}, PACKED)
                ids, rows, held = [i[size:]], [m[size:]], max(0, held - size)

    return run


class Ranker:
    """Running top k of each query of a block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, rotation: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors.astype(np.int64), k
        self.rotation, self.lead = rotation, max(1, int(np.ceil(rotation.shape[0] * LEADING)))
        turned = vectors @ rotation
        self.norm, self.first, self.rest = _parts(vectors, turned, self.lead)
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in ids]
        self.bar = np.full(len(ids), -np.inf)

    def meet(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Vectors in any order; they are taken by descending length."""
        norm = np.sqrt((vectors.astype(float) ** 2).sum(1))
        order = np.lexsort((ids, -norm))
        for at in range(0, len(order), 1024):
            some = order[at : at + 1024]
            alive = np.flatnonzero(self.norm * norm[some[0]] * (1 + 1e-9) + 1e-6 >= self.bar)
            if not len(alive):
                break
            x = vectors[some]
            xn, xf, xr = _parts(x, x @ self.rotation, self.lead)
            bound = self.first[alive] @ xf.T + self.rest[alive][:, None] * xr[None, :]
            slack = 1e-9 * self.norm[alive][:, None] * xn[None, :] + 1e-6
            left = bound + slack >= self.bar[alive][:, None]
            left &= self.ids[alive][:, None] != ids[some][None, :]
            xi = x.astype(np.int64)
            for r in np.flatnonzero(left.any(1)):
                q, c = alive[r], np.flatnonzero(left[r])
                score = xi[c] @ self.vectors[q]
                s, v = np.concatenate((self.best[q][0], score)), np.concatenate((self.best[q][1], ids[some][c]))
                top = np.lexsort((v, -s))[: self.k]
                self.best[q] = s[top], v[top]
                if len(top) == self.k:
                    self.bar[q] = max(self.bar[q], float(s[top[-1]]))


def _parts(vectors: np.ndarray, turned: np.ndarray, lead: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length, leading rotated coordinates, and length of the other coordinates."""
    square = (vectors.astype(float) ** 2).sum(1)
    return np.sqrt(square), turned[:, :lead], np.sqrt((turned[:, lead:] ** 2).sum(1))


def search(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best of all other rows for each row on which ``is_query`` (of ``id``) holds."""
    spark = vectors.sparkSession
    rows = written(integers(vectors, id_col, vec_col), "vectors")
    grams = rows.select("v").mapInArrow(_gram, "gram array<double>")
    sums = grams.select(F.posexplode("gram").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").toArrow()
    dim = int(round(sums.num_rows**0.5))
    if not dim:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    values, turn = np.linalg.eigh(sums.column("x").to_numpy().reshape(dim, dim))
    turn = turn[:, np.argsort(-values)]
    head = rows.orderBy(F.col("square").desc(), "id").limit(HEAD).select("id", "v").toArrow().combine_chunks()
    head_ids, head_vectors = head.column("id").to_numpy(), _matrix(head.column("v").chunk(0) if head.num_rows else pa.array([], pa.list_(pa.int64())))
    kept = spark.sparkContext.broadcast((turn, head_ids, head_vectors))

    n = rows.count()
    packed = "block long, ids binary, vectors binary, dim int, longest double"

    def by_length(some: DataFrame, groups: int) -> DataFrame:
        return some.repartitionByRange(groups, F.col("square").desc(), "id").sortWithinPartitions(F.col("square").desc(), "id").select("id", "v")

    groups = max(1, -(-n // BLOCK))
    blocks = written(by_length(rows, groups).mapInArrow(_packer(BLOCK), packed), "blocks").withColumnRenamed("block", "x_block")
    # The length of the longest vector of every block: 16 bytes for BLOCK rows.
    longest = blocks.select("x_block", "longest").toArrow()
    numbers, lengths = longest.column("x_block").to_numpy(), longest.column("longest").to_numpy()
    asked = rows.where(is_query).groupBy("id").agg(F.min(F.struct("v", "square")).alias("q")).select("id", "q.v", "q.square")
    n_asked = asked.count()

    def meets(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query's first bar, and the blocks of vectors that hold one long enough for some query."""
        turn, head_ids, head_vectors = kept.value
        for b in frames:
            for r in b.to_pylist():
                first = Ranker(np.frombuffer(r["ids"], np.int64), np.frombuffer(r["vectors"], np.int32).reshape(-1, r["dim"]), turn, k)
                first.meet(head_ids, head_vectors)
                with np.errstate(divide="ignore", invalid="ignore"):
                    reach = np.where(first.norm > 0, (first.bar - 1e-6) / (first.norm * (1 + 1e-9)), -np.inf).min()
                yield batches({f.name: [r[f.name]] for f in PACKED} | {"bars": [first.bar.tobytes()], "x_blocks": [numbers[lengths >= reach]]}, ASKED)

    queries = by_length(asked, max(1, -(-n_asked // QUERIES))).mapInArrow(_packer(QUERIES), packed)
    queries = written(queries.mapInArrow(meets, packed + ", bars binary, x_blocks array<long>"), "queries")
    met = queries.withColumn("x_block", F.explode("x_blocks"))
    sent = blocks.join(met.select("block", "x_block"), "x_block").select("block", "x_block", "ids", "vectors", "dim", F.lit(None).cast("binary").alias("bars"))
    both = met.select("block", "x_block", "ids", "vectors", "dim", "bars").union(sent)
    tasks = max(groups, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(part: pa.Table) -> pa.Table:
        turn, _, _ = kept.value
        q, x = sorted(part.to_pylist(), key=lambda r: r["bars"] is None)
        ranker = Ranker(np.frombuffer(q["ids"], np.int64), np.frombuffer(q["vectors"], np.int32).reshape(-1, q["dim"]), turn, k)
        # The k-th score among the longest vectors is a bar that the final k-th score can't be under.
        ranker.bar = np.frombuffer(q["bars"], float).copy()
        ranker.meet(np.frombuffer(x["ids"], np.int64), np.frombuffer(x["vectors"], np.int32).reshape(-1, x["dim"]))
        size = [len(s) for s, _ in ranker.best]
        out = {"query_id": np.repeat(ranker.ids, size), "vec_id": np.concatenate([v for _, v in ranker.best]), "score": np.concatenate([s for s, _ in ranker.best])}
        return pa.Table.from_batches([batches(out, FOUND)])

    found = both.repartition(tasks, "block", "x_block").groupBy("block", "x_block").applyInArrow(run, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
