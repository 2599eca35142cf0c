"""All-pairs similarity by blocks of vectors, reduced inside the task that makes the pairs.

A block is one row of packed bytes, up to ``BLOCK`` vectors. Blocks have numbers from 0 on, so a block's copies for every
other block come from a sequence, without a join; one shuffle brings the two blocks of a pair together, on explicit
numbers, once for both directions where a table meets itself. A numpy kernel makes their similarities by strips, and only a
reduced result (best per label, top k, pairs over a threshold) leaves the task, never the pairs. What is moved is the table
times the number of its blocks, so these are few and large; vectors that are floats move as such.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparrowgrid.operators import graph

EPS = 1e-8
#: Vectors of a block at most and at least, bytes of its vectors as floats at most, and blocks that a table is cut into at least.
BLOCK, LEAST, BYTES, BLOCKS = 98_304, 256, 25 << 20, 6
#: Rows and columns whose similarities are made at once, and their number where a strip meets a whole block.
STRIP, TILE, CELLS = 512, 1024, 1 << 21
#: More than what rounding to nine places can move a similarity.
NEAR = 1e-9
PACKED = "block long, n long, kind string, ids binary, vectors binary, labels binary"


def matrix(rows) -> np.ndarray:
    return np.array([np.asarray(r, np.float64) for r in rows], np.float64).reshape(len(rows), -1)


def unit(m: np.ndarray) -> np.ndarray:
    """Rows over their length, the length floored."""
    return m / np.maximum(np.sqrt((m * m).sum(1)), EPS)[:, None]


class Block:
    """Vectors with ascending ids; labels are NaN where there is none. ``v`` are the vectors in doubles, ``u`` those of unit length, ``f`` these in floats.

    Whole blocks are kept as they came and as ``f``; doubles are for rows (``some``) and for kernels that need all of them.
    """

    def __init__(self, id: np.ndarray, raw: np.ndarray, label: np.ndarray):
        self.id, self.raw, self.label = id, raw, label

    @cached_property
    def v(self) -> np.ndarray:
        return self.raw.astype(np.float64)

    @cached_property
    def u(self) -> np.ndarray:
        return unit(self.raw.astype(np.float64))

    @cached_property
    def f(self) -> np.ndarray:
        out = np.empty(self.raw.shape, np.float32)
        for k in range(0, len(out), TILE):
            out[k : k + TILE] = self.some(slice(k, k + TILE))
        return out

    def some(self, rows: slice | np.ndarray, cosine: bool = True) -> np.ndarray:
        """Some of its vectors in doubles, for cosines of unit length."""
        v = self.raw[rows].astype(np.float64)
        return unit(v) if cosine else v

    @cached_property
    def by_label(self) -> Block:
        """Its labelled vectors, those of a label side by side."""
        order = np.argsort(self.label, kind="stable")
        return self[order[~np.isnan(self.label[order])]]

    def __getitem__(self, rows: slice | np.ndarray) -> Block:
        out = Block(self.id[rows], self.raw[rows], self.label[rows])
        for c in ("v", "u", "f"):
            if c in self.__dict__:
                out.__dict__[c] = self.__dict__[c][rows]
        return out


def _pack(part: pa.Table) -> pa.Table:
    order = np.argsort(part.column("id").to_numpy(), kind="stable")
    vectors = part.column("v").combine_chunks()
    if len(np.unique(np.diff(vectors.offsets.to_numpy()))) > 1:
        raise ValueError("vectors have several dimensions")
    v = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(part), -1)[order]
    label = part.column("label").to_numpy(zero_copy_only=False).astype(np.float64)[order]
    with np.errstate(over="ignore"):
        short = v.astype(np.float32)
    if np.array_equal(short, v, equal_nan=True):
        v = short
    row = {"block": part.column("block")[:1], "n": [len(part)], "kind": [v.dtype.str], "ids": [part.column("id").to_numpy()[order].tobytes()], "vectors": [v.tobytes()], "labels": [label.tobytes()]}
    return pa.table(row)


def _rows(df: DataFrame, id_col: str, vec_col: str, label_col: str | None = None) -> tuple[DataFrame, int, int]:
    """``id, v, label`` without null ids and vectors, their number, and how many of them a block holds at most."""
    label = F.col(label_col).cast("double") if label_col else F.lit(None).cast("double")
    rows = df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), label.alias("label"))
    n, width = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    return rows, n, max(1, min(BLOCK, BYTES // (4 * max(width or 1, 1))))


def _blocks(rows: DataFrame, n: int, most: int, count: int) -> tuple[DataFrame, int]:
    count = max(1, min(count, -(-n // LEAST)), -(-n // most))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(count)))
    return dealt.groupBy("block").applyInArrow(_pack, PACKED), count


def blocks(df: DataFrame, id_col: str, vec_col: str, label_col: str | None = None) -> tuple[DataFrame, int]:
    """Packed blocks, numbered from 0, and how many numbers there are.

    Rows are dealt by a hash of the id, so blocks are even whatever the ids are. Null ids and null vectors take no part.
    """
    return _blocks(*_rows(df, id_col, vec_col, label_col), _least_blocks(df))


def _least_blocks(df: DataFrame) -> int:
    """As many blocks as give every core four pairs of them."""
    return max(BLOCKS, math.ceil(math.sqrt(4 * df.sparkSession.sparkContext.defaultParallelism)))


def two_sides(queries: DataFrame, entries: DataFrame, id_col: str, vec_col: str, label_col: str | None = None, both: bool = False) -> tuple[tuple[DataFrame, int], tuple[DataFrame, int]]:
    """Packed blocks of queries and of (labelled) entries; with ``both``, queries are labelled too. Of a few queries there are few blocks, so that what is moved stays near the size of the entries."""
    (a, n_a, most_a), (b, n_b, most_b) = _rows(queries, id_col, vec_col, label_col if both else None), _rows(entries, id_col, vec_col, label_col)
    pairs = _least_blocks(entries) ** 2
    left = _blocks(a, n_a, most_a, min(pairs, max(1, round(math.sqrt(pairs * n_a / max(n_b, 1))))))
    return left, _blocks(b, n_b, most_b, -(-pairs // left[1]))


def against(left: tuple[DataFrame, int], right: tuple[DataFrame, int], kernel: Callable, schema: str, whole: bool = False) -> DataFrame:
    """``kernel(strip of a left block, right block)`` for every pair of blocks.

    Where ``left is right``, two blocks meet once, and the kernel gets them both ways. A ``whole`` kernel gets two whole blocks and
    whether a block meets itself (else, of a table with itself, only one of the two ways) and gives several results.
    """
    (a, n_a), (b, n_b) = left, right
    alone = left is right
    first = lambda lo, hi: F.explode(F.sequence(F.lit(lo).cast("long") if isinstance(lo, int) else lo, F.lit(hi).cast("long") if isinstance(hi, int) else hi))
    cols = ["n", "kind", "ids", "vectors", "labels"]
    x = a.select("block", first(F.col("block") if alone else 0, n_b - 1).alias("other"), F.lit(0).alias("side"), *cols)
    y = (b.where("block > 0") if alone else b).select(first(0, F.col("block") - 1 if alone else n_a - 1).alias("at"), F.col("block").alias("other"), F.lit(1).alias("side"), *cols)
    names = [c.split(" ")[0] for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "double": pa.float64()}
    types = [kinds[c.split(" ")[1]] for c in schema.split(", ")]

    def strips(x: Block, y: Block) -> list[dict]:
        step = max(1, min(STRIP, CELLS // max(len(y.id), 1)))
        return [kernel(x[k : k + step], y) for k in range(0, len(x.id), step)]

    def run(part: pa.Table) -> pa.Table:
        two: dict[int, Block] = {}
        for k in range(len(part)):
            r = {c: part.column(c)[k] for c in ("n", "kind", "side", "ids", "vectors", "labels")}
            two[r["side"].as_py()] = Block(np.frombuffer(r["ids"].as_buffer(), np.int64), np.frombuffer(r["vectors"].as_buffer(), r["kind"].as_py()).reshape(r["n"].as_py(), -1), np.frombuffer(r["labels"].as_buffer(), np.float64))
        itself = alone and part.column("block")[0] == part.column("other")[0]
        if itself:
            two[1] = two[0]
        found = []
        if len(two) == 2:
            found = kernel(two[0], two[1], itself) if whole else strips(two[0], two[1]) + (strips(two[1], two[0]) if alone and not itself else [])
        parts = [pa.table({c: pa.array(f[c], t) for c, t in zip(names, types, strict=True)}) for f in found]
        return pa.concat_tables(parts) if parts else pa.table({c: pa.array([], t) for c, t in zip(names, types, strict=True)})

    pairs = n_a * n_b
    tasks = max(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(2 * pairs, 1000), pairs // 8)
    return x.union(y).repartition(tasks, "block", "other").groupBy("block", "other").applyInArrow(run, schema)


def cosines(x: Block, y: Block) -> np.ndarray:
    return np.clip(x.u @ y.u.T, -1, 1)


def screen(width: int) -> float:
    """How far a cosine of unit vectors in floats can be from that in doubles, with what rounding to nine places adds."""
    return 2 * (width + 8) * 2.0**-24


def tiles(x: Block, y: Block, cosine: bool = True) -> Iterator[tuple[int, int, np.ndarray, float, Callable]]:
    """``at, to, s, slack, exact``: similarities tile by tile, of cosines in floats; ``exact(r, c)`` has those of some of a tile in doubles, rounded."""
    slack = screen(x.raw.shape[1]) if cosine else NEAR
    for at in range(0, len(x.id), STRIP):
        left, strip = slice(at, at + STRIP), []
        for to in range(0, len(y.id), TILE):
            right = slice(to, to + TILE)
            s = x.f[left] @ y.f[right].T if cosine else x.some(left, False) @ y.some(right, False).T

            def exact(r: np.ndarray, c: np.ndarray, left: slice = left, right: slice = right, n: int = s.size, strip: list = strip) -> np.ndarray:
                if not strip:
                    strip.append(x.some(left, cosine))
                a = strip[0]
                if len(r) > TILE:
                    # Of many (copies) the whole tile is cheaper.
                    b = y.some(right, cosine)
                    v = (a @ b.T)[r, c] if 20 * len(r) > n else np.einsum("ij,ij->i", a[r], b[c])
                else:
                    v = np.einsum("ij,ij->i", a[r], y.some(right.start + c, cosine))
                return np.round(np.clip(v, -1, 1) if cosine else v, 9)

            yield at, to, s, slack, exact


def hide(s: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """A row's similarity to itself counts as none; ``y`` is ascending."""
    low, high = np.searchsorted(y, x, "left"), np.searchsorted(y, x, "right")
    for r in np.flatnonzero(high > low):
        s[r, low[r] : high[r]] = -np.inf


class Best:
    """The k greatest similarities of each row so far, rounded; equal ones go to the smaller place. Places come in ascending tiles."""

    def __init__(self, n: int, k: int):
        self.k, self.s, self.at = k, np.full((n, k), -np.inf), np.full((n, k), -1)

    def take(self, s: np.ndarray, rows: int, places: int, axis: int, slack: float, exact: Callable) -> None:
        """Similarities of rows (along ``axis``) from ``rows`` on to places from ``places`` on, wrong by ``slack`` at most; ``exact`` makes those that may count."""
        n, m = s.shape[axis], s.shape[1 - axis]
        last = self.s[rows : rows + n, -1]
        # An equal similarity of a later place doesn't count; what rounding may lift does.
        bar = last - slack
        fresh = np.flatnonzero(np.isinf(last))
        if len(fresh) and m > 4 * self.k:
            t = s[fresh] if axis == 0 else s.T[fresh]
            low = -np.partition(-t, self.k - 1, axis=1)[:, self.k - 1]
            bar[fresh] = np.where(np.isnan(low), -np.inf, low - 2 * slack)
        bar = bar.astype(s.dtype)
        r, c = np.divmod(np.flatnonzero(s > (bar[:, None] if axis == 0 else bar[None, :])), s.shape[1])
        if not len(r):
            return
        v = exact(r, c)
        p, q = (r, c) if axis == 0 else (c, r)
        good = np.isfinite(v) & (v > last[p])
        if not good.any():
            return
        p, q, v = p[good] + rows, q[good] + places, v[good]
        had = np.unique(p)
        p = np.concatenate((p, np.repeat(had, self.k)))
        q, v = np.concatenate((q, self.at[had].reshape(-1))), np.concatenate((v, self.s[had].reshape(-1)))
        order = np.lexsort((q, -v, p))
        p, q, v = p[order], q[order], v[order]
        place = np.arange(len(p)) - np.searchsorted(p, p)
        keep = place < self.k
        self.s[p[keep], place[keep]], self.at[p[keep], place[keep]] = v[keep], q[keep]

    def found(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, k = np.nonzero(np.isfinite(self.s))
        return {"i": x[p], "j": y[self.at[p, k]], "s": self.s[p, k]}


def best_of_each(x: Block, y: Block, s: np.ndarray, k: int) -> dict[str, np.ndarray]:
    """The k greatest finite similarities of each row; ties go to the smaller id."""
    if s.shape[1] > 4 * k:
        # What is under the k-th value can't be among the first k; equal values stay for the sort.
        bar = -np.partition(-s, k - 1, axis=1)[:, k - 1]
        p, q = np.nonzero((s >= bar[:, None]) & np.isfinite(s))
    else:
        p, q = np.nonzero(np.isfinite(s))
    v = s[p, q]
    order = np.lexsort((y.id[q], -v, p))
    p, q, v = p[order], q[order], v[order]
    place = np.arange(len(p)) - np.searchsorted(p, p)
    keep = place < k
    return {"i": x.id[p[keep]], "j": y.id[q[keep]], "s": v[keep]}


def label_best(df: DataFrame, id_col: str, label_col: str, vec_col: str) -> DataFrame:
    """``i, li, lj, s``: best cosine of each vector to each label, itself left out."""
    b = blocks(df, id_col, vec_col, label_col)

    def kernel(x: Block, y: Block) -> dict[str, np.ndarray]:
        y = y.by_label
        s = x.u @ y.u.T
        order = np.argsort(y.id, kind="stable")
        ids = y.id[order]
        low, high = np.searchsorted(ids, x.id, "left"), np.searchsorted(ids, x.id, "right")
        for row in np.flatnonzero(high > low):
            s[row, order[low[row] : high[row]]] = -np.inf
        out = {c: [] for c in ("i", "li", "lj", "s")}
        values, starts = np.unique(y.label, return_index=True)
        for lab, start, stop in zip(values, starts, [*starts[1:], len(y.label)], strict=True):
            best = s[:, start:stop].max(1)
            good = np.isfinite(best)
            out["i"].append(x.id[good])
            out["li"].append(x.label[good])
            out["lj"].append(np.full(good.sum(), lab))
            out["s"].append(np.round(np.clip(best[good], -1, 1), 9))
        got = {c: np.concatenate(v) if v else np.empty(0) for c, v in out.items()}
        return {"i": got["i"].astype(np.int64), "li": _labels(got["li"]), "lj": _labels(got["lj"]), "s": got["s"]}

    return against(b, b, kernel, "i long, li long, lj long, s double").groupBy("i", "li", "lj").agg(F.max("s").alias("s"))


def label_top(df: DataFrame, id_col: str, label_col: str, vec_col: str, k: int, queries: DataFrame | None = None) -> DataFrame:
    """``i, lj, j, s, rank``: the k most similar vectors of each label to each vector (of ``queries``, where given), itself left out."""
    if queries is None:
        a = b = blocks(df, id_col, vec_col, label_col)
    else:
        a, b = two_sides(queries, df, id_col, vec_col, label_col)

    def kernel(x: Block, y: Block) -> dict[str, np.ndarray]:
        s = np.round(cosines(x, y), 9)
        s[x.id[:, None] == y.id[None, :]] = -np.inf
        parts = []
        for lab in np.unique(y.label[~np.isnan(y.label)]):
            mine = np.flatnonzero(y.label == lab)
            best = best_of_each(x, y[mine], s[:, mine], k)
            parts.append(best | {"lj": np.full(len(best["i"]), int(lab))})
        empty = {c: np.empty(0, np.int64) for c in ("i", "j", "lj")} | {"s": np.empty(0)}
        return {c: np.concatenate([p[c] for p in [*parts, empty]]) for c in ("i", "lj", "j", "s")}

    w = Window.partitionBy("i", "lj").orderBy(F.col("s").desc(), "j")
    return against(a, b, kernel, "i long, lj long, j long, s double").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _labels(x: np.ndarray) -> pa.Array:
    return pa.array([None if np.isnan(v) else int(v) for v in x], pa.int64())


def self_recovery(df: DataFrame, id_col: str, label_col: str, vec_col: str) -> DataFrame:
    """Share of each label's vectors whose most similar other vector has the same label; ties go to the smaller label."""
    w = Window.partitionBy("i").orderBy(F.col("s").desc(), F.col("lj"))
    pick = label_best(df, id_col, label_col, vec_col).withColumn("rn", F.row_number().over(w)).where("rn = 1")
    hit = F.when(F.col("lj") == F.col("li"), 1).otherwise(0)
    return pick.groupBy(F.col("li").alias("label")).agg(
        F.count("*").alias("n"), F.sum(hit).cast("long").alias("recovered"), F.round(F.avg(hit.cast("double")), 6).alias("rate")
    )


def top_k(queries: DataFrame, entries: DataFrame, id_col: str, vec_col: str, k: int, metric: str = "cosine", skip_self: bool = True, under: str | None = None) -> DataFrame:
    """``i, j, s, rank``: the k most similar entries of each query; ties by smaller id. ``metric``: cosine or dot.

    ``under`` names a number of both (not null): a query only takes entries whose number isn't over its own.
    """
    if under:
        a, b = two_sides(queries, entries, id_col, vec_col, under, both=True)
    elif queries is entries:
        a = b = blocks(queries, id_col, vec_col)
    else:
        a, b = two_sides(queries, entries, id_col, vec_col)
    alone = a is b

    def kernel(x: Block, y: Block, itself: bool) -> list[dict[str, np.ndarray]]:
        rows, cols = Best(len(x.id), k), Best(len(y.id), k)
        for at, to, s, slack, exact in tiles(x, y, metric == "cosine"):
            if skip_self:
                hide(s, x.id[at : at + len(s)], y.id[to : to + s.shape[1]])
            if under:
                s[x.label[at : at + len(s), None] < y.label[None, to : to + s.shape[1]]] = -np.inf
            rows.take(s, at, to, 0, slack, exact)
            if alone and not itself:
                cols.take(s, to, at, 1, slack, exact)
        return [rows.found(x.id, y.id), cols.found(y.id, x.id)]

    w = Window.partitionBy("i").orderBy(F.col("s").desc(), F.col("j"))
    found = against(a, b, kernel, "i long, j long, s double", whole=True)
    # Made once, whatever is joined to it; what was moved for it is given up.
    out = graph.cut(found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k))
    del found, a, b
    graph.free(out.sparkSession)
    return out


def all_scores(queries: DataFrame, entries: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``i, j, s``: cosine of each of a stated set of queries to every entry."""

    def kernel(x: Block, y: Block) -> dict[str, np.ndarray]:
        s = np.round(cosines(x, y), 9)
        return {"i": np.repeat(x.id, len(y.id)), "j": np.tile(y.id, len(x.id)), "s": s.reshape(-1)}

    return against(*two_sides(queries, entries, id_col, vec_col), kernel, "i long, j long, s double")


def pairs_above(df: DataFrame, id_col: str, vec_col: str, threshold: float, strict: bool = True) -> DataFrame:
    """``i, j, s`` with i < j and cosine over the threshold."""
    b = blocks(df, id_col, vec_col)

    def kernel(x: Block, y: Block, itself: bool) -> list[dict[str, np.ndarray]]:
        found = []
        for p, q, s in close(x, y, threshold, strict):
            i, j = x.id[p], y.id[q]
            keep = i < j if itself else i != j
            i, j, s = i[keep], j[keep], s[keep]
            found.append({"i": np.minimum(i, j), "j": np.maximum(i, j), "s": s})
        return found

    return against(b, b, kernel, "i long, j long, s double", whole=True)


def close(x: Block, y: Block, threshold: float, strict: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, columns and cosines over (or at) the threshold, tile by tile."""
    for at, to, s, slack, exact in tiles(x, y):
        p, q = np.divmod(np.flatnonzero(s > np.float32(threshold - slack)), s.shape[1])
        v = exact(p, q)
        keep = v > threshold if strict else v >= threshold
        yield p[keep] + at, q[keep] + to, v[keep]


def join_up(label: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Labels (least node of a component) after nodes p and q are linked."""
    while True:
        a, b = label[p], label[q]
        apart = a != b
        if not apart.any():
            return label
        p, q, a, b = p[apart], q[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]


def links_above(df: DataFrame, id_col: str, vec_col: str, threshold: float) -> DataFrame:
    """``u, v``: links that join the same vectors as all pairs of a cosine at or over the threshold would, a few per vector and block
    pair, so that a large group of like vectors makes no square of rows. For components; pairs themselves come from ``pairs_above``."""
    b = blocks(df, id_col, vec_col)

    def kernel(x: Block, y: Block, itself: bool) -> list[dict[str, np.ndarray]]:
        # Of a block with itself, a node comes as a row and as a column.
        n = 0 if itself else len(x.id)
        ids = y.id if itself else np.concatenate((x.id, y.id))
        label, links, waiting = np.arange(len(ids)), [], 0
        for p, q, _ in close(x, y, threshold, False):
            apart = label[p] != label[n + q]
            links.append((p[apart], n + q[apart]))
            waiting += int(apart.sum())
            if waiting > 4 * len(ids):
                label, links, waiting = join_up(label, *(np.concatenate(c) for c in zip(*links, strict=True))), [], 0
        if links:
            label = join_up(label, *(np.concatenate(c) for c in zip(*links, strict=True)))
        linked = np.flatnonzero(ids[label] != ids)
        return [{"u": ids[linked], "v": ids[label[linked]]}]

    return against(b, b, kernel, "u long, v long", whole=True)


def families(df: DataFrame, id_col: str, vec_col: str, nearest: DataFrame, slack: float = 0.02) -> tuple[DataFrame, float | None]:
    """``node, component`` of vectors that chains of pairs join which are about as near as the median nearest neighbour (``nearest``: ``i, s``), and that median."""
    median = order_statistics(nearest, "s", {"m": 0.5}).first()["m"]
    return graph.components(links_above(df, id_col, vec_col, (2.0 if median is None else median) - slack)), median


def mutual(top: DataFrame) -> DataFrame:
    """Pairs i < j that are in each other's lists."""
    back = top.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("s").alias("_s"))
    return top.join(back, ["i", "j"]).where("i < j").select("i", "j", "s")


def centroids(df: DataFrame, keys: list[str], vec_col: str) -> DataFrame:
    """``keys..., n, centroid``: component-wise means (not normalised), by position so that only sums are shuffled."""
    long = df.where(F.col(vec_col).isNotNull()).select(*keys, F.posexplode(F.col(vec_col).cast("array<double>")).alias("pos", "x"))
    means = long.groupBy(*keys, "pos").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    vec = F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"])
    return means.groupBy(*keys).agg(F.max("n").alias("n"), vec.alias("centroid"))


def density(top5: DataFrame, nodes: DataFrame, id_col: str) -> DataFrame:
    """``id, coherence``: mean of the five best similarities, floored at 0; 1 for a node alone."""
    mean = top5.groupBy("i").agg(F.avg("s").alias("m"))
    ids = nodes.select(F.col(id_col).cast("long").alias("i"))
    return ids.join(mean, "i", "left").select(F.col("i").alias("id"), F.when(F.col("m").isNull(), 1.0).otherwise(F.greatest(F.lit(0.0), F.col("m"))).alias("coherence"))


def earlier_top_k(df: DataFrame, id_col: str, vec_col: str, k: int) -> DataFrame:
    """``i, j, s, rank`` among rows of a smaller id only: what was there when each row arrived."""
    b = blocks(df, id_col, vec_col)

    def kernel(x: Block, y: Block) -> dict[str, np.ndarray]:
        s = np.round(cosines(x, y), 9)
        s[y.id[None, :] >= x.id[:, None]] = -np.inf
        return best_of_each(x, y, s, k)

    w = Window.partitionBy("i").orderBy(F.col("s").desc(), F.col("j"))
    return against(b, b, kernel, "i long, j long, s double").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def order_statistics(df: DataFrame, col: str, at: dict[str, float]) -> DataFrame:
    """One row of nearest-rank statistics, sorted[floor(n * share)]: the values are counted, range by range, not gathered in one task."""
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("x")).agg(F.count("*").alias("c"))
    ranged = counts.repartitionByRange("x").sortWithinPartitions("x").withColumn("part", F.spark_partition_id()).persist()
    totals = {r["part"]: r["c"] for r in ranged.groupBy("part").agg(F.sum("c").alias("c")).collect()}
    n, start, starts = sum(totals.values()), 0, {}
    for p in sorted(totals):
        starts[p] = start
        start += totals[p]
    spark = df.sparkSession
    out: dict[str, float | None] = {name: None for name in at}
    for name, share in at.items():
        k = min(int(n * share), n - 1)
        p = next((p for p in sorted(totals, reverse=True) if starts[p] <= k), None)
        if p is not None:
            w = Window.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
            hit = ranged.where(F.col("part") == p).withColumn("upto", F.sum("c").over(w)).where(F.col("upto") > k - starts[p]).agg(F.min("x").alias("x")).first()
            out[name] = float(hit["x"])
    ranged.unpersist()
    return spark.createDataFrame([tuple(out.values())], ", ".join(f"{n} double" for n in out))
