"""Set similarity: joins over a threshold by rare-first prefixes, and the most similar other set by blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrowgrid.operators.graph import cut

#: Sets of a block at least and at most (they have 16-bit places), blocks of a group from which on these grow, and pairs of a strip.
BLOCK, MOST, BLOCKS, STRIP = 16_384, 32_768, 8, 1 << 19
#: Share of a block pair's pairs from which a term is counted by a product of matrices, and how many are at most.
DENSE, TERMS = 0.0125, 512
#: Buckets whose counts order terms (a table of fixed size), and 64-bit words of a set's parities.
BUCKETS, WORDS = 1 << 18, 8
#: Thresholds from which prefixes are short; sketches of a block, and pairs of a strip.
SHORT, SKETCHES, CELLS = 0.8, 8192, 1 << 20


def similar(left: DataFrame, right: DataFrame | None, threshold: float) -> DataFrame:
    """``a, b, n, na, nb`` of pairs whose Jaccard reaches ``threshold`` (over 0), from frames ``grp, id, t array<string>`` of distinct terms.

    ``right`` None joins ``left`` with itself, a < b. Sets are 64-bit hashes of their terms. A set's parities by bucket say how far two
    sets are apart at least; what they leave is counted once, on the whole sets. Empty sets are in no pair. Null groups meet nothing.

    From ``SHORT`` on, a pair of Jaccard t shares one of the |x| - ceil(t |x|) + 1 first terms of either set in one order for both, so
    only these prefixes meet, under a length and a positional filter. The order is that of the counts of hash buckets (about rare
    first; any order finds every pair), a table of fixed size. Under it prefixes are half of the sets and meet nearly everything:
    parities alone meet, in packed blocks of a group, and no pair that they part is ever a row.
    """
    hashed = lambda f, i: f.where(F.size("t") > 0).select("grp", i.alias("id"), F.transform("t", lambda x: F.xxhash64(x)).alias("t"))
    if right is None:
        whole = hashed(left, F.col("id"))
    else:
        whole = hashed(left, F.struct(F.lit(0).alias("side"), F.col("id").alias("id"))).unionByName(hashed(right, F.struct(F.lit(1).alias("side"), F.col("id").alias("id"))))
    whole = cut(whole.where("grp IS NOT NULL"))
    near = (_near_prefixes if threshold >= SHORT else _near_blocks)(whole, right is not None, threshold)
    sets = lambda c: whole.select("grp", F.col("id").alias(c), F.col("t").alias(f"t_{c}")).hint("merge")
    met = near.join(sets("a"), ["grp", "a"]).join(sets("b"), ["grp", "b"])
    found = met.select("a", "b", F.size(F.array_intersect("t_a", "t_b")).cast("long").alias("n"), F.size("t_a").alias("na"), F.size("t_b").alias("nb"))
    found = found.where(jaccard() >= threshold)
    return found if right is None else found.withColumns({"a": F.col("a.id"), "b": F.col("b.id")})


def _near_prefixes(whole: DataFrame, sides: bool, threshold: float) -> DataFrame:
    """``grp, a, b`` whose prefixes meet and whose parities don't part them."""
    spark = whole.sparkSession
    kinds = dict(whole.dtypes)
    prefix = whole.mapInArrow(_prefixes(spark.sparkContext.broadcast(_bucket_counts(whole)), threshold), f"grp {kinds['grp']}, term long, id {kinds['id']}, n int, pos int")
    side = lambda p: prefix.select("grp", "term", *[F.col(c).alias(f"{p}_{c}") for c in ("id", "n", "pos")])
    x, y = side("a"), side("b")
    order = F.col("a_id") < F.col("b_id")
    if sides:
        x, y, order = x.where("a_id.side = 0"), y.where("b_id.side = 1"), F.lit(True)
    size = (F.least("a_n", "b_n") >= F.greatest("a_n", "b_n") * threshold - 1e-9)
    # What can still be shared from this term on (positional filter).
    rest = 1 + F.least(F.col("a_n") - F.col("a_pos"), F.col("b_n") - F.col("b_pos")) >= (F.col("a_n") + F.col("b_n")) * (threshold / (1 + threshold)) - 1e-9
    pairs = x.join(y, ["grp", "term"]).where(order & size & rest).select("grp", F.col("a_id").alias("a"), F.col("b_id").alias("b")).distinct()
    marks = whole.mapInArrow(_parities, f"grp {kinds['grp']}, id {kinds['id']}, n int, " + ", ".join(f"p{k} long" for k in range(WORDS)))
    mark = lambda c: marks.select("grp", F.col("id").alias(c), F.col("n").alias(f"n{c}"), *[F.col(f"p{k}").alias(f"{c}{k}") for k in range(WORDS)])
    apart = sum((F.bit_count(F.col(f"a{k}").bitwiseXOR(F.col(f"b{k}"))) for k in range(WORDS)), F.lit(0))
    return pairs.join(mark("a").hint("merge"), ["grp", "a"]).join(mark("b").hint("merge"), ["grp", "b"]).where(apart <= (F.col("na") + F.col("nb")) * ((1 - threshold) / (1 + threshold)) + 1e-9).select("grp", "a", "b")


def _near_blocks(whole: DataFrame, sides: bool, threshold: float) -> DataFrame:
    """``grp, a, b`` that parities don't part: every two blocks of a group meet in a task, which compares sketches of three to six bits a term."""
    kinds = dict(whole.dtypes)
    key = F.col("id.id") if sides else F.col("id")
    flat = whole.select("grp", key.cast("long").alias("id"), (F.col("id.side") if sides else F.lit(0)).alias("side"), "t")
    rows = flat.mapInArrow(_sketches, f"grp {kinds['grp']}, id long, side int, n int, sketch binary")
    number = cut(flat.groupBy("grp").agg(F.ceil(F.count("*") / SKETCHES).cast("long").alias("blocks")))
    met = number.agg(F.coalesce(F.sum(F.col("blocks") * (F.col("blocks") + 1) / 2), F.lit(0)).cast("long")).first()[0]
    dealt = rows.join(number, "grp").withColumn("block", F.pmod(F.xxhash64("id", "side"), F.col("blocks")))
    packed = dealt.groupBy("grp", "block", "blocks").applyInArrow(_pack_sketches, f"grp {kinds['grp']}, block long, blocks long, ids binary, sides binary, sizes binary, sketches binary")
    # A pair of blocks meets once, at the lesser one; a block meets itself alone.
    cols = ["ids", "sides", "sizes", "sketches"]
    x = packed.select("grp", "block", F.explode(F.sequence("block", F.col("blocks") - 1)).alias("other"), F.lit(0).alias("part"), *cols)
    y = packed.where("block > 0").select("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("block") - 1)).alias("at"), F.col("block").alias("other"), F.lit(1).alias("part"), *cols)
    tasks = max(int(whole.sparkSession.conf.get("spark.sql.shuffle.partitions")), met // 2)
    both = x.union(y).repartition(tasks, "grp", "block", "other").groupBy("grp", "block", "other").applyInArrow(_close(sides, threshold), f"grp {kinds['grp']}, a long, b long")
    if not sides:
        return both.select("grp", F.col("a").cast(kinds["id"]).alias("a"), F.col("b").cast(kinds["id"]).alias("b"))
    of = lambda k, c: F.struct(F.lit(k).alias("side"), F.col(c).alias("id")).cast(kinds["id"]).alias(c)
    return both.select("grp", of(0, "a"), of(1, "b"))


def _sketches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parities of each set over a power of two of bits, at least three a term."""
    for b in frames:
        row, term, n = _flat(b.column("t"))
        words = 1 << np.ceil(np.log2(np.maximum(3 * n / 64, 1))).astype(np.int64)
        edge = np.concatenate(([0], np.cumsum(words)))
        place = np.mod(term >> 8, 64 * words[row])
        flat = np.zeros(edge[-1], np.uint64)
        np.bitwise_xor.at(flat, edge[row] + (place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
        made = pa.array([flat[edge[k] : edge[k + 1]].tobytes() for k in range(len(n))], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column("grp"), b.column("id"), b.column("side"), pa.array(n.astype(np.int32)), made], names=["grp", "id", "side", "n", "sketch"])


def _pack_sketches(part: pa.Table) -> pa.Table:
    row = {c: part.column(c)[:1] for c in ("grp", "block", "blocks")}
    packed = {"ids": part.column("id").to_numpy().tobytes(), "sides": part.column("side").to_numpy().astype(np.int8).tobytes(), "sizes": part.column("n").to_numpy().astype(np.int32).tobytes()}
    return pa.table(row | {c: [v] for c, v in packed.items()} | {"sketches": [b"".join(part.column("sketch").to_pylist())]})


def _close(sides: bool, threshold: float):
    """Pairs of two packed blocks (or of one with itself) that sizes and parities allow."""
    share = (1 - threshold) / (1 + threshold)

    def classes(r: dict) -> dict[int, tuple]:
        ids, side, n = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["sides"], np.int8), np.frombuffer(r["sizes"], np.int32).astype(np.int64)
        words = 1 << np.ceil(np.log2(np.maximum(3 * n / 64, 1))).astype(np.int64)
        start, flat = np.cumsum(words) - words, np.frombuffer(r["sketches"], np.uint64)
        mine = {int(w): np.flatnonzero(words == w) for w in np.unique(words)}
        return {w: (ids[k], side[k], n[k], flat[start[k][:, None] + np.arange(w)]) for w, k in mine.items()}

    def folded(m: np.ndarray, w: int) -> np.ndarray:
        # Parities over fewer bits are those of the parts on each other.
        return np.bitwise_xor.reduce(m.reshape(len(m), -1, w), axis=1)

    def run(part: pa.Table) -> pa.Table:
        two = {r["part"]: classes(r) for r in part.select(["part", "ids", "sides", "sizes", "sketches"]).to_pylist()}
        alone = 1 not in two
        left, right = two[0], two[0] if alone else two[1]
        found_a, found_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for v, (a_id, a_side, a_n, a_m) in left.items():
            for w, (b_id, b_side, b_n, b_m) in right.items():
                if min(a_n.max(), b_n.max()) < threshold * max(a_n.min(), b_n.min()) - 1e-9:
                    continue
                low = min(v, w)
                x, y = folded(a_m, low), np.ascontiguousarray(folded(b_m, low).T)
                step = max(1, CELLS // len(b_id))
                for k in range(0, len(a_id), step):
                    some = slice(k, k + step)
                    apart = np.zeros((len(a_id[some]), len(b_id)), np.int32)
                    for j in range(low):
                        apart += np.bitwise_count(x[some, j][:, None] ^ y[j][None, :])
                    p, q = np.nonzero(apart <= (a_n[some][:, None] + b_n[None, :]) * share + 1e-9)
                    p += k
                    keep = np.minimum(a_n[p], b_n[q]) >= threshold * np.maximum(a_n[p], b_n[q]) - 1e-9
                    # Of a block with itself, a pair comes up both ways.
                    keep &= (a_side[p] < b_side[q]) if sides and alone else (a_side[p] != b_side[q]) if sides else (a_id[p] < b_id[q]) if alone else (a_id[p] != b_id[q])
                    p, q = p[keep], q[keep]
                    turn = (a_side[p] > b_side[q]) if sides else (a_id[p] > b_id[q])
                    found_a.append(np.where(turn, b_id[q], a_id[p]))
                    found_b.append(np.where(turn, a_id[p], b_id[q]))
        a, b = np.concatenate(found_a), np.concatenate(found_b)
        return pa.table({"grp": part.column("grp").take(pa.array(np.zeros(len(a), np.int64))), "a": a, "b": b})

    return run


def _bucket_counts(whole: DataFrame) -> np.ndarray:
    rows = whole.select(F.explode("t").alias("x")).groupBy(F.pmod("x", F.lit(BUCKETS)).cast("int").alias("k")).agg(F.count("*").alias("c")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[rows.column("k").to_numpy()] = rows.column("c").to_numpy()
    return out


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and value of each element, and each row's size."""
    n = np.diff(lists.offsets.to_numpy())
    return np.repeat(np.arange(len(n)), n), lists.flatten().to_numpy(zero_copy_only=False), n


def _prefixes(counts, threshold: float):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            row, term, n = _flat(b.column("t"))
            often = counts.value[np.mod(term, BUCKETS)]
            at = np.lexsort((term, often, row))
            row, term, often = row[at], term[at], often[at]
            pos = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + 1
            # A term that is alone in its bucket makes no pair, but has its place in the prefix.
            keep = (pos <= n[row] - np.ceil(n[row] * threshold - 1e-9) + 1) & (often > 1)
            row = row[keep]
            yield pa.RecordBatch.from_arrays([b.column("grp").take(pa.array(row)), pa.array(term[keep]), b.column("id").take(pa.array(row)), pa.array(n[row].astype(np.int32)), pa.array(pos[keep].astype(np.int32))], names=["grp", "term", "id", "n", "pos"])

    return run


def _parities(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in frames:
        row, term, n = _flat(b.column("t"))
        out = np.zeros((len(n), WORDS), np.uint64)
        place = np.mod(term >> 20, 64 * WORDS)
        np.bitwise_xor.at(out, (row, place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
        yield pa.RecordBatch.from_arrays([b.column("grp"), b.column("id"), pa.array(n.astype(np.int32)), *[pa.array(np.ascontiguousarray(out[:, k]).view(np.int64)) for k in range(WORDS)]], names=["grp", "id", "n", *[f"p{k}" for k in range(WORDS)]])


def jaccard() -> Column:
    """Of a pair's counts ``n, na, nb``."""
    return F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))


def nearest(sets: DataFrame) -> DataFrame:
    """``id, j``: greatest Jaccard of each set with another of its group, from ``grp, id long, t array<string>`` of distinct terms.

    Sets go in blocks of their group, turned round: for each term (a 64-bit hash) the 16-bit places of the sets that have it, so that a
    term of a set is two bytes. Every two blocks of a group meet once, in a task that counts shared terms for both: frequent ones by
    a product of matrices, others by the second block's places. It returns one number for each set. A group that holds a
    third of all rows is as many blocks as it needs. Sets alone in a group get no row.
    """
    rows = sets.where("grp IS NOT NULL AND id IS NOT NULL").select("grp", F.col("id").cast("long").alias("id"), F.transform("t", lambda x: F.xxhash64(x)).alias("t"))
    size = F.greatest(F.lit(BLOCK), F.least(F.lit(MOST), F.ceil(F.count("*") / BLOCKS)))
    number = cut(rows.groupBy("grp").agg(F.ceil(F.count("*") / size).cast("long").alias("blocks")))
    met = number.agg(F.coalesce(F.sum(F.col("blocks") * (F.col("blocks") + 1) / 2), F.lit(0)).cast("long")).first()[0]
    dealt = rows.join(number, "grp").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    cols = ["ids", "sizes", "terms", "counts", "places"]
    packed = dealt.groupBy("grp", "block", "blocks").applyInArrow(_pack, f"grp {dict(rows.dtypes)['grp']}, block long, blocks long, {', '.join(f'{c} binary' for c in cols)}")
    x = packed.select("grp", "block", F.explode(F.sequence("block", F.col("blocks") - 1)).alias("other"), F.lit(0).alias("side"), *cols)
    y = packed.where("block > 0").select("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("block") - 1)).alias("at"), F.col("block").alias("other"), F.lit(1).alias("side"), *cols)
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), met)
    pairs = x.union(y).repartition(tasks, "grp", "block", "other").groupBy("grp", "block", "other").applyInArrow(_nearest, "id long, j double")
    return pairs.groupBy("id").agg(F.max("j").alias("j"))


def _pack(part: pa.Table) -> pa.Table:
    sets = part.column("t").combine_chunks()
    holder, terms, n = _flat(sets)
    keys, code, counts = np.unique(terms.astype(np.int64), return_inverse=True, return_counts=True)
    places = holder[np.argsort(code, kind="stable")]
    row = {c: part.column(c)[:1] for c in ("grp", "block", "blocks")}
    # Blocks are even by hash; one that has more than 16 bits of places keeps wider ones.
    places = places.astype(np.uint16 if len(n) <= 1 << 16 else np.uint32)
    made = {"ids": part.column("id").to_numpy().astype(np.int64), "sizes": n.astype(np.int32), "terms": keys, "counts": counts.astype(np.int32), "places": places}
    return pa.table(row | {c: [v.tobytes()] for c, v in made.items()})


def _nearest(part: pa.Table) -> pa.Table:
    two = {}
    for k in range(len(part)):
        r = {c: part.column(c)[k] for c in ("ids", "sizes", "terms", "counts", "places")}
        ids, size, terms, count = (np.frombuffer(r[c].as_buffer(), t) for c, t in (("ids", np.int64), ("sizes", np.int32), ("terms", np.int64), ("counts", np.int32)))
        places = np.frombuffer(r["places"].as_buffer(), np.uint16 if len(ids) <= 1 << 16 else np.uint32)
        two[part.column("side")[k].as_py()] = ids, size.astype(np.int64), terms, count.astype(np.int64), places
    itself = part.column("block")[0] == part.column("other")[0]
    if itself:
        two[1] = two[0]
    if len(two) < 2:
        return pa.table({"id": pa.array([], pa.int64()), "j": pa.array([], pa.float64())})
    (ids, size, terms, counts, places), (other, other_size, other_terms, other_counts, holder) = two[0], two[1]
    best, other_best = np.full(len(ids), -1.0), np.full(len(other), -1.0)
    _, mine, theirs = np.intersect1d(terms, other_terms, assume_unique=True, return_indices=True)
    often = counts[mine] / len(ids) * (other_counts[theirs] / len(other))
    dense = np.flatnonzero(often > DENSE)
    dense = dense[np.argsort(-often[dense], kind="stable")[:TERMS]]
    start, other_start = np.cumsum(counts) - counts, np.cumsum(other_counts) - other_counts
    x, y = np.zeros((len(ids), len(dense)), np.float32), np.zeros((len(other), len(dense)), np.float32)
    for k, d in enumerate(dense):
        x[places[start[mine[d]] :][: counts[mine[d]]], k] = 1
        y[holder[other_start[theirs[d]] :][: other_counts[theirs[d]]], k] = 1
    # The other terms of each set that the second block has, as its numbers for them.
    number = np.full(len(terms), -1, np.int32)
    number[mine] = theirs
    number[mine[dense]] = -1
    code = np.repeat(number, counts)
    some = np.flatnonzero(code >= 0)
    row, code = places[some], code[some]
    order = np.argsort(row, kind="stable")
    row, code = row[order].astype(np.int64), code[order]
    step = max(1, STRIP // max(len(other), 1))
    for k in range(0, len(ids), step):
        stop = min(k + step, len(ids))
        both = (x[k:stop] @ y.T).astype(np.float64)
        low, high = np.searchsorted(row, (k, stop))
        at = code[low:high]
        n = other_counts[at]
        # The holders of every term that is met, one after another.
        place = np.arange(n.sum()) + np.repeat(other_start[at] - (np.cumsum(n) - n), n)
        both += np.bincount(np.repeat((row[low:high] - k) * len(other), n) + holder[place], minlength=both.size).reshape(both.shape)
        j = both / np.maximum(size[k:stop][:, None] + other_size[None, :] - both, 1)
        j[ids[k:stop][:, None] == other[None, :]] = -1
        best[k:stop] = j.max(1)
        np.maximum(other_best, j.max(0), out=other_best)
    if not itself:
        ids, best = np.concatenate((ids, other)), np.concatenate((best, other_best))
    good = best > 0
    return pa.table({"id": pa.array(ids[good], pa.int64()), "j": pa.array(best[good], pa.float64())})
