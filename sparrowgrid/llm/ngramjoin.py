"""N-gram Jaccard self-join of documents by rare-first prefix filtering, to connected components.

A document is the set of its distinct shingles of ``WIDTH`` words. Two documents link when 100 * |A and B| >= 75 * |A or B|.

1. One scan gives each document's set size and a 128-bit digest of its set. Documents of equal sets are one class; its
   least doc_id stands for it. A sample of classes tells which shingles are in a million classes or more.
2. A second scan, over one text of each class, deals every shingle once by ranges of its hash. A range counts in how many
   classes each of its shingles is and sends back only those of two classes or more: exact frequencies, in steps of an
   eighth of a doubling. Shingles that the sample calls hot are dealt over many ranges and need no count.
3. Back at the document, shingles are in rare-first order: those that are nowhere else, then by frequency, then by hash.
   The prefix is what any partner must share a shingle of. Shingles of one class can be in no partner, so a document with
   more of them than the prefix is long links with nothing and leaves; only shingles of several classes are kept of others.
4. Stars: of the classes whose prefixes share a shingle, each is paired with the one that has the fewest shingles of its
   own. Length and positional filters drop pairs that can't link; a pair left is verified once. Components of these links
   cost as many pairs as there are rows, however large a group of near copies is.
5. What stars can't show: for prefix shingles whose classes are in several components, each class outside the shingle's
   largest component is paired with all classes of other components there, under length, positional and suffix filters (the
   suffix filter compares parities of shingle counts over ranges of the hash, twice as many or more as there are
   shingles). These pairs too are verified once. Pairs inside a component need no look, so no link between components is lost.

Nulls: a null text has no shingles, as an empty one: size 0, no link, its own component. A null doc_id keeps its row with
a null component. Rows that share a doc_id join the components of their texts, but for a row without shingles, which
links with nothing. Long texts are taken whole; further columns are left
out. An empty table gives an empty table. Equality of shingles is that of their 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrowgrid.llm.components import components
from sparrowgrid.llm.shared import batches, chunks, discard, gaps, lean, mix, packed, runs, shingles, signed, small_batches, texts_of, unpacked, words, written

WIDTH = 5
#: Shingles of a range of hashes, and of what a task deals at once.
RANGE, DEAL = 1_000_000, 2_000_000
#: One class in so many is sampled; a shingle estimated to be in so many classes is hot.
SAMPLE, HOT = 1024, 1_000_000
#: Hot shingles that are broadcast at most (8 bytes each); with more, the bar rises until they fit.
HOT_LIST = 1_000_000
#: Ids of copies that are broadcast at most (8 bytes each); beyond, texts are joined by a shuffle.
BROADCAST_IDS = 4_000_000
#: Bytes of sets that a task verifies at once.
VERIFY_BYTES = 32 << 20
#: The finest grid of the suffix filter, as a power of two of its ranges.
FINEST = 17

SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("sample", pa.binary())])
#: Shingles of a range with the documents of a deal that hold them, or (n is set) those documents themselves.
DEALT = pa.schema([("range", pa.int64()), ("deal", pa.int64()), ("token", pa.binary()), ("doc", pa.binary()), ("n", pa.binary())])
#: Shared shingles of a deal's documents, or (n is set) those documents.
COUNTED = pa.schema([("deal", pa.int64()), ("token", pa.binary()), ("doc", pa.binary()), ("level", pa.binary()), ("n", pa.binary())])
#: ``tokens`` in rare-first order, of which the first ``k`` are in the prefix; ``rare`` is the number of shingles of this class alone.
CANDIDATES = pa.schema([("class", pa.int64()), ("n", pa.int32()), ("rare", pa.int32()), ("k", pa.int32()), ("tokens", pa.binary()), ("parity", pa.list_(pa.int64()))])
TOKENS = pa.schema([("token", pa.int64()), ("class", pa.int64()), ("n", pa.int32()), ("pos", pa.int32()), ("rare", pa.int32())])


def ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.list_(pa.int64()): "array<long>"}
    return ", ".join(f"`{f.name}` {names[f.type]}" for f in schema)


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Sorted distinct shingle hashes of each text, by runs of texts."""
    for at, some in chunks(texts):
        h, off = shingles(*words(some)[3:], width)
        yield at, [np.unique(h[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)]


def digests(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and two order-free digests of each set."""
    n = np.array([len(s) for s in sets], np.int64)
    edge = np.concatenate(([0], np.cumsum(n)))
    flat = np.concatenate(sets) if len(sets) else np.empty(0, np.uint64)
    out = []
    for salt in (0x2545F4914F6CDD1D, 0x94D049BB133111EB):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(flat ^ np.uint64(salt)), dtype=np.uint64)))
        out.append(total[edge[1:]] - total[edge[:-1]])
    return n, out[0], out[1]


def _summaries(width: int, sample: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampled: set[int] = set()
        for b in frames:
            ids = b.column(0).to_pylist()
            for at, sets in shingle_sets(texts_of(b.column(1)), width):
                n, h1, h2 = digests(sets)
                held: list[bytes | None] = [None] * len(sets)
                for i in np.flatnonzero((mix(h1 ^ np.uint64(0xA5A5A5A5)) % np.uint64(sample) == 0) & (n > 0)):
                    # Copies within a task are sampled once.
                    if int(h1[i]) not in sampled:
                        sampled.add(int(h1[i]))
                        held[i] = sets[i].tobytes()
                yield batches({"doc_id": ids[at : at + len(sets)], "n": n, "h1": signed(h1), "h2": signed(h2), "sample": held}, SETS)

    return run


def _sampled(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in frames:
        for x in b.column(0):
            yield pa.record_batch([pa.array(np.frombuffer(x.as_py(), np.int64))], names=["token"])


def hot_tokens(sets: DataFrame, sample: int, hot: int, most: int) -> np.ndarray:
    """Shingles in ``hot`` classes or more, as the sample tells; one column sorted by hash, one of estimated counts."""
    taken = sets.where("sample IS NOT NULL").dropDuplicates(["h1"]).select("sample")
    counts = taken.mapInArrow(_sampled, "token long").groupBy("token").agg(F.count("*").alias("c"))
    bar = max(hot // sample, 2)
    while True:
        found = counts.where(F.col("c") >= bar).limit(most + 1).collect()
        if len(found) <= most:
            break
        bar *= 2
    found.sort(key=lambda r: r["token"] & (2**64 - 1))
    return np.array([[r["token"] & (2**64 - 1), r["c"] * sample] for r in found], np.uint64).reshape(-1, 2)


def levels(counts: np.ndarray) -> np.ndarray:
    """Steps of an eighth of a doubling, from 8 for two classes."""
    return np.minimum(8 * np.log2(np.maximum(counts, 1).astype(np.float64)), 255).astype(np.uint8)


def _deal(n_ranges: int, hot: np.ndarray, width: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deal = TaskContext.get().partitionId() << 24
        held: dict[int, np.ndarray] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            token = np.concatenate(list(held.values()))
            n = np.array([len(s) for s in held.values()], np.uint32)
            order = np.argsort(token, kind="stable")
            token, doc = token[order], np.repeat(np.arange(len(n), dtype=np.uint32), n)[order]
            where = ((token >> np.uint64(32)) * np.uint64(n_ranges) >> np.uint64(32)).astype(np.int64)
            if len(hot):
                at = np.minimum(np.searchsorted(hot[:, 0], token), len(hot) - 1)
                # Ranges below zero hold hot shingles; each deal has its own.
                where[hot[at, 0] == token] = -1 - int(mix(np.array([deal], np.uint64))[0] % np.uint64(1 << 40))
                again = np.argsort(where, kind="stable")
                token, doc, where = token[again], doc[again], where[again]
            start, _ = runs(where)
            for a, b in zip(start, [*start[1:], len(token)], strict=True):
                yield batches({"range": [where[a]], "deal": [deal], "token": [packed(gaps(token[a:b]))], "doc": [packed(doc[a:b])], "n": [None]}, DEALT)
            classes = np.fromiter(held.keys(), np.uint64, len(held))
            yield batches({"range": [int(mix(np.array([deal], np.uint64))[0] % np.uint64(n_ranges))], "deal": [deal], "token": [classes.tobytes()], "doc": [b""], "n": [n.tobytes()]}, DEALT)

        for b in frames:
            for _, sets in shingle_sets(texts_of(b.column(0)), width):
                for s, h in zip(sets, digests(sets)[1].tolist(), strict=True):
                    if len(s) and h not in held:
                        held[h] = s
                        size += len(s)
                if size >= DEAL:
                    yield from flush()
                    deal += 1
                    held.clear()
                    size = 0
        if held:
            yield from flush()

    return run


def _counted(hot: np.ndarray):
    def run(part: pa.Table) -> pa.Table:
        """Shingles of a range that several documents hold, by deal; rows of documents go through."""
        known = part.filter(pc.is_valid(part.column("n")))
        none = [None] * len(known)
        rows = {"deal": known.column("deal").to_pylist(), "token": known.column("token").to_pylist(), "doc": list(none), "level": list(none), "n": known.column("n").to_pylist()}
        some = part.filter(pc.is_null(part.column("n")))
        if len(some):
            token = [np.cumsum(unpacked(x.as_py(), np.uint64), dtype=np.uint64) for x in some.column("token")]
            count = [len(t) for t in token]
            deals, deal = np.unique(some.column("deal").to_numpy(), return_inverse=True)
            deal = np.repeat(deal, count)
            token = np.concatenate(token)
            doc = np.concatenate([unpacked(x.as_py(), np.uint32) for x in some.column("doc")])
            if part.column("range")[0].as_py() < 0:
                level = levels(hot[np.searchsorted(hot[:, 0], token), 1])
                keep = np.ones(len(token), bool)
            else:
                order = np.argsort(token, kind="stable")
                _, of = runs(token[order])
                df = np.empty(len(token), np.int64)
                df[order] = np.bincount(of)[of]
                level, keep = levels(df), df > 1
            deal, token, doc, level = deal[keep], token[keep], doc[keep], level[keep]
            order = np.lexsort((token, deal))
            deal, token, doc, level = deal[order], token[order], doc[order], level[order]
            start, _ = runs(deal)
            for a, b in zip(start, [*start[1:], len(deal)], strict=True):
                for name, x in (("deal", int(deals[deal[a]])), ("token", packed(gaps(token[a:b]))), ("doc", packed(doc[a:b])), ("level", level[a:b].tobytes()), ("n", None)):
                    rows[name].append(x)
        return pa.table({f.name: pa.array(rows[f.name], f.type) for f in COUNTED})

    return run


def needed(n):
    """Shingles that a partner of a set of n must share with it, at least."""
    return (3 * n + 3) // 4


def parity(tokens: np.ndarray, n: int) -> np.ndarray:
    """Whether an odd number of shingles falls in each range, 64 to a long; 2n ranges or more, a power of two."""
    bits = min(max(int(2 * n - 1).bit_length(), 6), FINEST)
    odd = np.bincount((tokens & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.int64)


def _candidates(part: pa.Table) -> pa.Table:
    """Documents of a deal that can have a partner, with their shared shingles in rare-first order."""
    known = part.filter(pc.is_valid(part.column("n")))
    some = part.filter(pc.is_null(part.column("n")))
    rows = {f.name: [] for f in CANDIDATES}
    if len(some) and len(known):
        h1 = np.frombuffer(known.column("token")[0].as_py(), np.int64)
        n = np.frombuffer(known.column("n")[0].as_py(), np.uint32).astype(np.int64)
        token = np.concatenate([np.cumsum(unpacked(x.as_py(), np.uint64), dtype=np.uint64) for x in some.column("token")])
        doc = np.concatenate([unpacked(x.as_py(), np.uint32) for x in some.column("doc")]).astype(np.int64)
        level = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in some.column("level")])
        shared = np.bincount(doc, minlength=len(n))
        able = shared >= needed(n)
        keep = able[doc]
        token, doc, level = token[keep], doc[keep], level[keep]
        order = np.lexsort((token, level, doc))
        token = token[order]
        at = 0
        for i in np.flatnonzero(able & (n > 0)):
            mine = token[at : at + shared[i]]
            at += shared[i]
            row = (h1[i], n[i], n[i] - shared[i], shared[i] - needed(n[i]) + 1, mine.tobytes(), parity(mine, n[i]))
            for f, x in zip(CANDIDATES, row, strict=True):
                rows[f.name].append(x)
    return pa.table({f.name: pa.array(rows[f.name], f.type) for f in CANDIDATES})


def _prefix_tokens(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shared shingle of a prefix, with its place in the document's order."""
    for b in frames:
        cls, n, rare, k = (b.column(i).to_numpy() for i in range(4))
        token = [np.frombuffer(t.as_py(), np.int64, int(m)) for t, m in zip(b.column(4), k, strict=True)]
        if len(token):
            pos = np.concatenate([np.arange(r, r + m, dtype=np.int32) for r, m in zip(rare, k, strict=True)])
            yield batches({"token": np.concatenate(token), "class": np.repeat(cls, k), "n": np.repeat(n, k), "pos": pos, "rare": np.repeat(rare, k)}, TOKENS)


def may_link(n1: Column, pos1: Column, n2: Column, pos2: Column) -> Column:
    """Length and positional filter of a pair at a shingle that both prefixes hold."""
    need = F.ceil(3 * (n1 + n2) / 7)
    return (4 * F.least(n1, n2) >= 3 * F.greatest(n1, n2)) & (1 + F.least(n1 - 1 - pos1, n2 - 1 - pos2) >= need)


def may_overlap(n1: Column, rare1: Column, parity1: Column, n2: Column, rare2: Column, parity2: Column) -> Column:
    """Suffix filter: sets differ by the shingles that one class alone holds, and in every range of unlike parity."""

    def folded(a: Column, b: Column) -> Column:
        half = (F.size(a) / 2).cast("int")
        low = F.slice(a, F.lit(1), half)
        return F.when(F.size(a) > F.size(b), F.zip_with(low, F.slice(a, half + 1, half), lambda x, y: x.bitwiseXOR(y))).otherwise(a)

    apart = F.aggregate(F.zip_with(folded(parity1, parity2), folded(parity2, parity1), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return rare1 + rare2 + apart <= n1 + n2 - 2 * F.ceil(3 * (n1 + n2) / 7)


def _verified(part: pa.Table) -> pa.Table:
    """Links among the pairs ``u, v`` of a block, by the sets (rows without v) of the same block."""
    has = part.filter(pc.is_null(part.column("v")))
    sets = {c: (n, np.sort(np.frombuffer(t.as_py(), np.uint64))) for c, n, t in zip(has.column("u").to_pylist(), has.column("n").to_pylist(), has.column("tokens"), strict=True)}
    pairs = part.filter(pc.is_valid(part.column("v")))
    found: list[tuple[int, int]] = []
    for u, v in zip(pairs.column("u").to_pylist(), pairs.column("v").to_pylist(), strict=True):
        (n1, a), (n2, b) = sets[u], sets[v]
        both = len(np.intersect1d(a, b, assume_unique=True))
        if 100 * both >= 75 * (n1 + n2 - both):
            found.append((u, v))
    return pa.table({"u": pa.array([f[0] for f in found], pa.int64()), "v": pa.array([f[1] for f in found], pa.int64())})


def _links(pairs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Verification of distinct pairs ``u, v`` of classes, in blocks by v: a set goes once to each block that needs it."""
    sizes = candidates.select("class", "n")
    total = pairs.join(sizes, pairs["v"] == sizes["class"]).agg(F.sum(F.col("n").cast("long"))).first()[0]
    n_blocks = (total or 0) * 16 // VERIFY_BYTES + 1
    blocks = pairs.withColumn("block", F.pmod(F.xxhash64("v"), F.lit(n_blocks)))
    met = blocks.select("block", F.col("v").alias("class")).union(blocks.select("block", "u")).distinct()
    sets = met.join(candidates.select("class", "n", "tokens"), "class").select("block", F.col("class").alias("u"), F.lit(None).cast("long").alias("v"), "n", "tokens")
    none = blocks.select("block", "u", "v", F.lit(None).cast("int").alias("n"), F.lit(None).cast("binary").alias("tokens"))
    return none.union(sets).groupBy("block").applyInArrow(_verified, "u long, v long")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """(members, links): ``doc_id, n_shingles, class_id, component_id`` of every document, and links ``u, v`` between
    classes, enough of them to span every component."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    members = written(rows.mapInArrow(lean(_summaries(width, SAMPLE)), ddl(SETS)), "sets")
    hot = hot_tokens(members, SAMPLE, HOT, HOT_LIST)
    members = members.select("doc_id", "n", "h1", "h2")
    classes = written(members.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep")), "classes")

    # Rows that share an id join their classes.
    full = members.where("n > 0 AND doc_id IS NOT NULL")
    several = full.groupBy("doc_id").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select("doc_id")
    same = full.join(several, "doc_id").join(classes, ["n", "h1", "h2"]).select(F.col("doc_id").alias("u"), F.col("rep").alias("v")).distinct()
    same = written(same, "same")

    # One text of each class; of rows that share an id, all.
    copies = members.where("doc_id IS NOT NULL").select("doc_id").distinct().join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_anti")
    copies = written(copies, "copies")
    if copies.count() <= BROADCAST_IDS:
        firsts = rows.where("doc_id IS NOT NULL").join(F.broadcast(copies), "doc_id", "left_anti")
    else:
        # The same order in every attempt of a task: deals number their documents.
        firsts = rows.where("doc_id IS NOT NULL").join(copies, "doc_id", "left_anti").sortWithinPartitions("doc_id", "text")
    total = classes.agg(F.sum(F.col("n").cast("long"))).first()[0] or 0
    n_ranges = int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // RANGE + 1))
    dealt = firsts.select("text").mapInArrow(lean(_deal(n_ranges, hot, width)), ddl(DEALT))
    counted = dealt.groupBy("range").applyInArrow(_counted(hot), ddl(COUNTED))
    candidates = written(counted.groupBy("deal").applyInArrow(_candidates, ddl(CANDIDATES)), "candidates")

    tokens = candidates.select("class", "n", "rare", "k", "tokens").mapInArrow(_prefix_tokens, ddl(TOKENS))
    # The text with the fewest shingles of its own is what the others of a group vary: few of them miss it.
    first = tokens.groupBy("token").agg(F.min(F.struct("rare", "class", "n", "pos")).alias("u"))
    stars = tokens.join(first, "token").where((F.col("class") != F.col("u.class")) & may_link(F.col("n"), F.col("pos"), F.col("u.n"), F.col("u.pos")))
    stars = written(stars.select(F.least("u.class", "class").alias("u"), F.greatest("u.class", "class").alias("v")).distinct(), "stars")
    reps = written(candidates.select("class", "n").distinct().join(classes.select(F.col("h1").alias("class"), "n", "rep"), ["class", "n"]).select("class", "rep"), "reps")

    def by_rep(links: DataFrame) -> DataFrame:
        side = lambda c: reps.select(F.col("class").alias(c), F.col("rep").alias(f"rep_{c}"))
        return written(links.join(side("u"), "u").join(side("v"), "v").select(F.col("rep_u").alias("u"), F.col("rep_v").alias("v")), "links")

    links = by_rep(_links(stars, candidates))
    parts = components(links.union(same))

    # Shingles whose classes are in several components.
    component = reps.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("class", F.coalesce("component", "rep").alias("component"))
    placed = tokens.join(component, "class")
    several = placed.groupBy("token").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("token")
    placed = written(placed.join(several, "token"), "placed")
    sizes = placed.groupBy("token", "component").agg(F.count("*").alias("size"))
    major = sizes.groupBy("token").agg(F.max(F.struct("size", F.col("component").alias("major"))).alias("m")).select("token", "m.major")
    # Both sides carry the grid, so that unlike texts that share a passage don't become rows.
    placed = placed.join(candidates.select("class", "parity"), "class")
    minor = placed.join(major, "token").where("component <> major")
    minor = minor.select("token", "major", *[F.col(c).alias(f"{c}1") for c in ("class", "n", "pos", "component", "rare", "parity")])
    pairs = minor.join(placed, "token").where(
        (F.col("component1") != F.col("component"))
        & ((F.col("component") == F.col("major")) | (F.col("class1") < F.col("class")))
        & may_link(F.col("n1"), F.col("pos1"), F.col("n"), F.col("pos"))
        & may_overlap(F.col("n1"), F.col("rare1"), F.col("parity1"), F.col("n"), F.col("rare"), F.col("parity"))
    )
    pairs = pairs.select(F.least("class1", "class").alias("u"), F.greatest("class1", "class").alias("v")).distinct()
    pairs = written(pairs.join(stars, ["u", "v"], "left_anti"), "pairs")
    more = by_rep(_links(pairs, candidates))
    if more.limit(1).count():
        links = written(links.union(more), "links")
        parts = components(links.union(same))
    discard(candidates, stars, reps, placed, pairs, more, copies)

    known = members.join(classes.select("n", "h1", "h2", "rep"), ["n", "h1", "h2"], "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    out = known.select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("class_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"),
    )
    return out, links
