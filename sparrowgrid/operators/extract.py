"""Extraction from texts: entities, co-occurrence, contradiction candidates, scoring against gold."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparrowgrid.functions import text as T
from sparrowgrid.operators.graph import cut, free
from sparrowgrid.operators.overlap import jaccard, similar

#: Rows of words up to which they are broadcast.
FEW = 1_000_000
#: Words that the rule of frequent terms leaves out (fixed values).
COMMON = tuple(
    "the and that with from this then than into over under after before while when were was are its his her their they them "
    "have has had been being which what each both some more most less very also still".split()
)


def entities(docs: DataFrame, id_col: str, text_col: str, min_length: int = 4, min_df: int = 2, ids: bool = True, capitals: bool = True, frequent: bool = True) -> DataFrame:
    """``doc, key, ord``: entities in order of first mention, by up to three rules: id-shaped words, capitals inside a sentence, frequent content terms of ``min_length`` bytes."""
    # The word before comes from the array shifted by one, not from a window over all words.
    words = F.split(F.col(text_col), " ")
    zipped = F.arrays_zip(words.alias("w"), F.concat(F.array(F.lit(None).cast("string")), words).alias("before"))
    w = docs.select(F.col(id_col).alias("doc"), F.posexplode(zipped).alias("pos", "z")).select("doc", "pos", "z.w", "z.before").where("w IS NOT NULL")
    w = w.withColumn("key", T.entity_key(F.col("w"))).where("key <> ''")
    sure = F.lit(False)
    if ids:
        sure = sure | F.col("key").rlike("^[a-z]+-[a-z0-9]+$")
    if capitals:
        sure = sure | F.coalesce(F.col("w").rlike(r"^\p{Lu}") & F.col("before").isNotNull() & ~F.col("before").rlike(r"[.!?\n]"), F.lit(False))
    may = (F.octet_length("key") >= min_length) & ~F.col("key").isin(*COMMON) if frequent else F.lit(False)
    # A row for each key of a document, with its first place and the first at which a rule of the word itself holds.
    one = w.select("doc", "pos", "key", sure.alias("sure"), may.alias("may")).where("sure OR may")
    one = one.groupBy("doc", "key", "may").agg(F.min("pos").alias("any"), F.min(F.when(F.col("sure"), F.col("pos"))).alias("pos"))
    if frequent:
        df = cut(one.where("may").groupBy("key").agg(F.count("*").alias("df")).where(F.col("df") >= min_df))
        free(docs.sparkSession)
        one = one.join(F.broadcast(df) if df.count() <= FEW else df, "key", "left").withColumn("pos", F.when(F.col("df").isNotNull(), F.col("any")).otherwise(F.col("pos")))
    first = one.where("pos IS NOT NULL")
    return first.select("doc", "key", F.row_number().over(Window.partitionBy("doc").orderBy("pos", "key")).alias("ord"))


def micro_prf(found: DataFrame, gold: DataFrame | Column) -> DataFrame:
    """``tp, fp, fn, precision, recall, f1`` over all rows of two frames with equal columns.

    ``gold`` can be a condition on ``found``, whose rows are distinct then: those that it holds for are the gold ones, which are
    counted where they are and not made and joined again.
    """
    if isinstance(gold, Column):
        both, a, b = found.select(F.coalesce(gold, F.lit(False)).alias("b")), F.lit(True), F.col("b")
    else:
        cols = found.columns
        both = found.distinct().withColumn("a", F.lit(1)).join(gold.distinct().withColumn("b", F.lit(1)), cols, "full")
        a, b = F.col("a").isNotNull(), F.col("b").isNotNull()
    n = both.agg(F.count_if(a & b).alias("tp"), F.count_if(a & ~b).alias("fp"), F.count_if(b & ~a).alias("fn"))
    share = lambda x, y: F.round(x / F.greatest(y, F.lit(1)), 6)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return n.select("tp", "fp", "fn", share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"))


def ppmi(docs: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """``w, c, n, ppmi``: positive pointwise mutual information of words within ``window`` places of each other, equal words left out.

    Neighbours come from shifted copies of the term array, so words are paired without a join.
    """
    t = docs.select(T.terms(F.col(text_col)).alias("t"))

    def others(t: Column) -> Column:
        """Each word of an array with its neighbours that are other words."""

        def one(w: Column, i: Column) -> Column:
            there = [F.get(t, i + d) for d in range(-window, window + 1) if d]
            return F.struct(w.alias("w"), sum((F.coalesce((x != w).cast("long"), F.lit(0).cast("long")) for x in there), F.lit(0).cast("long")).alias("n"))

        return F.transform(t, one)

    # How often a word is in a pair comes from the words themselves: one row for each word of the corpus.
    side = t.select(F.explode(F.transform(F.array("t"), others)[0]).alias("x")).groupBy(F.col("x.w").alias("w")).agg(F.sum("x.n").alias("nw")).where("nw > 0")
    side = cut(side)
    free(docs.sparkSession)
    words, total = side.agg(F.count("*"), F.sum("nw")).first()
    if words <= FEW:
        n = _numbered_pairs(t, side, window)
    else:
        pairs = None
        for d in range(1, window + 1):
            zipped = F.arrays_zip(F.col("t").alias("a"), F.slice("t", 1 + d, F.greatest(F.size("t") - d, F.lit(0))).alias("b"))
            one = t.where(F.size("t") > d).select(F.explode(zipped).alias("p")).select(F.col("p")["a"].alias("w"), F.col("p")["b"].alias("c")).where("c IS NOT NULL AND w <> c")
            pairs = one if pairs is None else pairs.unionByName(one)
        # Counts are alike in both directions: unordered pairs are counted, and turned round at the end.
        n = pairs.groupBy(F.least("w", "c").alias("w"), F.greatest("w", "c").alias("c")).agg(F.count("*").alias("n"))
        n = n.join(side, "w").join(side.select(F.col("w").alias("c"), F.col("nw").alias("nc")), "c")
    j = n.withColumn("ppmi", F.log(F.col("n").cast("double") * F.lit(float(total or 0)) / (F.col("nw") * F.col("nc")))).where("ppmi > 0")
    both = F.explode(F.array(F.struct("w", "c"), F.struct(F.col("c").alias("w"), F.col("w").alias("c"))))
    return j.select(both.alias("p"), "n", "ppmi").select("p.w", "p.c", "n", "ppmi")


#: Pairs that a task counts before it lets go of them.
PAIRS = 4_000_000


def _numbered_pairs(t: DataFrame, side: DataFrame, window: int) -> DataFrame:
    """``w, c, n, nw, nc`` of unordered pairs: words of a bounded vocabulary (``side``: ``w, nw``) are numbered by frequency, and a task counts its
    pairs as numbers before the shuffle, which moves no word."""
    spark = t.sparkSession
    table = side.orderBy(F.col("nw").desc(), "w").toArrow()
    vocabulary = spark.sparkContext.broadcast(table.column("w").combine_chunks())
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64())])

    def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
        key, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        return key[first], np.add.reduceat(n, first)

    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, parts, size = vocabulary.value, [], 0

        def out() -> Iterator[pa.RecordBatch]:
            key, n = merged(parts)
            for k in range(0, len(key), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(key[k : k + (1 << 17)]), pa.array(n[k : k + (1 << 17)])], schema=schema)

        for b in frames:
            lists = b.column(0)
            words = lists.flatten().dictionary_encode()
            # Words that are in no pair have no number.
            number = pc.fill_null(pc.index_in(words.dictionary, value_set=known), -1).to_numpy().astype(np.int64)
            code = number[words.indices.to_numpy()]
            n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            doc = np.repeat(np.arange(len(n)), n)
            for d in range(1, window + 1):
                x, y = code[:-d], code[d:]
                use = (doc[:-d] == doc[d:]) & (x != y)
                x, y = x[use], y[use]
                key, many = np.unique(np.minimum(x, y) << 32 | np.maximum(x, y), return_counts=True)
                if len(key):
                    parts.append((key, many.astype(np.int64)))
                    size += len(key)
            if size > PAIRS:
                parts = [merged(parts)]
                size = len(parts[0][0])
                if size > PAIRS // 2:
                    yield from out()
                    parts, size = [], 0
        if parts:
            yield from out()

    counted = pa.schema([("w", pa.string()), ("c", pa.string()), ("n", pa.int64()), ("nw", pa.int64()), ("nc", pa.int64())])
    often = spark.sparkContext.broadcast(table.column("nw").combine_chunks())

    def spelt(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            key = b.column(0).to_numpy()
            low, high = pa.array(key >> 32), pa.array(key & ((1 << 32) - 1))
            words, nw = vocabulary.value, often.value
            yield pa.RecordBatch.from_arrays([words.take(low), words.take(high), b.column(1), nw.take(low), nw.take(high)], schema=counted)

    n = t.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return n.mapInArrow(spelt, "w string, c string, n long, nw long, nc long")


def contradictions(docs: DataFrame, id_col: str, cluster: str, text_col: str, threshold: float = 0.5) -> DataFrame:
    """``a, b, lexical, negation_clash, number_clash``: pairs of a cluster with shared words but other negations or decimals, by rare-first prefixes.

    Texts of the same words, negations and decimals don't clash with each other and clash with the same others: one of them is
    compared, and its pairs are told for all at the end.
    """
    t = F.col(text_col)
    words = F.array_sort(F.array_distinct(F.filter(T.terms(t), lambda x: F.octet_length(x) > 3)))
    like = docs.select(F.col(id_col).alias("id"), F.col(cluster).alias("grp"), words.alias("t"), T.negations(t).alias("neg"), T.leading_number(t, True).alias("dec")).where(F.size("t") > 0)
    kept = like.withColumns({"k": F.xxhash64("t"), "l": F.xxhash64(F.lit(1), "t")})
    same = ["grp", "k", "l", "neg", "dec"]
    first = kept.groupBy(*same).agg(F.min(F.struct("id", "t")).alias("f")).select(*same, F.col("f.id").alias("rep"), F.col("f.t").alias("t"))
    first = cut(first)
    on = [kept[c].eqNullSafe(first[c]) for c in same]
    member = cut(kept.drop("t").join(first.drop("t").hint("merge"), on).select(kept["id"], "rep"))
    free(docs.sparkSession)
    near = similar(first.select("grp", F.col("rep").alias("id"), "t"), None, threshold)
    marks = lambda c: first.select(F.col("rep").alias(c), F.col("neg").alias(f"neg_{c}"), F.col("dec").alias(f"dec_{c}"))
    neg, num = F.col("neg_a") != F.col("neg_b"), F.coalesce(F.col("dec_a") != F.col("dec_b"), F.lit(False))
    both = near.join(marks("a"), "a").join(marks("b"), "b").where(neg | num)
    each = lambda c: member.select(F.col("rep").alias(c), F.col("id").alias(f"id_{c}"))
    told = both.join(each("a"), "a").join(each("b"), "b")
    return told.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), F.round(jaccard(), 6).alias("lexical"), neg.alias("negation_clash"), num.alias("number_clash"))


#: Lexicons of claim signatures (our own lists): words that affirm, words that deny, and negators that flip what follows within three tokens.
AFFIRM = frozenset("increase increases improve improves rise rises support supports enable enables true succeed succeeds works".split())
DENY = frozenset("decrease decreases worsen worsens fall falls prevent prevents block blocks false fail fails broken".split())
NEGATORS = frozenset("not no never without cannot neither".split())


def signature(statement: str | None) -> tuple[int, list[str]]:
    """Polarity (-1, 0, 1) and sorted content of a claim; read left to right, a negator flips the next polar word within three tokens and both are consumed."""
    tokens = [w for w in re.split(r"[\W_]+", (statement or "").lower()) if w]
    polarity, content, reach = 0, set(), 0
    for w in tokens:
        if w in NEGATORS:
            reach = 4
        elif w in AFFIRM or w in DENY:
            polarity += (1 if w in AFFIRM else -1) * (-1 if reach > 0 else 1)
            reach = 0
        elif len(w) >= 3 and w not in T.STOP:
            content.add(w)
        reach -= 1
    return (polarity > 0) - (polarity < 0), sorted(content)


def signatures(claims: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, polarity, content`` of each claim."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            s = [signature(t) for t in f["text"]]
            yield pd.DataFrame({"id": f["id"], "polarity": [x[0] for x in s], "content": [x[1] for x in s]})

    return claims.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, "id long, polarity int, content array<string>")


def opposed(sigs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``a, b, overlap`` of claims of opposite polarity whose content overlaps, by rare-first prefixes."""
    side = lambda p: sigs.where(F.col("polarity") == p).select(F.lit(0).alias("grp"), "id", F.array_distinct("content").alias("t"))
    return similar(side(1), side(-1), threshold).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.round(jaccard(), 6).alias("overlap"))


#: Thresholds of an identity sweep (fixed values).
SWEEP = (0.30, 0.40, 0.50, 0.60, 0.70, 0.80, 0.85, 0.90, 0.95)


def identity_sweep(claims: DataFrame, truth: DataFrame | str) -> DataFrame:
    """``method, threshold, tp, fp, precision, recall, f1, best, unresolved``: two ways to tell that claims contradict, at each threshold of ``SWEEP``.

    ``claims(id, v, polarity, content)``, ``truth(a, b)`` with a < b. Embedding flags pairs whose cosine reaches the threshold;
    structural those of opposite polarity whose content does. ``best`` marks a method's greatest F1 (the highest threshold of
    equals), ``unresolved`` counts true pairs with a claim of no polarity. Pairs under the least threshold are never made.
    ``truth`` can name a column of the claims: claims of one value there and of opposite polarity are true pairs, which are counted
    by value and never made.
    """
    from sparrowgrid.operators import neighbours

    near = neighbours.pairs_above(claims, "id", "v", SWEEP[0], strict=False).select(F.lit("embedding").alias("method"), F.col("i").alias("a"), F.col("j").alias("b"), "s")
    alike = opposed(claims, SWEEP[0]).select(F.lit("structural").alias("method"), "a", "b", F.col("overlap").alias("s"))
    pairs = near.unionByName(alike)
    if isinstance(truth, str):
        side = lambda c: claims.select(F.col("id").alias(c), F.col(truth).alias(f"t_{c}"), F.col("polarity").alias(f"p_{c}"))
        pairs = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("true", (F.col("t_a") == F.col("t_b")) & (F.col("p_a") * F.col("p_b") == -1))
        by = claims.where(F.col(truth).isNotNull()).groupBy(truth).agg((F.count_if(F.col("polarity") == 1) * F.count_if(F.col("polarity") == -1)).alias("n"))
        size = by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("known"), F.lit(0).cast("long").alias("unresolved"))  # one row
    else:
        known = truth.select("a", "b").distinct()
        pairs = pairs.join(known.withColumn("true", F.lit(True)), ["a", "b"], "left")
        polar = lambda c: claims.select(F.col("id").alias(c), (F.col("polarity") == 0).alias(f"none_{c}"))
        size = known.join(polar("a"), "a").join(polar("b"), "b").agg(F.count("*").alias("known"), F.count_if(F.col("none_a") | F.col("none_b")).alias("unresolved"))  # one row
    at = F.explode(F.filter(F.array(*[F.lit(t) for t in SWEEP]), lambda t: t <= F.col("s")))
    hits = pairs.select("method", at.alias("threshold"), F.coalesce("true", F.lit(False)).alias("true")).groupBy("method", "threshold").agg(F.count_if("true").alias("tp"), F.count_if(~F.col("true")).alias("fp"))
    grid = claims.sparkSession.createDataFrame([(m, t) for m in ("embedding", "structural") for t in SWEEP], "method string, threshold double")
    j = grid.join(hits, ["method", "threshold"], "left").fillna(0, ["tp", "fp"]).join(F.broadcast(size))
    precision = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    j = j.withColumns({"precision": precision, "recall": F.col("tp") / F.greatest("known", F.lit(1))})
    j = j.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))
    first = F.row_number().over(Window.partitionBy("method").orderBy(F.col("f1").desc(), F.col("threshold").desc())) == 1
    return j.select("method", "threshold", "tp", "fp", "precision", "recall", "f1", first.alias("best"), "unresolved")


#: What a phrase follows, and endings that mark a verb (fixed values).
DETERMINERS = ("the", "a", "an", "this", "that", "its")
VERBISH = ("ing", "ed")


def _phrases(t: Column, most: int) -> Column:
    """Of an array of words: a struct (ord, words) for each determiner that a phrase follows."""

    def plain(w: Column) -> Column:
        verb = F.endswith(w, F.lit(VERBISH[0])) | F.endswith(w, F.lit(VERBISH[1]))
        return ~(w.isin(*DETERMINERS) | w.isin(*COMMON) | (F.octet_length(w) < 3) | (verb & (F.octet_length(w) >= 4)))

    def step(so_far: Column, w: Column) -> Column:
        # After the first word, an ending in -s (not -ss) is a verb's.
        head = (F.size(so_far["words"]) > 0) & F.endswith(w, F.lit("s")) & ~F.endswith(w, F.lit("ss"))
        on = so_far["on"] & plain(w) & ~head
        return F.struct(F.when(on, F.array_append(so_far["words"], w)).otherwise(so_far["words"]).alias("words"), on.alias("on"))

    def after(w: Column, i: Column) -> Column:
        start = F.struct(F.array().cast("array<string>").alias("words"), F.lit(True).alias("on"))
        words = F.aggregate(F.transform(F.slice(t, i + 2, most), F.lower), start, step, lambda s: s["words"])
        # A capital inside a text is a name's.
        return F.when(F.lower(w).isin(*DETERMINERS) & ((i == 0) | (F.lower(w) == w)), F.struct(i.alias("ord"), words.alias("words")))

    return F.filter(F.transform(t, after), lambda p: p.isNotNull() & (F.size(p["words"]) > 0))


def words_of(text: Column) -> Column:
    """Words between white space, without the signs around them; hyphens stay."""
    return F.filter(F.transform(F.split(text, r"\s+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}-]+|[^\p{L}\p{N}-]+$", "")), lambda w: w != "")


def phrases(docs: DataFrame, id_col: str, text_col: str, most: int = 3) -> DataFrame:
    """``id, ord, phrase, head``: for each determiner, at word ``ord``, the up to ``most`` words that follow it, ended by a determiner, a stop
    word, a verb-like or a short word; joined by hyphens, and the last of them."""
    # The lambda binds the words: they are cut once for each text.
    found = F.transform(F.array(words_of(F.col(text_col))), lambda t: _phrases(t, most))[0]
    rows = docs.select(F.col(id_col).alias("id"), F.explode(found).alias("p"))
    return rows.select("id", "p.ord", F.array_join("p.words", "-").alias("phrase"), F.element_at("p.words", -1).alias("head"))
