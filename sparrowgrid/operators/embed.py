"""Text embeddings without a model: hashed character grams, counted word tables, and combination of vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowgrid.functions import text as T
from sparrowgrid.functions import vector as V
from sparrowgrid.operators.extract import ppmi


def gram_vector(gram: str, dim: int, seed: int) -> np.ndarray:
    """A unit Gaussian vector that depends on the gram alone."""
    g = np.random.default_rng(int.from_bytes(hashlib.sha256(gram.encode()).digest()[:8], "little") ^ seed).normal(size=dim)
    return g / np.linalg.norm(g)


def random_projection(docs: DataFrame, id_col: str, text_col: str, dim: int = 64, seed: int = 42) -> DataFrame:
    """``id_col, embedding``: weighted sum of vectors of characters (1) and pairs of characters (0.5), of unit length. Each distinct text is embedded once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[str, np.ndarray] = {}

        def vec(g: str) -> np.ndarray:
            if g not in memo:
                if len(memo) > 200_000:
                    memo.clear()
                memo[g] = gram_vector(g, dim, seed ^ (0xFFFF if len(g) == 2 else 0))
            return memo[g]

        for f in frames:
            out = []
            for t in f["text"]:
                t = f" {(t or '').lower()} "
                counts = pd.Series([*t, *(a + b for a, b in zip(t, t[1:], strict=False))]).value_counts()
                v = sum((n * (0.5 if len(g) == 2 else 1.0) * vec(g) for g, n in counts.items()), np.zeros(dim))
                n = np.linalg.norm(v)
                out.append((v / n if n > 1e-8 else v).tolist())
            yield pd.DataFrame({"text": f["text"], "embedding": out})

    once = docs.select(F.col(text_col).alias("text")).distinct().mapInPandas(run, "text string, embedding array<double>")
    key = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    return key.join(once, key["text"].eqNullSafe(once["text"])).select(id_col, "embedding")


def signature(word: str, dim: int, slots: int = 8) -> list[tuple[int, float]]:
    """Sparse signs of a context word: slots that its digest names."""
    d = hashlib.sha256(word.encode()).digest()
    return [(int.from_bytes(d[2 * i : 2 * i + 2], "little") % dim, 1.0 if d[31 - i] & 1 else -1.0) for i in range(slots)]


def signature_of(word: Column, dim: int, slots: int = 8) -> Column:
    """``signature`` of a word as an array of ``slot, sign``."""

    def at(digest: Column, i: int) -> Column:
        two = F.conv(F.substring(digest, 4 * i + 1, 4), 16, 10).cast("long")
        slot = (two % 256 * 256 + F.floor(two / 256)) % dim
        odd = F.substring(digest, 64 - 2 * i, 1).isin(*"13579bdf")
        return F.struct(slot.cast("int").alias("slot"), F.when(odd, 1.0).otherwise(-1.0).alias("sign"))

    # The digest is made once for all slots.
    return F.transform(F.array(F.sha2(word, 256)), lambda digest: F.array(*[at(digest, i) for i in range(slots)]))[0]


def word_table(docs: DataFrame, id_col: str, text_col: str, dim: int = 32, window: int = 2) -> DataFrame:
    """``w, embedding``: PPMI-weighted sums of the signatures of context words; only (word, slot) sums are shuffled, and no matrix is made."""
    # Signs come from each pair's own word: pairs are made once, and no join moves them.
    signs = F.explode(signature_of(F.col("c"), dim)).alias("s")
    sums = ppmi(docs, id_col, text_col, window).select("w", "ppmi", signs).groupBy("w", "s.slot").agg(F.sum(F.col("ppmi") * F.col("s.sign")).alias("x"))
    filled = sums.groupBy("w").agg(F.map_from_entries(F.collect_list(F.struct("slot", "x"))).alias("m"))
    raw = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0)))
    v = filled.select("w", raw.alias("v"))
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return v.withColumn("n", F.array_repeat(F.greatest(size, F.lit(1e-8)), dim)).select("w", F.zip_with("v", "n", lambda x, n: x / n).alias("embedding"))


def synthetic(docs: DataFrame, id_col: str, text_col: str, dim: int = 64, seed: int = 42) -> DataFrame:
    """``id_col, embedding``: a unit Gaussian vector that depends on the whole text alone; equal texts have equal vectors, others are unrelated. Null is the empty text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"id": f["id"], "embedding": [gram_vector(t or "", dim, seed).tolist() for t in f["text"]]})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "id long, embedding array<double>").withColumnRenamed("id", id_col).withColumn("embedder", F.lit(f"synthetic-{dim}-{seed}"))


def sentences(docs: DataFrame, table: DataFrame, id_col: str, text_col: str, dim: int = 32) -> DataFrame:
    """``id_col, embedding, hits``: sum of the vectors of a text's known words (``table(w, embedding)``), of unit length; without a hit the zero vector.

    Words meet the table by a join and sums are made by component, so neither texts nor the table are gathered.
    """
    words = docs.select(F.col(id_col).alias("id"), F.explode(T.terms(F.col(text_col))).alias("w")).groupBy("id", "w").agg(F.count("*").alias("n"))
    parts = words.join(table, "w").select("id", "n", F.posexplode("embedding").alias("pos", "x"))
    sums = parts.groupBy("id", "pos").agg(F.sum(F.col("x") * F.col("n")).alias("x"), F.sum("n").alias("n"))
    v = sums.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("v"), F.max("n").alias("hits"))
    none = F.array_repeat(F.lit(0.0), dim)
    out = docs.select(F.col(id_col).alias("id")).join(v, "id", "left")
    return out.select(F.col("id").alias(id_col), F.when(F.col("v").isNull(), none).otherwise(V.normalise(F.col("v"))).alias("embedding"), F.coalesce("hits", F.lit(0)).alias("hits"))


#: Texts of which the first two are related and the third isn't, without a word in common (fixed values), and by how much the relation must lead.
PROBES = (
    ("car", "automobile", "banana"),
    ("dog", "puppy", "spreadsheet"),
    ("spindle motor overheated and tripped", "thermal fault shut down the drive", "invoice payment terms net thirty days"),
)
PROBE_LEAD = 0.05

Embedder = Callable[[DataFrame, str, str], DataFrame]


def semantic(spark: SparkSession, embedder: Embedder) -> bool:
    """Whether an embedder tells related texts from unrelated ones in every probe; empty or non-finite vectors fail."""
    texts = spark.createDataFrame([(3 * k + j, t) for k, p in enumerate(PROBES) for j, t in enumerate(p)], "id long, text string")
    v = {r["id"]: np.array(r["embedding"] or [], float) for r in embedder(texts, "id", "text").select("id", "embedding").collect()}
    cos = lambda a, b: float(a @ b / max(np.linalg.norm(a) * np.linalg.norm(b), 1e-8))
    for k in range(len(PROBES)):
        some = [v.get(3 * k + j, np.empty(0)) for j in range(3)]
        if any(not len(x) or not np.isfinite(x).all() for x in some) or cos(some[0], some[1]) <= cos(some[0], some[2]) + PROBE_LEAD:
            return False
    return True


def choose(spark: SparkSession, providers: dict[str, Embedder], wanted: str | None = None) -> tuple[str, Embedder]:
    """The provider that is wanted by name, else the first that passes the probes, else the random projection. An unknown name is an error."""
    if wanted:
        if wanted not in providers:
            raise ValueError(f"no embedder {wanted}; there are {', '.join(providers)}")
        return wanted, providers[wanted]
    for name, e in providers.items():
        if semantic(spark, e):
            return name, e
    return "random-projection", random_projection


def tagged(embedded: DataFrame, name: str) -> DataFrame:
    """Embeddings with the name of what made them: vectors of different embedders don't compare."""
    return embedded.withColumn("embedder", F.lit(name))
