"""Document quality by Bradley-Terry ranking.

A preference pair is a good and a poor document. Logistic loss on the differences of their features gives the weights
of a score that ranks documents. The threshold is a quantile of the training scores: that which leaves the share of
poor documents below it, moved inside the labels' gap to where the fewest training documents fall on the wrong side.
Scores in [0, 1] are the logistic function of the distance to it, so that the threshold is at ``cut``.

Only a bounded sample of labelled documents (``most``) trains; every document is scored from its whole text. Of rows that share a
labelled id the one of the least features trains, so that the model doesn't depend on where rows lie. Nulls: a
null text is the empty text, and gets the score of its features (all zero); a label of null, or for no document, isn't
used. Where the sample holds one class or nothing, the score is the share of label 1 in it (0.5 for none). Ties get
equal scores; repeated rows stay; further columns are left out. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrowgrid.llm.features import NAMES, features, pair_logistic, sample_ids
from sparrowgrid.llm.shared import batches, lean, release, small_batches, texts_of

#: Labelled documents that train at most, and preference pairs for each of them.
MOST, PAIRS = 20_000, 20


@dataclass
class Ranker:
    """Score = logistic(slope * (weights . transformed features - threshold) + offset of the cut)."""

    weights: np.ndarray
    threshold: float
    slope: float
    cut: float
    constant: float | None = None

    def raw(self, f: np.ndarray) -> np.ndarray:
        return expand(f) @ self.weights

    def score(self, f: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(f), self.constant)
        z = self.slope * (self.raw(f) - self.threshold) + np.log(self.cut / (1 - self.cut))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def expand(f: np.ndarray) -> np.ndarray:
    """Features and, for shares, their square roots, in which a little of a rare thing already counts."""
    return np.concatenate((f, np.sqrt(np.maximum(f, 0))), 1)


def fit(f: np.ndarray, y: np.ndarray, cut: float = 0.7, pairs: int = PAIRS, seed: int = 7) -> Ranker:
    good, poor = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(poor):
        return Ranker(np.zeros(2 * len(NAMES)), 0.0, 1.0, cut, float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(seed)
    n = pairs * max(len(good), len(poor))
    a, b = rng.choice(good, n), rng.choice(poor, n)
    x = expand(f)
    scale = np.maximum(x.std(0), 1e-6)
    weights = pair_logistic(x / scale, a, b, l2=1e-3) / scale
    s = x @ weights
    # Errors if the threshold is at a quantile q: poor documents above it and good ones below it, by class share.
    order = np.argsort(s, kind="stable")
    good_below = np.concatenate(([0], np.cumsum(y[order] == 1))) / len(good)
    poor_above = 1 - np.concatenate(([0], np.cumsum(y[order] == 0))) / len(poor)
    wrong = good_below + poor_above
    best = np.flatnonzero(wrong == wrong.min())
    q = int(best[np.argmin(np.abs(best - len(poor)))])
    ranked = s[order]
    threshold = float(ranked[max(q - 1, 0)] + ranked[min(q, len(s) - 1)]) / 2
    return Ranker(weights, threshold, 1.0, cut)


def train(docs: DataFrame, labels: DataFrame, held_out: Column, label_col: str = "quality", cut: float = 0.7, most: int = MOST) -> Ranker:
    """Fit on a bounded sample of labelled documents; ``held_out`` is a condition on ``doc_id``. Features alone reach the driver."""
    small_batches(docs.sparkSession)
    ids = sample_ids(labels, label_col, held_out, most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id").select("doc_id", "label", "text")
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("f", pa.list_(pa.float64()))])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            yield batches({"doc_id": b.column(0), "label": b.column(1), "f": list(features(texts_of(b.column(2))))}, schema)

    # Of rows that share an id, the one of the least features trains, wherever the rows lie.
    one = rows.mapInArrow(lean(run), "doc_id long, label int, f array<double>").groupBy("doc_id").agg(F.min(F.struct("f", "label")).alias("r"))
    got = one.select("doc_id", "r.label", "r.f").toArrow().sort_by("doc_id")
    f = np.array(got.column("f").to_pylist(), float).reshape(-1, len(NAMES))
    y = np.array(got.column("label").to_pylist(), int)
    del got
    release()
    return fit(f, y, cut)


def score(docs: DataFrame, ranker: Ranker, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score`` of every whole text."""
    schema = pa.schema([("id", pa.int64()), ("score", pa.float64())])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            yield batches({"id": b.column(0), "score": ranker.score(features(texts_of(b.column(1))))}, schema)

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lean(run), "id long, score double").withColumnRenamed("id", id_col)


def keep(docs: DataFrame, ranker: Ranker, at_least: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose whole text scores ``at_least``; columns and rows are otherwise as they were."""
    small_batches(docs.sparkSession)
    place = docs.columns.index(text_col)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            yield b.filter(pa.array(ranker.score(features(texts_of(b.column(place)))) >= at_least))

    return docs.mapInArrow(lean(run), docs.schema)


def fold(remainder: int, modulus: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; an id of null is in no fold."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))
