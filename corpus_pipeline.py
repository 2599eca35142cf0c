"""From raw documents to token-ready ones: quality, toxicity, near copies, benchmark leaks, tokens.

Each stage is ``(name, function)``; a function takes ``(spark, docs, sf_dir)`` and returns a frame. ``run`` writes each
stage's frame as Parquet in the shared folder and hands it, read again, to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowgrid.llm import bpe, decontaminate, ngramjoin, quality, toxicity
from sparrowgrid.llm.registry import vocabulary
from sparrowgrid.llm.shared import discard, table, written

#: Documents that score at least so much as good, and less than so much as toxic, stay.
GOOD, TOXIC = 0.7, 0.5


def _kept(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id is in ``decided``; a null id counts as an id."""
    return docs.join(decided.select(F.col("doc_id").alias("_sparrowgrid_kept")).distinct(), F.col("doc_id").cast("long").eqNullSafe(F.col("_sparrowgrid_kept")), "left_semi")


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranking places at or over the threshold, learnt from all labels that these documents have.

    Without a good and a poor labelled document there is no ranking, and every document stays. A null text counts as an
    empty one, a row without id is scored like others, repeated rows share their fate, and no rows give no rows.
    """
    ranker = quality.train(docs, table(spark, sf_dir, "labels"), F.lit(False))
    return docs if ranker.constant is not None else quality.keep(docs, ranker, GOOD)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under the toxicity threshold, by a lexicon learnt from the labels of the stage's documents.

    Without a toxic and a clean labelled document there is no lexicon, and every document stays. Null and empty texts
    have no matches; rows without id are scored, repeated rows share their fate, and no rows give no rows.
    """
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"), F.lit(False))
    return docs if lexicon.constant is not None else toxicity.keep(docs, lexicon, TOXIC)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of 0.75 join: the least doc_id. Of rows that share it, and of rows without an id, all stay.

    Null and empty texts are in no group and stay; no rows give no rows.
    """
    members, _ = ngramjoin.join(docs)
    first = members.where(F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))
    return _kept(docs, first)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates; with an empty benchmark, all.

    Null and empty texts, and rows without id whose text is clean, stay; repeated rows share their fate; no rows give no rows.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row that is left; a null text is encoded as the empty text."""
    return bpe.encode(docs, vocabulary("byte_bpe_50k.json"), digests=True)


STAGES = [
    ("quality classifier", drop_low_quality),
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("BPE encoding and decoding", tokenize),
]

#: Fitted scores and byte-pair ids have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        # What a stage read is not needed once its result is written; the input table stays.
        if k:
            discard(before)
    return docs
