"""An append-only log with rising numbers that a stream can write: a batch is added once, however often it is replayed.

A batch's rows get the numbers after the last committed one and are written as JSON lines into a folder of their own; then its commit,
which names the batch, the folder and the range, is renamed into place under the next place in the log, which fails where that is
taken. Readers see committed folders alone, so a log can be read while it is written, and a write that is cut off adds nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparrowgrid.operators.graph import cut
from sparrowgrid.operators.process import numbered
from sparrowgrid.sources.state import Store
from sparrowgrid.sources.tables import OBSERVATION

COMMIT = "place long, batch string, folder string, first long, last long"


@dataclass
class Log:
    """Rows of ``schema``, whose ``seq`` the log gives."""

    spark: SparkSession
    path: str
    schema: str = OBSERVATION

    @property
    def _store(self) -> Store:
        return Store(self.spark, self.path)

    def commits(self) -> DataFrame:
        """``place, batch, folder, first, last`` of every commit."""
        if not self._store._names("commits"):
            return self.spark.createDataFrame([], COMMIT)
        return self.spark.read.schema(COMMIT).json(f"{self.path.rstrip('/')}/commits")

    def append(self, rows: DataFrame, batch: str | None = None, order: tuple[str, ...] = ("at", "source", "subject", "body")) -> tuple[int, int]:
        """Adds rows in their order and gives the first and last number (the last is one less than the first where there are no rows).

        A batch that was committed isn't added again: its numbers are given. Of two writers at a time, the slower one takes new numbers.
        """
        batch = batch or uuid.uuid4().hex
        kinds = {f.name: f.dataType for f in StructType.fromDDL(self.schema).fields}
        own = [(F.col(c) if c in rows.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in kinds if c != "seq"]
        by = [f"_order{k}" for k in range(len(order))]
        plain = cut(rows.select(*own, *[F.col(c).alias(b) for c, b in zip(order, by, strict=True)]))
        while True:
            known = self.commits()
            if found := known.where(F.col("batch") == batch).first():
                return found["first"], found["last"]
            place, last = known.agg(F.coalesce(F.max("place"), F.lit(0)), F.coalesce(F.max("last"), F.lit(0))).first()
            folder = uuid.uuid4().hex
            to = f"{self.path.rstrip('/')}/parts/{folder}"
            numbered(plain, last, by).select(*kinds).write.json(to)
            n = self.spark.read.schema(self.schema).json(to).count()
            commit = {"place": place + 1, "batch": batch, "folder": folder, "first": last + 1, "last": last + n}
            if self._store._put(f"commits/{place + 1:012d}.json", json.dumps(commit)):
                return last + 1, last + n
            # Another writer took the place: these rows get other numbers.
            self._store._fs().delete(self._store._at("parts", folder), True)

    def sink(self, name: str) -> Callable[[DataFrame, int], None]:
        """For ``writeStream.foreachBatch``: batches of the stream of that name, each added once."""
        return lambda rows, number: self.append(rows, f"{name}-{number}") and None

    def read(self, first: int | None = None) -> DataFrame:
        """Committed rows; from a number on, only folders that have some are opened."""
        known = self.commits()
        if first is not None:
            known = known.where(F.col("last") >= first)
        # One name for each batch.
        folders = [f"{self.path.rstrip('/')}/parts/{r.folder}" for r in known.where("last >= first").select("folder").collect()]
        rows = self.spark.read.schema(self.schema).json(folders) if folders else self.spark.createDataFrame([], self.schema)
        return rows if first is None else rows.where(F.col("seq") >= first)

    def tail(self, n: int) -> DataFrame:
        """The newest n rows, newest first; older folders aren't opened."""
        last = self.commits().agg(F.max("last")).first()[0] or 0
        return self.read(max(1, last - n + 1)).orderBy(F.col("seq").desc())

    def adopt(self, path: str, batch: str) -> tuple[tuple[int, int], int]:
        """Adds a plain log of JSON lines that something else wrote, once; gives its numbers here and how many lines were torn.

        Lines that don't parse - such as a last one that was cut off - are kept beside the log under ``torn``, not in it. Rows keep
        the order of their own numbers.
        """
        lines = self.spark.read.text(path).where(F.trim("value") != "")
        schema = f"{self.schema}, _bad string"
        parsed = lines.select("value", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
        parsed = cut(parsed)
        torn = parsed.where("r IS NULL OR r._bad IS NOT NULL OR r.seq IS NULL")
        good = parsed.where("r._bad IS NULL AND r.seq IS NOT NULL").select("r.*").withColumnRenamed("seq", "_was")
        n = torn.count()
        if n:
            torn.select("value").write.mode("overwrite").text(f"{self.path.rstrip('/')}/torn/{batch}")
        return self.append(good.drop("_bad"), batch, ("_was", "at", "source", "subject", "body")), n
