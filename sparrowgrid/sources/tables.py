"""Directories of tables with a checked manifest: state, n-gram tables and observation logs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 2
OBSERVATION = "seq long, at timestamp, duration_ms long, source string, subject string, body string, produced_by string"


def checksum(df: DataFrame) -> str:
    """Order-free checksum of all rows: sum of 64-bit hashes and count."""
    text = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    r = df.agg(F.sum(F.xxhash64(text).cast("decimal(38,0)")).alias("h"), F.count("*").alias("n")).first()
    return f"{r['n']}:{r['h'] or 0}"


def save(df: DataFrame, path: str, name: str, **facts: object) -> None:
    """Write a table and, after it, its manifest; without the manifest a table doesn't exist."""
    df.write.mode("overwrite").parquet(f"{path}/{name}/data")
    stored = df.sparkSession.read.parquet(f"{path}/{name}/data")
    manifest = {"name": name, "version": VERSION, "checksum": checksum(stored), **facts}
    df.sparkSession.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}/manifest")


def info(spark: SparkSession, path: str, name: str) -> dict:
    return json.loads(spark.read.text(f"{path}/{name}/manifest").first()["value"])


def load(spark: SparkSession, path: str, name: str, **expected: object) -> DataFrame:
    """The table; other versions, other facts (such as its tokenizer) and damage are refused."""
    m = info(spark, path, name)
    if m["version"] != VERSION:
        raise ValueError(f"{name}: version {m['version']} isn't {VERSION}")
    for k, v in expected.items():
        if m.get(k) != v:
            raise ValueError(f"{name}: {k} is {m.get(k)!r}, not {v!r}")
    df = spark.read.parquet(f"{path}/{name}/data")
    if checksum(df) != m["checksum"]:
        raise ValueError(f"{name}: its rows don't have the manifest's checksum")
    return df


def observations(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines log; malformed lines are left out."""
    return spark.read.schema(OBSERVATION).option("mode", "DROPMALFORMED").json(path).where("seq IS NOT NULL")


def tail(log: DataFrame, n: int) -> DataFrame:
    return log.orderBy(F.col("seq").desc()).limit(n)
