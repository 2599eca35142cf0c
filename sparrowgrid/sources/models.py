"""Models as folders of files in a registry: copied and hashed in tasks, with a manifest that says what every file is.

Files go from the folder that holds them into one of the registry's own, each by one task in pieces; the manifest is a version of a
``state.Store``, so a model is there whole or not at all. Only stores that Arrow's file systems open are read: nothing is fetched from the web.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowgrid.operators.graph import cut
from sparrowgrid.sources import state, tree

PIECE = 8 << 20
FILE = pa.schema([("file", pa.string()), ("bytes", pa.int64()), ("sha256", pa.string())])
FILE_DDL = "file string, bytes long, sha256 string"


def _hashed(root: str, to: str | None):
    """Rows ``path, rel`` to the digest of each file, copied under ``to`` where it is given."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = pafs.FileSystem.from_uri(root)[0]
        target, base = pafs.FileSystem.from_uri(to) if to else (None, "")
        for b in frames:
            for path, rel in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                digest, size = hashlib.sha256(), 0
                out = None
                if target:
                    place = f"{base}/{rel}"
                    target.create_dir(place.rsplit("/", 1)[0], recursive=True)
                    out = target.open_output_stream(place)
                with source.open_input_stream(path) as f:
                    while piece := f.read(PIECE):
                        digest.update(piece)
                        size += len(piece)
                        if out:
                            out.write(piece)
                if out:
                    out.close()
                yield pa.RecordBatch.from_pylist([{"file": rel, "bytes": size, "sha256": digest.hexdigest()}], schema=FILE)

    return run


def files(spark: SparkSession, folder: str, to: str | None = None) -> DataFrame:
    """``file, bytes, sha256`` of everything under a folder, packed by size over tasks."""
    if folder.split("://")[0] in ("http", "https", "ftp"):
        raise ValueError("models are installed from files only")
    binned = cut(tree.packed(tree.listing(spark, folder).where("NOT folder")))
    bins = (binned.agg(F.max("bin")).first()[0] or 0) + 1
    return binned.repartitionById(bins, "bin").select("path", "rel").mapInArrow(_hashed(folder, to), FILE_DDL)


def install(spark: SparkSession, root: str, name: str, folder: str, **facts: object) -> int:
    """Adds a model, or a new version of it, from a folder."""
    to = f"{root.rstrip('/')}/.files/{name}-{uuid.uuid4().hex}"
    # Copied once: what the tasks report is kept.
    copied = cut(files(spark, folder, to))
    return state.install(spark, root, name, copied, folder=to, **facts)


def models(spark: SparkSession, root: str) -> DataFrame:
    """``name, version, bytes, facts`` of the models that are installed."""
    return state.tables(spark, root)


def check(spark: SparkSession, root: str, name: str) -> DataFrame:
    """``file, state`` of a model's files: as installed, changed or gone; and strange ones."""
    was = state.table(spark, root, name)
    now = files(spark, path(spark, root, name)).select("file", F.col("sha256").alias("now"))
    said = F.when(F.col("sha256").isNull(), "strange").when(F.col("now").isNull(), "gone").when(F.col("now") == F.col("sha256"), "as installed").otherwise("changed")
    return was.join(now, "file", "full").select("file", said.alias("state"))


def path(spark: SparkSession, root: str, name: str) -> str:
    """The folder of a model's files; one that isn't installed is an error."""
    found = state.Store(spark, f"{root.rstrip('/')}/{name}").newest()
    if not found:
        raise state.Damaged(f"{name}: no such model")
    return found[1]["facts"]["folder"]


def remove(spark: SparkSession, root: str, name: str) -> None:
    """Takes a model and its files away."""
    here = state.Store(spark, path(spark, root, name))
    state.remove(spark, root, name)
    here._fs().delete(here._at(), True)
