"""Directory trees as sources: folders are listed in tasks, level by level, and files are read in partitions packed by size.

A listing is a table (``path, rel, folder, bytes``), never a list on the driver. What a scan leaves out - folders and files by name, files
by extension or size - goes while folders are listed, before any content is read. Any store that Arrow's file systems know
(local folders that all executors share, HDFS, object stores) can be read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparrowgrid.functions import text as T
from sparrowgrid.operators.graph import cut

#: Folders and files of a project that a scan leaves out (fixed values).
SKIPPED_FOLDERS = ("target", "node_modules", ".git", "dist", "build", ".gradle", "__pycache__", ".idea")
SKIPPED_FILES = ("Cargo.lock", "package-lock.json", "poetry.lock")
#: Extensions of a corpus and of a scan; trimmed bytes that a corpus text is longer than, and characters that a scanned text has at most (fixed values).
CORPUS, LONGER_THAN = ("md", "txt", "json"), 40
SCANNED, MOST_CHARS = ("txt", "md", "rs", "py", "json", "toml", "csv", "log", "xml", "yml", "yaml"), 5000
#: Bytes of files that one task reads, and what opening a file counts as.
PACK_BYTES, OPEN_BYTES = 64 << 20, 64 << 10
LISTED = pa.schema([("path", pa.string()), ("rel", pa.string()), ("folder", pa.bool_()), ("bytes", pa.int64())])
LISTED_DDL = "path string, rel string, folder boolean, bytes long"


def _opened(root: str) -> tuple[pafs.FileSystem, str]:
    fs, base = pafs.FileSystem.from_uri(root)
    return fs, base.rstrip("/")


def _children(root: str, extensions: tuple[str, ...], skip_folders: tuple[str, ...], skip_files: tuple[str, ...], least_bytes: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _opened(root)
        for b in frames:
            for rel in b.column(0).to_pylist():
                rows = []
                for f in fs.get_file_info(pafs.FileSelector(f"{base}/{rel}".rstrip("/") or "/")):
                    here = f"{rel}/{f.base_name}".lstrip("/")
                    if f.type == pafs.FileType.Directory:
                        keep = f.base_name not in skip_folders
                    else:
                        keep = f.type == pafs.FileType.File and f.base_name not in skip_files and (not extensions or f.extension in extensions) and f.size >= least_bytes
                    if keep:
                        rows.append({"path": f.path, "rel": here, "folder": f.type == pafs.FileType.Directory, "bytes": f.size or 0})
                yield pa.RecordBatch.from_pylist(rows, schema=LISTED)

    return run


def listing(spark: SparkSession, root: str, extensions: tuple[str, ...] = (), skip_folders: tuple[str, ...] = (), skip_files: tuple[str, ...] = (), least_bytes: int = 0) -> DataFrame:
    """``path, rel, folder, bytes`` of everything under ``root`` that the predicates keep; a folder that is left out isn't entered.

    A round lists the folders that the round before found, so rounds are the tree's depth. A root that isn't there is an error.
    """
    list_all = _children(root, tuple(extensions), tuple(skip_folders), tuple(skip_files), least_bytes)
    front, found = spark.createDataFrame([("",)], "rel string"), None
    while True:
        # Folders are dealt over the cluster: one may have very many entries.
        level = cut(front.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "rel").mapInArrow(list_all, LISTED_DDL))
        found = level if found is None else found.union(level)
        front = level.where("folder").select("rel")
        if front.isEmpty():
            return found


def packed(files: DataFrame, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """``files`` with ``bin``: in the order of paths, files whose sizes add up to about ``pack_bytes`` share a bin."""
    size = F.col("bytes") + OPEN_BYTES
    ranged = cut(files.withColumn("_s", size).repartitionByRange("path").withColumn("_p", F.spark_partition_id()))
    totals = ranged.groupBy("_p").agg(F.sum("_s").alias("t"))
    # One row for each partition.
    starts = totals.select("_p", F.coalesce(F.sum("t").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    before = F.sum("_s").over(Window.partitionBy("_p").orderBy("path").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_s")
    at = ranged.join(F.broadcast(starts), "_p").withColumn("bin", F.floor((F.col("start") + before) / pack_bytes).cast("int"))
    return at.drop("_s", "_p", "start")


def texts(files: DataFrame, root: str, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """``path, rel, body`` of files as UTF-8, in the order of paths over the partitions; what isn't UTF-8, or is gone since it was listed, is left out."""

    def read(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _opened(root)
        schema = pa.schema([("path", pa.string()), ("rel", pa.string()), ("body", pa.string())])
        for b in frames:
            for path, rel in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    with fs.open_input_stream(path) as f:
                        body = f.read().decode("utf-8")
                except (UnicodeDecodeError, FileNotFoundError):
                    continue
                yield pa.RecordBatch.from_pylist([{"path": path, "rel": rel, "body": body}], schema=schema)

    binned = cut(packed(files.where("NOT folder"), pack_bytes))
    bins = (binned.agg(F.max("bin")).first()[0] or 0) + 1
    return binned.repartitionById(bins, "bin").sortWithinPartitions("path").select("path", "rel").mapInArrow(read, "path string, rel string, body string")


def corpus(spark: SparkSession, root: str) -> DataFrame:
    """``path, rel, body`` of a corpus: texts by extension whose trimmed body is longer than ``LONGER_THAN`` bytes, in the order of paths."""
    files = listing(spark, root, CORPUS, least_bytes=LONGER_THAN + 1)
    return texts(files, root).where(F.octet_length(F.regexp_replace("body", r"(?U)^\s+|\s+$", "")) > LONGER_THAN)


def scan(spark: SparkSession, root: str) -> DataFrame:
    """``path, label``: texts by extension, neither empty nor over ``MOST_CHARS`` characters when trimmed, with the label that a node gets."""
    trimmed = F.regexp_replace("body", r"(?U)^\s+|\s+$", "")
    rows = texts(listing(spark, root, SCANNED, least_bytes=1), root).select("path", trimmed.alias("body"))
    return rows.where((F.length("body") > 0) & (F.length("body") <= MOST_CHARS)).select("path", F.concat_ws(": ", "path", "body").alias("label"))


def project(spark: SparkSession, root: str) -> DataFrame:
    """``path, kind, tokens, depth`` of a project's files and folders, in order of path; builds, version data and lock files are left out. No content is read."""
    rows = listing(spark, root, (), SKIPPED_FOLDERS, SKIPPED_FILES).select(F.col("rel").alias("path"), "folder")
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.when(F.col("folder"), "directory").otherwise(T.shape_kind(F.col("path")))
    return rows.select("path", kind.alias("kind"), T.name_tokens(name).alias("tokens"), (F.size(F.split("path", "/")) - 1).alias("depth")).orderBy("path")


#: What reads a tree, by name.
READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"corpus": corpus, "scan": scan, "project": project}
