"""State of several tables as numbered versions: a version is there whole or not at all.

Tables are written first, each into a folder of its own; a version comes to be when its manifest is renamed into place, which fails
where the number is taken. A write that is cut off leaves the version before as it was, and folders that no manifest names. Reading
takes the newest sound version: a manifest that can't be read, or whose tables' files aren't all there, is passed over for the
one before. Manifests are small and read on the driver; tables are never.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparrowgrid.sources.tables import checksum

FORMAT = 3


class Damaged(ValueError):
    """No sound version."""


@dataclass
class Store:
    spark: SparkSession
    path: str

    # Files of the store, by the session's file systems.

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path.rstrip("/"), *parts]))

    def _fs(self):
        return self._at().getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _names(self, folder: str) -> list[str]:
        fs, at = self._fs(), self._at(folder)
        return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []

    def _put(self, name: str, text: str) -> bool:
        """Writes a small file whole, or not at all; false where there is one of that name."""
        jvm = self.spark._jvm
        draft = self._at("drafts", uuid.uuid4().hex)
        fs = self._fs()
        out = fs.create(draft)
        out.write(bytearray(text.encode()))
        out.close()
        to = self._at(name)
        fs.mkdirs(to.getParent())
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri() if to.toUri().getScheme() else fs.getUri(), self.spark._jsparkSession.sessionState().newHadoopConf())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(fs.makeQualified(draft), fs.makeQualified(to), none)
        except Exception as e:
            if not fs.exists(to):
                raise
            if "FileAlreadyExists" not in str(e) and "exists" not in str(e).lower():
                raise
            fs.delete(draft, False)
            return False
        return True

    def _text(self, name: str) -> str:
        fs = self._fs()
        stream = fs.open(self._at(name))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _bytes(self, folder: str) -> int:
        fs, at = self._fs(), self._at(folder)
        return fs.getContentSummary(at).getLength() if fs.exists(at) else -1

    # Versions.

    def numbers(self) -> list[int]:
        """Numbers of all manifests, sound or not, rising."""
        return sorted(int(n.removesuffix(".json")) for n in self._names("versions") if n.removesuffix(".json").isdigit())

    def manifest(self, number: int) -> dict | None:
        """A version's manifest; none where it can't be read or a table's files don't have the bytes that it names."""
        try:
            m = json.loads(self._text(f"versions/{number:012d}.json"))
            sound = m["format"] == FORMAT and all(self._bytes(f"data/{t['folder']}") == t["bytes"] for t in m["tables"].values())
        except (ValueError, KeyError, TypeError, AttributeError):
            return None
        return m if sound else None

    def newest(self) -> tuple[int, dict] | None:
        for n in reversed(self.numbers()):
            if m := self.manifest(n):
                return n, m
        return None

    def save(self, tables: dict[str, DataFrame], keep: bool = False, **facts: object) -> int:
        """Writes tables as the next version and gives its number. ``keep``: tables of the newest version that aren't named stay as they are, without a copy."""
        last = self.newest() if keep else None
        entries = dict(last[1]["tables"]) if last else {}
        for name, df in tables.items():
            folder = f"{name}-{uuid.uuid4().hex}"
            to = f"{self.path.rstrip('/')}/data/{folder}"
            df.write.parquet(to)
            stored = self.spark.read.schema(df.schema).parquet(to)
            entries[name] = {"folder": folder, "bytes": self._bytes(f"data/{folder}"), "checksum": checksum(stored), "schema": df.schema.json()}
        text = json.dumps({"format": FORMAT, "tables": entries, "facts": facts})
        number = (self.numbers() or [0])[-1] + 1
        while not self._put(f"versions/{number:012d}.json", text):
            number += 1
        return number

    def load(self, number: int | None = None, deep: bool = False) -> dict[str, DataFrame]:
        """Tables of a version, or of the newest sound one. ``deep`` reads all rows and compares their checksums."""
        if number is None:
            found = self.newest()
        else:
            found = (number, m) if (m := self.manifest(number)) else None
        if not found:
            raise Damaged(f"{self.path}: no sound version")
        out = {}
        for name, t in found[1]["tables"].items():
            out[name] = self.spark.read.schema(StructType.fromJson(json.loads(t["schema"]))).parquet(f"{self.path.rstrip('/')}/data/{t['folder']}")
            if deep and checksum(out[name]) != t["checksum"]:
                raise Damaged(f"{self.path}: {name} doesn't have its rows")
        return out

    def load_or_empty(self) -> dict[str, DataFrame]:
        """The newest sound version, or no tables where there never was a version. Versions that are all damaged are an error, never an empty state."""
        return self.load() if self.numbers() else {}

    def prune(self, versions: int = 1) -> None:
        """Keeps the newest sound versions and deletes the others, then folders that no manifest names. Nothing may be writing meanwhile."""
        fs = self._fs()
        kept = [n for n in reversed(self.numbers()) if self.manifest(n)][:versions]
        for n in self.numbers():
            if n not in kept:
                fs.delete(self._at(f"versions/{n:012d}.json"), False)
        named = {t["folder"] for n in kept for t in self.manifest(n)["tables"].values()}
        for folder in self._names("data"):
            if folder not in named:
                fs.delete(self._at("data", folder), True)
        fs.delete(self._at("drafts"), True)


def older(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of a state in one JSON file of an older form: a bare array is the nodes; of an object, each array is a table."""
    head = spark.read.text(path, wholetext=True).select(F.substring(F.ltrim(F.regexp_replace("value", r"^\s+", "")), 1, 1)).first()[0]
    rows = spark.read.option("multiLine", "true").option("mode", "FAILFAST").json(path)
    if head == "[":
        return {"nodes": rows}
    out = {}
    for name, kind in rows.dtypes:
        if kind.startswith("array<struct"):
            out[name] = rows.select(F.inline(name))
        elif kind.startswith("array"):
            out[name] = rows.select(F.explode(name).alias("value"))
    return out


# A registry of tables: each name is a store of its own.


def _store(spark: SparkSession, root: str, name: str) -> Store:
    if not name or "/" in name or name.startswith("."):
        raise ValueError(f"not a table's name: {name!r}")
    return Store(spark, f"{root.rstrip('/')}/{name}")


def install(spark: SparkSession, root: str, name: str, table: DataFrame, **facts: object) -> int:
    """Adds a table, or a new version of it, with facts that say what it goes with (such as its tokenizer)."""
    return _store(spark, root, name).save({"table": table}, **facts)


def tables(spark: SparkSession, root: str) -> DataFrame:
    """``name, version, bytes, facts``: the newest sound version of each table."""
    rows = []
    for name in Store(spark, root)._names(""):
        if not name.startswith(".") and (found := Store(spark, f"{root.rstrip('/')}/{name}").newest()):
            t = found[1]["tables"]["table"]
            rows.append((name, found[0], t["bytes"], json.dumps(found[1]["facts"], sort_keys=True)))
    return spark.createDataFrame(rows, "name string, version long, bytes long, facts string")


def table(spark: SparkSession, root: str, name: str, deep: bool = False, **expected: object) -> DataFrame:
    """A table of the registry; other facts than the expected ones are refused."""
    store = _store(spark, root, name)
    found = store.newest()
    if not found:
        raise Damaged(f"{name}: no such table, or none that is sound")
    for k, v in expected.items():
        if found[1]["facts"].get(k) != v:
            raise ValueError(f"{name}: {k} is {found[1]['facts'].get(k)!r}, not {v!r}")
    return store.load(found[0], deep)["table"]


def remove(spark: SparkSession, root: str, name: str) -> None:
    store = _store(spark, root, name)
    if not store._fs().delete(store._at(), True):
        raise ValueError(f"{name}: no such table")


def export(spark: SparkSession, root: str, name: str, to: str) -> int:
    """Copies a table, with its facts and checked against its rows, into another registry."""
    return install(spark, to, name, table(spark, root, name, deep=True), **_store(spark, root, name).newest()[1]["facts"])
