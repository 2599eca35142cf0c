"""WARC archives as a Spark data source, and archiving of pages with revisit records for equal payloads.

Reading (``format("warc")``): the driver lists the archives and packs them into partitions by size. Predicates on the
record type and on header columns are pushed down; a task parses a record's headers first, and skips the payload of a
record that a predicate rejects (a seek in a plain archive, inflating without decoding in a compressed one). Option
``payload=false`` leaves every payload out. Option ``verify`` (default true) holds each payload against its digest.

Writing: each task writes archives of its own under names that no other attempt uses; each commit of the driver adds a
manifest of its own that names the finished ones, so a lost executor or a second attempt leaves no half archive in the
result, and appending keeps what earlier commits wrote. Mode overwrite removes earlier manifests and their archives once
the new manifest is there. Paths may be any URI that pyarrow.fs opens.

Nulls: a null payload is the empty payload, a null url or id an absent header. A url is kept as it is, percent signs and
inner spaces included; only control characters and spaces at its ends, which a header can't hold, are percent-encoded
and read back so. A record without a type reads as null type; one without a length, or an archive that ends inside a
record, raises. Long payloads are written whole. Rows
that repeat a page stay as records of their own. An empty table gives an empty archive folder that reads as no rows.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)

MANIFEST = "_archives"
SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, http_length long, payload binary"
ARROW = pa.schema(
    [("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string())]
    + [("payload_digest", pa.string()), ("http_length", pa.int64()), ("payload", pa.binary())]
)
#: Header of each column that a predicate may test before the payload is read.
HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To"}
ID = "urn:x-page:"
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


#: What a header's value can't hold as it is.
UNFIT = re.compile(r"[\x00-\x1f\x7f\x85\u2028\u2029]|^ +| +$")


def base32(hexadecimal: str) -> str:
    return base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def record(record_id: str | None, kind: str, url: str | None, digest: str, payload: bytes, refers_to: str | None) -> bytes:
    """One record; a revisit keeps the HTTP headers, whose Content-Length is that of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {DATE}"]
    if record_id is not None:
        head.append(f"WARC-Record-ID: <{ID}{record_id}>")
    if url is not None:
        head.append(f"WARC-Target-URI: {UNFIT.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)}")
    if refers_to is not None:
        head.append(f"WARC-Refers-To: <{ID}{refers_to}>")
    if kind == "revisit":
        head.append(f"WARC-Profile: {PROFILE}")
    head += [f"WARC-Payload-Digest: sha1:{base32(digest)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Inflated(io.RawIOBase):
    """The bytes of a file of gzip members, one for each record."""

    def __init__(self, raw):
        self.raw, self.ready, self.member = raw, b"", zlib.decompressobj(31)
        self.rest = b""

    def readable(self):
        return True

    def readinto(self, to) -> int:
        while not self.ready:
            if self.member.eof:
                self.rest, self.member = self.member.unused_data or self.rest, zlib.decompressobj(31)
            data = self.rest or self.raw.read(1 << 16)
            self.rest = b""
            if not data:
                return 0
            self.ready = self.member.decompress(data)
            self.rest = b"" if self.member.eof else self.rest
        n = min(len(to), len(self.ready))
        to[:n] = self.ready[:n]
        self.ready = self.ready[n:]
        return n


@dataclass
class Archives(InputPartition):
    paths: list[str]


class Predicate:
    """A pushed filter that headers alone decide."""

    def __init__(self, column: str, test: str, value):
        self.column, self.test, self.value = column, test, value

    def holds(self, found: str | None) -> bool:
        if found is None:
            return False
        if self.test == "in":
            return found in self.value
        return {"start": str.startswith, "end": str.endswith, "has": str.__contains__}[self.test](found, self.value)

    @staticmethod
    def of(f: Filter) -> Predicate | None:
        column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
        if column not in HEADERS:
            return None
        if isinstance(f, EqualTo):
            return Predicate(column, "in", {f.value})
        if isinstance(f, In):
            return Predicate(column, "in", set(f.value))
        for kind, test in ((StringStartsWith, "start"), (StringEndsWith, "end"), (StringContains, "has")):
            if isinstance(f, kind):
                return Predicate(column, test, f.value)
        return None


def manifests(fs, there: list[pafs.FileInfo]) -> Iterator[list[dict]]:
    """The archives that each finished commit in a folder named."""
    for i in there:
        if i.base_name.startswith(MANIFEST) and i.base_name.endswith(".json"):
            with fs.open_input_stream(i.path) as f:
                yield json.loads(f.read())


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.verify = options.get("verify", "true").lower() == "true"
        self.pack = int(options.get("partitionbytes", 32 << 20))
        self.predicates: list[Predicate] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if p := Predicate.of(f):
                self.predicates.append(p)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, root = pafs.FileSystem.from_uri(self.path)
        if fs.get_file_info(root).type == pafs.FileType.File:
            return [Archives([self.path])]
        there = fs.get_file_info(pafs.FileSelector(root, recursive=False, allow_not_found=True))
        found = []
        for m in manifests(fs, there):
            found += [(x["name"], x["bytes"]) for x in m]
        if not found:
            found = [(i.base_name, i.size) for i in there if i.type == pafs.FileType.File and i.base_name.endswith((".warc", ".warc.gz"))]
        out: list[InputPartition] = []
        size = self.pack
        for name, n in sorted(found):
            if size + n > self.pack:
                out.append(Archives([]))
                size = 0
            out[-1].paths.append(f"{self.path.rstrip('/')}/{name}")
            size += n
        return out or [Archives([])]

    def read(self, partition: Archives) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for path in partition.paths:
            fs, name = pafs.FileSystem.from_uri(path)
            with fs.open_input_file(name) as raw:
                packed = name.endswith(".gz")
                stream = io.BufferedReader(Inflated(raw) if packed else raw, 1 << 18)
                for row in self.records(stream, seek=not packed):
                    rows.append(row)
                    held += len(row[-1] or b"")
                    if held > 8 << 20 or len(rows) >= 5000:
                        yield self.batch(rows)
                        rows, held = [], 0
        yield self.batch(rows)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(ARROW)], schema=ARROW)

    def records(self, stream, seek: bool) -> Iterator[tuple]:
        def lines() -> Iterator[bytes]:
            while (line := stream.readline()).strip():
                yield line

        def skip(n: int) -> None:
            if seek and n:
                # The last byte is read, so that an archive that ends inside a record is noticed.
                stream.seek(n - 1, 1)
                n = 1
            while n > 0 and (got := len(stream.read(min(n, 1 << 16)))):
                n -= got
            if n > 0:
                raise ValueError("an archive ends inside a record")

        while True:
            version = stream.readline()
            while version in (b"\r\n", b"\n"):
                version = stream.readline()
            if not version:
                return
            if not version.startswith(b"WARC/"):
                raise ValueError(f"not a WARC record: {version[:40]!r}")
            head: dict[str, str] = {}
            for line in lines():
                key, _, value = line.decode("utf-8", "replace").partition(":")
                head[key.strip().lower()] = value.strip()
            if not head.get("content-length", "").isdigit():
                raise ValueError(f"record {head.get('warc-record-id')}: no Content-Length")
            length = int(head["content-length"])
            if not all(p.holds(self.value(head, p.column)) for p in self.predicates):
                skip(length)
                continue
            digest = head.get("warc-payload-digest", "").removeprefix("sha1:")
            digest = base64.b32decode(digest).hex() if digest else None
            payload = http_length = None
            if head.get("content-type", "").startswith("application/http"):
                block = b""
                if self.payload:
                    block = stream.read(length)
                    if len(block) < length:
                        raise ValueError("an archive ends inside a record")
                    http, _, body = block.partition(b"\r\n\r\n")
                else:
                    got = []
                    for line in lines():
                        got.append(line)
                    http = b"".join(got)
                    skip(length - len(http) - 2)
                for line in http.split(b"\r\n")[1:]:
                    if line.lower().startswith(b"content-length:"):
                        http_length = int(line.split(b":")[1])
                if self.payload and head.get("warc-type") != "revisit":
                    payload = body
                    if self.verify and digest and hashlib.sha1(body).hexdigest() != digest:
                        raise ValueError(f"record {head.get('warc-record-id')}: its payload has another digest")
            else:
                payload = stream.read(length) if self.payload else skip(length)
                if payload is not None and len(payload) < length:
                    raise ValueError("an archive ends inside a record")
            yield *(self.value(head, c) for c in HEADERS), digest, http_length, payload

    @staticmethod
    def value(head: dict[str, str], column: str) -> str | None:
        found = head.get(HEADERS[column].lower())
        if found is not None and column in ("record_id", "refers_to"):
            found = found.strip("<>").removeprefix(ID)
        return found


@dataclass
class Written(WriterCommitMessage):
    files: list[dict]


class WarcWriter(DataSourceArrowWriter):
    """Rows ``record_id, record_type, target_uri, refers_to, payload_digest, payload``."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.most = int(options.get("archivebytes", 64 << 20))
        self.level = int(options.get("level", 1))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        done: list[dict] = []
        out, name, size = None, "", 0
        for batch in iterator:
            for r in batch.to_pylist():
                if out is None:
                    name, size = f"part-{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                pack = zlib.compressobj(self.level, zlib.DEFLATED, 31)
                data = pack.compress(record(r["record_id"], r["record_type"], r["target_uri"], r["payload_digest"], r["payload"] or b"", r["refers_to"])) + pack.flush()
                out.write(data)
                size += len(data)
                if size >= self.most:
                    out.close()
                    done.append({"name": name, "bytes": size})
                    out = None
        if out is not None:
            out.close()
            done.append({"name": name, "bytes": size})
        return Written(done)

    def commit(self, messages) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        there = fs.get_file_info(pafs.FileSelector(root, recursive=False)) if self.overwrite else []
        old = [x["name"] for m in manifests(fs, there) for x in m]
        # A manifest counts under its final name only, which it gets when it is whole.
        name = f"{root}/{MANIFEST}-{uuid.uuid4().hex}"
        with fs.open_output_stream(f"{name}.tmp", compression=None) as f:
            f.write(json.dumps([x for m in messages if m for x in m.files]).encode())
        fs.move(f"{name}.tmp", f"{name}.json")
        for i in there:
            if i.base_name.startswith(MANIFEST):
                fs.delete_file(i.path)
        for x in old:
            fs.delete_file(f"{root}/{x}")

    def abort(self, messages) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        for x in [x for m in messages if m for x in m.files]:
            fs.delete_file(f"{root}/{x['name']}")


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read(spark: SparkSession, path: str, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("warc").options(**options).load(path)


def archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_from: int = 1000, mode: str = "append") -> None:
    """Write a record for each page. Of equal payloads of ``revisit_from`` bytes or more the one with the largest id is a
    response (each of them, where rows share that id) and the others are revisits of it; smaller ones are all responses.

    The payload's digest is made by the scan; a partial aggregate finds the largest id of each digest, and the join
    back is an outer one that Spark can split where one payload holds many rows. Revisits send no payload to the join's
    result beyond its length: it is the HTTP header of the record that keeps it.
    """
    register(pages.sparkSession)
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = rows.where(F.octet_length("payload") >= revisit_from)
    firsts = large.groupBy("digest").agg(F.max("id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL")
    revisit = F.col("first").isNotNull() & (F.octet_length("payload") >= revisit_from) & ~F.col("id").eqNullSafe(F.col("first"))
    out = rows.join(firsts.drop("n"), "digest", "left").select(
        F.col("id").cast("string").alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.when(revisit, F.col("first").cast("string")).alias("refers_to"),
        F.col("digest").alias("payload_digest"),
        F.col("payload"),
    )
    out.write.format("warc").mode(mode).save(path)
