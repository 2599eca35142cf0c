"""What the operators of this package share: shared-folder tables, whole-text scans, word and shingle hashes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sparrowgrid.session import sound

#: ASCII upper case to lower case and the white space 0x09-0x0D to a space; nothing else changes.
LOWER = bytes(0x20 if 9 <= i <= 13 else i + 32 if 65 <= i <= 90 else i for i in range(256))
#: The white space alone.
SPACES = bytes(0x20 if 9 <= i <= 13 else i for i in range(256))
#: Bytes of text that are hashed at once; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20
#: Bytes of a batch that a Python worker gets; a longer text is a batch of its own.
BATCH_BYTES = 4 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sound(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Where a local session names none (tests), a folder of our own is set once; a cluster must name it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("sparrowgrid.shared.dir", None)
        if not found:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            found = f"file://{tempfile.mkdtemp(prefix='sparrowgrid-')}"
            spark.conf.set("sparrowgrid.shared.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: it cuts lineage and any executor can read it again."""
    spark = sound(df.sparkSession)
    path = f"{shared_dir(spark)}/sparrowgrid/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    # Shuffle files of finished steps stay until the driver collects the plans that made them.
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.parquet(path)


def discard(*frames: DataFrame) -> None:
    """Deletes tables that ``written`` made and that nothing reads any more."""
    for df in frames:
        for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/sparrowgrid/" in f:
                path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(f)
                path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Batches of texts for Python by bytes rather than rows, so that long texts don't meet in one batch by the thousand."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def release() -> None:
    """Gives freed memory back: a worker lives on after its task, beside an executor that needs the room."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def lean(run):
    """A function of batches that releases memory after each of its 64 MB and at its end."""

    def wrapped(frames):
        moved = 0

        def counted():
            nonlocal moved
            for b in frames:
                moved += b.nbytes
                yield b

        for out in run(counted()):
            yield out
            if moved > 64 << 20:
                moved = 0
                release()
        release()

    return wrapped


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is the empty text."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def chunks(texts: list[bytes], most: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of whole texts of about ``most`` bytes, with the index of the first."""
    at, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t) + 1
        if n >= most:
            yield at, texts[at : i + 1]
            at, n = i + 1, 0
    if at < len(texts):
        yield at, texts[at:]


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if not _POWERS or len(_POWERS["up"]) < n:
        m = max(n, CHUNK_BYTES + (1 << 18))
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        for key, b in (("up", BASE), ("down", inverse)):
            p = np.full(m, b, np.uint64)
            p[0] = 1
            _POWERS[key] = np.cumprod(p)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def spans(buf: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that aren't gaps; the first byte must be a gap."""
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if len(edge) % 2:
        edge = np.append(edge, len(buf))
    return edge[::2], edge[1::2]


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes: differences of prefix sums of a polynomial, mixed with the length."""
    up, down = _powers(len(buf) + 1)
    total = np.empty(len(buf) + 1, np.uint64)
    total[0] = 0
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def words(texts: list[bytes], table: bytes = LOWER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of a chunk: buffer, starts, ends, hashes, and offsets of each text's words (one more than texts)."""
    joined = b" " + b" ".join(texts)
    joined = joined.translate(table)
    buf = np.frombuffer(joined, np.uint8)
    start, end = spans(buf, buf == 32)
    edges = np.concatenate(([1], 1 + np.cumsum([len(t) + 1 for t in texts]))) if texts else np.array([1])
    return buf, start, end, span_hashes(buf, start, end), np.searchsorted(start, edges)


def shingles(h: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words inside each text and offsets by text; a text with fewer words is one run."""
    n = np.diff(offsets)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(n.dtype))
    out = np.concatenate(([0], np.cumsum(count)))
    if not out[-1]:
        return np.empty(0, np.uint64), out
    first = np.repeat(offsets[:-1] - out[:-1], count) + np.arange(out[-1])
    have = np.repeat(np.minimum(n, width), count).astype(np.uint64)
    total = mix(have + np.uint64(0x5851F42D4C957F2D))
    padded = np.concatenate((h, np.zeros(width, np.uint64)))
    for j in range(width):
        k = np.uint64((0xD6E8FEB86659FD93 * (2 * j + 1)) & (2**64 - 1))
        total += np.where(have > j, (padded[first + j] ^ (padded[first + j] >> np.uint64(32))) * k, np.uint64(0))
        total = total * np.uint64(0xFF51AFD7ED558CCD) ^ (total >> np.uint64(29))
    return mix(total), out


def signed(x: np.ndarray) -> np.ndarray:
    """uint64 hashes as the long column of the same bits."""
    return x.view(np.int64)


def batches(columns: dict[str, Iterable], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def packed(x: np.ndarray) -> bytes:
    """Bytes of an array by significance: high bytes of small numbers come together and compress away."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def unpacked(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8).reshape(size, -1).T.copy().view(kind).reshape(-1)


def gaps(x: np.ndarray) -> np.ndarray:
    """Differences of a sorted array; the first is the value itself."""
    return np.diff(x, prepend=np.uint64(0))


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of equal values of a sorted array, and the run of each element."""
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1
