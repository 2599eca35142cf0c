"""Periodic runs of words: each lag compares the word-id array with its shift; true stretches are run-length coded.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and at least
``max(6, 4 * q)`` words that no neighbouring word extends keeping that period. So lag q, for every q up to n / 4, has to
be true for ``max(6 - q, 3 * q)`` places on end. A stretch whose smallest period is a proper divisor of q has the same
first and last word at both lags (a maximal stretch of that length has one smallest period, which divides all others), so
of equal (start, length) the smallest lag stays.

* Documents that aren't long are compared in blocks: their word hashes lie one after another, parted by values that equal
  nothing, longest first, so that lag q only sees documents of 4 * q words or more.
* A longer document is compared alone. A stretch of 3 * q true places holds three neighbouring multiples of q, so a lag is
  first compared at its multiples (n / q places); around three hits in a row the whole stretch is compared.
* A document of over ``LONG_BYTES`` is cut into ranges of lags, which Spark deals over the cluster; its runs meet again
  by document, a few rows each. Which way a text goes changes no result.

Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text, compared by 64-bit hash, case included. Nulls: a null text has no
words and no runs; a null id is kept. Repeated rows each give a row; other columns are left out whatever their names. An
empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowgrid.llm.shared import SPACES, batches, chunks, lean, small_batches, span_hashes, spans, texts_of, words

#: Words up to which documents are compared in blocks.
SHORT_WORDS = 1024
#: Bytes over which a text's lags are dealt in ranges, and words times lags of a range.
LONG_BYTES, RANGE_WORK = 1 << 16, 1 << 32
OUT = pa.schema(
    [("id", pa.int64()), ("n_words", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64())]
    + [("runs", pa.string()), ("runs_sha256", pa.string()), ("collapsed", pa.string()), ("collapsed_sha256", pa.string())]
)
Run = tuple[int, int, int]


def least(q: int) -> int:
    """True places on end that make a run of period q."""
    return max(6 - q, 3 * q)


def primitive(found: list[Run]) -> list[Run]:
    """``(start, length, period)`` by start and period, of equal stretches the one of the smallest period."""
    best: dict[tuple[int, int], int] = {}
    for s, n, q in found:
        if q < best.get((s, n), q + 1):
            best[s, n] = q
    return sorted(((s, n, q) for (s, n), q in best.items()), key=lambda r: (r[0], r[2]))


def block_runs(hashes: list[np.ndarray]) -> list[list[Run]]:
    """Runs of each of many arrays of word hashes, all lags of all arrays at once."""
    if not hashes:
        return []
    order = sorted(range(len(hashes)), key=lambda i: -len(hashes[i]))
    size = np.array([len(hashes[i]) for i in order])
    at = np.concatenate(([0], np.cumsum(size + 1)))  # one border after each
    _, inverse = np.unique(np.concatenate([hashes[i] for i in order]), return_inverse=True)
    border = np.zeros(at[-1], bool)
    border[at[1:] - 1] = True
    w = np.empty(at[-1], np.int32)
    w[~border] = inverse
    w[border] = -1 - np.arange(len(order))
    found: list[list[Run]] = [[] for _ in hashes]
    for q in range(1, int(size[0]) // 4 + 1):
        # Documents of fewer words than 4 * q (or 6) have no run of this lag.
        n = at[np.searchsorted(-size, -max(6, 4 * q), side="right")]
        hit = np.flatnonzero(w[: max(n - q, 0)] == w[q:n])
        need = least(q)
        if len(hit) < need or not (hit[need - 1 :] - hit[: len(hit) - need + 1] == need - 1).any():
            continue
        new = np.concatenate(([True], np.diff(hit) != 1))
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(hit)))
        for k in np.flatnonzero(count >= need):
            s = int(hit[first[k]])
            doc = int(np.searchsorted(at, s, side="right")) - 1
            found[order[doc]].append((s - int(at[doc]), int(count[k]) + q, q))
    return [primitive(f) for f in found]


def lag_runs(w: np.ndarray, low: int, high: int) -> list[Run]:
    """Runs of lags ``low <= q < high`` of one array; of a stretch that several of these lags hold, only the smallest lag's."""
    n, found, known = len(w), [], []
    for q in range(low, min(high, n // 4 + 1)):
        probes = w[::q]
        same = probes[1:] == probes[:-1]
        three = np.flatnonzero(same[:-2] & same[1:-1] & same[2:])
        if not len(three):
            continue
        # A run of a divisor of q that is long enough for q is the run that q would find there.
        known = [r for r in known if r[1] >= 4 * q]
        divisors = [(s, s + m - q) for s, m, p in known if q % p == 0]
        after = -1
        for k in three.tolist():
            i = k * q
            if i < after:
                continue
            if inside := [b for a, b in divisors if a <= i < b]:
                after = max(inside)
                continue
            # The true stretch around the hit: it is widened in steps until a false place bounds it on either side.
            a, after = _left(w, i, q), _right(w, i, q)
            if after - a >= least(q):
                found.append((a, after - a + q, q))
                known.append(found[-1])
    return found


def _left(w: np.ndarray, i: int, q: int) -> int:
    """First place of the true stretch of lag q that holds place i."""
    step = 2 * q
    while i > 0:
        j = max(0, i - step)
        false = np.flatnonzero(w[j:i] != w[j + q : i + q])
        if len(false):
            return j + int(false[-1]) + 1
        i, step = j, step * 2
    return 0


def _right(w: np.ndarray, i: int, q: int) -> int:
    """The place after the true stretch of lag q that holds place i."""
    n, step = len(w) - q, 4 * q
    while i < n:
        j = min(n, i + step)
        false = np.flatnonzero(w[i:j] != w[i + q : j + q])
        if len(false):
            return i + int(false[0])
        i, step = j, step * 2
    return n


def result(doc_id: int | None, n_words: int, found: list[Run], kept: Iterator[bytes] | list[bytes], texts: bool) -> dict:
    """The row of a document: its runs by start and period, and its words without repeats."""
    best = None
    for s, m, q in found:
        # The greatest length / period, compared as whole numbers; of equal ones the smallest start, then period.
        if best is None or m * best[2] > best[1] * q:
            best = (s, m, q)
    spelt = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    collapsed = b" ".join(kept)
    return {
        "id": doc_id, "n_words": n_words, "n_runs": len(found), "start": best and best[0], "length": best and best[1], "period": best and best[2],
        "exponent_milli": best and 1000 * best[1] // best[2], "runs": spelt if texts else None, "runs_sha256": hashlib.sha256(spelt.encode()).hexdigest(),
        "collapsed": collapsed.decode() if texts else None, "collapsed_sha256": hashlib.sha256(collapsed).hexdigest(),
    }


def collapse(n: int, found: list[Run]) -> np.ndarray:
    """Numbers of the words that no run holds after its first period."""
    drop = np.zeros(n + 1, np.int64)
    for s, m, q in found:
        drop[s + q] += 1
        drop[s + m] -= 1
    return np.flatnonzero(np.cumsum(drop[:n]) == 0)


def _cut(text: bytes) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """A text with plain spaces, and its words' starts, ends and hashes."""
    data = (b" " + text).translate(SPACES)
    buf = np.frombuffer(data, np.uint8)
    start, end = spans(buf, buf == 32)
    return data, start, end, span_hashes(buf, start, end)


def _whole(texts: bool):
    """Batches of (id, text) to results; all lags of a text in this task."""

    def rows(ids: list, some: list[bytes]) -> pa.RecordBatch:
        buf, start, end, h, at = words(some, SPACES)
        data = buf.tobytes()
        n = np.diff(at)
        short = [i for i in range(len(some)) if n[i] <= SHORT_WORDS]
        found = dict(zip(short, block_runs([h[at[i] : at[i + 1]] for i in short]), strict=True))
        out: dict[str, list] = {f.name: [] for f in OUT}
        for i in range(len(some)):
            runs = found[i] if i in found else primitive(lag_runs(h[at[i] : at[i + 1]], 1, int(n[i])))
            k = at[i] + collapse(int(n[i]), runs)
            row = result(ids[i], int(n[i]), runs, [data[a:b] for a, b in zip(start[k].tolist(), end[k].tolist(), strict=True)], texts)
            for f in OUT:
                out[f.name].append(row[f.name])
        return batches(out, OUT)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            ids = b.column(0).to_pylist()
            for at, some in chunks(texts_of(b.column(1))):
                yield rows(ids[at : at + len(some)], some)

    return run


RANGE_ROWS = pa.schema([("key", pa.int64()), ("low", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _ranged(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one range of a text's lags: (key, text, low, high) to (key, start, length, period)."""
    for b in frames:
        for key, text, low, high in zip(b.column(0).to_pylist(), texts_of(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            found = lag_runs(_cut(text)[3], low, high)
            columns = {"key": [key] * len(found), "low": [low] * len(found)} | {c: [r[j] for r in found] for j, c in enumerate(("start", "length", "period"))}
            yield batches(columns, RANGE_ROWS)


def _gathered(texts: bool):
    """Results of long texts from (id, text, starts, lengths, periods)."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            for doc_id, text, runs in zip(b.column(0).to_pylist(), texts_of(b.column(1)), b.column(2).to_pylist(), strict=True):
                data, start, end, h = _cut(text)
                found = primitive([(r["start"], r["length"], r["period"]) for r in runs or []])
                k = collapse(len(h), found)
                row = result(doc_id, len(h), found, [data[x:y] for x, y in zip(start[k].tolist(), end[k].tolist(), strict=True)], texts)
                yield batches({f.name: [row[f.name]] for f in OUT}, OUT)

    return run


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = True, long_bytes: int = LONG_BYTES, range_work: int = RANGE_WORK) -> DataFrame:
    """``id_col, n_words, n_runs``, the run of greatest exponent (``start, length, period, exponent_milli``; null without one),
    ``runs`` (``start,length,period`` lines) and ``collapsed`` (kept words; both null unless ``texts``), and the SHA-256 of these two.

    ``long_bytes`` and ``range_work`` say what is dealt in ranges of lags; they change no result.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    out = "id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs string, runs_sha256 string, collapsed string, collapsed_sha256 string"
    whole = rows.where(size <= long_bytes).mapInArrow(lean(_whole(texts)), out)
    # A long text of b bytes has at most b / 2 + 1 words. Rows are told apart by id and content; equal rows have equal runs.
    long = rows.where(size > long_bytes).withColumn("key", F.xxhash64("id", "text"))
    lags = F.floor((F.octet_length("text") / 2 + 1) / 4).cast("long") + 1
    step = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(float(range_work)) / (F.octet_length("text") / 2 + 1)).cast("long"))
    ranges = long.dropDuplicates(["key"]).select("key", "text", F.explode(F.sequence(F.lit(1).cast("long"), lags, step)).alias("low"), step.alias("step"))
    ranges = ranges.select("key", "text", "low", (F.col("low") + F.col("step")).alias("high")).repartition("key", "low")
    found = ranges.mapInArrow(lean(_ranged), "key long, low long, start long, length long, period long")
    least_lag = found.groupBy("key", "start", "length").agg(F.min("period").alias("period"))
    runs = least_lag.groupBy("key").agg(F.collect_list(F.struct("start", "length", "period")).alias("found"))
    gathered = long.join(runs, "key", "left").select("id", "text", "found").mapInArrow(lean(_gathered(texts)), out)
    return whole.unionByName(gathered).withColumnRenamed("id", id_col)
