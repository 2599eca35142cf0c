"""Chat formatting by assembling token ids.

Every turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. Role, text and breaks are encoded alone as ordinary text; the two
marks are reserved ids that no text can produce, spliced in between. Segment lengths and their prefix sums give the
loss mask (the text of assistant turns, nothing else) and each turn's place in its conversation. Control strings in a
role or text are escaped reversibly: ``<|`` becomes ``<\\|`` (and ``<\\|`` becomes ``<\\\\|``, and so on).

A conversation is assembled in runs of ``RUN`` turn numbers, so a long one is dealt over tasks; prefix sums over its
runs give offsets. Nulls: null text or role is empty; null turns come first; rows without a conversation form one.
Turns of equal number are ordered by role, then text; repeated rows all stay. Further columns are left out. An empty
table gives an empty table; empty texts give turns without loss tokens.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparrowgrid.llm.bpe import codec
from sparrowgrid.llm.shared import batches

START, END = "<|im_start|>", "<|im_end|>"
RUN = 256
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: f"<\\{m[1]}|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: f"<{m[1]}|", text)


def escape_role(role: str) -> str:
    """A role is one line: its line breaks are escaped too."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


def assemble(turns: list[tuple[str, str]], vocabulary: str) -> tuple[list[int], np.ndarray, int]:
    """Ids, loss mask and characters of (role, text) turns."""
    c = codec(vocabulary)
    start, end = reserved(vocabulary)
    ids: list[int] = []
    lengths: list[int] = []
    chars = 0
    for role, text in turns:
        role, body = escape_role(role), escape(text)
        for segment in ([start], c.encode(role + "\n", special=False), c.encode(body, special=False), [end], c.encode("\n", special=False)):
            ids += segment
            lengths.append(len(segment))
        chars += len(START) + len(role) + 1 + len(body) + len(END) + 1
    ends = np.cumsum(lengths, dtype=np.int64)
    step = np.zeros(len(ids) + 1, np.int64)
    for k, (role, _) in enumerate(turns):
        if role == "assistant":
            np.add.at(step, ends[[5 * k + 1, 5 * k + 2]], [1, -1])
    return ids, np.cumsum(step)[:-1], chars


def reserved(vocabulary: str) -> tuple[int, int]:
    """The two ids after the last of the vocabulary."""
    c = codec(vocabulary)
    n = max(c.bytes) + 1
    return n, n + 1


def parse(ids: list[int], vocabulary: str) -> list[tuple[str, str]]:
    """The turns of assembled ids; reserved ids alone part them."""
    c = codec(vocabulary)
    start, end = reserved(vocabulary)
    out = []
    for at in [i for i, x in enumerate(ids) if x == start]:
        role, _, text = c.decode(ids[at + 1 : ids.index(end, at)]).partition("\n")
        out.append((unescape_role(role), unescape(text)))
    return out


def lossy(ids: list[int], mask: np.ndarray, vocabulary: str) -> list[str]:
    """The unescaped texts under the mask, one for each run of it."""
    c = codec(vocabulary)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask, [0]))))
    return [unescape(c.decode(ids[a:b])) for a, b in zip(edge[::2], edge[1::2], strict=True)]


RUNS = pa.schema(
    [("conv_id", pa.int64()), ("run", pa.int64()), ("n_turns", pa.int64()), ("ids", pa.list_(pa.int32())), ("loss_mask", pa.list_(pa.int8()))]
    + [("n_tokens", pa.int64()), ("n_chars", pa.int64())]
)


def _grouped(frames: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Sorted rows by their first ``keys`` columns, across batches."""
    at, rows = None, []
    for batch in frames:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if row[:keys] != at:
                if rows:
                    yield at, rows
                at, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield at, rows


def format_runs(conversations: DataFrame, vocabulary: str) -> DataFrame:
    """``conv_id, run, n_turns, ids, loss_mask, n_tokens, n_chars, token_start``: the output, one row for each run of turns.

    ``token_start`` is the place of a run's first token in its conversation.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.floor(F.col("turn").cast("long") / RUN).cast("long").alias("run"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    dealt = rows.repartition("conv_id", "run").sortWithinPartitions("conv_id", "run", "turn", "role", "text")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list] = {f.name: [] for f in RUNS}
        for (conv, part), turns in _grouped(frames, 2):
            ids, mask, chars = assemble([(r, t) for _, r, t in turns], vocabulary)
            for k, v in zip(found, (conv, part, len(turns), ids, mask.astype(np.int8), len(ids), chars), strict=True):
                found[k].append(v)
            if sum(found["n_tokens"][-50:]) > 100_000 or len(found["n_tokens"]) >= 2000:
                yield batches(found, RUNS)
                found = {f.name: [] for f in RUNS}
        yield batches(found, RUNS)

    out = dealt.mapInArrow(run, "conv_id long, run long, n_turns long, ids array<int>, loss_mask array<byte>, n_tokens long, n_chars long")
    w = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumn("token_start", F.coalesce(F.sum("n_tokens").over(w), F.lit(0)))


DIGEST = pa.schema(
    [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64())]
    + [("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
)


def digests(runs: DataFrame, vocabulary: str) -> DataFrame:
    """What the output reads back as, by conversation. A digest takes its bytes in order, so the runs of a conversation stream through one task, one run in memory at a time."""
    part = runs.select("conv_id", "run", "ids", "loss_mask", "n_chars").repartition("conv_id").sortWithinPartitions("conv_id", "run")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def small(frames):
            for b in frames:
                for at in range(0, b.num_rows, 64):
                    yield b.slice(at, 64)

        at, state, found = None, None, []
        for b in small(frames):
            for conv, _, ids, mask, chars in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if state is None or conv != at:
                    if state:
                        found.append((at, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
                    at, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                turns = parse(ids, vocabulary)
                state[0] += len(turns)
                for role, text in turns:
                    state[1].update(f"{role}\n{text}\n".encode())
                for text in lossy(ids, np.array(mask, np.int64), vocabulary):
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[4] += chars
        if state:
            found.append((at, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
        yield batches({f.name: [r[i] for r in found] for i, f in enumerate(DIGEST)}, DIGEST)

    return part.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
