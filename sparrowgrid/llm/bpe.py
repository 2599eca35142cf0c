"""Byte-level BPE encoding and decoding by dynamic programming over the prefixes of a pre-token.

For every prefix of a pre-token exactly one token can end its encoding. The candidates for a prefix are the vocabulary
entries that are suffixes of it (an automaton over the vocabulary gives them all in one pass). A candidate t after the
prefix that it leaves is right if the last token u stored for that prefix is compatible with t: the merges of u and t
alone, done in order of rank, never join across their border. The right candidate is stored; back-pointers give the ids.

Nulls: a null text is the empty text (no ids). Empty text: no tokens. Long texts are encoded whole. Repeated rows stay;
further columns of the input are left out of the result. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowgrid.llm.shared import batches, lean, small_batches

#: White space by the Unicode property.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The pre-tokens of a byte-level tokenizer, a fixed value of the format.
PATTERN = rf"'(?:s|t|re|ve|m|ll|d)| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Pre-tokens that a worker keeps; beyond it the memo starts anew.
MEMO = 250_000


def byte_letters() -> dict[str, int]:
    """Letter that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves, the others follow from 256."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in kept}
    out.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(kept))})
    return out


class Codec:
    """The tokenizer of a ``tokenizers`` JSON file (model BPE, pre-tokenizer ByteLevel, no normalizer)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or spec["normalizer"] or pre["add_prefix_space"] or not pre.get("use_regex", True):
            raise ValueError(f"{path}: only byte-level BPE without normalizer and prefix space is supported")
        letters = byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        self.bytes = {i: as_bytes(s) for s, i in model["vocab"].items()}
        ids = {b: i for i, b in self.bytes.items()}
        #: Pair of ids to (rank, id); id to its two parts and the rank that made it.
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = (ids[as_bytes(x)] for x in (m if isinstance(m, list) else m.split(" ")))
            whole = ids[self.bytes[a] + self.bytes[b]]
            self.merge[a, b] = (rank, whole)
            self.parts.setdefault(whole, (a, b, rank))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes |= {i: s.encode() for s, i in self.special.items()}
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pattern = regex.compile(PATTERN)
        self.edges: dict[int, tuple[list[tuple[int, float]], list[tuple[int, float]]]] = {}
        self.compatible: dict[tuple[int, int], bool] = {}
        automaton = ahocorasick.Automaton()
        for i, b in self.bytes.items():
            # A token that two merges of its own text would not give is never the end of an encoding.
            if len(b) == 1 or i in self.parts and self.fits(*self.parts[i][:2], self.parts[i][2]):
                automaton.add_word(b.decode("latin-1"), (len(b), i))
        automaton.make_automaton()
        self.suffixes = automaton
        self.memo: dict[str, tuple[int, str, str]] = {}

    def edge(self, token: int) -> tuple[list[tuple[int, float]], list[tuple[int, float]]]:
        """The pieces that stand at a token's left and right end while it is merged, each with the rank that ends it."""
        if token not in self.edges:
            both = []
            for side in (0, 1):
                spine, at, until = [], token, float("inf")
                while True:
                    spine.append((at, until))
                    if at not in self.parts:
                        break
                    until = self.parts[at][2]
                    at = self.parts[at][side]
                both.append(spine)
            self.edges[token] = both[0], both[1]
        return self.edges[token]

    def fits(self, left: int, right: int, below: float = float("inf")) -> bool:
        """Whether no merge of a rank under ``below`` joins the two tokens across their border. Equal ranks go left to right."""
        for a, a_until in self.edge(left)[1]:
            for b, b_until in self.edge(right)[0]:
                found = self.merge.get((a, b))
                if found and found[0] < below and found[0] < a_until and found[0] <= b_until:
                    return False
        return True

    def piece(self, pre_token: str) -> list[int]:
        """Ids of one pre-token."""
        data = pre_token.encode("utf-8")
        n = len(data)
        last, back = [-1] * (n + 1), [0] * (n + 1)
        known = self.compatible
        for end, (size, token) in self.suffixes.iter(data.decode("latin-1")):
            end += 1
            if last[end] >= 0:
                continue
            begin = end - size
            if begin:
                before = last[begin]
                if before < 0:
                    continue
                ok = known.get((before, token))
                if ok is None:
                    if len(known) > 2 * MEMO:
                        known.clear()
                    ok = known[before, token] = self.fits(before, token)
                if not ok:
                    continue
            last[end], back[end] = token, begin
        out, at = [], n
        while at:
            out.append(last[at])
            at = back[at]
        return out[::-1]

    def _remember(self, pre_token: str) -> tuple[int, str, str]:
        ids = self.piece(pre_token)
        back = b"".join(self.bytes[i] for i in ids).decode("utf-8", "replace")
        if len(self.memo) >= MEMO:
            self.memo.clear()
        found = self.memo[pre_token] = (len(ids), ",".join(map(str, ids)), pre_token if back == pre_token else back)
        return found

    def segments(self, text: str, special: bool = True) -> Iterator[tuple[int, str, str]]:
        """(ids, ids in decimal with commas, decoded text) of each pre-token and special token."""
        get, find = self.memo.get, self.pattern.findall
        for k, part in enumerate(self.splitter.split(text) if special and self.splitter else (text,)):
            if k % 2:
                yield 1, str(self.special[part]), part
            else:
                for p in find(part):
                    yield get(p) or self._remember(p)

    def encode(self, text: str, special: bool = True) -> list[int]:
        return [int(x) for _, ids, _ in self.segments(text, special) for x in ids.split(",")]

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.bytes[i] for i in ids).decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec for each worker process."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


OUT = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.string()), ("decoded", pa.string())])
DIGESTS = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Ids and decoded text of every whole text: ``id_col, n_tokens, ids array<int>, decoded``.

    ``digests``: SHA-256 of the ids in decimal, joined by commas, and of the decoded text in place of both; the same
    ids and texts are made, but only their digests leave the worker.
    """
    schema = DIGESTS if digests else OUT
    small_batches(docs.sparkSession)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for batch in frames:
            found: dict[str, list] = {f.name: [] for f in schema}
            for text in batch.column(1):
                parts = list(c.segments(text.as_py() or ""))
                ids, back = ",".join([p[1] for p in parts]), "".join([p[2] for p in parts])
                found["n_tokens"].append(sum([p[0] for p in parts]))
                if digests:
                    found["ids_sha256"].append(hashlib.sha256(ids.encode()).hexdigest())
                    found["decoded_sha256"].append(hashlib.sha256(back.encode()).hexdigest())
                else:
                    found["ids"].append(ids)
                    found["decoded"].append(back)
            found["id"] = batch.column(0)
            yield batches(found, schema)

    kinds = "id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids string, decoded string")
    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(lean(run), kinds)
    if not digests:
        out = out.withColumn("ids", F.when(F.col("ids") == "", F.array().cast("array<int>")).otherwise(F.split("ids", ",").cast("array<int>")))
    return out.withColumnRenamed("id", id_col)
