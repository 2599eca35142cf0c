"""Shape of a text as numbers, made from bytes and words of whole texts in numpy."""

from __future__ import annotations

import numpy as np

from sparrowgrid.llm.shared import SPACES, chunks, spans, words

NAMES = (
    "log_words", "word_bytes", "upper", "exclaim", "symbols", "pipes", "digits", "other_punctuation", "high_bytes", "repeats",
    "distinct", "top_word", "line_repeats", "short_lines", "marked_words", "upper_words",
)


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _sums(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags)))
    return (total[edges[1:]] - total[edges[:-1]]).astype(float)


def _class(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    for a, b in ranges:
        out[a : b + 1] = 1
    return out


UPPER, LETTER, DIGIT = _class((65, 90)), _class((65, 90), (97, 122), (128, 255)), _class((48, 57))
SYMBOL = _class((35, 38), (42, 43), (60, 62), (64, 64), (92, 92), (94, 96), (123, 123), (125, 126))
PUNCTUATION = _class((34, 34), (39, 41), (44, 47), (58, 59), (63, 63), (91, 91), (93, 93), (95, 95))
HIGH = _class((128, 255))


def features(texts: list[bytes]) -> np.ndarray:
    """One row for each text, one column for each of NAMES; an empty text has zeros."""
    return np.concatenate([_features(some) for _, some in chunks(texts)]) if texts else np.empty((0, len(NAMES)))


def _features(texts: list[bytes]) -> np.ndarray:
    texts = [*texts, b""]  # so that every text is followed by a space, wherever it lies
    buf, start, end, h, at = words(texts, SPACES)
    n = np.diff(at)
    size = np.array([len(t) for t in texts])
    edges = np.concatenate(([1], 1 + np.cumsum(size + 1)))
    edges[-1] = len(buf)
    doc = np.repeat(np.arange(len(texts)), n)
    by = lambda lut: _sums(lut[buf], edges)
    letters, used = by(LETTER), size - by(_class((32, 32))) + 1  # the space after it isn't the text's
    same = np.zeros(len(h), bool)
    if len(h):
        same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    # Distinct words and the most frequent one of each text.
    order = np.lexsort((h, doc))
    hs, ds = h[order], doc[order]
    new = np.ones(len(hs), bool)
    if len(hs):
        new[1:] = (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(hs)))
    distinct = np.bincount(ds[first], minlength=len(texts)).astype(float)
    top = np.zeros(len(texts))
    np.maximum.at(top, ds[first], counts)
    # Lines, from the texts with their line breaks.
    lines = np.zeros((len(texts), 2))
    for i, t in enumerate(texts):
        parts = t.split(b"\n")
        if len(parts) > 1:
            real = [p for p in parts if p]
            lines[i] = 1 - len(set(real)) / max(len(real), 1), sum(len(p) < 25 for p in real) / max(len(real), 1)
    last, head = (buf[end - 1], buf[start]) if len(h) else (np.empty(0, np.uint8),) * 2
    second = buf[np.minimum(start + 1, np.maximum(end - 1, 0))] if len(h) else head
    marked = SYMBOL[last] | (last == 33)
    loud = UPPER[head] & UPPER[second] & (end - start > 1)
    word_sum = lambda f: np.bincount(doc, weights=f, minlength=len(texts))
    return np.stack(
        [
            np.log1p(n), np.minimum(_share(size, n), 30), _share(by(UPPER), letters), _share(by(_class((33, 33))), used), _share(by(SYMBOL), used),
            _share(by(_class((124, 124))), used), _share(by(DIGIT), used), _share(by(PUNCTUATION), used), _share(by(HIGH), used), _share(word_sum(same), n),
            _share(distinct, n), _share(top, n), lines[:, 0], lines[:, 1], _share(word_sum(marked), n), _share(word_sum(loud), n),
        ],
        1,
    )[:-1]


def sample_ids(labels, label_col: str, held_out, most: int):
    """A bounded sample of labelled ids outside the held-out fold, by a hash of the id: ``doc_id, label``."""
    from pyspark.sql import functions as F

    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull() & ~held_out)
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 60, weights: np.ndarray | None = None) -> np.ndarray:
    """Weights that minimise the mean logistic loss with a ridge, by damped Newton steps."""
    w = np.zeros(x.shape[1])
    s = np.ones(len(y)) if weights is None else weights
    s = s / s.sum()

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(s @ (np.logaddexp(0, z) - y * z) + l2 / 2 * w @ w)

    at = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        g = x.T @ (s * (p - y)) + l2 * w
        step = np.linalg.solve((x * (s * p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w)), g)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > at:
            size /= 2
        w = w - size * step
        now = loss(w)
        if at - now < 1e-10:
            break
        at = now
    return w


def pair_logistic(x: np.ndarray, a: np.ndarray, b: np.ndarray, l2: float = 1e-3, steps: int = 60, block: int = 1 << 14) -> np.ndarray:
    """Weights under which rows ``a`` come before rows ``b``: ``logistic`` of the differences x[a] - x[b], which are made by ``block`` and never kept."""
    w = np.zeros(x.shape[1])

    def margins(w: np.ndarray) -> np.ndarray:
        z = x @ w
        return z[a] - z[b]

    def loss(w: np.ndarray) -> float:
        return float(np.logaddexp(0, -margins(w)).mean() + l2 / 2 * w @ w)

    at = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(margins(w), -40, 40)))
        pull = (p - 1) / len(a)
        g = x.T @ (np.bincount(a, pull, len(x)) - np.bincount(b, pull, len(x))) + l2 * w
        bend = l2 * np.eye(len(w))
        for k in range(0, len(a), block):
            d = x[a[k : k + block]] - x[b[k : k + block]]
            q = p[k : k + block]
            bend += (d * (q * (1 - q) / len(a))[:, None]).T @ d
        step = np.linalg.solve(bend, g)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > at:
            size /= 2
        w = w - size * step
        now = loss(w)
        if at - now < 1e-10:
            break
        at = now
    return w
