"""Operator 10: quality rules - gradient-boosted trees over document statistics.

Every document's statistics come from one vectorised pass over its whole text.
The trees are fitted on the driver from a bounded sample of labelled documents
(``SAMPLE_ROWS`` of lowest hash, a documented parameter), with histogram splits
and monotonic constraints on chosen statistics, and are flattened into numpy
node arrays that score a batch of documents level by level. A document that
breaks a base rule is rejected; otherwise the trees decide.

Defined results: a null text has no words, so it fails the base rules; repeated
rows each get a row; labels that are null, or whose document is absent, are
left out, and of several labels of one document the lowest counts; without
labels of both kinds only the base rules decide; an empty table gives an empty
result; further columns are ignored (``keep_good`` passes them through).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_SPACE, Block, blocks, mix

SAMPLE_ROWS = 20_000
THRESHOLD = 0.5

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("mean_word", "symbol_rate", "dup_line_rate", "repeat_rate", "distinct_rate", "upper_rate", "digit_rate",
            "mark_rate", "words_per_line", "log_words")
#: +1: the score may only rise with the statistic, -1: only fall, 0: free.
MONOTONE = {"symbol_rate": -1, "dup_line_rate": -1, "repeat_rate": -1, "mark_rate": -1}


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_SYMBOL, _MARK = _table(b"#*$%&|<>"), _table(b"!?")
_UPPER, _DIGIT, _NEWLINE = _table(bytes(range(65, 91))), _table(bytes(range(48, 58))), _table(b"\n")


def _per_doc_bytes(b: Block, mask: np.ndarray) -> np.ndarray:
    c = np.concatenate(([0], np.cumsum(mask)))
    return c[b.offs[1:]] - c[b.offs[:-1]]


def _repeats(docs: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For (document, fingerprint) items: how often the item occurs in its document,
    and a mask of one item for each distinct value."""
    order = np.lexsort((h, docs))
    d, g = docs[order], h[order]
    new = np.concatenate(([True], (d[1:] != d[:-1]) | (g[1:] != g[:-1]))) if len(d) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    times = np.empty(len(d), np.int64)
    times[order] = np.bincount(group)[group] if len(d) else 0
    first = np.zeros(len(d), bool)
    first[order[new]] = True
    return times, first


def statistics(b: Block) -> dict[str, np.ndarray]:
    """Counts and rates of each document of a block."""
    s, e, d = b.words()
    c = b.prefix()
    h = b.ranges(c, s, e)
    n_words = b.per_doc(d)
    chars = np.concatenate(([0], np.cumsum((b.data & 0xC0) != 0x80)))
    word_chars = b.per_doc(d, chars[e] - chars[s])
    # words of 3-word windows that occur twice or more in the text
    marked = np.zeros(len(s), bool)
    if len(s) >= 3:
        i = np.flatnonzero(d[2:] == d[:-2])
        tri = mix(mix(h[i] * np.uint64(3) + h[i + 1]) * np.uint64(5) + h[i + 2])
        i = i[_repeats(d[i], tri)[0] >= 2]
        for k in range(3):
            marked[i + k] = True
    n_repeat = b.per_doc(d[marked])
    _, first_word = _repeats(d, h)
    # lines that have a word
    start = np.zeros(len(b.data) + 1, bool)
    start[b.offs[:-1][np.diff(b.offs) > 0]] = True
    start[1:] |= _NEWLINE[b.data]
    ls = np.flatnonzero(start[:-1])
    le = np.append(ls[1:], len(b.data))
    ended = (le > ls) & _NEWLINE[b.data[np.maximum(le - 1, 0)]] if len(ls) else np.zeros(0, bool)
    le = le - ended
    solid = np.concatenate(([0], np.cumsum(~IS_SPACE[b.data])))
    full = solid[le] > solid[ls]
    ls, le = ls[full], le[full]
    ld = b.doc_of(ls)
    _, first_line = _repeats(ld, b.ranges(c, ls, le))
    n_lines = b.per_doc(ld)
    n_dup = b.per_doc(ld[~first_line])
    solid_bytes = np.maximum(1, _per_doc_bytes(b, ~IS_SPACE[b.data]))
    words1, lines1 = np.maximum(1, n_words), np.maximum(1, n_lines)
    n_symbols = _per_doc_bytes(b, _SYMBOL[b.data])
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup,
        "n_repeat_words": n_repeat,
        "mean_word": word_chars / words1, "symbol_rate": n_symbols / solid_bytes, "dup_line_rate": n_dup / lines1,
        "repeat_rate": n_repeat / words1, "distinct_rate": b.per_doc(d[first_word]) / words1,
        "upper_rate": _per_doc_bytes(b, _UPPER[b.data]) / solid_bytes,
        "digit_rate": _per_doc_bytes(b, _DIGIT[b.data]) / solid_bytes,
        "mark_rate": _per_doc_bytes(b, _MARK[b.data]) / solid_bytes,
        "words_per_line": n_words / lines1, "log_words": np.log1p(n_words),
    }


def column_statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    parts = [statistics(b) for b in blocks(texts)]
    names = (*BASE, *FEATURES)
    if not parts:
        return {k: np.zeros(0, np.int64 if k in BASE else float) for k in names}
    return {k: np.concatenate([p[k] for p in parts]) for k in names}


def base_failed(st: dict[str, np.ndarray]) -> np.ndarray:
    return (st["n_words"] < 50) | (100 * st["n_repeat_words"] > 50 * st["n_words"])


@dataclass
class Trees:
    """Boosted trees of one depth as node arrays [tree, node]; node i has children
    2i+1 and 2i+2. ``feature`` is -1 where a node passes every row to the left."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    depth: int
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = self.feature[t, node]
                right = (f >= 0) & (x[rows, f] > self.threshold[t, node])
                node = 2 * node + 1 + right
            out += self.value[t, node]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit_trees(x: np.ndarray, y: np.ndarray, monotone: tuple[int, ...], n_trees: int = 40, depth: int = 3,
              rate: float = 0.2, bins: int = 64, l2: float = 1.0, min_rows: int = 20) -> Trees:
    """Second-order boosting of the logistic loss on histogram bins. A split on a
    constrained feature must order its children's values, and the midpoint bounds
    all nodes below, so that the whole score is monotonic in that feature."""
    n, k = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
    code = np.stack([np.searchsorted(cuts[j], x[:, j], "left") for j in range(k)], 1)
    nodes = 2 ** (depth + 1) - 1
    feature = np.full((n_trees, nodes), -1, np.int64)
    threshold = np.zeros((n_trees, nodes))
    value = np.zeros((n_trees, nodes))
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(share / (1 - share)))
    score = np.full(n, bias)
    for t in range(n_trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        at = np.zeros(n, np.int64)
        bound = {0: (-np.inf, np.inf)}
        for node in range(nodes):
            rows = np.flatnonzero(at == node)
            lo, hi = bound.get(node, (-np.inf, np.inf))
            gs, hs = g[rows].sum(), h[rows].sum()
            value[t, node] = np.clip(-gs / (hs + l2), lo, hi)
            if node >= nodes // 2 or len(rows) < 2 * min_rows:
                if node < nodes // 2:  # every row goes left and keeps this value
                    at[rows] = 2 * node + 1
                    bound[2 * node + 1] = (value[t, node], value[t, node])
                    bound[2 * node + 2] = (value[t, node], value[t, node])
                continue
            best = (1e-6, -1, 0, 0.0, 0.0)
            for j in range(k):
                m = len(cuts[j]) + 1
                if m < 2:
                    continue
                gl = np.cumsum(np.bincount(code[rows, j], g[rows], m))[:-1]
                hl = np.cumsum(np.bincount(code[rows, j], h[rows], m))[:-1]
                nl = np.cumsum(np.bincount(code[rows, j], minlength=m))[:-1]
                vl = np.clip(-gl / (hl + l2), lo, hi)
                vr = np.clip(-(gs - gl) / (hs - hl + l2), lo, hi)

                def gain_of(v, gg, hh):
                    return -(gg * v + 0.5 * (hh + l2) * v * v)

                gain = gain_of(vl, gl, hl) + gain_of(vr, gs - gl, hs - hl) - gain_of(value[t, node], gs, hs)
                ok = (nl >= min_rows) & (len(rows) - nl >= min_rows) & (monotone[j] * (vr - vl) >= 0)
                gain = np.where(ok, gain, -np.inf)
                i = int(np.argmax(gain))
                if gain[i] > best[0]:
                    best = (gain[i], j, i, vl[i], vr[i])
            _, j, i, vl_, vr_ = best
            left, right = 2 * node + 1, 2 * node + 2
            if j < 0:
                at[rows] = left
                bound[left] = bound[right] = (value[t, node], value[t, node])
                continue
            feature[t, node], threshold[t, node] = j, cuts[j][i]
            at[rows] = np.where(code[rows, j] <= i, left, right)
            mid = (vl_ + vr_) / 2
            bound[left] = (lo, hi) if not monotone[j] else (lo, mid) if monotone[j] > 0 else (mid, hi)
            bound[right] = (lo, hi) if not monotone[j] else (mid, hi) if monotone[j] > 0 else (lo, mid)
        value[t] *= rate
        score += value[t, at]
    return Trees(feature, threshold, value, depth, bias)


def _matrix(st: dict[str, np.ndarray]) -> np.ndarray:
    return np.stack([st[f].astype(float) for f in FEATURES], 1)




def labelled_sample(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, key: str = "doc_id",
                    text: str = "text", label: str = "quality") -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most ``sample_rows`` labelled documents. The ids are
    bounded by that parameter, which is what makes the broadcast safe."""
    picked = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()) \
        .groupBy(F.col(key).alias("_id")).agg(F.min(F.col(label).cast("double")).alias("_y")) \
        .orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
    rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(picked), "_id") \
        .select("_y", "_text")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            st = column_statistics(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(st[f], pa.float64()) for f in FEATURES]],
                                             names=["y", *FEATURES])

    found = rows.mapInArrow(measure, "y double, " + ", ".join(f"{f} double" for f in FEATURES)).limit(2 * sample_rows)
    data = np.array([tuple(r) for r in found.collect()], float).reshape(-1, 1 + len(FEATURES))
    data = data[np.lexsort(data.T)]  # the same fit whatever the order of tasks
    return data[:, 1:], data[:, 0]


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, key: str = "doc_id",
          text: str = "text", label: str = "quality") -> Trees | None:
    x, y = labelled_sample(docs, labels, sample_rows, key, text, label)
    y = (y > 0).astype(float)
    if len(y) == 0 or y.min() == y.max():
        return None
    return fit_trees(x, y, tuple(MONOTONE.get(f, 0) for f in FEATURES))


def _verdict(st: dict[str, np.ndarray], trees: Trees | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    failed = base_failed(st)
    p = trees.probability(_matrix(st)) if trees is not None and len(failed) else np.ones(len(failed))
    return p, ~failed & (p >= threshold)


def score(docs: DataFrame, trees: Trees | None, threshold: float = THRESHOLD, key: str = "doc_id",
          text: str = "text") -> DataFrame:
    """Base counts, probability and verdict of every document."""
    rows = docs.select(key, text)
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            st = column_statistics(b.column(1))
            p, kept = _verdict(st, trees, threshold)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(st[c], pa.int64()) for c in BASE], pa.array(base_failed(st)),
                 pa.array(kept), pa.array(p, pa.float64())],
                names=[key, *BASE, "base_failed", "kept", "probability"])

    return rows.mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"{c} long" for c in BASE)
                           + ", base_failed boolean, kept boolean, probability double")


def keep_good(docs: DataFrame, trees: Trees | None, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows that are kept, with all their columns. Only the texts go to Python, and only
    a verdict comes back."""
    @F.arrow_udf("boolean")
    def good(texts: pa.Array) -> pa.Array:
        return pa.array(_verdict(column_statistics(texts), trees, threshold)[1])

    return docs.where(good(text))
