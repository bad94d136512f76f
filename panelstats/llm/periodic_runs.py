"""Periodic runs of words (operator 12): descending-LCP Kruskal.

A run is a stretch of consecutive words with smallest period ``q`` and a length of at
least ``max(least, exponent * q)`` that no neighbouring word extends. Two occurrences at
distance ``q`` whose suffixes agree on ``l`` words make a stretch of ``q + l`` words with
that period, so runs are found where suffix classes meet:

1. words become exact numbers (``dictionary_encode``); a position whose window of
   ``seed`` words occurs once in its text takes part in no run and is left out;
2. the other positions are put into suffix order by prefix doubling, many texts at once,
   texts kept apart; the common prefix of neighbours (LCP) comes from the same ranks;
3. neighbours are united by decreasing LCP with union-find; every class holds its
   positions in order, and the smaller class is added to the larger. Positions that
   become adjacent at a distance within the LCP seed a run. Within one class nothing
   lies between the first two starts of a run, so each run is seeded by its own start,
   and by its smallest period only.

Null and empty texts have no words and no runs; repeated rows and ids stay rows of
their own; other columns are ignored. A text is never cut: its memory is a few hundred
bytes for every word that repeats with its window (``tests/llm`` measures it).
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, Block, blocks, mix

CHUNK = 1024  # positions in one piece of an ordered set


class OrderedPositions:
    """A sorted set of numbers in pieces of bounded length."""

    __slots__ = ("pieces", "tops", "size")

    def __init__(self, first: int):
        self.pieces, self.tops, self.size = [[first]], [first], 1

    def __iter__(self) -> Iterator[int]:
        for piece in self.pieces:
            yield from piece

    def around(self, p: int) -> tuple[int, int]:
        """The members next to ``p`` on its left and right, -1 where there is none."""
        k = bisect_left(self.tops, p)
        if k == len(self.tops):
            return self.tops[-1], -1
        piece = self.pieces[k]
        i = bisect_left(piece, p)
        left = piece[i - 1] if i else (self.tops[k - 1] if k else -1)
        return left, piece[i]

    def add(self, p: int) -> None:
        k = min(bisect_left(self.tops, p), len(self.tops) - 1)
        piece = self.pieces[k]
        piece.insert(bisect_left(piece, p), p)
        self.tops[k] = piece[-1]
        self.size += 1
        if len(piece) > 2 * CHUNK:
            self.pieces[k:k + 1] = [piece[:CHUNK], piece[CHUNK:]]
            self.tops[k:k + 1] = [piece[CHUNK - 1], piece[-1]]


def suffix_order(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of ``ids`` and the LCP of its neighbours. The last number must be
    unlike all others, as must any number that ends a text."""
    m = len(ids)
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int32)
    levels, k = [rank], 1
    order = np.argsort(rank, kind="stable")
    while rank[order[-1]] < m - 1:
        key = rank.astype(np.int64) * (m + 1)
        key[:m - k] += rank[k:] + 1
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank = np.empty(m, np.int32)
        rank[order] = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
        levels.append(rank)
        k *= 2
    i, j = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(max(m - 1, 0), np.int64)
    for power in range(len(levels) - 1, -1, -1):
        same = levels[power][i] == levels[power][j]
        step = same.astype(np.int64) << power
        lcp, i, j = lcp + step, i + step, j + step
    return order, lcp


def kruskal_runs(at: np.ndarray, order: np.ndarray, lcp: np.ndarray, least: int, exponent: int, seed: int) -> np.ndarray:
    """Runs as rows (start, length, period). ``at`` gives each number of the sorted
    string its word position."""
    edges = np.flatnonzero(lcp >= seed)
    edges = edges[np.argsort(-lcp[edges], kind="stable")]
    members = np.unique(np.concatenate((edges, edges + 1)))
    where = {r: at[order[r]].item() for r in members.tolist()}
    parent = {r: r for r in where}
    sets: dict[int, OrderedPositions] = {}
    found: dict[tuple[int, int], int] = {}

    def find(r: int) -> int:
        while parent[r] != r:
            parent[r] = r = parent[parent[r]]
        return r

    def seeds(left: int, right: int, common: int) -> None:
        period = right - left
        if (exponent - 1) * period <= common and period + common >= least:
            key = (right + common, period)
            found[key] = min(left, found.get(key, left))

    for r, common in zip(edges.tolist(), lcp[edges].tolist(), strict=True):
        a, b = find(r), find(r + 1)
        one, two = (sets.pop(x, None) or OrderedPositions(where[x]) for x in (a, b))
        if one.size < two.size:
            a, b, one, two = b, a, two, one
        parent[b] = a
        sets[a] = one
        small = list(two)
        last = -1
        for n, p in enumerate(small):
            left, right = one.around(p)
            if left > last:  # no other newcomer in between
                seeds(left, p, common)
            if right >= 0 and (n + 1 == len(small) or small[n + 1] > right):
                seeds(p, right, common)
            last = p
        for p in small:
            one.add(p)
    runs = np.array([(start, end - start, period) for (end, period), start in found.items()], np.int64).reshape(-1, 3)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def word_numbers(b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, document numbers and exact numbers of a block's words."""
    s, e, d = b.words()
    inside = np.zeros(len(b.data) + 1, np.int8)
    inside[s] += 1
    inside[e] -= 1
    letters = b.data[np.cumsum(inside[:-1]) > 0]
    offsets = np.concatenate(([0], np.cumsum(e - s)))
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(s), [
        None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(letters))])
    return s, e, d, words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def least_seed(least: int, exponent: int) -> int:
    """Words that any two starts of a run, one period apart, have in common."""
    return min(max((exponent - 1) * q, least - q) for q in range(1, max(least, 1) + 1))


def block_runs(ids: np.ndarray, docs: np.ndarray, least: int, exponent: int) -> np.ndarray:
    """Runs of all texts of a block; positions count over the block."""
    n, seed = len(ids), least_seed(least, exponent)
    if n < seed:
        return np.zeros((0, 3), np.int64)
    # A hash of each window only leaves positions out: equal windows have equal hashes.
    m = n - seed + 1
    h = mix(docs[:m].astype(U64) + U64(1))
    for k in range(seed):
        h = mix(h + ids[k:k + m].astype(U64))
    whole = docs[seed - 1:] == docs[:m]
    by = np.argsort(h, kind="stable")
    same = (h[by[1:]] == h[by[:-1]]) & whole[by[1:]] & whole[by[:-1]]
    repeats = np.zeros(n, bool)
    repeats[by[1:][same]] = repeats[by[:-1][same]] = True
    if not repeats.any():
        return np.zeros((0, 3), np.int64)
    # Stretches of repeating positions with the words of their last window, each
    # stretch ended by a number of its own: no LCP of ``seed`` or more is changed.
    edge = np.diff(np.concatenate(([False], repeats, [False])).astype(np.int8))
    breaks = np.flatnonzero(repeats[1:] & repeats[:-1] & (docs[1:] != docs[:-1])) + 1
    lo = np.sort(np.concatenate((np.flatnonzero(edge == 1), breaks)))
    hi = np.sort(np.concatenate((np.flatnonzero(edge == -1), breaks))) + seed - 1
    size = hi - lo + 1
    first = np.cumsum(size) - size
    at = np.arange(size.sum()) - np.repeat(first, size) + np.repeat(lo, size)
    ends = first + size - 1
    string = np.empty(len(at), np.int64)
    words = np.ones(len(at), bool)
    words[ends] = False
    string[words] = docs[at[words]] * (ids.max() + 1) + ids[at[words]]
    string[ends] = -1 - np.arange(len(ends))
    order, lcp = suffix_order(string)
    return kruskal_runs(at, order, lcp, least, exponent, seed)


def runs_in_block(b: Block, least: int, exponent: int) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """Of every text of a block: number of words, runs, words kept (one space between)."""
    s, e, d, ids = word_numbers(b)
    runs = block_runs(ids, d, least, exponent)
    first = np.searchsorted(d, np.arange(b.n + 1))
    run_of = np.searchsorted(runs[:, 0], first)
    covered = np.zeros(len(ids) + 1, np.int64)
    np.add.at(covered, runs[:, 0] + runs[:, 2], 1)
    np.add.at(covered, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(covered[:-1]) == 0
    # The kept words' bytes, each followed by one space.
    size = (e - s + 1)[kept]
    to = np.cumsum(size) - size
    copy = np.repeat(s[kept] - to, size) + np.arange(size.sum())
    out = np.concatenate((b.data, [np.uint8(32)]))[copy]
    out[to + size - 1] = 32
    cut = np.concatenate((to, [len(out)]))[np.concatenate(([0], np.cumsum(kept)))[first]]
    for i in range(b.n):
        lo, hi = first[i], first[i + 1]
        yield int(hi - lo), runs[run_of[i]:run_of[i + 1]] - [lo, 0, 0], out[cut[i]:max(cut[i], cut[i + 1] - 1)].tobytes()


RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 6, exponent: int = 4) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``n_words``, ``runs`` by start and period,
    and ``collapsed``, the words that no run contains after its first period."""
    if exponent < 2 or least < 2:
        raise ValueError("a run repeats: exponent and least length must be 2 or more")
    frame = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([T.StructField("key", frame.schema["key"].dataType)]
                          + T.StructType.fromDDL(f"n_words bigint, runs {RUN}, collapsed string").fields)
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column("text")):
                rows = list(runs_in_block(b, least, exponent))
                every = np.concatenate([r for _, r, _ in rows])
                offs = pa.array(np.concatenate(([0], np.cumsum([len(r) for _, r, _ in rows]))).astype(np.int32))
                values = pa.StructArray.from_arrays([pa.array(every[:, i]) for i in range(3)],
                                                    fields=list(run_type.value_type))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").slice(b.first, b.n), pa.array([n for n, _, _ in rows], pa.int64()),
                     pa.ListArray.from_arrays(offs, values, type=run_type),
                     pa.array([t for _, _, t in rows], pa.binary()).cast(pa.string())],
                    names=["key", "n_words", "runs", "collapsed"])

    return frame.mapInArrow(work, schema).withColumnRenamed("key", key)
