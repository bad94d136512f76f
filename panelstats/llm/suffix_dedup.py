"""Operator 8: repeated byte strings by prefix-free parsing.

A byte belongs to a repeat if it lies in a string of ``length`` bytes that also
starts somewhere else. Texts are parsed into phrases: a rolling hash of
``TRIGGER`` bytes marks phrase ends, so equal strings are cut at equal places,
and each text position is the start of exactly one phrase suffix of at least
``TRIGGER`` bytes (the prefix-free property). The order of all suffixes of the
corpus follows from two smaller orders: that of the dictionary's phrase
suffixes, and that of the parse after the phrase. Here both are needed only to a
depth of ``length`` bytes and only as equality classes, so suffixes are ranked by
64-bit fingerprints, which Spark groups; equal ranks, however many, are counted
by partial aggregation and never have to meet in one task.

* Parse level: a phrase end with the positions it serves gives one row with two
  ranks: that of the bytes common to all windows starting there (``near``), and
  that of all bytes those windows cover (``whole``). A unique ``near`` rank
  settles all its positions as unique, a repeated ``whole`` rank settles them as
  repeated; almost the whole corpus is settled here, a row per phrase.
* Dictionary level: what remains (the phrases in which a repeat begins or ends)
  is ranked position by position, against one representative of each repeated
  ``whole`` rank with the same ``near`` rank.

Positions without a phrase end within ``REACH`` of the window are ranked one by
one in the first step, so texts of any kind (one letter, no blanks) are exact.

Defined results: a null text is empty; texts shorter than ``length`` keep all;
repeated rows are occurrences of their own and each get a row; null ids are kept;
an empty table gives an empty result; other columns are ignored
(``without_repeats`` keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPAN, U64, Block, as_signed, blocks, mix, stage_table

TRIGGER = 12
BANDS = (0.25, 0.5, 0.9)  # of the window: distances of a window's start to its phrase end
REACH = BANDS[-1]


def _bands(length: int) -> list[tuple[int, int]]:
    """(least, greatest) distance of each band."""
    highs = [max(TRIGGER, int(length * f)) for f in BANDS]
    lows = [TRIGGER, *[h + 1 for h in highs[:-1]]]
    return [(a, b) for a, b in zip(lows, highs, strict=True) if a <= b]


def phrase_ends(b: Block, c: np.ndarray, length: int) -> np.ndarray:
    """Positions e such that the bytes [e - TRIGGER, e) are a trigger, inside a document."""
    n = len(b.data)
    if n < TRIGGER:
        return np.zeros(0, np.int64)
    found = []
    for first in range(0, n - TRIGGER + 1, SPAN):
        lo = np.arange(first, min(first + SPAN, n - TRIGGER + 1))
        h = b.ranges(c, lo, lo + TRIGGER)
        found.append(lo[h < U64((1 << 64) // max(2, length // 7))] + TRIGGER)
    e = np.concatenate(found)
    doc = b.doc_of(e - TRIGGER)
    return e[e <= b.offs[doc + 1]]


def parse(b: Block, length: int) -> tuple[np.ndarray, ...]:
    """Rows (near, whole, document, first start, number of starts); starts count from
    the beginning of their document."""
    c = b.prefix()
    ends = phrase_ends(b, c, length)
    doc = b.doc_of(ends - 1)
    last_start = b.offs[1:] - length  # of each document; may lie before its beginning
    prev = np.concatenate(([-1], ends[:-1]))
    same = np.concatenate(([False], doc[1:] == doc[:-1])) if len(ends) else np.zeros(0, bool)
    first = np.where(same, prev - TRIGGER + 1, b.offs[doc])
    first = np.maximum(first, b.offs[doc])
    final = np.minimum(ends - TRIGGER, last_start[doc])
    out = []
    served = np.zeros(len(b.data) + 2, np.int32)
    for k, (near, far) in enumerate(_bands(length)):
        lo = np.maximum(first, ends - far)
        hi = np.minimum(final, ends - near)
        ok = lo <= hi
        lo, hi, e, d = lo[ok], hi[ok], ends[ok], doc[ok]
        np.add.at(served, lo, 1)
        np.add.at(served, hi + 1, -1)
        rank = b.ranges(c, e - TRIGGER, e + (length - far))
        out.append((mix(rank + U64(k + 1)), b.ranges(c, lo, hi + length), d, lo - b.offs[d], hi - lo + 1))
    starts = np.zeros(len(b.data) + 2, np.int32)
    long = np.flatnonzero(last_start >= b.offs[:-1])
    np.add.at(starts, b.offs[long], 1)
    np.add.at(starts, last_start[long] + 1, -1)
    left = np.flatnonzero((np.cumsum(starts, out=starts) > 0) & (np.cumsum(served, out=served) == 0))
    if len(left):
        w = b.ranges(c, left, left + length)
        d = b.doc_of(left)
        out.append((mix(w + U64(99)), w, d, left - b.offs[d], np.ones(len(left), np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``doc``: a fingerprint of id and text names a row (and its exact repetitions)."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.xxhash64(F.col(key), t).alias("doc"), t.alias("text"))


def phrase_rows(docs: DataFrame, length: int, key: str, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for b in blocks(batch.column(1)):
                near, whole, d, lo, n = parse(b, length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(as_signed(near)), pa.array(as_signed(whole)), pa.array(ids[b.first + d]),
                     pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int32))],
                    names=["near", "whole", "doc", "lo", "n"])

    return _keyed(docs, key, text).mapInArrow(run, "near long, whole long, doc long, lo int, n int")


def window_rows(docs: DataFrame, asked: DataFrame, length: int, key: str, text: str) -> DataFrame:
    """Ranks of single windows for the asked starts: ``rank, doc, lo``."""
    wanted = asked.groupBy("doc").agg(F.collect_set(F.struct("lo", "n")).alias("runs")) \
        .select("doc", F.col("runs.lo").alias("lo"), F.col("runs.n").alias("n"))
    rows = _keyed(docs, key, text).join(wanted, "doc").select("doc", "text", "lo", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for b in blocks(batch.column(1)):
                c = b.prefix()
                los, ns = batch.column(2).slice(b.first, b.n), batch.column(3).slice(b.first, b.n)
                d = np.repeat(np.arange(b.n), los.value_lengths().to_numpy())
                lo, n = np.asarray(los.flatten(), np.int64), np.asarray(ns.flatten(), np.int64)
                at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                d = np.repeat(d, n)
                s = at + b.offs[d]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(as_signed(b.ranges(c, s, s + length))), pa.array(ids[b.first + d]),
                     pa.array(at.astype(np.int32))], names=["rank", "doc", "lo"])

    return rows.mapInArrow(run, "rank long, doc long, lo int")


def repeated_runs(docs: DataFrame, length: int = 400, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc, lo, n``: runs of window starts that occur elsewhere too."""
    rows = phrase_rows(docs, length, key, text)
    again = rows.groupBy("near").agg(F.count(F.lit(1)).alias("times"), F.min("whole").alias("a"),
                                     F.max("whole").alias("b")) \
        .where(F.col("times") > 1).select("near", (F.col("a") == F.col("b")).alias("alike"))
    some = stage_table(rows.join(again, "near"), "phrases")
    open_ = some.where(~F.col("alike"))
    whole = open_.groupBy("near", "whole").agg(F.count(F.lit(1)).alias("times"),
                                               F.min(F.struct("doc", "lo", "n")).alias("one"))
    whole = stage_table(whole, "ranks")
    sure = some.where(F.col("alike")).select("doc", "lo", "n") \
        .unionByName(open_.join(whole.where(F.col("times") > 1).select("near", "whole"), ["near", "whole"])
                     .select("doc", "lo", "n"))
    # one row of each rank: the single one, or a representative of a repeated one
    undecided = whole.groupBy("near").agg(F.min("times").alias("least")).where(F.col("least") == 1).select("near")
    asked = whole.join(undecided, "near").select("one.*")
    windows = stage_table(window_rows(docs, asked, length, key, text), "windows")
    twice = windows.groupBy("rank").agg(F.count(F.lit(1)).alias("times")).where(F.col("times") > 1).select("rank")
    found = windows.join(twice, "rank").select("doc", "lo", F.lit(1).alias("n"))
    return stage_table(sure.unionByName(found), "repeats")


def _cut(b: Block, i: int, lo: list[int], n: list[int], length: int) -> tuple[bytes, list[tuple[int, int]]]:
    """Remaining bytes of document i and the removed spans."""
    raw = b.data[b.offs[i]:b.offs[i + 1]]
    depth = np.zeros(len(raw) + 1, np.int64)
    start = np.asarray(lo, np.int64)
    np.add.at(depth, start, 1)
    np.add.at(depth, start + np.asarray(n, np.int64) - 1 + length, -1)
    gone = np.cumsum(depth[:-1]) > 0
    edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
    return raw[~gone].tobytes(), list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def remove_repeats(docs: DataFrame, length: int = 400, key: str = "doc_id", text: str = "text",
                   as_text: bool = False) -> DataFrame:
    """All columns of ``docs`` plus ``kept`` and ``spans`` (removed [from, to) in bytes).
    ``kept`` is binary; with ``as_text`` a string, in which a character cut in two is gone."""
    runs = repeated_runs(docs, length, key, text).groupBy("doc") \
        .agg(F.collect_set(F.struct("lo", "n")).alias("runs")) \
        .select(F.col("doc").alias("_doc"), F.col("runs.lo").alias("_lo"), F.col("runs.n").alias("_n"))
    docs = docs.drop("kept", "spans")
    names = docs.columns
    rows = docs.withColumn("_key", F.xxhash64(F.col(key), F.coalesce(F.col(text), F.lit("")))) \
        .join(runs, F.col("_key") == F.col("_doc"), "left").select(*names, "_lo", "_n")
    at = names.index(text)
    kept_type = pa.string() if as_text else pa.binary()
    out_type = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(at)):
                part = batch.slice(b.first, b.n)
                lo, n = part.column(len(names)).to_pylist(), part.column(len(names) + 1).to_pylist()
                done = [_cut(b, i, lo[i], n[i], length) if lo[i] else (b.text(i), []) for i in range(b.n)]
                kept = [k.decode("utf-8", "ignore") if as_text else k for k, _ in done]
                spans = [[{"from": x, "to": y} for x, y in s] for _, s in done]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(k) for k in range(len(names))], pa.array(kept, kept_type),
                     pa.array(spans, out_type)], names=[*names, "kept", "spans"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return rows.mapInArrow(run, schema + f", kept {'string' if as_text else 'binary'}, spans array<struct<`from`:int,`to`:int>>")


def report(removed: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Contract columns, from the kept bytes and the spans."""
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["to"] - s["from"])
    return removed.select(
        F.col(key).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
        n_removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame, length: int = 400, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents with their repeats cut out; a character cut in two goes whole, and
    documents with nothing but blanks left are dropped if they lost something."""
    rows = remove_repeats(docs, length, key, text, as_text=True)
    rows = rows.where((F.size("spans") == 0) | (F.length(F.trim("kept")) > 0))
    kept = F.when(F.size("spans") == 0, F.col(text)).otherwise(F.col("kept")).alias(text)
    return rows.select(*[kept if c == text else F.col(c) for c in docs.columns])
