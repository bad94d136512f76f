"""Operator 9: language-model scoring with a log-frequency Bloom filter.

Counts of words and word pairs come from one aggregate over all training
documents, pairs seen once included. They are quantised to powers of two, and an
n-gram of level q is put into the filter q times, as ``(n-gram, 1) ... (n-gram, q)``;
asking for the levels in turn until one is missing gives the level back, never too
low. The filter is cut into segments by hash, about ``SEGMENT_ENTRIES`` entries each
and as many as the entries need, with ``BITS_PER_ENTRY`` bits for every entry. It is
never in one place: texts are worked on in blocks of a megabyte, each block sends
its distinct n-grams to their segments by a shuffle, a message per segment, and gets
a level for each of them back. A task holds one segment or one block at a time.

``P(w|h) = L c(h,w)/c(h) + (1-L) P(w)`` with ``P(w) = M c(w)/N + (1-M)/(V+1)``, all
counts read from the filter.

The base score needs exact counts of every word. The commonest words, at most
``HEAD_WORDS``, are broadcast with their counts; the other words of each document
meet theirs in a join.

Defined results: a null or blank text is one end token; a null id counts as the
empty string, which puts it in the held-out tenth; repeated rows count and score
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, Block, as_signed, blocks, discard, mix, stage_table

HEAD_WORDS = 1 << 19
BITS_PER_ENTRY = 10
PROBES = 4
SEGMENT_ENTRIES = 1 << 19
KEY_BYTES = 5
HELD = 1 << 20  # n-grams that a task holds before it sends them on
ASKED = 1 << 15  # n-grams looked up at once: their places stay in the processor's cache
WEIGHT_PAIR, WEIGHT_WORD = 0.6, 0.999
END, BEGIN = U64(0x5851F42D4C957F2D), U64(0x14057B7EF767814F)


def tokens(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """(document, fingerprint) of every word, lower-cased in ASCII, and one end each."""
    low = b.lowered()
    s, e, d = low.words()
    h = low.ranges(low.prefix(), s, e)
    count = b.per_doc(d)
    place = np.arange(len(d)) + d  # every earlier document has its end token before
    all_d = np.repeat(np.arange(b.n), count + 1)
    all_h = np.full(len(d) + b.n, END, U64)
    all_h[place] = h
    return all_d, all_h


def pairs(d: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Fingerprint of each token with the one before it (or the beginning)."""
    prev = np.concatenate(([BEGIN], h[:-1])) if len(h) else h
    prev[np.concatenate(([True], d[1:] != d[:-1]))[:len(h)]] = BEGIN
    return mix(prev * U64(0x2545F4914F6CDD1D) + mix(h))


def held_out(key: str) -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 10 == 0


def summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of several counts, and their sums."""
    h, n = (np.concatenate(c) for c in zip(*held, strict=True))
    order = np.argsort(h)
    h, n = h[order], n[order]
    at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))[:len(h)])
    return h[at], np.add.reduceat(n, at) if len(at) else n


def ngram_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``size, h, n``: all words and all pairs. A task sums the counts of its blocks in at most
    some ``HELD`` places before it sends them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {1: [], 2: []}

        def send(size: int) -> Iterator[pa.RecordBatch]:
            if held[size]:
                g, n = summed(held[size])
                held[size] = []
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), size, np.int8)), pa.array(as_signed(g)), pa.array(n)],
                                                 names=["size", "h", "n"])

        for batch in batches:
            for b in blocks(batch.column(0)):
                d, h = tokens(b)
                for size, grams in ((1, h), (2, pairs(d, h))):
                    held[size].append(np.unique(grams, return_counts=True))
                    if sum(len(g) for g, _ in held[size]) > HELD:
                        held[size] = [summed(held[size])]
                        if len(held[size][0][0]) > HELD // 2:
                            yield from send(size)
        for size in held:
            yield from send(size)

    rows = docs.select(text).mapInArrow(run, "size byte, h long, n long")
    return stage_table(rows.groupBy("size", "h").agg(F.sum("n").alias("n")), "ngrams")


def quantise(size, n):
    """Level of a count: 1, 2-3, 4-7 ... from 1 on, for words and pairs (``size``) alike."""
    return np.frexp(np.asarray(n, float))[1].astype(np.int64)


def unquantise(level: np.ndarray) -> np.ndarray:
    """Middle of a level's counts; 0 stays 0."""
    return np.where(level <= 1, level, 1.5 * np.exp2(level - 1.0))


def segment_of(mixed: np.ndarray, segments: int) -> np.ndarray:
    return ((mixed >> U64(32)) * U64(segments) >> U64(32)).astype(np.int64)


def keys_of(h: np.ndarray) -> np.ndarray:
    """What tells n-grams of one segment apart: 40 bits, enough for any number of segments."""
    return mix(h) & U64((1 << 8 * KEY_BYTES) - 1)


def packed(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // KEY_BYTES, 8), np.uint8)
    out[:, :KEY_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, KEY_BYTES)
    return out.view(U64).ravel()


def binaries(data: bytes, ends: np.ndarray) -> pa.Array:
    """Binary values that lie end to end: the i-th is ``data[ends[i]:ends[i + 1]]``."""
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)]) \
        .cast(pa.binary())


def raw(column: pa.Array) -> tuple[np.ndarray, bytes]:
    """The inverse of ``binaries``, for a column without nulls."""
    if not len(column):
        return np.zeros(1, np.int64), b""
    column = column.cast(pa.large_binary())
    _, ob, db = column.buffers()
    ends = np.frombuffer(ob, np.int64)[column.offset:column.offset + len(column) + 1]
    return ends - ends[0], db[ends[0]:ends[-1]].to_pybytes() if db is not None else b""


class Probes:
    """Places of the n-grams' level among the bits of their segment, by each hash."""

    def __init__(self, keys: np.ndarray, level: int):
        self.start = mix(keys ^ U64(level * 0x9E3779B97F4A7C15 % (1 << 64)))
        self.step = self.start >> U64(32) | U64(1)

    def place(self, k: int, bits: int) -> np.ndarray:
        p = self.start + U64(k) * self.step
        p -= p // U64(bits) * U64(bits)  # the remainder, by numpy's faster division
        return p.view(np.int64)

    def keep(self, some: np.ndarray) -> None:
        self.start, self.step = self.start[some], self.step[some]


def segment_bits(keys: np.ndarray, top: np.ndarray) -> np.ndarray:
    """A segment's bytes: as many as its entries need."""
    bits = np.zeros(max(8, int(top.sum()) * BITS_PER_ENTRY + 7 & ~7), bool)
    for level in range(1, int(top.max()) + 1):
        keys, top = keys[top >= level], top[top >= level]
        asked = Probes(keys, level)
        for k in range(PROBES):
            bits[asked.place(k, len(bits))] = True
    return np.packbits(bits, bitorder="little")


def segment_levels(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Repeated membership probes: the level before the first miss. Keys are looked up some
    ``ASKED`` at a time, however many there are."""
    out = np.zeros(len(keys), np.uint8)
    for lo in range(0, len(keys), ASKED):
        left, alive = keys[lo:lo + ASKED], np.arange(lo, min(lo + ASKED, len(keys)))
        level = 0
        while len(alive) and level < 64:
            level += 1
            asked = Probes(left, level)
            for k in range(PROBES):
                p = asked.place(k, 8 * len(bits))
                hit = np.flatnonzero((bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1)
                if len(hit) < len(alive):
                    alive, left = alive[hit], left[hit]
                    asked.keep(hit)
            out[alive] = level
    return out


class LogFrequencyFilter:
    """All segments in one place."""

    def __init__(self, segments: list[np.ndarray]):
        self.bits = segments

    def levels(self, h: np.ndarray) -> np.ndarray:
        out, seg = np.zeros(len(h), np.int64), segment_of(mix(h), len(self.bits))
        for k in np.unique(seg):
            out[seg == k] = segment_levels(self.bits[k], keys_of(h[seg == k]))
        return out


def filter_segments(counts: DataFrame, per_segment: int = SEGMENT_ENTRIES) -> tuple[DataFrame, int]:
    """``segment, bits`` of all n-grams, and the number of segments."""
    entries = counts.agg(F.sum(F.floor(F.log2("n")) + 1)).first()[0] or 0
    segments = max(1, -(-entries // per_segment))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def send() -> Iterator[pa.RecordBatch]:
            h, level = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            seg = segment_of(mix(h), segments)
            order = np.argsort(seg, kind="stable")
            h, level, seg = h[order], level[order], seg[order]
            at = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1]))[:len(seg)])
            ends = np.append(at, len(seg))
            yield pa.RecordBatch.from_arrays(
                [pa.array(seg[at]), binaries(packed(keys_of(h)), ends * KEY_BYTES), binaries(level.tobytes(), ends)],
                names=["segment", "keys", "levels"])

        for b in batches:
            held.append((np.asarray(b.column(1)).view(U64), quantise(np.asarray(b.column(0)), np.asarray(b.column(2))).astype(np.int8)))
            if sum(len(h) for h, _ in held) > HELD:
                yield from send()
        if held:
            yield from send()

    def build(group: pa.Table) -> pa.Table:
        keys = unpacked(b"".join(group["keys"].to_pylist()))
        bits = segment_bits(keys, np.frombuffer(b"".join(group["levels"].to_pylist()), np.int8).astype(np.int64))
        return pa.table({"segment": pa.array([group["segment"][0].as_py()], pa.int64()),
                         "bits": pa.array([bits.tobytes()], pa.binary())})

    return counts.select("size", "h", "n").mapInArrow(place, "segment long, keys binary, levels binary") \
        .groupBy("segment").applyInArrow(build, "segment long, bits binary"), segments


def build_filter(counts: DataFrame) -> tuple[LogFrequencyFilter, int]:
    """The filter of a small table in one place, and the least count of the pairs it holds."""
    parts, segments = filter_segments(counts)
    out = [np.zeros(1, np.uint8)] * segments
    for r in parts.collect():
        out[r["segment"]] = np.frombuffer(r["bits"], np.uint8)
    return LogFrequencyFilter(out), counts.where(F.col("size") == 2).agg(F.min("n")).first()[0]


def head_words(words: DataFrame, most: int = HEAD_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and counts of the commonest words: all words above the least
    count that at most ``most`` words reach."""
    power = F.floor(F.log2("n") * 4).cast("int")
    steps = sorted(((r["power"], r["count"]) for r in words.groupBy(power.alias("power")).count().collect()), reverse=True)
    total, least = 0, None
    for p, c in steps:
        total += c
        if total > most:
            break
        least = p
    if least is None:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    got = words.where(power >= least).select("h", "n").toPandas()
    h = got["h"].to_numpy(np.int64).view(U64)
    order = np.argsort(h)
    return h[order], got["n"].to_numpy(np.int64)[order]


def mixed_grams(h: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Distinct words and pairs of a block, mixed and sorted, which is by segment too."""
    return np.unique(mix(np.concatenate((h, two))))


LISTS = ("doc_id", "text", "held_out", "row")


def in_blocks(rows: DataFrame) -> DataFrame:
    """A row per block: ``block`` (the ``row`` of its first document) and its documents' columns
    as lists, so that however the table is split, a block stays whole."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(1)):
                part = batch.slice(b.first, b.n)
                ends = pa.array([0, b.n], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(3)[:1], *[pa.ListArray.from_arrays(ends, c) for c in part.columns]],
                                                 names=["block", *LISTS])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return stage_table(rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(
        run, f"block long, doc_id array<{kind}>, text array<string>, held_out array<boolean>, row array<long>"), "blocks")


def questions(cut: DataFrame, segments: int) -> DataFrame:
    """``segment, block, data``: the distinct n-grams of each block in each segment."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (b,) = blocks(batch.column(1)[i].values)
                d, h = tokens(b)
                grams = mixed_grams(h, pairs(d, h))
                seg = segment_of(grams, segments)
                at = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seg[at]), pa.array(np.full(len(at), batch.column(0)[i].as_py())),
                     binaries(packed(grams), np.append(at, len(seg)) * KEY_BYTES)],
                    names=["segment", "block", "data"])

    return cut.select("block", "text").mapInArrow(run, "segment long, block long, data binary")


def runs(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[list[pa.RecordBatch]]:
    """Rows of equal value in a sorted column, whatever batches they came in."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        v = np.asarray(batch.column(column))
        cuts = [0, *(np.flatnonzero(v[1:] != v[:-1]) + 1).tolist(), len(v)]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if i == j:
                continue
            if held and held[0].column(column)[0].as_py() != v[i]:
                yield held
                held = []
            held.append(batch.slice(i, j - i))
    if held:
        yield held


def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``block, segment, levels`` of ``segment, block, data`` sorted by segment, the segment's own
    row first (without a block). What a batch asks of a segment is looked up at once."""
    segment, bits = None, np.zeros(1, np.uint8)
    for batch in batches:
        seg = np.asarray(batch.column(0))
        cuts = [0, *(np.flatnonzero(seg[1:] != seg[:-1]) + 1).tolist(), len(seg)]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if i < j and batch.column(1)[i].as_py() is None:  # the segment itself comes before its questions
                segment, bits = seg[i], np.frombuffer(batch.column(2)[i].as_py(), np.uint8)
                i += 1
            if i == j:
                continue
            ends, data = raw(batch.column(2).slice(i, j - i))  # all blocks' questions to a segment at once
            keys = unpacked(data)
            levels = segment_levels(bits, keys) if seg[i] == segment else np.zeros(len(keys), np.uint8)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).slice(i, j - i), batch.column(0).slice(i, j - i), binaries(levels.tobytes(), ends // KEY_BYTES)],
                names=["block", "segment", "levels"])


def block_levels(asked: DataFrame, parts: DataFrame) -> DataFrame:
    """``block, segment, levels``: a byte for each n-gram asked."""
    own = parts.select("segment", F.lit(None).cast("long").alias("block"), F.col("bits").alias("data"))
    met = own.unionByName(asked).repartition("segment").sortWithinPartitions("segment", F.col("block").asc_nulls_first())
    return stage_table(met.mapInArrow(answer, "block long, segment long, levels binary"), "levels")


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", per_segment: int = SEGMENT_ENTRIES) -> DataFrame:
    """Contract columns for every document."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), held_out(key).alias("held_out"))
    counts = ngram_counts(rows.where(~F.col("held_out")))
    words = stage_table(counts.where(F.col("size") == 1).select("h", "n"), "words")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    parts, segments = filter_segments(counts, per_segment)
    parts = stage_table(parts, "filter")
    discard(counts)
    cut = in_blocks(rows)
    levels = block_levels(questions(cut, segments), parts)
    discard(parts)
    shared = spark.sparkContext.broadcast(head_words(words))
    kind = rows.schema["doc_id"].dataType.simpleString()
    base_log = math.log10(total + 0.1 * (distinct + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head_h, head_n = shared.value
        for held in runs(batches, 0):
            met = pa.Table.from_batches(held)
            level = np.concatenate([np.frombuffer(raw(c.column("levels").drop_null())[1], np.uint8) for c in held])
            whole = met.filter(met["row"].is_valid()).combine_chunks()
            own = {c: whole[c].chunk(0).flatten() for c in LISTS}
            (b,) = blocks(own["text"])
            d, h = tokens(b)
            two = pairs(d, h)
            grams = mixed_grams(h, two)
            if len(grams) != len(level):
                raise RuntimeError(f"{len(level)} levels for {len(grams)} n-grams of a block")
            count = unquantise(level.astype(float))
            types, at = np.unique(h, return_inverse=True)
            place = np.minimum(np.searchsorted(head_h, types), max(0, len(head_h) - 1))
            in_head = head_h[place] == types if len(head_h) else np.zeros(len(types), bool)
            exact = np.where(in_head, head_n[place] if len(head_h) else 0, 0)
            known = in_head[at]
            base = np.bincount(d, np.where(known, np.log10(exact + 0.1)[at], 0.0), b.n)
            # the other words: distinct per document, with their number
            od, oh = d[~known], h[~known]
            order = np.lexsort((oh, od))
            od, oh = od[order], oh[order]
            new = np.flatnonzero(np.concatenate(([True], (od[1:] != od[:-1]) | (oh[1:] != oh[:-1])))[:len(od)])
            times = np.diff(np.append(new, len(od)))
            ends = pa.array(np.concatenate(([0], np.cumsum(np.bincount(od[new], minlength=b.n)))), pa.int32())
            # model
            c1 = count[np.searchsorted(grams, mix(types))][at]
            c2 = count[np.searchsorted(grams, mix(two))]
            first = np.concatenate(([True], d[1:] != d[:-1]))[:len(d)]
            before = np.concatenate(([0.0], c1[:-1]))
            before[first] = c1[h == END][0]  # every training document begins once and ends once
            p1 = WEIGHT_WORD * np.minimum(1, c1 / max(1, total)) + (1 - WEIGHT_WORD) / (distinct + 1)
            p2 = np.where(before > 0, np.minimum(1, c2 / np.maximum(before, 1)), 0.0)
            logp = np.log10(WEIGHT_PAIR * p2 + (1 - WEIGHT_PAIR) * p1)
            out = pa.Table.from_arrays(
                [own["row"], own["doc_id"], own["held_out"],
                 pa.array(b.per_doc(d), pa.int64()), pa.array(b.per_doc(d[known]), pa.int64()),
                 pa.array(base), pa.array(np.bincount(d, logp, b.n)),
                 pa.ListArray.from_arrays(ends, pa.array(as_signed(oh[new]))),
                 pa.ListArray.from_arrays(ends, pa.array(times.astype(np.int32)))],
                names=["row", "doc_id", "held_out", "n_tokens", "head_known", "head_base", "score", "rare", "times"])
            yield from out.combine_chunks().to_batches()

    lists = [F.lit(None).cast(cut.schema[c].dataType).alias(c) for c in LISTS]
    answers = levels.select("block", "segment", "levels", *lists)
    asked = cut.select("block", F.lit(None).cast("long").alias("segment"), F.lit(None).cast("binary").alias("levels"), *LISTS)
    met = answers.unionByName(asked).repartition("block") \
        .sortWithinPartitions("block", F.col("segment").asc_nulls_last())
    scored = stage_table(met.mapInArrow(
        run, f"row long, doc_id {kind}, held_out boolean, n_tokens long, head_known long, head_base double, score double, "
             "rare array<long>, times array<int>"), "scored")
    for t in (cut, levels):
        discard(t)
    rare = scored.select("row", F.inline(F.arrays_zip("rare", "times")))
    met = rare.join(words.select(F.col("h").alias("rare"), "n"), "rare", "left") \
        .groupBy("row").agg(F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.1))).alias("rare_base"),
                            F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("rare_known"))
    zero = F.lit(0)
    return scored.drop("rare", "times").join(met, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("head_known") + F.coalesce("rare_known", zero)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("head_base") + F.coalesce("rare_base", F.lit(0.0)) - F.col("n_tokens") * F.lit(base_log)).alias("base_score"),
        "score")
