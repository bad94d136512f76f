"""Operator 1: n-gram Jaccard join with prefix, length, positional and suffix filters.

Documents of equal shingle sets form one class from the start. Shingles are put
in one global order: by fingerprint, but those that many documents have come last,
rare ones of them first. Only the first shingles by fingerprint can come into a
prefix, half as many again as it takes are counted, each by itself, and the most frequent
stand in a table of fixed size (any order keeps the join exact, the counts only make
prefixes selective). A class of n shingles is indexed under its first
``n - ceil(t n) + 1`` shingles. Classes that share such a shingle are candidates
if their sizes allow the threshold (length filter) and if the positions leave
room for enough common shingles (positional filter); the parities of ``PARITIES``
parts of each set, which the lists carry, and then a histogram bound their difference
from below (suffix filter). Survivors are compared once each on their whole sets.

A list of classes under one shingle is not expanded into all its pairs: each class
is compared with one of the list only; verified links are closed into components,
and lists whose other members of like size are in one component are finished. Of the
unfinished lists the short ones are joined pair by pair across components; the
classes in the long ones get new prefixes in the exact rare-first order of their own
shingles, go through such rounds again, and what three rounds leave over is
joined pair by pair across components. So every link between different
components is found, however long a list is. Components are therefore exact;
links inside a component are not all listed.

Defined results: a null, empty or blank text has no shingles and links with
nothing; equal texts share a component; repeated rows each get a row; null ids
never name a component unless it has no other id; an empty table gives an empty
result; other columns are ignored (``one_per_group`` keeps them, and
judges every row by itself).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, as_signed, blocks, discard, mix, shingle_hashes, stage_table
from .graph import components

ORDER_BITS = 21  # places of the frequency table: 2 MB, whatever the corpus
COUNT_PARTS = 1024  # in which shingles are counted, by their last bits
PART_MOST = 256  # frequent shingles that a part gives to the table, which stays seven eighths empty
COUNT_AT_ONCE = 1 << 20  # shingles that a task holds for counting
SHORT_LIST = 32  # members up to which a list's pairs are joined directly; longer ones take hub rounds
BINS = 64  # of the suffix filter's histogram
PARITIES = 256  # parts of a set whose sizes are known to be even or odd
SKETCH = [f"p{k}" for k in range(PARITIES // 64)]
FEW = 1 << 17  # classes whose numbers are broadcast (2 MB) to pick their rows; more meet them in a shuffle
ID_BITS = 23  # of the map of ids that keeps most rows nobody asks for out of that shuffle


def _class_of(d: np.ndarray, g: np.ndarray, n_docs: int) -> np.ndarray:
    """Fingerprint of each document's shingle set: a sum, so order does not matter."""
    total = np.zeros(n_docs, U64)
    if len(d):
        start = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
        total[d[start]] = np.add.reduceat(mix(g ^ U64(0xA0761D6478BD642F)), start)
    return as_signed(mix(total + np.bincount(d, minlength=n_docs).astype(U64)))


def _parities(d: np.ndarray, g: np.ndarray, n_docs: int) -> np.ndarray:
    """Bit k of a document: whether an odd number of its shingles lie in part k."""
    part = (g >> U64(20) & U64(PARITIES - 1)).astype(np.int64)
    odd = np.zeros(n_docs * PARITIES, np.uint8)
    at = np.flatnonzero(np.bincount(d * PARITIES + part, minlength=0) & 1)
    odd[at] = 1
    return np.packbits(odd, bitorder="little").view(np.int64).reshape(n_docs, -1)


def prefix_length(size, percent: int):
    return size - -(-size * percent // 100) + 1


def _least_size(percent: int) -> int:
    """Smaller sets link only if equal."""
    return next(m for m in range(1, 1000) if 100 * m >= percent * (m + 1))


def _rank_within(d: np.ndarray, n_docs: int) -> np.ndarray:
    """Number of each row within its document (``d`` ascending)."""
    count = np.bincount(d, minlength=n_docs)
    return np.arange(len(d)) - (np.cumsum(count) - count)[d]


def _one_of_equal(cls: np.ndarray) -> np.ndarray:
    """Whether a document is the first of its class in the block."""
    first = np.zeros(len(cls), bool)
    first[np.unique(cls, return_index=True)[1]] = True
    return first


def profile(docs: DataFrame, n: int, key: str, text: str, percent: int = 90) -> DataFrame:
    """Per document: set size, class and histogram; per task: the shingles to be counted, by
    part (``counts`` is null on document rows and set on the others)."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    least = _least_size(percent)
    names = ["doc_id", "size", "cls", "bins", *SKETCH, "part", "counts"]

    def counted(found: list[np.ndarray], id_type: pa.DataType) -> pa.RecordBatch:
        g = np.concatenate(found)
        part = (g & U64(COUNT_PARTS - 1)).astype(np.int64)
        g = g[np.argsort(part, kind="stable")]
        ends = np.cumsum(np.bincount(part, minlength=COUNT_PARTS))
        parts = [(k, x.tobytes()) for k, x in enumerate(np.split(g, ends[:-1])) if len(x)]
        m = len(parts)
        return pa.RecordBatch.from_arrays(
            [pa.nulls(m, id_type), pa.array(np.zeros(m, np.int64)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.list_(pa.int32())),
             *[pa.nulls(m, pa.int64()) for _ in SKETCH], pa.array([k for k, _ in parts], pa.int32()),
             pa.array([x for _, x in parts], pa.binary())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held, id_type = [], 0, None
        for batch in batches:
            id_type = batch.column(0).type
            for b in blocks(batch.column(1)):
                d, g = shingle_hashes(b, n)
                size = np.bincount(d, minlength=b.n)
                cls = _class_of(d, g, b.n)
                most = np.where((size >= least) & _one_of_equal(cls), 3 * prefix_length(size, percent) // 2 + 8, 0)
                found.append(g[_rank_within(d, b.n) < most[d]])
                held += len(found[-1])
                bins = np.bincount(d * BINS + (g & U64(BINS - 1)).astype(np.int64), minlength=b.n * BINS)
                odd = _parities(d, g, b.n)
                ids = batch.column(0).slice(b.first, b.n)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(size, pa.int64()), pa.array(cls, mask=size == 0),
                     pa.ListArray.from_arrays(pa.array(np.arange(b.n + 1) * BINS, pa.int32()),
                                              pa.array(bins.astype(np.int32))),
                     *[pa.array(odd[:, k]) for k in range(len(SKETCH))],
                     pa.nulls(b.n, pa.int32()), pa.nulls(b.n, pa.binary())], names=names)
                if held >= COUNT_AT_ONCE:
                    yield counted(found, id_type)
                    found, held = [], 0
        if held:
            yield counted(found, id_type)

    sketch = "".join(f"{p} long, " for p in SKETCH)
    return stage_table(rows.mapInArrow(run, f"doc_id {kind}, size long, cls long, bins array<int>, {sketch}part int, counts binary"),
                       "profile")


def _place(g: np.ndarray) -> np.ndarray:
    """Of a shingle in the frequency table."""
    return (g & U64((1 << ORDER_BITS) - 1)).astype(np.int64)


def frequency_table(profiles: DataFrame) -> np.ndarray:
    """By place: 0, or 1 and more (a step for a fifth) for the shingles that most documents have.
    COUNT_PARTS * PART_MOST rows reach the driver at most."""
    def frequent(blobs: list[bytes]) -> pa.RecordBatch:
        g = np.sort(np.frombuffer(b"".join(blobs), U64))
        start = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        count = np.diff(np.append(start, len(g)))
        start, count = start[count > 1], count[count > 1]
        top = np.argsort(-count, kind="stable")[:PART_MOST]
        level = np.minimum(4 * np.log2(count[top]) - 3, 255).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(_place(g[start[top]])), pa.array(level)], names=["place", "level"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, blobs = None, []
        for batch in batches:
            for part, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if part != held and blobs:
                    yield frequent(blobs)
                    blobs = []
                held = part
                blobs.append(x)
        if blobs:
            yield frequent(blobs)

    rows = profiles.where(F.col("counts").isNotNull()).select("part", "counts")
    table = rows.repartition("part").sortWithinPartitions("part").mapInArrow(run, "place long, level int").toPandas()
    out = np.zeros(1 << ORDER_BITS, np.uint8)
    np.maximum.at(out, table["place"].to_numpy(np.int64), table["level"].to_numpy(np.uint8))
    return out


def _positions(d: np.ndarray, level: np.ndarray, take: np.ndarray) -> np.ndarray:
    """Position of each shingle in the global order of its document, as its rows come by
    document and fingerprint; of the frequent ones, if there are ``take`` others, any behind these."""
    n_docs = len(take)
    rare = level == 0
    n_rare = np.bincount(d[rare], minlength=n_docs)
    pos = take[d]
    pos[rare] = _rank_within(d[rare], n_docs)
    late = np.flatnonzero(~rare & (n_rare < take)[d])
    late = late[np.lexsort((level[late], d[late]))]  # stable: equal ones stay in order of fingerprints
    pos[late] = n_rare[d[late]] + _rank_within(d[late], n_docs)
    return pos


def postings(docs: DataFrame, freq: np.ndarray, n: int, percent: int, text: str) -> DataFrame:
    """``token, cls, size, pos`` for the prefix of every set that can link at all; of equal
    sets in a block, one."""
    table = docs.sparkSession.sparkContext.broadcast(freq)
    least = _least_size(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(0)):
                d, g = shingle_hashes(b, n)
                size = np.bincount(d, minlength=b.n)
                cls = _class_of(d, g, b.n)
                size[(size < least) | ~_one_of_equal(cls)] = 0
                d, g = (x[size[d] > 0] for x in (d, g))
                take = prefix_length(size, percent)
                pos = _positions(d, table.value[_place(g)], take)
                keep = pos < take[d]
                d, g, pos = d[keep], g[keep], pos[keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(as_signed(g)), pa.array(cls[d]), pa.array(size[d].astype(np.int32)),
                     pa.array(pos.astype(np.int32))], names=["token", "cls", "size", "pos"])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "token long, cls long, size int, pos int")


def shared_lists(post: DataFrame) -> DataFrame:
    """The distinct rows of all tokens that several classes have, as ``post`` comes sorted by
    token and class: a row waits until the next one of its token, no list is held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sent = None, False  # the last row, and whether it has gone out
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.concat_batches([held, batch])
            token, cls = (np.asarray(batch.column(k)) for k in (0, 1))
            at = np.flatnonzero(np.concatenate(([True], (token[1:] != token[:-1]) | (cls[1:] != cls[:-1]))))
            alike = token[at][1:] == token[at][:-1]
            keep = np.concatenate((alike, [False])) | np.concatenate(([False], alike))
            last = bool(keep[-1]) or (len(at) == 1 and sent)
            keep[0] &= not sent
            yield batch.take(pa.array(at[keep]))
            held, sent = batch.slice(at[-1], 1), last

    return post.repartition("token").sortWithinPartitions("token", "cls").mapInArrow(run, post.schema)


def needed_overlap(x: Column, y: Column, percent: int) -> Column:
    return F.ceil((x + y) * F.lit(percent) / F.lit(100 + percent) - F.lit(1e-9))


def _fits(x: str, y: str, percent: int) -> Column:
    """Length and positional filter for a common shingle (before it, at most ``shared``
    shingles can be common, after it at most the shorter rest), and the parities'."""
    def get(f):
        return F.col(f"{x}.{f}"), F.col(f"{y}.{f}")

    (xs, ys), (xp, yp), (xq, yq) = get("size"), get("pos"), get("shared")
    room = F.least(xq, yq) + 1 + F.least(xs - xp - 1, ys - yp - 1)
    # a part of unlike parity holds a shingle of one set only
    unlike = reduce(add, [F.bit_count(a.bitwiseXOR(b)) for a, b in map(get, SKETCH)])
    need = needed_overlap(xs, ys, percent)
    return (F.least(xs, ys) * 100 >= F.greatest(xs, ys) * percent) & (room >= need) & (unlike <= xs + ys - 2 * need)


class Linker:
    """Verifies candidate pairs of classes and keeps the components found so far."""

    def __init__(self, docs: DataFrame, profiles: DataFrame, n: int, percent: int, key: str, text: str):
        self.docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
        self.n, self.percent = n, percent
        seen = profiles.where(F.col("cls").isNotNull())
        self.reps = stage_table(seen.groupBy("cls").agg(
            F.min("doc_id").alias("rep"), F.first("bins").alias("bins"), F.first("size").alias("size"),
            *[F.first(p).alias(p) for p in SKETCH]), "classes")
        self.comps: DataFrame | None = None

    def named(self, pairs: DataFrame, *columns: str) -> DataFrame:
        """``cls`` and ``columns`` of the classes in ``pairs`` (a stage table)."""
        names = pairs.select(F.explode(F.array("x", "y")).alias("cls")).distinct()
        if pairs.count() <= FEW // 2:
            names = F.broadcast(names)
        return self.reps.select("cls", *columns).join(names, "cls")

    def texts(self, pairs: DataFrame) -> DataFrame:
        """``wanted, text``: the classes in ``pairs`` and what has the id of one document of each.
        If they are many, a map of bits goes before the shuffle, so few other texts enter it."""
        wanted = self.named(pairs, "rep").withColumnRenamed("cls", "wanted")
        docs = self.docs
        if pairs.count() <= FEW // 2:
            wanted = F.broadcast(wanted)
        else:
            def place(key):
                return F.xxhash64(key).bitwiseAND(F.lit((1 << ID_BITS) - 1))
            ids = wanted.select(place("rep").alias("at"))
            bits = ids.groupBy(F.shiftright("at", 6).alias("word")).agg(
                F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
            docs = docs.withColumn("at", place("doc_id")).join(
                F.broadcast(bits), F.expr("shiftright(at, 6) = word and (shiftright(bits, cast(at & 63 as int)) & 1) = 1"),
                "left_semi").drop("at")
        return docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["rep"])).select("wanted", "text")

    def sets(self, pairs: DataFrame) -> DataFrame:
        """Whole shingle sets of the classes in ``pairs``, from one document of each."""
        n = self.n

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b in blocks(batch.column(1)):
                    d, g = shingle_hashes(b, n)
                    cls = _class_of(d, g, b.n)
                    ends = np.concatenate(([0], np.cumsum(np.bincount(d, minlength=b.n))))
                    sets = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(as_signed(g)))
                    out = pa.RecordBatch.from_arrays([pa.array(cls), sets], names=["cls", "shingles"])
                    asked = np.asarray(batch.column(0).slice(b.first, b.n))
                    yield out.filter(pa.array(cls == asked))  # one id may carry several texts

        return stage_table(self.texts(pairs).mapInArrow(run, "cls long, shingles array<long>"), "sets")

    def shingles(self, pairs: DataFrame) -> DataFrame:
        """``cls, token``: the sets of ``sets`` as rows; those of a class again if its id and text are."""
        n = self.n

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                asked = np.asarray(batch.column(0))
                for b in blocks(batch.column(1)):
                    d, g = shingle_hashes(b, n)
                    cls = _class_of(d, g, b.n)
                    keep = (cls == asked[b.first:b.first + b.n])[d]
                    yield pa.RecordBatch.from_arrays([pa.array(cls[d[keep]]), pa.array(as_signed(g[keep]))], names=["cls", "token"])

        return self.texts(pairs).mapInArrow(run, "cls long, token long")

    def suffix_filter(self, pairs: DataFrame) -> DataFrame:
        """Histograms differ by no more than two linked sets can."""
        h = self.named(pairs, "bins", "size")
        p = pairs.join(h.select(F.col("cls").alias("x"), F.col("bins").alias("xb"), F.col("size").alias("xs")), "x") \
            .join(h.select(F.col("cls").alias("y"), F.col("bins").alias("yb"), F.col("size").alias("ys")), "y")
        apart = F.aggregate(F.zip_with("xb", "yb", lambda a, b: F.abs(a - b)), F.lit(0), lambda s, v: s + v)
        return p.where(apart <= F.col("xs") + F.col("ys") - 2 * needed_overlap(F.col("xs"), F.col("ys"), self.percent)) \
            .select("x", "y", "hits")

    def apart(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose classes are not yet in one component."""
        if self.comps is None:
            return pairs
        c = self.comps
        p = pairs.join(c.select(F.col("node").alias("x"), F.col("comp").alias("xc")), "x", "left") \
            .join(c.select(F.col("node").alias("y"), F.col("comp").alias("yc")), "y", "left")
        return p.where(F.coalesce("xc", "x") != F.coalesce("yc", "y")).drop("xc", "yc")

    def verify(self, pairs: DataFrame, sets: DataFrame) -> None:
        p = pairs.select("x", "y").join(sets.select(F.col("cls").alias("x"), F.col("shingles").alias("xs")), "x") \
            .join(sets.select(F.col("cls").alias("y"), F.col("shingles").alias("ys")), "y")
        both = F.size(F.array_intersect("xs", "ys"))
        found = p.withColumn("both", both) \
            .where(100 * F.col("both") >= self.percent * (F.size("xs") + F.size("ys") - F.col("both")))
        links = stage_table(found.select(F.col("x").alias("a"), F.col("y").alias("b")), "links")
        if links.isEmpty():
            return
        if self.comps is None:
            self.comps = stage_table(components(links), "components")
            discard(links)
            return
        # the new links join components; their names are few, so this graph is small
        old = self.comps
        named = links.join(old.select(F.col("node").alias("a"), F.col("comp").alias("ac")), "a", "left") \
            .join(old.select(F.col("node").alias("b"), F.col("comp").alias("bc")), "b", "left") \
            .select(F.coalesce("ac", "a").alias("a"), F.coalesce("bc", "b").alias("b"))
        new = components(named).select(F.col("node").alias("comp"), F.col("comp").alias("to"))
        moved = old.join(new, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
        fresh = new.join(old.select(F.col("node").alias("comp")), "comp", "left_anti") \
            .select(F.col("comp").alias("node"), F.col("to").alias("comp"))
        self.comps = stage_table(moved.unionByName(fresh), "components")
        for t in (old, links):
            discard(t)

    def close(self, candidates: DataFrame) -> None:
        """Verify candidate rows (x, y): for each class the partner of most common
        prefix shingles first; of the others those that are still apart."""
        pairs = candidates.groupBy("x", "y").agg(F.count(F.lit(1)).alias("hits"))
        close = stage_table(self.apart(pairs), "candidates")
        if close.isEmpty():
            return
        pairs = stage_table(self.suffix_filter(close), "pairs")
        discard(close)
        sets = self.sets(pairs)
        best = pairs.groupBy("x").agg(F.max(F.struct("hits", "y"))["y"].alias("y"))
        self.verify(best, sets)
        rest = stage_table(self.apart(pairs.join(best, ["x", "y"], "left_anti")), "pairs")
        if not rest.isEmpty():
            self.verify(rest, sets)
        for t in (pairs, sets, rest):
            discard(t)


def _band(percent: int) -> Column:
    return F.floor(F.log(F.col("size").cast("double")) / (1.0001 * math.log(100 / percent)))


def _mixed(rows: DataFrame, percent: int) -> DataFrame:
    """``token, bands``: the size bands in which a list may still hold a link between two
    components: sizes that can link lie in one band or in two adjacent ones (a band is a
    little wider than the ratio), so bands without two components in them are finished."""
    band = _band(percent)
    spread = rows.select("token", "comp", F.explode(F.array(band, band - 1)).alias("band"))
    return spread.groupBy("token", "band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")) \
        .where(F.col("lo") != F.col("hi")).groupBy("token").agg(F.collect_list("band").alias("bands"))


def _within(rows: DataFrame, mixed: DataFrame, percent: int) -> DataFrame:
    """The rows of such bands, each once."""
    band = _band(percent)
    return rows.join(mixed, "token").where(F.array_contains("bands", band) | F.array_contains("bands", band - 1)).drop("bands")


def _with_components(rows: DataFrame, linker: Linker) -> DataFrame:
    if linker.comps is None:
        return rows.withColumn("comp", F.col("cls"))
    c = linker.comps.select(F.col("node").alias("cls"), "comp")
    return rows.join(c, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))


def _all_pairs(lists: DataFrame, linker: Linker) -> None:
    """Candidates of different components within each list."""
    a, b = (lists.select("token", F.struct("cls", "size", "pos", "shared", "comp", *SKETCH).alias(c)) for c in "ab")
    pairs = a.join(b, "token").where((F.col("a.cls") < F.col("b.cls")) & (F.col("a.comp") != F.col("b.comp"))
                                     & _fits("a", "b", linker.percent))
    linker.close(pairs.select(F.col("a.cls").alias("x"), F.col("b.cls").alias("y")))


def _hub_rounds(lists: DataFrame, linker: Linker, most: int) -> DataFrame:
    """Compare the members of each list with one of them (least ``rank``), close the
    links, and go on with the lists whose other members are in several components."""
    percent = linker.percent
    for _ in range(most):
        hub = lists.groupBy("token").agg(F.min(F.struct("rank", "cls", "size", "pos", "shared", *SKETCH)).alias("hub"))
        met = lists.join(hub, "token").where(F.col("cls") != F.col("hub.cls"))
        near = met.select("hub", F.struct("cls", "size", "pos", "shared", *SKETCH).alias("own")).where(_fits("own", "hub", percent))
        linker.close(near.select(F.col("own.cls").alias("x"), F.col("hub.cls").alias("y")))
        # which lists go on is told from rows without the parities, and written before theirs are read
        first = lists.groupBy("token").agg(F.min(F.struct("rank", "cls"))["cls"].alias("hub"))
        rest = lists.select("token", "cls", "size").join(first, "token").where(F.col("cls") != F.col("hub")).drop("hub")
        mixed = stage_table(_mixed(_with_components(rest, linker), percent), "mixed")
        left = _within(lists.drop("comp"), mixed, percent).join(first, "token").where(F.col("cls") != F.col("hub")).drop("hub")
        old, lists = lists, stage_table(_with_components(left, linker), "lists")
        for t in (old, mixed):
            discard(t)
        if lists.isEmpty():
            break
    return lists


def _exact_lists(linker: Linker, classes: DataFrame) -> DataFrame:
    """Prefix lists of some classes, in the exact rare-first order of their own shingles.
    ``shared`` counts the shingles before that any other of these classes has, so
    shingles of one class alone leave no room in the positional filter."""
    percent = linker.percent
    classes = stage_table(classes, "unfinished")
    own = classes.select(F.col("cls").alias("x"), F.col("cls").alias("y"))
    # one shuffle of all shingles; those of one class alone are only numbers from here on
    w = Window.partitionBy("token")
    met = linker.shingles(own).select("cls", "token", F.count(F.lit(1)).over(w).alias("often"),
                                      F.min("cls").over(w).alias("lo"), F.max("cls").over(w).alias("hi")).where("lo != hi")
    ordered = met.groupBy("cls").agg(F.array_sort(F.collect_set(F.struct("often", "token"))).alias("all"))
    size, alone = F.col("size"), F.col("size") - F.size("all")
    keep = size - F.ceil(size * F.lit(percent) / 100 - F.lit(1e-9)) + 1
    at = ordered.join(linker.named(own, "size", *SKETCH), "cls").select(
        "cls", size.cast("int").alias("size"), alone.cast("int").alias("rank"), *SKETCH,
        F.posexplode(F.slice("all", F.lit(1), F.greatest(keep - alone, F.lit(0)).cast("int"))).alias("shared", "t"))
    rows = stage_table(at.select(F.col("t.token").alias("token"), "cls", "size", (F.col("rank") + F.col("shared")).alias("pos"),
                                 "shared", "rank", *SKETCH), "exact-rows")
    several = rows.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("token")
    out = stage_table(rows.join(several, "token"), "exact-lists")
    discard(rows)
    discard(classes)
    return out


def groups(docs: DataFrame, n: int = 3, percent: int = 90, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id``; two documents link when 100 times their
    common shingles are at least ``percent`` times their united ones."""
    full = profile(docs, n, key, text, percent)
    freq = frequency_table(full)
    profiles = stage_table(full.where(F.col("counts").isNull()).drop("part", "counts"), "profile")  # without the shingles
    discard(full)
    linker = Linker(docs, profiles, n, percent, key, text)
    lists = stage_table(shared_lists(postings(docs, freq, n, percent, text)).join(linker.reps.select("cls", *SKETCH), "cls")
                        .withColumn("shared", F.col("pos")).withColumn("rank", F.col("size")), "lists")
    left = _hub_rounds(lists, linker, 1)
    if not left.isEmpty():
        few = left.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= SHORT_LIST).select("token")
        _all_pairs(left.join(few, "token"), linker)
        long = _with_components(left.join(few, "token", "left_anti").drop("comp"), linker)
        old, left = left, stage_table(_within(long, _mixed(long, percent), percent), "lists")
        discard(old)
    if not left.isEmpty():
        left = _hub_rounds(_exact_lists(linker, left.select("cls").distinct()), linker, 3)
        if not left.isEmpty():
            _all_pairs(left, linker)
    rows = profiles.select("doc_id", F.col("size").alias("n_shingles"), "cls")
    if linker.comps is not None:
        c = linker.comps.select(F.col("node").alias("cls"), "comp")
        rows = rows.join(c, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    else:
        rows = rows.withColumn("comp", F.col("cls"))
    names = rows.where(F.col("comp").isNotNull()).groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    return rows.join(names, "comp", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_per_group(docs: DataFrame, n: int = 5, percent: int = 80, key: str = "doc_id",
                  text: str = "text") -> DataFrame:
    """One row of each component, all columns kept: that of least id (rows without an id
    come last), one of them if several rows have it. Rows are told apart by a number of
    their own, so an id may be repeated, null, or carry several texts."""
    rows = stage_table(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    found = groups(rows, n, percent, "_row", text).select(F.col("doc_id").alias("_row"), "component_id")
    kept = rows.select("_row", F.col(key).alias("id")).join(found, "_row").groupBy("component_id") \
        .agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "_row"))["_row"].alias("_row"))
    return rows.join(kept.select("_row"), "_row", "left_semi").select(*docs.columns)
