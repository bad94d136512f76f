"""Helpers shared by the text operators: byte-level tokenising in numpy over
Arrow buffers, 64-bit fingerprints, stage tables.

Texts are handled as UTF-8 bytes straight from the Arrow string buffer, in
blocks of a few megabytes, so a task's memory does not depend on how many rows
an Arrow batch holds. A fingerprint is a pair of polynomials over the bytes modulo
2^31 - 1 (62 bits), finished by a bijective mixer; any byte range of a block costs
O(1). Powers of two as a modulus would not do: there some pairs of unlike strings
agree for every base (Thue-Morse words).
"""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .. import session
from ..session import cut_lineage, delete_table

U64 = np.uint64
BLOCK_BYTES = (1 << 20) - 64  # bytes of text worked on at once
BATCH_ROWS = 2000  # texts that go to Python at once, unless the cluster set a number
SPAN = 1 << 20  # positions whose inverse powers are kept in a table, whatever the length of a text
STEP = 1 << 15  # numbers worked on at once: they stay in the processor's cache

PRIME = (1 << 31) - 1
_rng = np.random.default_rng(20240607)
_BASES = [int(x) for x in _rng.integers(1 << 20, PRIME - 1, 2)]
_BYTE = _rng.integers(1, PRIME, (2, 256)).astype(U64)

ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True

_TABLES: list[tuple[np.ndarray, np.ndarray]] = []


def _fold(x: np.ndarray) -> np.ndarray:
    """Numbers below 2^63 to equal ones modulo the prime below 2^33, in place."""
    high = x >> U64(31)
    x &= U64(PRIME)
    x += high
    return x


def _mod(x: np.ndarray) -> np.ndarray:
    """``x`` modulo the Mersenne prime, in place."""
    _fold(_fold(x))
    x[x >= U64(PRIME)] -= U64(PRIME)
    return x


def _powers(k: int) -> tuple[np.ndarray, np.ndarray]:
    """STEP powers of base ``k`` and SPAN of its inverse; kept per worker."""
    while len(_TABLES) < 2:
        made = []
        base = _BASES[len(_TABLES)]
        for step, size in ((base, STEP), (pow(base, -1, PRIME), SPAN)):
            p = np.ones(size, U64)
            have = 1
            while have < size:
                p[have:2 * have] = _mod(p[:have] * U64(step))
                have, step = 2 * have, step * step % PRIME
            made.append(p)
        _TABLES.append((made[0], made[1].astype(np.uint32)))
    return _TABLES[k]


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser (bijective)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Block:
    """Some documents' bytes laid end to end. ``offs[i]:offs[i+1]`` is document i."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, first: int):
        self.data, self.offs, self.first = data, offs, first
        self.n = len(offs) - 1

    def lowered(self) -> Block:
        return Block(ASCII_LOWER[self.data], self.offs, self.first)

    def prefix(self) -> np.ndarray:
        """Running polynomial sums modulo a prime for two bases; feeds ``ranges``."""
        n = len(self.data)
        c = np.zeros((2, n + 1), np.uint32)
        for k in (0, 1):
            pw, _ = _powers(k)
            carry, shift, turn = U64(0), 1, pow(_BASES[k], STEP, PRIME)
            for lo in range(0, n, STEP):
                part = _BYTE[k][self.data[lo:lo + STEP]]
                part *= pw[:len(part)]
                np.cumsum(_fold(part), out=part)  # below 2^48
                _fold(part)
                part *= U64(shift)
                _fold(part)
                part += carry
                c[k, lo + 1:lo + 1 + len(part)] = _mod(part)
                carry, shift = part[-1], shift * turn % PRIME
        return c

    @staticmethod
    def ranges(c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Fingerprints of the byte ranges [lo, hi): equal bytes, equal value. Two
        polynomials modulo 2^31 - 1 and the length: unequal ranges of n bytes agree on one
        for at most n of its 2^31 bases."""
        out = np.empty(len(lo), U64)
        most = int(lo.max()) // SPAN if len(lo) else 0
        for i in range(0, len(lo), STEP):
            first, end = lo[i:i + STEP], hi[i:i + STEP]
            part = np.zeros(len(first), U64)
            for k in (0, 1):
                x = c[k][end].astype(U64)
                x += U64(PRIME)
                x -= c[k][first]
                x *= _powers(k)[1][first % SPAN if most else first]
                if most:
                    back = np.array([pow(_BASES[k], -SPAN * j, PRIME) for j in range(most + 1)], U64)
                    _fold(_fold(x))
                    x *= back[first // SPAN]
                part <<= U64(31)
                part += _mod(x)
            part += (end - first).astype(U64) * U64(0xD6E8FEB86659FD93)
            out[i:i + STEP] = mix(part)
        return out

    def words(self, is_sep: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and document numbers of the maximal runs of non-separators."""
        inside = np.zeros(len(self.data) + 2, bool)
        inside[1:-1] = ~is_sep[self.data]
        edge = np.zeros(len(self.data) + 1, bool)
        edge[self.offs] = True
        start = inside[1:] & (~inside[:-1] | edge)
        end = inside[:-1] & (~inside[1:] | edge)
        s, e = np.flatnonzero(start), np.flatnonzero(end)
        return s, e, self.doc_of(s)

    def doc_of(self, pos: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offs, pos, "right") - 1

    def per_doc(self, docs: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        out = np.bincount(docs, weights=weights, minlength=self.n)
        return out if weights is None else np.rint(out).astype(np.int64)

    def text(self, i: int) -> bytes:
        return self.data[self.offs[i]:self.offs[i + 1]].tobytes()


def blocks(column: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a string column into blocks of whole documents; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return
    _, ob, db = column.buffers()
    offs = np.frombuffer(ob, np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(db, np.uint8) if db is not None and db.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + block_bytes, "right")) - 1)
        j = min(j, n)
        yield Block(data[offs[i]:offs[j]], (offs[i:j + 1] - offs[i]).astype(np.int64), i)
        i = j


def as_signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def order_within(d: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Order by document (already ascending), then value: one sort of the document and the
    value's high bits, unless these leave different values of a document equal."""
    if len(d) and d[-1] < 1 << 20:
        x = d.astype(U64) << U64(44) | g >> U64(20)
        order = np.argsort(x)
        x, v = x[order], g[order]
        if not ((x[1:] == x[:-1]) & (v[1:] != v[:-1])).any():
            return order
    return np.lexsort((g, d))


def shingle_hashes(b: Block, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingles of each document: (document number, fingerprint),
    sorted by document, then fingerprint. Fewer than n words: the whole sequence
    is one shingle; no words: none. ASCII letters are lower-cased."""
    b = b.lowered()
    s, e, d = b.words()
    if not len(s):
        return np.zeros(0, np.int64), np.zeros(0, U64)
    h = b.ranges(b.prefix(), s, e)
    count = b.per_doc(d)
    total = len(h)
    acc = np.zeros(total, U64)
    own = np.zeros(total, np.int64)  # words of this shingle that exist
    for k in range(min(n, total)):
        m = total - k
        same = d[k:] == d[:m]
        acc[:m][same] = acc[:m][same] * U64(0xFF51AFD7ED558CCD) + h[k:][same]
        own[:m][same] += 1
    first = np.concatenate(([True], d[1:] != d[:-1]))
    keep = (own == n) | (first & (count[d] < n))
    d, g = d[keep], mix(acc[keep] + own[keep].astype(U64) * U64(0xC2B2AE3D27D4EB4F))
    order = order_within(d, g)
    d, g = d[order], g[order]
    new = np.concatenate(([True], (d[1:] != d[:-1]) | (g[1:] != g[:-1])))
    return d[new], g[new]


def ready(spark: SparkSession) -> SparkSession:
    """``session.ready`` for texts: Spark's 10,000 rows a batch are tens of megabytes, which the
    JVM's writer and the Python worker of every task would each hold, some of them twice."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows, None) is None:
        spark.conf.set(rows, str(BATCH_ROWS))
    return session.ready(spark)


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back. Before, Spark
    drops the shuffle files of the stages that are finished."""
    release(df.sparkSession)
    return cut_lineage(df, f"llm-{name}")


def discard(df: DataFrame | None) -> None:
    """Delete a stage table that no plan reads any more."""
    if df is None:
        return
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        delete_table(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Shuffle files live until the driver collects the plans that own them; do so
    now, so that a long job's disk use is that of its running stage."""
    gc.collect()
    jvm = getattr(spark.sparkContext, "_jvm", None)
    if jvm is not None:
        jvm.System.gc()


def scan_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


WORD = re.compile(r"[^\x20\x09-\x0D]+")

__all__ = ["ASCII_LOWER", "Block", "IS_SPACE", "U64", "WORD", "as_signed", "blocks", "discard", "mix", "order_within", "ready", "release",
           "scan_partitions", "shingle_hashes", "stage_table"]
