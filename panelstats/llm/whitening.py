"""Embedding whitening by incremental eigendecomposition (operator 13).

1. Each partition of the fit list starts with a zero spectrum and takes its vectors one
   by one: the scatter matrix about the running mean grows by a centred rank-one term,
   whose new eigenvalues are the roots of a secular equation. Entries that need no
   update (zero weight, equal eigenvalues) are deflated first.
2. Spectra of partitions are combined in a tree: the scatter of two lists is the first
   one plus the second one's eigenpairs, plus the difference of the means, all of them
   rank-one updates.
3. Rayleigh-Ritz passes over the whole fit list project the centred vectors on the
   basis found; the small problem's eigenvectors turn the basis, until the projected
   covariance is diagonal to double precision.

State is one spectrum of ``d * d`` numbers, whatever the number of rows; only the final
one comes to the driver (``d`` up to 4,096: 128 MB). Its cost per vector is ``d**3``.

Rows whose vector is null or holds a null, NaN or infinite entry are left out, as are
vectors of another length than the commonest one (ties: the longer; length 0 never).
Repeated rows stay; the fit list holds each distinct vector once. Directions without
variance (rank below ``k``, a single vector) give no component, so such a table has
fewer or no rows. Null ids stay null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

FAN_IN = 8  # spectra combined in one task of the tree
MAX_DIMENSION = 4096
DEFLATE = 8 * np.finfo(float).eps
DIAGONAL = 64 * np.finfo(float).eps
SLAB = 4096  # vectors worked on at once
TASK_VECTORS = 8192  # vectors per first spectrum: an update costs far more than to read its vector


def secular_roots(d: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of ``1 + sum(w / (d - x))`` for ascending ``d`` and positive ``w``, one in
    each interval: the index of the nearest pole and the distance from it."""
    k = len(d)
    upper = np.append(d[1:], d[-1] + w.sum() * (1 + 1e-9))
    width = upper - d
    middle = 1 + (w / (d - (d + width / 2)[:, None])).sum(1)
    left = middle >= 0  # the root lies in the left half
    left[-1] = True
    near = np.where(left, np.arange(k), np.minimum(np.arange(k) + 1, k - 1))
    gap = d - d[near][:, None]  # poles as seen from the nearest one
    lo = np.where(left, 0.0, -width / 2)
    hi = np.where(left, np.where(np.arange(k) < k - 1, width / 2, width), 0.0)
    x = (lo + hi) / 2
    a, b = gap[np.arange(k), np.arange(k)], np.append(np.diagonal(gap, 1), 0.0)
    last = np.arange(k) == k - 1
    active = np.ones(k, bool)
    low = np.tri(k)
    high = 1 - low
    for _ in range(100):
        with np.errstate(divide="ignore", invalid="ignore"):
            t = w / (gap - x[:, None])
            slope = t / (gap - x[:, None])
            below, above = np.einsum("ij,ij->i", t, low), np.einsum("ij,ij->i", t, high)
            f = 1 + below + above
            tiny = 4 * k * np.finfo(float).eps * (1 + np.abs(below) + np.abs(above))
            active &= ~(np.abs(f) <= tiny) & (hi - lo > 4 * np.finfo(float).eps * np.maximum(np.abs(lo), np.abs(hi)))
            if not active.any():
                break
            # f rises through each interval: keep the bracket.
            lo, hi = np.where(active & (f < 0), x, lo), np.where(active & (f > 0), x, hi)
            # Middle way: c + p / (a - x) + q / (b - x) with both sides' slopes.
            ps, qs = np.einsum("ij,ij->i", slope, low), np.einsum("ij,ij->i", slope, high)
            p, q = ps * (a - x) ** 2, qs * (b - x) ** 2
            c = f - ps * (a - x) - np.where(last, 0.0, qs * (b - x))
            # c (a-y)(b-y) + p (b-y) + q (a-y) = 0 in y; the last has one pole.
            B = c * (a + b) + p + q
            C = c * a * b + p * b + q * a
            root = np.sqrt(np.maximum(B * B - 4 * c * C, 0))
            y1 = np.where(B >= 0, 2 * C / (B + root), (B - root) / (2 * c))
            y2 = np.where(B >= 0, (B + root) / (2 * c), 2 * C / (B - root))
            y = np.where((y1 > lo) & (y1 < hi), y1, y2)
            y = np.where(last, a + p / c, y)
        y = np.where(np.isfinite(y) & (y > lo) & (y < hi), y, (lo + hi) / 2)
        x = np.where(active, y, x)
    return near, x


def rank_one(lam: np.ndarray, q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum (ascending) of ``q @ diag(lam) @ q.T + v @ v.T``."""
    z = q.T @ v
    scale = max(lam[-1], z @ z)
    if not scale > 0:
        return lam, q
    # Equal eigenvalues: turn their subspace so that one direction carries all of z.
    tol = DEFLATE * scale
    starts = np.flatnonzero(np.concatenate(([True], np.diff(lam) > tol, [True])))
    for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if hi - lo > 1:
            part = z[lo:hi].copy()
            size = np.linalg.norm(part)
            if size > 0:
                u = part.copy()
                u[-1] += np.copysign(size, u[-1])
                u /= np.linalg.norm(u)
                q = q.copy()
                q[:, lo:hi] -= 2 * np.outer(q[:, lo:hi] @ u, u)
                z[lo:hi] = 0
                z[hi - 1] = -np.copysign(size, part[-1])
    use = np.flatnonzero(np.abs(z) * np.sqrt(scale) > tol)
    if not len(use):
        return lam, q
    d, w = lam[use], z[use] ** 2
    near, x = secular_roots(d, w)
    # Roots minus poles without cancellation, then weights for which they are exact
    # roots (Gu and Eisenstat), so that the eigenvectors are orthogonal.
    apart = x[None, :] + (d[near][None, :] - d[:, None])  # [pole, root]
    k = len(d)
    poles = d[None, :] - d[:, None]
    np.fill_diagonal(poles, 1.0)
    ratio = apart.copy()
    ratio[:, :] /= poles
    diag = np.diagonal(apart).copy()
    ratio[np.arange(k), np.arange(k)] = 1.0
    weight = np.sqrt(np.abs(ratio.prod(1) * diag)) * np.copysign(1.0, z[use])
    vec = weight[:, None] / -apart
    vec /= np.linalg.norm(vec, axis=0)
    new_lam, new_q = lam.copy(), q.copy()
    new_lam[use] = d[near] + x
    new_q[:, use] = q[:, use] @ vec
    by = np.argsort(new_lam, kind="stable")
    return new_lam[by], new_q[:, by]


class Spectrum:
    """Number, sum, mean and scatter (as eigenpairs) of some vectors."""

    def __init__(self, dim: int):
        self.n, self.sums = 0, np.zeros(dim, object)
        self.mean, self.lam, self.q = np.zeros(dim), np.zeros(dim), np.eye(dim)

    def add(self, x: np.ndarray) -> None:
        off = x - self.mean
        self.n += 1
        if self.n > 1:
            self.lam, self.q = rank_one(self.lam, self.q, off * np.sqrt((self.n - 1) / self.n))
        self.mean = self.mean + off / self.n

    def merge(self, other: Spectrum) -> None:
        if not other.n:
            return
        if self.n:
            for lam, q in zip(other.lam[::-1], other.q.T[::-1], strict=True):
                if lam > 0:
                    self.lam, self.q = rank_one(self.lam, self.q, q * np.sqrt(lam))
            off, n = other.mean - self.mean, self.n + other.n
            self.lam, self.q = rank_one(self.lam, self.q, off * np.sqrt(self.n * (other.n / n)))
            self.mean = self.mean + off * (other.n / n)
            self.n = n
        else:
            self.n, self.mean, self.lam, self.q = other.n, other.mean, other.lam, other.q
        self.sums = self.sums + other.sums


SPECTRUM = "part bigint, n bigint, sums array<string>, mean array<double>, lam array<double>, q array<double>"


def spectrum_row(s: Spectrum, part: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "part": pa.array([part], pa.int64()), "n": pa.array([s.n], pa.int64()),
        "sums": pa.array([[str(v) for v in s.sums]], pa.list_(pa.string())),
        "mean": pa.array([s.mean]), "lam": pa.array([s.lam]), "q": pa.array([s.q.ravel()])})


def read_spectrum(row: dict) -> Spectrum:
    s = Spectrum(len(row["mean"]))
    s.n, s.sums = row["n"], np.array([int(v) for v in row["sums"]], object)
    s.mean, s.lam = np.array(row["mean"]), np.array(row["lam"])
    s.q = np.array(row["q"]).reshape(len(s.mean), -1)
    return s


def matrices(batches: Iterator[pa.RecordBatch], name: str, dim: int) -> Iterator[np.ndarray]:
    """Slabs of an array column of fixed length."""
    for batch in batches:
        for lo in range(0, batch.num_rows, SLAB):
            yield batch.column(name).slice(lo, SLAB).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def tree(df: DataFrame, schema: str, combine: Callable[[list[dict]], pa.RecordBatch], name: str) -> dict | None:
    """Combine the rows of ``df`` (numbered by ``part``) ``FAN_IN`` at a time until one is
    left. Each round is written, so that a lost executor costs one round at most."""
    df = cut_lineage(df, name)
    count = df.count()
    while count > 1:
        by_rank = df.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("bigint")).groupBy("part")

        def work(table: pa.Table) -> pa.Table:
            return pa.Table.from_batches([combine(table.to_pylist())])

        df = cut_lineage(by_rank.applyInArrow(work, schema), name)
        count = df.count()
    rows = df.collect()
    return rows[0].asDict() if rows else None


def partition_number() -> int:
    from pyspark import TaskContext
    return TaskContext.get().partitionId()


def spectrum_of(fit: DataFrame, dim: int) -> Spectrum:
    """Spectrum of the array column ``x`` of a written table."""
    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Spectrum(dim)
        for m in matrices(batches, "x", dim):
            s.sums = s.sums + m.astype(object).sum(0)
            for x in m.astype(float):
                s.add(x)
        if s.n:
            yield spectrum_row(s, partition_number())

    def combine(rows: list[dict]) -> pa.RecordBatch:
        s = read_spectrum(rows[0])
        for r in rows[1:]:
            s.merge(read_spectrum(r))
        return spectrum_row(s, rows[0]["part"])

    tasks = -(-fit.count() // TASK_VECTORS)
    fit = fit.repartition(tasks) if tasks > 1 else fit
    row = tree(fit.mapInArrow(start, SPECTRUM), SPECTRUM, combine, "spectra")
    return read_spectrum(row) if row else Spectrum(dim)


GRAM = "part bigint, gram array<double>"


def projected(fit: DataFrame, mean: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Sum of ``y.T @ y`` over the fit list, ``y`` the centred vectors on ``basis``."""
    dim, k = basis.shape

    def row(part: int, gram: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "gram": pa.array([gram.ravel()])})

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, any_rows = np.zeros((k, k)), False
        for m in matrices(batches, "x", dim):
            y = (m - mean) @ basis
            gram, any_rows = gram + y.T @ y, True
        if any_rows:
            yield row(partition_number(), gram)

    def combine(rows: list[dict]) -> pa.RecordBatch:
        return row(rows[0]["part"], np.sum([r["gram"] for r in rows], axis=0))

    found = tree(fit.mapInArrow(start, GRAM), GRAM, combine, "gram")
    return np.array(found["gram"]).reshape(k, k)


def refine(fit: DataFrame, s: Spectrum, rounds: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rayleigh-Ritz over the fit list: exact mean, falling eigenvalues and eigenvectors
    of its covariance."""
    mean = np.array([float(v) / s.n if abs(v) < 2 ** 53 else v / s.n for v in s.sums])
    basis = np.linalg.qr(s.q[:, ::-1])[0]
    lam = np.zeros(len(mean))
    for _ in range(rounds):
        t = projected(fit, mean, basis) / s.n
        t = (t + t.T) / 2
        off = np.abs(t - np.diag(np.diagonal(t))).max(initial=0)
        if off <= DIAGONAL * np.trace(t):
            lam = np.diagonal(t)
            by = np.argsort(-lam, kind="stable")
            return mean, lam[by], basis[:, by]
        lam, turn = np.linalg.eigh(t)
        lam, basis = lam[::-1], np.linalg.qr(basis @ turn[:, ::-1])[0]
    return mean, lam, basis


def clean_vectors(df: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """``key`` and ``x``: the entries times ``scale``, rounded down, of sound vectors."""
    v = F.col("v")
    unsound = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = df.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    return rows.where(v.isNotNull() & (F.size(v) > 0)).where(~unsound) \
        .select("key", F.transform(v, lambda c: F.floor(c * F.lit(float(scale))).cast("bigint")).alias("x"))


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 4, scale: int = 256) -> DataFrame:
    """One row per sound row and component up to ``k``: ``key``, ``component``, ``n`` (size
    of the fit list), ``deviation`` (sum of ``(n*x - S)**2``, null beyond a long),
    ``whitened``, ``explained`` and ``identity_error`` of the whole fit."""
    out = T.StructType([T.StructField("key", df.schema[key].dataType)] + T.StructType.fromDDL(
        "component int, n bigint, deviation bigint, whitened double, explained double").fields)
    rows = clean_vectors(df, key, vector, scale)
    lengths = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).head(1)
    if not lengths:
        return df.sparkSession.createDataFrame([], out).withColumn("identity_error", F.lit(None).cast("double")) \
            .withColumnRenamed("key", key)
    dim = lengths[0]["size"]
    if dim > MAX_DIMENSION:
        raise ValueError(f"vectors of {dim} entries; spectra are kept whole up to {MAX_DIMENSION}")
    rows = rows.where(F.size("x") == dim)
    fit = cut_lineage(rows.select("x").distinct(), "fit-list")
    s = spectrum_of(fit, dim)
    mean, lam, basis = refine(fit, s)
    total = lam.sum()
    found = int((lam[:k] > 1e-12 * max(total, 0)).sum()) if s.n > 1 else 0
    white = basis[:, :found] / np.sqrt(lam[:found])
    explained = lam[:found] / total if found else lam[:0]
    error = float(np.abs(projected(fit, mean, white) / s.n - np.eye(found)).max()) if found else None
    n, sums = s.n, s.sums
    safe = max((abs(int(v)) for v in sums), default=0)

    def deviation(m: np.ndarray) -> list[int | None]:
        most = n * int(np.abs(m).max(initial=0)) + safe
        wide = m.astype(object) if dim * most * most >= 2 ** 63 else m
        exact = ((wide * n - (sums if wide is not m else sums.astype(np.int64))) ** 2).sum(1)
        return [int(v) if v < 2 ** 63 else None for v in exact]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows if found else 0, SLAB):
                part = batch.slice(lo, SLAB)
                m = next(matrices(iter([part]), "x", dim))
                y = (m - mean) @ white
                each = np.repeat(np.arange(len(m)), found)
                yield pa.RecordBatch.from_arrays([
                    part.column("key").take(pa.array(each)), pa.array(np.tile(np.arange(1, found + 1, dtype=np.int32), len(m))),
                    pa.array(np.full(len(each), n)), pa.array(deviation(m), pa.int64()).take(pa.array(each)),
                    pa.array(y.ravel()), pa.array(np.tile(explained, len(m)))], names=out.names)

    return rows.mapInArrow(work, out).withColumn("identity_error", F.lit(error).cast("double")).withColumnRenamed("key", key)
