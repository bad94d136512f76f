"""Global cubic spline through the known points of each series (WN6).

The second derivatives at the known points solve a tridiagonal system. It is
eliminated in levels: known points are numbered and cut into buckets; inside a
bucket every unknown becomes an affine function of the first point of its own
and of the next bucket (at most ``BUCKET`` rows in one Arrow call); what is left
is a tridiagonal system over the first points, 64 times shorter, solved the same
way. No task sees a whole series, and each level costs two joins on
(keys, number).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .windows import running_sums_long

BUCKET = 64

_LIST = T.ArrayType(T.DoubleType())
_AFFINE = T.StructType([T.StructField(c, _LIST) for c in ("p", "q", "r")])


def _thomas(lo: np.ndarray, di: np.ndarray, up: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """Solve many tridiagonal systems at once; ``rhs`` is (systems, rows, right sides)."""
    rows = di.shape[1]
    c, d = np.zeros_like(di), np.zeros_like(rhs)
    for i in range(rows):
        below = lo[:, i] if i else np.zeros(len(di))
        den = di[:, i] - below * (c[:, i - 1] if i else 0.0)
        c[:, i] = up[:, i] / den
        d[:, i] = (rhs[:, i] - below[:, None] * (d[:, i - 1] if i else 0.0)) / den[:, None]
    for i in range(rows - 2, -1, -1):
        d[:, i] -= c[:, i, None] * d[:, i + 1]
    return d


@F.pandas_udf(_AFFINE)
def _eliminate(lo: pd.Series, di: pd.Series, up: pd.Series, rhs: pd.Series) -> pd.DataFrame:
    """Unknowns of a bucket as p + q·(unknown before it) + r·(unknown after it)."""
    sizes = np.array([len(v) for v in di], dtype=int)
    rows = int(sizes.max(initial=0))
    pad = {}
    for name, column, filler in (("lo", lo, 0.0), ("di", di, 1.0), ("up", up, 0.0), ("rhs", rhs, 0.0)):
        pad[name] = np.full((len(sizes), rows), filler)
        for i, v in enumerate(column):
            pad[name][i, :len(v)] = v
    sides = np.zeros((len(sizes), rows, 3))
    sides[:, :, 0] = pad["rhs"]
    some = np.flatnonzero(sizes)
    if rows:
        sides[some, 0, 1] = -pad["lo"][some, 0]
        sides[some, sizes[some] - 1, 2] = -pad["up"][some, sizes[some] - 1]
        pad["up"][some, sizes[some] - 1] = 0.0
    out = _thomas(pad["lo"], pad["di"], pad["up"], sides)
    return pd.DataFrame({c: [out[i, :n, j].tolist() for i, n in enumerate(sizes)] for j, c in enumerate("pqr")})


def solve_tridiagonal(eqs: DataFrame, keys: Sequence[str], longest: int, bucket: int = BUCKET) -> DataFrame:
    """keys, ``_k``, ``_m``: the solution of lo·m[k−1] + di·m[k] + up·m[k+1] = rhs per group.

    ``eqs`` has keys, ``_k`` = 0, 1, 2, … and the doubles ``lo di up rhs`` (``lo`` of the first
    and ``up`` of the last row are 0); ``longest`` is the number of rows of the longest group.
    """
    keys = list(keys)
    row = F.struct("_k", "lo", "di", "up", "rhs")
    b = eqs.groupBy(*keys, F.floor(F.col("_k") / bucket).alias("_b")).agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    whole = longest <= bucket
    inner = F.col("_rows") if whole else F.slice("_rows", 2, bucket)
    b = b.withColumn("_in", inner)
    b = b.withColumn("_e", _eliminate("_in.lo", "_in.di", "_in.up", "_in.rhs"))
    if whole:
        return b.select(*keys, F.explode(F.arrays_zip(F.col("_in._k").alias("k"), F.col("_e.p").alias("p"))).alias("_z")) \
            .select(*keys, F.col("_z.k").alias("_k"), F.col("_z.p").alias("_m"))
    b = cut_lineage(b.select(*keys, "_b", F.get("_rows", F.lit(0)).alias("_sep"), F.col("_in._k").alias("_ks"), "_e"),
                    "tridiagonal")

    def at(field: str, i: Column) -> Column:
        return F.coalesce(F.get(F.col(f"_e.{field}"), i), F.lit(0.0))

    last = F.size("_ks") - 1
    before = b.select(*keys, (F.col("_b") + 1).alias("_b"), *[at(c, last).alias(f"_{c}0") for c in "pqr"])
    j = b.join(before, on=[*keys, "_b"], how="left")
    lo, di, up, rhs = (F.col(f"_sep.{c}") for c in ("lo", "di", "up", "rhs"))
    p0, q0, r0 = (F.coalesce(F.col(f"_{c}0"), F.lit(0.0)) for c in "pqr")
    p1, q1, r1 = (at(c, F.lit(0)) for c in "pqr")
    reduced = j.select(*keys, F.col("_b").alias("_k"), (lo * q0).alias("lo"), (di + lo * r0 + up * q1).alias("di"),
                       (up * r1).alias("up"), (rhs - lo * p0 - up * p1).alias("rhs"))
    sep = cut_lineage(solve_tridiagonal(reduced, keys, -(-longest // bucket), bucket), "tridiagonal")
    own = sep.select(*keys, F.col("_k").alias("_b"), F.col("_m").alias("_left"))
    after = sep.select(*keys, (F.col("_k") - 1).alias("_b"), F.col("_m").alias("_right"))
    s = b.join(own, on=[*keys, "_b"]).join(after, on=[*keys, "_b"], how="left")
    zipped = F.arrays_zip(F.col("_ks").alias("k"), F.col("_e.p").alias("p"), F.col("_e.q").alias("q"), F.col("_e.r").alias("r"))
    m = F.transform(zipped, lambda z: F.struct(z["k"].alias("k"), (
        z["p"] + z["q"] * F.col("_left") + z["r"] * F.coalesce("_right", F.lit(0.0))).alias("m")))
    first = F.array(F.struct(F.col("_sep._k").alias("k"), F.col("_left").alias("m")))
    return s.select(*keys, F.explode(F.concat(first, m)).alias("_z")) \
        .select(*keys, F.col("_z.k").alias("_k"), F.col("_z.m").alias("_m"))


def _beside(points: DataFrame, keys: list[str], values: Sequence[str], offsets: Sequence[int]) -> DataFrame:
    """keys, ``_k``, ``_at0`` … : each numbered row with its neighbours at the given offsets (one exchange)."""
    sent = points.select(*keys, "_k", F.struct(*values).alias("_p"),
                         F.explode(F.array(*[F.lit(o) for o in offsets])).alias("_o"))
    name = {o: f"_at{i}" for i, o in enumerate(offsets)}
    g = sent.groupBy(*keys, (F.col("_k") - F.col("_o")).alias("_k")).agg(
        *[F.max(F.when(F.col("_o") == o, F.col("_p"))).alias(name[o]) for o in offsets])
    return g.where(F.col(name[0]).isNotNull())


def _third_derivative(pts: Sequence[Column]) -> Column:
    """Third derivative of the cubic through four points; 0 where one is missing."""
    total = F.lit(0.0)
    for i, a in enumerate(pts):
        den = F.lit(1.0)
        for j, b in enumerate(pts):
            if i != j:
                den = den * (a["_x"] - b["_x"])
        total = total + a["_v"] / den
    return F.coalesce(6 * total, F.lit(0.0))


def fill_spline(df: DataFrame, col: str, keys: Sequence[str], order: str, bucket_col: str | None = None,
                ends: str = "fitted", out: str | None = None, bucket: int = BUCKET) -> DataFrame:
    """Missing values from the interpolating cubic spline on row position, edges included.

    ``ends='fitted'``: the third derivative at either end is that of the cubic through the four
    outermost known points (Forsythe, Malcolm, Moler), and the outer cubics are continued beyond
    the known points. ``ends='natural'``: no curvature at the ends, straight lines beyond. Two
    known points give a line, three a parabola (fitted); with fewer than two the column stays as
    it is. ``bucket_col``: integer column that follows ``order`` (default: ``order`` itself).
    """
    if ends not in ("fitted", "natural"):
        raise ValueError(f"unknown ends {ends!r}")
    keys, out = list(keys), out or f"{col}_spline"
    base = running_sums_long(df, {"_seen": F.col(col).isNotNull().cast("long")}, keys, order, bucket_col or order)
    base = cut_lineage(base, "spline_rows")
    points = base.where(F.col(col).isNotNull()).select(
        *keys, (F.col("_seen").cast("long") - 1).alias("_k"), F.col("pos").cast("double").alias("_x"),
        F.col(col).cast("double").alias("_v"))
    size = points.groupBy(*keys).agg((F.max("_k") + 1).alias("_n"))
    longest = size.agg(F.max("_n")).first()[0] or 0
    if longest < 2:
        return df.withColumn(out, F.col(col).cast("double"))

    n, k = F.col("_n"), F.col("_k")
    outer = points.join(size, on=keys).where((k < 4) | (k >= n - 4))
    pt = F.struct("_x", "_v")
    outer = outer.groupBy(*keys).agg(F.first("_n").alias("_n"), *[F.max(F.when(k == i, pt)).alias(f"_h{i}") for i in range(4)],
                                     *[F.max(F.when(k == n - 4 + i, pt)).alias(f"_t{i}") for i in range(4)])
    outer = outer.select(*keys, "_n", _third_derivative([F.col(f"_h{i}") for i in range(4)]).alias("_d0"),
                         _third_derivative([F.col(f"_t{i}") for i in range(4)]).alias("_d1"))

    at = _beside(points, keys, ["_x", "_v"], [0, -1, 1]).join(outer, on=keys)
    here, left, right = F.col("_at0"), F.col("_at1"), F.col("_at2")
    hl, hr = here["_x"] - left["_x"], right["_x"] - here["_x"]
    inner = left.isNotNull() & right.isNotNull()
    bent = F.lit(ends == "fitted") & (n > 2)
    is_first, is_last = bent & left.isNull(), bent & right.isNull()
    zero = F.lit(0.0)
    eqs = at.select(
        *keys, "_k",
        F.when(inner, hl).when(is_last, F.lit(-1.0)).otherwise(zero).alias("lo"),
        F.when(inner, 2 * (hl + hr)).when(is_first, F.lit(-1.0)).otherwise(F.lit(1.0)).alias("di"),
        F.when(inner, hr).when(is_first, F.lit(1.0)).otherwise(zero).alias("up"),
        F.when(inner, 6 * ((right["_v"] - here["_v"]) / hr - (here["_v"] - left["_v"]) / hl))
        .when(is_first, hr * F.col("_d0")).when(is_last, hl * F.col("_d1")).otherwise(zero).alias("rhs"))
    bends = solve_tridiagonal(eqs, keys, longest, bucket)

    pieces = _beside(points.join(bends, on=[*keys, "_k"]), keys, ["_x", "_v", "_m"], [0, 1]) \
        .where(F.col("_at1").isNotNull()).withColumnRenamed("_k", "_piece")
    rows = base.join(size, on=keys, how="left").withColumn(
        "_piece", F.greatest(F.lit(0), F.least(F.col("_seen").cast("long") - 1, n - 2)))
    j = rows.join(pieces, on=[*keys, "_piece"], how="left")
    (x0, v0, m0), (x1, v1, m1) = ([F.col(f"{p}.{c}") for c in ("_x", "_v", "_m")] for p in ("_at0", "_at1"))
    h, x = x1 - x0, F.col("pos").cast("double")
    t, s = x - x0, x1 - x
    value = (m0 * s * s * s + m1 * t * t * t) / (6 * h) + (v0 / h - m0 * h / 6) * s + (v1 / h - m1 * h / 6) * t
    if ends == "natural":
        slope = (v1 - v0) / h
        value = F.when(t < 0, v0 + t * (slope - h * (2 * m0 + m1) / 6)) \
            .when(s < 0, v1 - s * (slope + h * (m0 + 2 * m1) / 6)).otherwise(value)
    return j.select(*df.columns, F.coalesce(F.col(col).cast("double"), value).alias(out))
