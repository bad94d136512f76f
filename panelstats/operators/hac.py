"""Heteroskedasticity and autocorrelation robust covariances (RG13–RG18).

Scores u_t = x_t e_t (x_t with the intercept). For a fixed number of lags
the lag cross-sums Γ_l = Σ_t u_t u_{t-l}' are DataFrame work: window ``lag``
over the (bounded) series, ``explode`` of the (l, a, b) products and a
partial hash aggregate. The k×k sandwich (X'X)⁻¹ S (X'X)⁻¹ runs in an Arrow
UDF on the aggregated rows.

Data-driven bandwidths (quadratic-spectral kernel with Andrews' bandwidth,
Newey–West automatic lag) weight all pairs of positions within a group's own
reach: :func:`kernel_meat`, in tiles of position buckets.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.linalg import safe_inv, stack
from . import tiles as TL


def with_scores(res: DataFrame, xs: Sequence[str], resid: str = "resid", out: str = "u") -> DataFrame:
    """Add ``u`` = [e, x1·e, …] (score vector per row)."""
    e = F.col(resid)
    return res.withColumn(out, F.array(e, *[F.col(x) * e for x in xs]))


def hc_meat(sc: DataFrame, p: int, keys: Sequence[str], u: str = "u") -> DataFrame:
    """Σ u u' per group (p×p, row-major) — one aggregate."""
    aggs = [F.sum(F.col(u)[a] * F.col(u)[b]).alias(f"_h{a}_{b}") for a in range(p) for b in range(a, p)]
    g = sc.groupBy(*keys).agg(*aggs)
    cells = [F.col(f"_h{min(a, b)}_{max(a, b)}") for a in range(p) for b in range(p)]
    return g.select(*keys, F.array(*cells).alias("meat"))


def gamma_sums(sc: DataFrame, p: int, keys: Sequence[str], order: str, max_lag: int,
               u: str = "u") -> DataFrame:
    """keys + ``gam``: Γ_0..Γ_L flattened as [l][a][b] (Γ_l = Σ_t u_t u_{t-l}').

    Window lags of the score vector, then ONE aggregate with a sum per
    (l, a, b) — partial aggregation on the map side, no row explosion.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    lagged = sc.select(*keys, F.col(u).alias("_u0"),
                       *[F.lag(u, l).over(w).alias(f"_u{l}") for l in range(1, max_lag + 1)])
    sums = [F.coalesce(F.sum(F.col("_u0")[a] * F.col(f"_u{l}")[b]), F.lit(0.0))
            for l in range(max_lag + 1) for a in range(p) for b in range(p)]
    return lagged.groupBy(*keys).agg(F.array(*sums).alias("gam"))


def var1_prewhiten(sc: DataFrame, p: int, keys: Sequence[str], order: str, u: str = "u",
                   out: str = "v") -> DataFrame:
    """VAR(1) without intercept on the scores: v_t = u_t − A u_{t−1} (t ≥ 2).

    A = (Σ u_t u_{t−1}')(Σ u_{t−1} u_{t−1}')⁻¹ from one aggregate; it is joined
    back (one row per series) and D = (I − A)⁻¹ is returned with it.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    d = sc.withColumn("_ul", F.lag(u, 1).over(w))
    aggs = []
    for a in range(p):
        for b in range(p):
            aggs.append(F.sum(F.col(u)[a] * F.col("_ul")[b]).alias(f"_c{a}_{b}"))
            aggs.append(F.sum(F.col("_ul")[a] * F.col("_ul")[b]).alias(f"_l{a}_{b}"))
    g = d.groupBy(*keys).agg(*aggs)
    g = g.select(*keys, var1_udf(F.array(*[F.col(f"_c{a}_{b}") for a in range(p) for b in range(p)]),
                                 F.array(*[F.col(f"_l{a}_{b}") for a in range(p) for b in range(p)])).alias("_var"))
    j = d.join(g, on=list(keys))
    A = F.col("_var.A")
    v = F.array(*[F.col(u)[a] - sum((A[a * p + b] * F.col("_ul")[b] for b in range(p)), F.lit(0.0))
                  for a in range(p)])
    return j.filter(F.col("_ul").isNotNull()).withColumn(out, v).withColumn("D", F.col("_var.D")) \
        .drop("_ul", "_var")


_VAR_SCHEMA = T.StructType([T.StructField("A", T.ArrayType(T.DoubleType())),
                            T.StructField("D", T.ArrayType(T.DoubleType()))])


@F.pandas_udf(_VAR_SCHEMA)
def var1_udf(cross: pd.Series, lagged: pd.Series) -> pd.DataFrame:
    pp = len(cross.iloc[0])
    p = int(round(math.sqrt(pp)))
    C = stack(cross, pp).reshape(-1, p, p)
    L = stack(lagged, pp).reshape(-1, p, p)
    inv, keep = safe_inv(L)
    both = keep[:, :, None] & keep[:, None, :]
    A = np.einsum("gij,gjk->gik", np.where(both, C, 0.0), inv)
    B = np.eye(p)[None] - A
    ok = np.isfinite(B).all(axis=(1, 2))
    B = np.where(ok[:, None, None], B, np.eye(p)[None])
    ok &= np.linalg.cond(B) < 1e12  # a unit root in the scores: no recolouring, NULL
    D = np.where(ok[:, None, None], np.linalg.inv(np.where(ok[:, None, None], B, np.eye(p)[None])), np.nan)
    return pd.DataFrame({"A": list(A.reshape(len(A), -1)), "D": list(D.reshape(len(D), -1))})


# ------------------------------------------------------------------ kernels
def bartlett_weights(L: int) -> np.ndarray:
    """Newey–West weights 1 − l/(L+1), l = 0..L."""
    return 1.0 - np.arange(L + 1) / (L + 1.0)


def bartlett_bw_weights(bw: float, n: int) -> np.ndarray:
    """Bartlett kernel with bandwidth bw: 1 − l/bw for l < bw."""
    l = np.arange(n)
    w = 1.0 - l / bw
    return w[w > 0]


_SE = T.ArrayType(T.DoubleType())


def _square(series: pd.Series) -> tuple[np.ndarray, int]:
    width = max((len(v) for v in series.to_numpy() if v is not None), default=0)
    p = int(round(math.sqrt(width)))
    return stack(series, width).reshape(-1, p, p), p


def _sandwich_batch(M: np.ndarray, S: np.ndarray, scale: np.ndarray) -> pd.Series:
    V = np.einsum("gij,gjk,gkl->gil", M, S, M) * scale[:, None, None]
    with np.errstate(invalid="ignore"):
        se = np.sqrt(np.einsum("gii->gi", V))
    se = np.where(np.einsum("gii->gi", M) > 0, se, np.nan)  # aliased columns have none
    return pd.Series([[float(v) if np.isfinite(v) else None for v in row] for row in se])


def hac_se_udf(kind: str, param: float, adjust: bool):
    """Arrow UDF: (xtx_inv, gam, n, D) → se array; ``kind`` 'nw' (lag L) or
    'bartlett' (bandwidth). Vectorised over the batch of groups."""

    @F.pandas_udf(_SE)
    def _udf(xtx_inv: pd.Series, gam: pd.Series, n: pd.Series, dmat: pd.Series) -> pd.Series:
        M, p = _square(xtx_inv)
        G = stack(gam, max(len(v) for v in gam.to_numpy())).reshape(len(gam), -1, p, p)
        w = bartlett_weights(int(param)) if kind == "nw" else bartlett_bw_weights(param, G.shape[1])
        L = min(len(w), G.shape[1]) - 1
        S = w[0] * G[:, 0]
        for l in range(1, L + 1):
            S = S + w[l] * (G[:, l] + np.swapaxes(G[:, l], 1, 2))
        if dmat.notna().any():
            D, _ = _square(dmat)
            S = np.einsum("gij,gjk,glk->gil", D, S, D)
        nn = n.to_numpy(float)
        scale = nn / (nn - p) if adjust else np.ones_like(nn)
        return _sandwich_batch(M, S, scale)

    return _udf


@F.pandas_udf(_SE)
def hc1_se_udf(xtx_inv: pd.Series, meat: pd.Series, n: pd.Series) -> pd.Series:
    M, p = _square(xtx_inv)
    S, _ = _square(meat)
    nn = n.to_numpy(float)
    return _sandwich_batch(M, S, nn / (nn - p))


# ------------------------------------------------- data-driven bandwidths
def positions(rows: DataFrame, keys: Sequence[str], order: str, buckets: str | None = None) -> DataFrame:
    """``rows`` with ``pos``; ``buckets`` (an integer column) for very long series."""
    if buckets is None:
        return rows.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    from .windows import running_sums_long
    return running_sums_long(rows, {"_one": F.lit(1)}, keys, order, buckets).drop("_one")


def lagged(rows: DataFrame, keys: Sequence[str], value: str, lags: int) -> DataFrame:
    """Each row once per lag 1..lags that reaches an earlier row, as ``lag`` and ``past``: an
    equi-join on the position, which spreads a long series over tasks."""
    past = rows.select(*keys, F.col(value).alias("past"), F.explode(F.sequence(F.lit(1), F.lit(lags))).alias("lag"),
                       F.col("pos").alias("_at"))
    past = past.withColumn("pos", F.col("_at") + F.col("lag")).drop("_at")
    return rows.join(past, on=[*keys, "pos"])


def andrews_bandwidth(sc: DataFrame, p: int, keys: Sequence[str], weigh_first: bool = False, u: str = "u") -> DataFrame:
    """Andrews (1991) AR(1) plug-in bandwidth of the quadratic-spectral kernel: keys, ``_n``,
    ``bandwidth``. First-order sums of each score are one aggregate over rows joined with
    the row before. The intercept's score has no weight unless ``weigh_first``."""
    use = range(0 if weigh_first else 1, p)
    j = lagged(sc.select(*keys, "pos", u), keys, u, 1)
    sums = [F.sum(a * b).alias(f"_{n}{i}") for i in use for n, a, b in (
        ("uu", F.col(u)[i], F.col(u)[i]), ("ul", F.col(u)[i], F.col("past")[i]), ("ll", F.col("past")[i], F.col("past")[i]))]
    g = j.groupBy(*keys).agg((F.count(F.lit(1)) + 1).cast("double").alias("_n"), *sums)
    num = den = F.lit(0.0)
    for i in use:
        rho = F.try_divide(F.col(f"_ul{i}"), F.col(f"_ll{i}"))
        s2 = F.pow(F.try_divide(F.col(f"_uu{i}") - 2 * rho * F.col(f"_ul{i}") + rho * rho * F.col(f"_ll{i}"), F.col("_n") - 1), F.lit(2.0))
        num = num + F.try_divide(4 * rho * rho * s2, F.pow(1 - rho, F.lit(8.0)))
        den = den + F.try_divide(s2, F.pow(1 - rho, F.lit(4.0)))
    return g.select(*keys, "_n", (1.3221 * F.pow(F.try_divide(num, den) * F.col("_n"), F.lit(0.2))).alias("bandwidth"))


#: The quadratic-spectral weight is below 1e-7 for all lags beyond this many bandwidths.
QS_REACH = 1460.0


def kernel_weights(kind: str, lag: np.ndarray, bandwidth: np.ndarray) -> np.ndarray:
    """Weights of lags: 'bartlett' 1 − l/bandwidth below the bandwidth, or 'qs'."""
    with np.errstate(divide="ignore", invalid="ignore"):
        z = lag / bandwidth
        if kind == "bartlett":
            return np.where(z < 1, 1 - z, 0.0) + 0.0 * bandwidth
        a = 6 * np.pi * z / 5
        w = 25 / (12 * np.pi ** 2 * z ** 2) * (np.sin(a) / a - np.cos(a))
    return np.where(lag == 0, 1.0, np.where(z > QS_REACH, 0.0, w)) + 0.0 * bandwidth


def tile_meat_udf(kind: str, p: int):
    """Arrow UDF: sum of weight × u_s u_t' over the pairs of a tile, flattened."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def meat(a: pa.Array, b: pa.Array, a_at: pa.Array, b_at: pa.Array, bandwidth: pa.Array) -> pa.Array:
        out = np.empty((len(a), p * p))
        bw = bandwidth.to_numpy(zero_copy_only=False).astype(float)
        for lo, n in TL.pieces(len(a)):
            us, ut = TL.dense(a.slice(lo, n), p, 0.0), TL.dense(b.slice(lo, n), p, 0.0)
            s, t = TL.dense(a_at.slice(lo, n), 1, 0.0)[:, :, 0], TL.dense(b_at.slice(lo, n), 1, 0.0)[:, :, 0]
            w = kernel_weights(kind, np.abs(s[:, :, None] - t[:, None, :]), bw[lo:lo + n, None, None])
            out[lo:lo + n] = np.einsum("gsa,gst,gtb->gab", us, w, ut, optimize=True).reshape(n, -1)
        return TL.as_lists(out)

    return meat


def kernel_meat(sc: DataFrame, bandwidth: DataFrame, p: int, keys: Sequence[str], kind: str, block: Sequence[str] = (),
                u: str = "u") -> DataFrame:
    """S = Σ_s Σ_t w(|s − t|) u_s u_t' per group with the group's own ``bandwidth``: keys and
    ``meat``. Tiles of position buckets as far apart as the kernel reaches, then one sum of
    p² numbers per group, whatever the bandwidth.

    ``block``: columns (a regime) by which the scores lie in different blocks of the
    design; the result then has a row per pair of blocks, ``a_``/``b_`` columns."""
    rows = sc.select(*keys, *block, "pos", u).join(bandwidth.select(*keys, "bandwidth"), on=list(keys))
    whole = sc.groupBy(*keys).agg(F.max("pos").alias("_last"))
    b = TL.buckets(rows, keys, u, ["bandwidth"], block).join(whole, on=list(keys))
    reach = F.col("bandwidth") * (1.0 if kind == "bartlett" else QS_REACH)
    last = F.least(TL.bucket_of("_last"), F.col("bucket") + F.ceil(F.coalesce(reach, F.lit(0.0)) / TL.BUCKET) + 1)
    t = TL.spread(TL.tiles(b, keys, last, block), *keys, "a_bucket", "b_bucket")
    m = t.withColumn("_m", tile_meat_udf(kind, p)("a_flat", "b_flat", "a_places", "b_places", "bandwidth"))
    same = (F.col("a_bucket") == F.col("b_bucket"))
    turned = F.array(*[F.col("_m")[c * p + r] for r in range(p) for c in range(p)])
    # A pair of different buckets stands for both orders; blocks change places with it.
    as_is = F.struct(*[F.col(f"{e}_{c}").alias(f"{e}_{c}") for e in "ab" for c in block], F.col("_m").alias("m"))
    swapped = F.struct(*[F.col(f"{o}_{c}").alias(f"{e}_{c}") for e, o in ("ab", "ba") for c in block], turned.alias("m"))
    e = m.select(*keys, F.explode(F.when(same, F.array(as_is)).otherwise(F.array(as_is, swapped))).alias("_e")).select(*keys, "_e.*")
    names = [f"{x}_{c}" for x in "ab" for c in block]
    g = e.groupBy(*keys, *names).agg(*[F.sum(F.col("m")[i]).alias(f"_s{i}") for i in range(p * p)])
    return g.select(*keys, *names, F.array(*[F.col(f"_s{i}") for i in range(p * p)]).alias("meat"))


def meat_se_udf(adjust: bool):
    """Arrow UDF: (xtx_inv, meat, n, k) → se array; ``k`` is the number of coefficients that
    the degrees-of-freedom factor n/(n − k) counts."""

    @F.pandas_udf(_SE)
    def _udf(xtx_inv: pd.Series, meat: pd.Series, n: pd.Series, k: pd.Series) -> pd.Series:
        M, _ = _square(xtx_inv)
        S = stack(meat, M.shape[1] ** 2).reshape(M.shape)
        nn, kk = n.to_numpy(float), k.to_numpy(float)
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = np.where(nn > kk, nn / (nn - kk), np.nan) if adjust else np.ones_like(nn)
        return _sandwich_batch(M, S, scale)

    return _udf


def block_covariance_udf(adjust: bool):
    """Arrow UDF: A_a S_ab A_b × n/(n − k) per pair of blocks."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def _udf(a: pd.Series, meat: pd.Series, b: pd.Series, n: pd.Series, k: pd.Series) -> pd.Series:
        A, p = _square(a)
        B, S = stack(b, p * p).reshape(-1, p, p), stack(meat, p * p).reshape(-1, p, p)
        nn, kk = n.to_numpy(float), k.to_numpy(float)
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = np.where(nn > kk, nn / (nn - kk), np.nan) if adjust else np.ones_like(nn)
        V = np.einsum("gij,gjk,gkl->gil", A, S, B) * scale[:, None, None]
        return pd.Series([[float(v) if np.isfinite(v) else None for v in row] for row in V.reshape(len(V), -1)])

    return _udf
