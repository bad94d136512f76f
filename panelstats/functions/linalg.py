"""Batched least-squares solve on sufficient statistics (numpy, Arrow UDF).

Input per group: ``n``, centred cross products ``sxx`` (k*k, row-major),
``sxy`` (k), ``syy`` and the means ``mx`` (k), ``my``. The intercept is solved
implicitly (b0 = my - mx.b). Columns that are (numerically) linear
combinations of earlier columns are *aliased*: they get a NULL coefficient and
the model is fitted without them — in that group only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

ALIAS_TOL = 1e-7

SOLVE_SCHEMA = T.StructType([
    T.StructField("k", T.IntegerType()),             # estimated coefficients incl. intercept
    T.StructField("df_resid", T.LongType()),
    T.StructField("beta", T.ArrayType(T.DoubleType())),
    T.StructField("se", T.ArrayType(T.DoubleType())),
    T.StructField("rss", T.DoubleType()),
    T.StructField("tss", T.DoubleType()),
    T.StructField("r2", T.DoubleType()),
    T.StructField("adj_r2", T.DoubleType()),
    T.StructField("sigma", T.DoubleType()),
    T.StructField("f_stat", T.DoubleType()),
    T.StructField("xtx_inv", T.ArrayType(T.DoubleType())),  # full (k+1)^2 with intercept
    T.StructField("aliased", T.ArrayType(T.BooleanType())),
])


def stack(series: pd.Series, width: int) -> np.ndarray:
    """Arrow list column → (G, width) float array; NULL lists/elements and lists of
    another length → NaN. The lists are flattened once."""
    import pyarrow as pa

    col = pa.array(series, type=pa.list_(pa.float64()), from_pandas=True)
    out = np.full((len(col), width), np.nan)
    fits = np.asarray(col.value_lengths().fill_null(-1)) == width
    if width and fits.any():
        flat = col.filter(pa.array(fits)).flatten()
        out[fits] = flat.to_numpy(zero_copy_only=False).reshape(-1, width)
    return out


def pivot_keep(M: np.ndarray) -> np.ndarray:
    """Columns of symmetric cross-product matrices that pass the pivot test."""
    G, p = M.shape[0], M.shape[-1]
    return alias_mask(M, np.ones(G), np.zeros((G, p)))


def safe_inv(M: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Batched inverse on the columns that pass the pivot test (zero elsewhere), and
    the mask: a singular group loses columns, it never stops the batch."""
    keep = pivot_keep(M) if keep is None else keep
    inv = np.linalg.inv(masked_system(np.where(np.isfinite(M), M, 0.0), keep))
    return inv * (keep[:, :, None] & keep[:, None, :]), keep


def masked_system(S: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """Replace rows/cols of dropped columns by the identity so a batched solve works."""
    k = S.shape[-1]
    km = keep[:, :, None] & keep[:, None, :]
    eye = np.broadcast_to(np.eye(k, dtype=bool), S.shape)
    return np.where(km, S, np.where(eye, 1.0, 0.0))


def alias_mask(S: np.ndarray, n: np.ndarray, mx: np.ndarray) -> np.ndarray:
    """Keep column j iff its centred residual norm on the kept earlier columns
    exceeds ``ALIAS_TOL`` of its own centred norm (and that is not ~0)."""
    G, k = S.shape[0], S.shape[-1]
    keep = np.zeros((G, k), dtype=bool)
    finite = np.isfinite(S).all(axis=(1, 2))
    S0 = np.where(np.isfinite(S), S, 0.0)
    for j in range(k):
        sjj = S0[:, j, j]
        raw = sjj + n * np.nan_to_num(mx[:, j]) ** 2
        if j == 0:
            resid = sjj
        else:
            sub = masked_system(S0[:, :j, :j], keep[:, :j])
            v = S0[:, :j, j] * keep[:, :j]
            sol = np.linalg.solve(sub, v[..., None])[..., 0]
            resid = sjj - np.einsum("gi,gi->g", v, sol)
        keep[:, j] = finite & (sjj > 1e-12 * np.maximum(raw, 1e-300)) & (resid > ALIAS_TOL * sjj)
    return keep


def solve_sufficient(n, sxx, sxy, syy, mx, my) -> dict:
    """Vectorised OLS from sufficient statistics; returns numpy arrays per field."""
    n = np.asarray(n, dtype=float)
    G = len(n)
    k = sxy.shape[1]
    S = sxx.reshape(G, k, k)
    keep = alias_mask(S, n, mx) if k else np.zeros((G, 0), dtype=bool)
    Sm = masked_system(np.where(np.isfinite(S), S, 0.0), keep)
    rhs = np.where(keep, np.nan_to_num(sxy), 0.0)
    A = np.linalg.inv(Sm) * (keep[:, :, None] & keep[:, None, :])
    b = np.einsum("gij,gj->gi", A, rhs)
    p = keep.sum(axis=1) + 1
    df = n - p
    with np.errstate(divide="ignore", invalid="ignore"):
        rss = np.maximum(syy - np.einsum("gi,gi->g", b, rhs), 0.0)
        sigma2 = np.where(df > 0, rss / df, np.nan)
        mxz = np.where(keep, np.nan_to_num(mx), 0.0)
        b0 = my - np.einsum("gi,gi->g", mxz, b)
        Amx = np.einsum("gij,gj->gi", A, mxz)
        m00 = 1.0 / n + np.einsum("gi,gi->g", mxz, Amx)
        full = np.zeros((G, k + 1, k + 1))
        full[:, 0, 0] = m00
        full[:, 0, 1:] = -Amx
        full[:, 1:, 0] = -Amx
        full[:, 1:, 1:] = A
        beta = np.concatenate([b0[:, None], np.where(keep, b, np.nan)], axis=1)
        diag = np.concatenate([m00[:, None], np.where(keep, np.diagonal(A, axis1=1, axis2=2), np.nan)], axis=1)
        se = np.sqrt(sigma2[:, None] * diag)
        r2 = np.where(syy > 0, 1.0 - rss / syy, np.nan)
        adj = np.where(df > 0, 1.0 - (1.0 - r2) * (n - 1) / df, np.nan)
        fstat = np.where((p > 1) & (df > 0), ((syy - rss) / (p - 1)) / sigma2, np.nan)
    bad = n <= 0
    beta[bad] = np.nan
    return dict(k=p, df_resid=df, beta=beta, se=se, rss=np.where(bad, np.nan, rss),
                tss=np.where(bad, np.nan, syy), r2=r2, adj_r2=adj, sigma=np.sqrt(sigma2),
                f_stat=fstat, xtx_inv=full.reshape(G, -1), aliased=~keep)


def _clean_list(row) -> list:
    return [float(v) if np.isfinite(v) else None for v in row]


def _clean(v):
    return float(v) if np.isfinite(v) else None


@F.pandas_udf(SOLVE_SCHEMA)
def solve_udf(n: pd.Series, sxx: pd.Series, sxy: pd.Series, syy: pd.Series,
              mx: pd.Series, my: pd.Series) -> pd.DataFrame:
    k = max((len(v) for v in sxy.to_numpy() if v is not None), default=0)
    r = solve_sufficient(n.to_numpy(dtype=float, na_value=0.0), stack(sxx, k * k), stack(sxy, k),
                         syy.to_numpy(dtype=float, na_value=np.nan), stack(mx, k),
                         my.to_numpy(dtype=float, na_value=np.nan))
    return pd.DataFrame({
        "k": r["k"].astype("int32"),
        "df_resid": r["df_resid"].astype("int64"),
        "beta": [_clean_list(v) for v in r["beta"]],
        "se": [_clean_list(v) for v in r["se"]],
        "rss": [_clean(v) for v in r["rss"]],
        "tss": [_clean(v) for v in r["tss"]],
        "r2": [_clean(v) for v in r["r2"]],
        "adj_r2": [_clean(v) for v in r["adj_r2"]],
        "sigma": [_clean(v) for v in r["sigma"]],
        "f_stat": [_clean(v) for v in r["f_stat"]],
        "xtx_inv": [_clean_list(v) for v in r["xtx_inv"]],
        "aliased": [list(map(bool, v)) for v in r["aliased"]],
    })
