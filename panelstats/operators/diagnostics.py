"""Residual diagnostics (DG1–DG12, AG13).

Each test is an aggregate over the residual table (rows joined to their
group's coefficients). Auxiliary regressions reuse :mod:`.ols`; serial
statistics read neighbours with window ``lag``/``lead`` over the (bounded)
series or, for many lags, with an equi-join on (key, position − lag).
Only the final closed forms and tail probabilities run in Arrow UDFs.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dist import chi2_pvalue_udf, f_pvalue_udf, norm_cdf_udf, norm_ppf_udf
from ..session import cut_lineage
from . import ols as O


def resid_series(df: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str], order: str,
                 fit: DataFrame | None = None) -> DataFrame:
    """Residual rows with 1-based position ``pos`` and series length ``n_rows``."""
    fit = fit if fit is not None else O.ols(df, y, xs, keys)
    r = O.residuals(df, fit, y, xs, keys)
    w = Window.partitionBy(*keys).orderBy(order)
    return r.withColumn("pos", F.row_number().over(w)).withColumn(
        "n_rows", F.count(F.lit(1)).over(Window.partitionBy(*keys)))


def _lm_stat(aux_fit: DataFrame, keys: Sequence[str], df: int, name: str) -> DataFrame:
    out = aux_fit.select(*keys, F.lit(name).alias("test"), (F.col("n") * F.col("r2")).alias("statistic"),
                         F.lit(df).alias("df"))
    return out.withColumn("p_value", chi2_pvalue_udf("statistic", F.col("df").cast("double")))


def breusch_pagan(res: DataFrame, zs: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """DG1: studentised Breusch–Pagan — n·R² of e² on Z, df = |Z|."""
    d = res.withColumn("_e2", F.col("resid") * F.col("resid"))
    return _lm_stat(O.ols(d, "_e2", zs, keys), keys, len(zs), "breusch_pagan")


def white(res: DataFrame, xs: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """DG2/PR14: White — regressors, their squares and cross products."""
    xs = list(xs)
    d = res
    terms = list(xs)
    for i, a in enumerate(xs):
        for b in xs[i:]:
            nm = f"{a}_sq" if a == b else f"{a}_x_{b}"
            d = d.withColumn(nm, F.col(a) * F.col(b))
            terms.append(nm)
    d = d.withColumn("_e2", F.col("resid") * F.col("resid"))
    return _lm_stat(O.ols(d, "_e2", terms, keys), keys, len(terms), "white")


def goldfeld_quandt(df: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str], by: str,
                    tie: str, point: float = 0.5) -> DataFrame:
    """DG3: order by ``by`` (ties by ``tie``), split after floor(point·n) rows,
    statistic = (RSS2/df2)/(RSS1/df1), p from the upper F tail."""
    from .quantile import rank_within
    d = df.filter(O.complete([y, *xs]))
    # skew-safe ordering (range-partitioned ranks), also for row-level inputs
    carry = [c for c in dict.fromkeys([y, *xs]) if c != by]
    d = rank_within(d, by, keys, tie=[tie], carry=carry)
    d = d.withColumn("segment", F.when(F.col("_rank") <= F.floor(F.col("_n") * point), 1).otherwise(2))
    fit = O.ols(d, y, xs, [*keys, "segment"])
    s = fit.groupBy(*keys).agg(
        F.max(F.when(F.col("segment") == 1, F.try_divide(F.col("rss"), F.col("df_resid")))).alias("_s1"),
        F.max(F.when(F.col("segment") == 2, F.try_divide(F.col("rss"), F.col("df_resid")))).alias("_s2"),
        F.max(F.when(F.col("segment") == 1, F.col("df_resid"))).alias("df1"),
        F.max(F.when(F.col("segment") == 2, F.col("df_resid"))).alias("df2"))
    out = s.select(*keys, F.try_divide(F.col("_s2"), F.col("_s1")).alias("statistic"), "df1", "df2")
    return out.withColumn("p_value", f_pvalue_udf("statistic", F.col("df2").cast("double"), F.col("df1").cast("double")))


def _design(xs):
    return [F.lit(1.0), *[F.col(x) for x in xs]]


_DW = T.StructType([T.StructField("mean", T.DoubleType()), T.StructField("var", T.DoubleType())])


@F.pandas_udf(_DW)
def dw_moments_udf(xtx_inv: pd.Series, xax: pd.Series, xa2x: pd.Series, n: pd.Series, k: pd.Series) -> pd.DataFrame:
    """Exact mean/variance of DW under H0 from traces; vectorised over groups. ``k`` counts the
    coefficients that are not aliased."""
    from ..functions.linalg import stack
    width = max(len(v) for v in xtx_inv.to_numpy())
    p = int(round(math.sqrt(width)))
    Q = stack(xtx_inv, width).reshape(-1, p, p)
    A1 = np.einsum("gij,gjk->gik", stack(xax, width).reshape(-1, p, p), Q)
    A2 = np.einsum("gij,gjk->gik", stack(xa2x, width).reshape(-1, p, p), Q)
    nn = n.to_numpy(float)
    P = 2 * (nn - 1) - np.einsum("gii->g", A1)
    Q2 = 2 * (3 * nn - 4) - 2 * np.einsum("gii->g", A2) + np.einsum("gij,gji->g", A1, A1)
    dfr = nn - k.to_numpy(float)
    dfr = np.where(dfr > 0, dfr, np.nan)
    mean = P / dfr
    var = 2 * (Q2 - P * mean) / (dfr * (dfr + 2))
    return pd.DataFrame({"mean": mean, "var": var})


def durbin_watson(res: DataFrame, fit: DataFrame, xs: Sequence[str], keys: Sequence[str], order: str) -> DataFrame:
    """DG4: DW = Σ(Δe)²/Σe²; mean/variance under H0 from X'AX and X'A²X (exact
    moments of the quadratic form), normal approximation, p = Φ(z) (positive autocorrelation)."""
    p = len(xs) + 1
    w = Window.partitionBy(*keys).orderBy(order)
    X = _design(xs)
    d = res.select(*keys, order, "resid", F.array(*X).alias("_x"))
    d = d.select("*", F.lag("resid", 1).over(w).alias("_el"), F.lag("_x", 1).over(w).alias("_xl"),
                 F.lead("_x", 1).over(w).alias("_xn"))
    xl = F.coalesce(F.col("_xl"), F.col("_x"))
    xn = F.coalesce(F.col("_xn"), F.col("_x"))
    # (A x)_t = 2x_t − x_{t−1} − x_{t+1}, one-sided at both ends; Δx_t = x_t − x_{t−1}
    ax = [2 * F.col("_x")[a] - xl[a] - xn[a] for a in range(p)]
    dx = [F.col("_x")[a] - F.col("_xl")[a] for a in range(p)]
    aggs = [F.sum((F.col("resid") - F.col("_el")) ** 2).alias("_num"), F.sum(F.col("resid") ** 2).alias("_den")]
    aggs += [F.sum(dx[a] * dx[b]).alias(f"_d{a}_{b}") for a in range(p) for b in range(p)]
    aggs += [F.sum(ax[a] * ax[b]).alias(f"_a{a}_{b}") for a in range(p) for b in range(p)]
    g = d.groupBy(*keys).agg(*aggs)
    g = g.select(*keys, F.try_divide(F.col("_num"), F.col("_den")).alias("statistic"),
                 F.array(*[F.col(f"_d{a}_{b}") for a in range(p) for b in range(p)]).alias("xax"),
                 F.array(*[F.col(f"_a{a}_{b}") for a in range(p) for b in range(p)]).alias("xa2x"))
    j = g.join(fit.select(*keys, "n", "k", "xtx_inv"), on=list(keys))
    j = j.withColumn("_m", dw_moments_udf("xtx_inv", "xax", "xa2x", F.col("n").cast("double"), F.col("k").cast("double")))
    z = F.try_divide(F.col("statistic") - F.col("_m.mean"), F.sqrt(F.col("_m.var")))
    j = j.select(*keys, "statistic", F.col("_m.mean").alias("mean"), F.col("_m.var").alias("var"), z.alias("z"))
    return j.withColumn("p_value", norm_cdf_udf("z"))


def breusch_godfrey(res: DataFrame, xs: Sequence[str], keys: Sequence[str], order: str, q: int) -> DataFrame:
    """DG5: e_t on X and e_{t−1..t−q} (missing lags filled with 0), n·R², df q."""
    w = Window.partitionBy(*keys).orderBy(order)
    lags = [F.coalesce(F.lag("resid", l).over(w), F.lit(0.0)).alias(f"_el{l}") for l in range(1, q + 1)]
    d = res.select(*keys, order, "resid", *xs, *lags)
    aux = O.ols(d, "resid", [*xs, *[f"_el{l}" for l in range(1, q + 1)]], keys)
    return _lm_stat(aux, keys, q, f"breusch_godfrey_{q}")


def centred_resid(res: DataFrame, keys: Sequence[str]) -> DataFrame:
    mu = res.groupBy(*keys).agg(F.avg("resid").alias("_mu"), F.count(F.lit(1)).alias("_nn"))
    return res.join(mu, on=list(keys)).withColumn("_c", F.col("resid") - F.col("_mu"))


def autocorrelations(res: DataFrame, keys: Sequence[str], max_lag: F.Column | int | None = None) -> DataFrame:
    """DG8: r_k = Σ c_t c_{t−k} / Σ c_t², c = e − ē, k = 1..L with
    L = floor(10·log10 n) by default. Lag pairs come from an equi-join on
    (keys, pos − k), so a long series spreads over many tasks."""
    c = centred_resid(res, keys).select(*keys, "pos", "_c", "_nn")
    lmax = F.floor(10 * F.log10(F.col("_nn"))).cast("int") if max_lag is None else (
        max_lag if isinstance(max_lag, F.Column) else F.lit(max_lag))
    lmax = F.least(lmax, F.col("_nn") - 1).cast("int")
    ks = c.select(*keys, "pos", "_c", F.explode(F.sequence(F.lit(1), F.greatest(lmax, F.lit(1)))).alias("lag"),
                  lmax.alias("_L"))
    ks = ks.filter(F.col("lag") <= F.col("_L"))
    past = c.select(*keys, F.col("pos").alias("_pp"), F.col("_c").alias("_cp"))
    j = ks.join(past, on=[*[ks[k] == past[k] for k in keys], ks["pos"] - ks["lag"] == past["_pp"]])
    j = j.select(*[ks[k] for k in keys], "lag", (F.col("_c") * F.col("_cp")).alias("_prod"))
    num = j.groupBy(*keys, "lag").agg(F.sum("_prod").alias("_num"))
    den = c.groupBy(*keys).agg(F.sum(F.col("_c") * F.col("_c")).alias("_den"), F.first("_nn").alias("n"))
    return num.join(den, on=list(keys)).select(*keys, "lag", "n", F.try_divide(F.col("_num"), F.col("_den")).alias("acf"))


def ljung_box(res: DataFrame, keys: Sequence[str], lag: int = 12, order: str = "m") -> DataFrame:
    """DG6: Q = n(n+2) Σ_{k≤lag} r_k²/(n−k), χ²(lag). A fixed number of lags:
    window ``lag`` products summed in one aggregate (no self-join)."""
    wall = Window.partitionBy(*keys)
    w = Window.partitionBy(*keys).orderBy(order)
    # centring by a window over the same partitioning as the lags: one exchange
    c = res.select(*keys, order, (F.col("resid") - F.avg("resid").over(wall)).alias("_c"),
                   F.count(F.lit(1)).over(wall).alias("_nn"))
    lagged = c.select(*keys, "_c", "_nn", *[F.lag("_c", k).over(w).alias(f"_l{k}") for k in range(1, lag + 1)])
    g = lagged.groupBy(*keys).agg(F.first("_nn").alias("n"), F.sum(F.col("_c") * F.col("_c")).alias("_d"),
                                  *[F.sum(F.col("_c") * F.col(f"_l{k}")).alias(f"_s{k}") for k in range(1, lag + 1)])
    n = F.col("n")
    terms = [F.try_divide(F.try_divide(F.col(f"_s{k}"), F.col("_d")) ** 2, n - k) for k in range(1, lag + 1)]
    stat = n * (n + 2) * sum(terms[1:], terms[0])
    q = g.select(*keys, stat.alias("statistic"), F.lit(lag).alias("df"))
    return q.withColumn("p_value", chi2_pvalue_udf("statistic", F.col("df").cast("double")))


def jarque_bera(res: DataFrame, keys: Sequence[str]) -> DataFrame:
    """DG7: JB = n/6 (S² + (K−3)²/4) with population skewness S and kurtosis K
    of the residuals — one aggregate (Spark's stable central-moment merge);
    p = exp(−JB/2) (χ², 2 df)."""
    g = res.groupBy(*keys).agg(F.count("resid").alias("n"), F.skewness("resid").alias("skewness"),
                               (F.kurtosis("resid") + 3).alias("kurtosis"))
    s, k = F.col("skewness"), F.col("kurtosis")
    jb = F.col("n") / 6 * (s * s + (k - 3) * (k - 3) / 4)
    return g.select(*keys, jb.alias("statistic"), "skewness", "kurtosis") \
        .withColumn("p_value", F.exp(-F.col("statistic") / 2))


_PACF = T.ArrayType(T.DoubleType())


def durbin_levinson(r: np.ndarray) -> np.ndarray:
    """Partial autocorrelations from autocorrelations r_1..r_L (Durbin–Levinson)."""
    r = np.asarray(r, dtype=float)
    L = len(r)
    pac = np.zeros(L)
    phi = np.zeros(L)
    if L:
        phi[0] = pac[0] = r[0]
    for k in range(1, L):
        num = r[k] - np.dot(phi[:k], r[k - 1::-1][:k])
        den = 1 - np.dot(phi[:k], r[:k])
        a = num / den
        phi[:k] = phi[:k] - a * phi[:k][::-1]
        phi[k] = pac[k] = a
    return pac


@F.pandas_udf(_PACF)
def durbin_levinson_udf(acf: pd.Series) -> pd.Series:
    return pd.Series([list(durbin_levinson(r)) for r in acf])


def partial_autocorrelations(acf: DataFrame, keys: Sequence[str]) -> DataFrame:
    """DG9: Durbin–Levinson on the per-series acf array (one row per series)."""
    arr = acf.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("lag", "acf"))).alias("_a"))
    arr = arr.select(*keys, F.transform("_a", lambda s: s["acf"]).alias("_r"))
    return arr.select(*keys, F.posexplode(durbin_levinson_udf("_r")).alias("_i", "pacf")) \
        .select(*keys, (F.col("_i") + 1).alias("lag"), "pacf")


# Dickey–Fuller critical values, trend case (public table); rows are the
# probabilities below and columns the sample sizes 25, 50, 100, 250, 500, ∞.
ADF_SIZES = (25, 50, 100, 250, 500, 100000)
ADF_PROBS = (0.01, 0.025, 0.05, 0.10, 0.90, 0.95, 0.975, 0.99)
ADF_TABLE = (
    (4.38, 4.15, 4.04, 3.99, 3.98, 3.96),
    (3.95, 3.80, 3.73, 3.69, 3.68, 3.66),
    (3.60, 3.50, 3.45, 3.43, 3.42, 3.41),
    (3.24, 3.18, 3.15, 3.13, 3.13, 3.12),
    (1.14, 1.19, 1.22, 1.23, 1.24, 1.25),
    (0.80, 0.87, 0.90, 0.92, 0.93, 0.94),
    (0.50, 0.58, 0.62, 0.64, 0.65, 0.66),
    (0.15, 0.24, 0.28, 0.31, 0.32, 0.33),
)


def adf_pvalue(stat, n) -> np.ndarray:
    """Interpolated p-values of arrays of statistics and sample sizes: the critical
    values at each n first, then the probability between them (clamped)."""
    stat, n = np.atleast_1d(np.asarray(stat, float)), np.atleast_1d(np.asarray(n, float))
    crit = np.stack([np.interp(n, ADF_SIZES, [-v for v in row]) for row in ADF_TABLE], axis=1)
    probs = np.asarray(ADF_PROBS)
    j = np.clip((stat[:, None] > crit).sum(axis=1), 1, len(probs) - 1)
    rows = np.arange(len(stat))
    lo, hi = crit[rows, j - 1], crit[rows, j]
    p = probs[j - 1] + (stat - lo) * (probs[j] - probs[j - 1]) / (hi - lo)
    return np.where(np.isfinite(stat), np.clip(p, probs[0], probs[-1]), np.nan)


@F.pandas_udf(T.DoubleType())
def adf_pvalue_udf(stat: pd.Series, n: pd.Series) -> pd.Series:
    p = pd.Series(adf_pvalue(stat.to_numpy(dtype=float, na_value=np.nan), n.to_numpy(dtype=float, na_value=np.nan)))
    return p.where(p.notna(), None)


def adf(df: DataFrame, col: str, keys: Sequence[str], order: str) -> DataFrame:
    """DG10: augmented Dickey–Fuller with trend: Δy_t on y_{t−1}, 1, t and
    Δy_{t−1..t−k}, k = trunc((N−1)^(1/3)); statistic = t of the lagged level;
    p by linear interpolation in the critical-value table (clamped to [0.01, 0.99]).
    The number of lag columns follows from the longest series present (one scalar)."""
    longest = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    w = Window.partitionBy(*keys).orderBy(order)
    nn = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    d = df.select(*keys, order, col).withColumn("_N", nn).withColumn("_pos", F.row_number().over(w))
    d = d.withColumn("_k", F.floor(F.pow(F.col("_N") - 1, 1.0 / 3)).cast("int"))
    maxk = int(math.floor((longest - 1) ** (1.0 / 3) + 1e-9)) + 2
    d = d.select("*", (F.col(col) - F.lag(col, 1).over(w)).alias("_dy"), F.lag(col, 1).over(w).alias("_lvl"),
                 *[(F.lag(col, l).over(w) - F.lag(col, l + 1).over(w)).alias(f"_dl{l}") for l in range(1, maxk)])
    # a lag slot beyond k is 0 → aliased (and does not remove rows)
    for l in range(1, maxk):
        d = d.withColumn(f"_dl{l}", F.when(F.col("_k") >= l, F.col(f"_dl{l}")).otherwise(F.lit(0.0)))
    d = d.filter(F.col("_pos") > F.col("_k") + 1)
    xs = ["_lvl", "_pos", *[f"_dl{l}" for l in range(1, maxk)]]
    fit = O.ols(d, "_dy", xs, keys)
    st = fit.select(*keys, F.try_divide(F.col("beta")[1], F.col("se")[1]).alias("statistic"),
                    (F.col("n") + F.lit(0)).alias("n_used"))
    nref = d.groupBy(*keys).agg((F.first("_N") - 1).alias("_nd"), (F.first("_k")).alias("lag_order"))
    j = st.join(nref, on=list(keys))
    return j.select(*keys, "statistic", "lag_order", adf_pvalue_udf("statistic", F.col("_nd").cast("double")).alias("p_value")) \
        .withColumn("stationary", F.when(F.col("p_value") < 0.05, "yes").otherwise("no"))


def qq_pairs(res: DataFrame, keys: Sequence[str]) -> DataFrame:
    """AG13: sorted residuals against normal quantiles (i − a)/(n + 1 − 2a),
    a = 3/8 if n ≤ 10 else 1/2; reference line through the quartiles."""
    from .quantile import rank_within
    r = rank_within(res, "resid", keys)
    a = F.when(F.col("_n") <= 10, F.lit(0.375)).otherwise(F.lit(0.5))
    pp = (F.col("_rank") - a) / (F.col("_n") + 1 - 2 * a)
    return r.select(*keys, F.col("_rank").alias("i"), F.col("resid").alias("sample"), pp.alias("_pp")) \
        .withColumn("theoretical", norm_ppf_udf("_pp")).drop("_pp")


# ------------------------------------------------------- several models at once
def model_rows(df: DataFrame, specs: dict[str, tuple[str, Sequence[str]]], keys: Sequence[str], order: str) -> DataFrame:
    """One row per model and complete row: keys, ``order``, ``model``, ``_y``, ``used`` (number of
    regressors) and the slots ``_x0`` …; ``specs``: {model: (dependent column, regressor columns)}.
    Slots a model does not use are 0, so they come out aliased; one exploded frame, no copy per test."""
    slots = max(len(xs) for _, xs in specs.values())
    rows = []
    for name, (y, xs) in specs.items():
        cols = [F.col(x).cast("double") for x in xs] + [F.lit(0.0)] * (slots - len(xs))
        row = F.struct(F.lit(name).alias("model"), F.col(y).cast("double").alias("_y"), F.lit(len(xs)).alias("used"),
                       *[c.alias(f"_x{i}") for i, c in enumerate(cols)])
        rows.append(F.when(O.complete([y, *xs]), row))
    ex = df.select(*keys, order, F.explode(F.array_compact(F.array(*rows))).alias("_s"))
    return ex.select(*keys, order, "_s.*")


def model_slots(rows: DataFrame) -> list[str]:
    return sorted((c for c in rows.columns if c.startswith("_x") and c[2:].isdigit()), key=lambda c: int(c[2:]))


def model_diagnostics(rows: DataFrame, keys: Sequence[str], order: str, bg_order: int = 6, lb_lag: int = 12,
                      gq_by: str = "_x0") -> DataFrame:
    """DG1, DG3–DG7 for every model of :func:`model_rows`: keys, model, test, statistic, df, p_value.

    The residual frame, keyed by model, is written once; each test is an aggregate over it.
    Breusch–Pagan's df is the number of regressors that are not aliased in the model; Durbin–Watson
    has no df and its p is the normal one of :func:`durbin_watson`; Goldfeld–Quandt orders by
    ``gq_by`` (df: that of the upper half).
    """
    mk, xs = [*keys, "model"], model_slots(rows)
    fit = O.ols(rows, "_y", xs, mk, materialize=True)
    res = cut_lineage(O.residuals(rows, fit, "_y", xs, mk), "residuals")
    cols = [*mk, "test", "statistic", "df", "p_value"]

    bp = breusch_pagan(res, xs, mk).drop("df", "p_value").join(fit.select(*mk, (F.col("k") - 1).alias("df")), on=mk)
    bp = bp.withColumn("p_value", chi2_pvalue_udf("statistic", F.col("df").cast("double")))
    bg = breusch_godfrey(res, xs, mk, order, bg_order)
    lb = ljung_box(res, mk, lb_lag, order).withColumn("test", F.lit(f"ljung_box_{lb_lag}"))
    jb = jarque_bera(res, mk).withColumn("test", F.lit("jarque_bera")).withColumn("df", F.lit(2))
    dw = durbin_watson(res, fit, xs, mk, order).withColumn("test", F.lit("durbin_watson")).withColumn("df", F.lit(None))
    gq = goldfeld_quandt(rows, "_y", xs, mk, gq_by, order).withColumn("test", F.lit("goldfeld_quandt")) \
        .withColumn("df", F.col("df2"))
    out = None
    for t in (bp, bg, lb, jb, dw, gq):
        t = t.withColumn("df", F.col("df").cast("int")).select(*cols)
        out = t if out is None else out.unionByName(t)
    return out


# ------------------------------------------------------------- Shapiro-Wilk
# Royston's polynomials (1995) for the outer weights and for the normal
# approximation of the transformed statistic; coefficients from the constant upwards.
SW_OUTER = (0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
SW_SECOND = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
SW_SMALL_GAMMA = (-2.273, 0.459)
SW_SMALL_MEAN = (0.5440, -0.39978, 0.025054, -0.0006714)
SW_SMALL_LOG_SD = (1.3822, -0.77857, 0.062767, -0.0020322)
SW_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
SW_LOG_SD = (-0.4803, -0.082676, 0.0030302)
SW_MOST = 5000


def _poly(coefficients: Sequence[float], x: F.Column) -> F.Column:
    out = F.lit(float(coefficients[-1]))
    for c in reversed(coefficients[:-1]):
        out = out * x + F.lit(float(c))
    return out


def shapiro_wilk(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """DG7, small samples: keys, n, statistic W, p_value for groups of 3 to 5,000 values.

    Exact ranks (range-partitioned) give each value its expected normal order statistic; W is one
    aggregate of products over them, the two outer weights per side by Royston's polynomials.
    Other sizes and groups of one value get NULL; missing values do not count.
    """
    from .quantile import rank_within
    keys = list(keys)
    r = rank_within(df, value, keys).withColumn("_pp", (F.col("_rank") - 0.375) / (F.col("_n") + 0.25))
    r = r.withColumn("_m", norm_ppf_udf("_pp"))
    x, i, n, m = F.col(value), F.col("_rank"), F.col("_n"), F.col("_m")
    pick = {"_x1": i == 1, "_x2": i == 2, "_y2": i == n - 1, "_y1": i == n}
    g = r.groupBy(*keys).agg(
        F.first("_n").alias("n"), F.sum(m * m).alias("_mm"), (F.var_pop(x) * F.count(x)).alias("_ss"),
        F.sum(F.when((i > 2) & (i < n - 1), m * x)).alias("_inner2"), F.sum(F.when((i > 1) & (i < n), m * x)).alias("_inner1"),
        F.max(F.when(i == n, m)).alias("_m1"), F.max(F.when(i == n - 1, m)).alias("_m2"),
        *[F.max(F.when(c, x)).alias(name) for name, c in pick.items()])
    n, mm, m1, m2 = F.col("n"), F.col("_mm"), F.col("_m1"), F.col("_m2")
    u = 1 / F.sqrt(n)
    a1 = F.when(n == 3, F.lit(math.sqrt(0.5))).otherwise(_poly(SW_OUTER, u) + m1 / F.sqrt(mm))
    a2 = _poly(SW_SECOND, u) + m2 / F.sqrt(mm)
    phi2 = (mm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)
    phi1 = (mm - 2 * m1 * m1) / (1 - 2 * a1 * a1)
    outer = a1 * (F.col("_y1") - F.col("_x1"))
    top = F.when(n == 3, outer) \
        .when(n <= 5, outer + F.coalesce(F.col("_inner1"), F.lit(0.0)) / F.sqrt(phi1)) \
        .otherwise(outer + a2 * (F.col("_y2") - F.col("_x2")) + F.coalesce(F.col("_inner2"), F.lit(0.0)) / F.sqrt(phi2))
    fits = (n >= 3) & (n <= SW_MOST) & (F.col("_y1") > F.col("_x1"))
    w = F.when(fits, F.least(F.try_divide(top * top, F.col("_ss")), F.lit(1.0)))
    s = g.select(*keys, "n", w.alias("statistic"))
    n, w = F.col("n").cast("double"), F.col("statistic")
    ln = F.log(n)
    short = (-F.log(_poly(SW_SMALL_GAMMA, n) - F.log1p(-w)) - _poly(SW_SMALL_MEAN, n)) / F.exp(_poly(SW_SMALL_LOG_SD, n))
    long = (F.log1p(-w) - _poly(SW_MEAN, ln)) / F.exp(_poly(SW_LOG_SD, ln))
    s = s.withColumn("_z", F.when(n <= 11, short).otherwise(long))
    three = F.greatest(6 / math.pi * (F.asin(F.sqrt(w)) - math.asin(math.sqrt(0.75))), F.lit(0.0))
    return s.withColumn("p_value", F.when(w.isNull(), None).when(n == 3, three).when(w >= 1, 1.0)
                        .otherwise(1 - norm_cdf_udf("_z"))).drop("_z")


def qq_line(res: DataFrame, keys: Sequence[str], value: str = "resid") -> DataFrame:
    """AG13: keys, slope, intercept of the line through the sample and normal quartiles."""
    from .quantile import quantiles
    q = quantiles(res, value, keys, [0.25, 0.75], ["_lo", "_hi"])
    lo, hi = F.col("_lo"), F.col("_hi")
    z = 0.6744897501960817  # fixed value: upper quartile of the standard normal
    return q.select(*keys, ((hi - lo) / (2 * z)).alias("slope"), ((hi + lo) / 2).alias("intercept"))
