"""Model-level operators built on :mod:`.ols` (RG6–RG12, RG13–RG21 wrappers).

Several specifications are estimated in **one** aggregate by exploding the
rows into (model, regressor vector) pairs — regressors a model does not use
are 0 and come out aliased, so each model is fitted on exactly its own
complete rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dist import t_pvalue_udf, t_upper_udf
from ..functions.linalg import stack
from ..session import cut_lineage
from . import hac as H
from . import ols as O

LOG_2PI = math.log(2 * math.pi)


def stacked_specs(df: DataFrame, y: str, specs: dict[str, dict[str, Column | None]],
                  keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Explode rows into one copy per model.

    ``specs``: {model: {regressor slot: column or None}}; the union of slots
    becomes the regressor list, missing slots are 0.0 (aliased in the fit).
    Rows with a NULL in a *used* slot are dropped for that model only.
    """
    slots: list[str] = []
    for s in specs.values():
        for k in s:
            if k not in slots:
                slots.append(k)
    structs = []
    for name, s in specs.items():
        cols = [(s[k] if s.get(k) is not None else F.lit(0.0)).cast("double").alias(k) for k in slots]
        structs.append(F.struct(F.lit(name).alias("model"), *cols))
    ex = df.select(*keys, F.col(y).alias("_y"), F.explode(F.array(*structs)).alias("_s"))
    return ex.select(*keys, "_s.model", "_y", *[F.col(f"_s.{k}").alias(k) for k in slots]), slots


def information_criteria(fit: DataFrame, keys: Sequence[str]) -> DataFrame:
    """RG8: log-likelihood, AIC = −2ll + 2(k+1), BIC = −2ll + log(n)(k+1)."""
    n = F.col("n").cast("double")
    ll = -n / 2 * (F.lit(LOG_2PI) + F.log(F.try_divide(F.col("rss"), n)) + 1)
    return fit.select(*keys, "n", "k", "rss", ll.alias("loglik"),
                      (-2 * ll + 2 * (F.col("k") + 1)).alias("aic"),
                      (-2 * ll + F.log(n) * (F.col("k") + 1)).alias("bic"))


def model_select(ic: DataFrame, keys: Sequence[str], model: str = "model") -> DataFrame:
    """RG8/PR16/SO4: ΔAIC/ΔBIC to the group minimum; best model per criterion
    (``min_by`` with the model label as tie-break — first wins)."""
    best = ic.groupBy(*keys).agg(
        F.min("aic").alias("_amin"), F.min("bic").alias("_bmin"),
        F.min_by(F.col(model), F.struct("aic", model)).alias("best_aic"),
        F.min_by(F.col(model), F.struct("bic", model)).alias("best_bic"))
    j = ic.join(best, on=list(keys))
    return j.select(*ic.columns, (F.col("aic") - F.col("_amin")).alias("d_aic"),
                    (F.col("bic") - F.col("_bmin")).alias("d_bic"), "best_aic", "best_bic")


def joint_f(unrestricted: DataFrame, restricted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """RG7: F = ((RSS_r − RSS_u)/q)/(RSS_u/df_u), q = k_u − k_r; ΔR²."""
    u = unrestricted.select(*keys, F.col("rss").alias("rss_u"), F.col("k").alias("k_u"),
                            F.col("df_resid").alias("df_u"), F.col("r2").alias("r2_u"))
    r = restricted.select(*keys, F.col("rss").alias("rss_r"), F.col("k").alias("k_r"), F.col("r2").alias("r2_r"))
    j = u.join(r, on=list(keys))
    q = F.col("k_u") - F.col("k_r")
    f = F.try_divide(F.try_divide(F.col("rss_r") - F.col("rss_u"), q), F.try_divide(F.col("rss_u"), F.col("df_u")))
    from ..functions.dist import f_pvalue_udf
    return j.select(*keys, q.alias("q"), "df_u", f.alias("f_stat"),
                    (F.col("r2_u") - F.col("r2_r")).alias("d_r2")) \
        .withColumn("p_value", f_pvalue_udf("f_stat", F.col("q").cast("double"), F.col("df_u").cast("double")))


def coef_vs_benchmark(coef: DataFrame, benchmarks: Sequence[tuple[str, float, str]],
                      keys: Sequence[str]) -> DataFrame:
    """RG12: t = (b − b0)/se against fixed values; two-sided or 'greater'."""
    spark = coef.sparkSession
    bm = spark.createDataFrame(list(benchmarks), "term string, b0 double, alternative string")
    j = coef.join(F.broadcast(bm), on="term")
    t = F.try_divide(F.col("estimate") - F.col("b0"), F.col("se"))
    j = j.select(*keys, "term", "b0", "alternative", "estimate", "se", "df_resid", t.alias("t_stat"))
    df = F.col("df_resid").cast("double")
    p = F.when(F.col("alternative") == "greater", t_upper_udf("t_stat", df)).otherwise(t_pvalue_udf("t_stat", df))
    return j.withColumn("p_value", p)


def coef_compare(a: DataFrame, b: DataFrame, labels: dict[str, str], keys: Sequence[str],
                 z: float = 1.96) -> DataFrame:
    """RG11/ST1/JN4/FL3: two coefficient tables with ±z·se bounds, intercept removed,
    display label looked up from a small literal table."""
    u = a.unionByName(b, allowMissingColumns=True)
    u = u.filter(~F.col("term").rlike(r"^\(Intercept\)$"))
    spark = u.sparkSession
    lab = spark.createDataFrame(list(labels.items()), "term string, label string")
    u = u.join(F.broadcast(lab), on="term", how="left")
    return u.select(*keys, "model", "term", F.coalesce("label", "term").alias("label"), "estimate", "se",
                    (F.col("estimate") - z * F.col("se")).alias("lower"),
                    (F.col("estimate") + z * F.col("se")).alias("upper"))


# ------------------------------------------------------------ VIF, rank check
_VIF = T.ArrayType(T.DoubleType())


@F.pandas_udf(_VIF)
def vif_udf(sxx: pd.Series) -> pd.Series:
    """Diagonal of the inverse correlation matrix, batched over groups."""
    kk = max((len(v) for v in sxx.to_numpy() if v is not None), default=0)
    k = int(round(math.sqrt(kk)))
    S = stack(sxx, kk).reshape(-1, k, k)
    with np.errstate(invalid="ignore", divide="ignore"):
        d = np.sqrt(np.einsum("gii->gi", S))
        R = S / d[:, :, None] / d[:, None, :]
        ok = np.isfinite(R).all(axis=(1, 2)) & (np.abs(np.linalg.det(np.nan_to_num(R))) > 1e-12)
        inv = np.linalg.inv(np.where(ok[:, None, None], np.nan_to_num(R), np.eye(k)[None]))
    diag = np.einsum("gii->gi", inv)
    return pd.Series([[float(v) for v in row] if good else [None] * k for row, good in zip(diag, ok)])


def vif(df: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """RG20: VIF_j = [R⁻¹]_jj of the regressors' correlation matrix; bands 5 / 10."""
    st = O.sufficient_stats(df, y, xs, keys)
    v = st.select(*keys, F.posexplode(vif_udf("sxx")).alias("pos", "vif"))
    names = F.array(*[F.lit(x) for x in xs])
    band = F.when(F.col("vif") >= 10, "high").when(F.col("vif") >= 5, "moderate").otherwise("low")
    return v.select(*keys, F.element_at(names, F.col("pos") + 1).alias("term"), "vif", band.alias("band"))


_RANK = T.StructType([T.StructField("rank", T.IntegerType()), T.StructField("condition", T.DoubleType())])


@F.pandas_udf(_RANK)
def rank_udf(sxx: pd.Series) -> pd.DataFrame:
    """Numerical rank and condition number of the centred design, batched."""
    kk = max((len(v) for v in sxx.to_numpy() if v is not None), default=0)
    k = int(round(math.sqrt(kk)))
    S = np.nan_to_num(stack(sxx, kk).reshape(-1, k, k))
    if k == 0:
        return pd.DataFrame({"rank": [0] * len(S), "condition": [None] * len(S)})
    ev = np.linalg.eigvalsh(S)
    top = ev.max(axis=1)
    rank = (ev > 1e-10 * np.maximum(top, 1e-300)[:, None]).sum(axis=1)
    low = ev.min(axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        cond = np.sqrt(top / low)
    return pd.DataFrame({"rank": rank.astype("int32"),
                         "condition": [float(c) if low_ > 0 and np.isfinite(c) else None for c, low_ in zip(cond, low)]})


def rank_check(df: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """RG19: complete rows, rank and condition number of the centred design, aliased terms."""
    st = O.sufficient_stats(df, y, xs, keys)
    fit = O.fit_from_stats(st, keys)
    names = F.array(*[F.lit(x) for x in xs])
    aliased = F.filter(F.transform(F.sequence(F.lit(1), F.lit(len(xs))),
                                   lambda i: F.when(F.col("aliased")[i - 1], F.element_at(names, i))),
                       lambda s: s.isNotNull())
    r = st.select(*keys, rank_udf("sxx").alias("_r"))
    return fit.select(*keys, "n", "k", aliased.alias("aliased_terms")).join(r, on=list(keys)) \
        .select(*keys, "n", "k", "aliased_terms", "_r.rank", "_r.condition")


# ------------------------------------------------------------ robust SEs
def robust_se(df: DataFrame, fit: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str],
              order: str, kind: str, param: float = 0, adjust: bool = True) -> DataFrame:
    """keys + ``se`` array under a robust covariance.

    kind: 'hc1'; 'nw' (lag = param); 'bartlett' (bandwidth = param);
    'nw_prewhite' (lag = param, VAR(1) prewhitening).
    """
    p = len(xs) + 1
    res = O.residuals(df, fit, y, xs, keys)
    sc = H.with_scores(res, xs)
    small = fit.select(*keys, "n", "xtx_inv")
    if kind == "hc1":
        meat = H.hc_meat(sc, p, keys)
        j = small.join(meat, on=list(keys))
        return j.select(*keys, H.hc1_se_udf("xtx_inv", "meat", F.col("n").cast("double")).alias("se"))
    if kind in ("nw", "bartlett"):
        lags = int(param) if kind == "nw" else int(math.ceil(param)) - 1
        g = H.gamma_sums(sc, p, keys, order, lags)
        j = small.join(g, on=list(keys))
        udf = H.hac_se_udf(kind, param, adjust)
        return j.select(*keys, udf("xtx_inv", "gam", F.col("n").cast("double"),
                                   F.lit(None).cast("array<double>")).alias("se"))
    if kind == "nw_prewhite":
        pw = H.var1_prewhiten(sc, p, keys, order)
        g = H.gamma_sums(pw, p, keys, order, int(param), u="v")
        dm = pw.groupBy(*keys).agg(F.first("D").alias("D"))
        j = small.join(g, on=list(keys)).join(dm, on=list(keys))
        udf = H.hac_se_udf("nw", param, adjust)
        return j.select(*keys, udf("xtx_inv", "gam", F.col("n").cast("double"), "D").alias("se"))
    raise ValueError(kind)


def newey_west_bandwidth(sc: DataFrame, keys: Sequence[str], terms: Sequence[int], u: str = "u") -> DataFrame:
    """Newey–West (1994) bandwidth from the autocovariances of the sum of the scores
    ``terms``: keys, ``_n``, ``bandwidth``. A group's own number of lags counts; the lag
    products are rows of an equi-join and one aggregate."""
    total = reduce(lambda a, i: a + F.col(u)[i], terms, F.lit(0.0))
    d = cut_lineage(sc.select(*keys, "pos", total.alias("_w")), "score-sums")
    n = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col("_w") * F.col("_w")).alias("_s0"))
    longest = n.agg(F.max("_n")).first()[0] or 1
    most = int(math.floor(4 * (longest / 100) ** (2 / 9)))
    j = H.lagged(d, keys, "_w", max(most, 1)).join(n.select(*keys, "_n"), on=list(keys)) \
        .filter(F.col("lag") <= F.floor(4 * F.pow(F.col("_n") / 100, F.lit(2 / 9))))
    g = j.groupBy(*keys).agg(F.sum(F.col("_w") * F.col("past")).alias("_a"), F.sum(F.col("lag") * F.col("_w") * F.col("past")).alias("_b"))
    q = n.join(g, on=list(keys), how="left").fillna(0.0, ["_a", "_b"])
    ratio = F.try_divide(2 * F.col("_b"), F.col("_s0") + 2 * F.col("_a"))
    return q.select(*keys, F.col("_n").cast("double").alias("_n"),
                    (1.1447 * F.pow(ratio * ratio * F.col("_n"), F.lit(1 / 3))).alias("bandwidth"))


def series_robust_se(df: DataFrame, fit: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str],
                     order: str, kind: str, adjust: bool = True, buckets: str | None = None) -> DataFrame:
    """RG16/RG17: HAC errors with a bandwidth from the data, keys, ``se``, ``bandwidth``:
    'nw_auto' (Bartlett weights 1 − l/(bandwidth + 1), Newey–West 1994) or 'qs_andrews'
    (quadratic-spectral kernel, Andrews' AR(1) rule). Lag products are tiles of position
    buckets, each group weighted by its own bandwidth. ``buckets``: an integer column,
    for positions of very long series."""
    keys, p = list(keys), len(xs) + 1
    res = O.residuals(df, fit, y, xs, keys).select(*keys, order, *xs, "resid", *([buckets] if buckets else []))
    sc = cut_lineage(H.positions(H.with_scores(res, xs), keys, order, buckets).select(*keys, "pos", "u"), "scores")
    if kind == "nw_auto":
        bw = cut_lineage(newey_west_bandwidth(sc, keys, range(1, p)), "bandwidth")
        meat = H.kernel_meat(sc, bw.withColumn("bandwidth", F.col("bandwidth") + 1), p, keys, "bartlett")
    elif kind == "qs_andrews":
        bw = cut_lineage(H.andrews_bandwidth(sc, p, keys), "bandwidth")
        meat = H.kernel_meat(sc, bw, p, keys, "qs")
    else:
        raise ValueError(kind)
    j = fit.select(*keys, "xtx_inv", F.col("k").cast("double").alias("k")).join(bw, on=keys).join(meat, on=keys, how="left")
    return j.select(*keys, H.meat_se_udf(adjust)("xtx_inv", "meat", "_n", "k").alias("se"), "bandwidth")


# ------------------------------------------------- one regression over regimes
def regime_fit(df: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str], regime: str = "regime",
               materialize: bool = False) -> DataFrame:
    """RG21: y on regime, regime × xs in one regression. Its design is block-diagonal, so the
    coefficients are those of each regime and the residual variance is pooled over the
    regimes of a group: keys, regime, ``beta``, ``se``, ``xtx_inv``, ``n_all``, ``k_all``,
    ``df_resid``, ``sigma``, and the whole model's ``rss_all`` and ``r2`` (about the mean)."""
    keys = list(keys)
    fit = cut_lineage(O.ols(df, y, xs, [*keys, regime]), "regime-fit")
    n, k = F.sum("n"), F.sum("k")
    mean = F.try_divide(F.sum(F.col("n") * F.col("my")), n)
    whole = fit.groupBy(*keys).agg(n.alias("n_all"), k.alias("k_all"), F.sum("rss").alias("rss_all"),
                                   (F.sum(F.col("tss") + F.col("n") * F.col("my") * F.col("my")) - n * mean * mean).alias("_tss"))
    j = fit.select(*keys, regime, "beta", "xtx_inv", "aliased").join(whole, on=keys)
    df_all = F.col("n_all") - F.col("k_all")
    sigma = F.sqrt(F.when(df_all > 0, F.col("rss_all") / df_all))
    p = len(xs) + 1
    kept = [F.lit(False), *[F.col("aliased")[i] for i in range(p - 1)]]
    se = F.array(*[F.when(~kept[i], sigma * F.sqrt(F.col("xtx_inv")[i * p + i])) for i in range(p)])
    out = j.select(*keys, regime, "beta", se.alias("se"), "xtx_inv", "n_all", "k_all", df_all.alias("df_resid"), sigma.alias("sigma"),
                   "rss_all", (1 - F.try_divide(F.col("rss_all"), F.col("_tss"))).alias("r2"))
    return cut_lineage(out, "regime-model") if materialize else out


def regime_robust_se(df: DataFrame, fit: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str], order: str,
                     kind: str, param: float = 0, adjust: bool = True, regime: str = "regime") -> DataFrame:
    """RG14, RG16–RG18 for the regression over regimes: keys, regime, ``se``, ``bandwidth``.
    A row's score lies in the block of its regime. Lag products within a regime give its
    diagonal block of the covariance, which is all that its errors need; those across a
    border belong to the blocks beside the diagonal (:func:`regime_covariance`).

    kind: 'nw' (lag = param), 'bartlett' (bandwidth = param), 'nw_auto', 'qs_andrews';
    data-driven bandwidths count the scores of all slopes of all regimes."""
    cov = regime_covariance(df, fit, y, xs, keys, order, kind, param, adjust, regime)
    same = cov.filter(F.col(f"a_{regime}") == F.col(f"b_{regime}"))
    p = len(xs) + 1
    se = F.array(*[F.when(F.col("cov")[i * p + i] > 0, F.sqrt(F.col("cov")[i * p + i])) for i in range(p)])
    return same.select(*keys, F.col(f"a_{regime}").alias(regime), se.alias("se"), "bandwidth")


def regime_covariance(df: DataFrame, fit: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str], order: str,
                      kind: str, param: float = 0, adjust: bool = True, regime: str = "regime") -> DataFrame:
    """The robust covariance of the regression over regimes in blocks: keys, ``a_regime``,
    ``b_regime``, ``cov`` (p × p), ``bandwidth``; absent blocks are zero."""
    keys, p = list(keys), len(xs) + 1
    res = O.residuals(df, fit, y, xs, [*keys, regime]).select(*keys, regime, order, *xs, "resid")
    sc = cut_lineage(H.positions(H.with_scores(res, xs), keys, order).select(*keys, regime, "pos", "u"), "scores")
    groups = fit.select(*keys, "n_all", "k_all").distinct()
    if kind in ("nw", "bartlett"):
        bw = groups.select(*keys, F.lit(float(param)).alias("bandwidth"))
    elif kind == "nw_auto":
        bw = newey_west_bandwidth(sc, keys, range(1, p)).select(*keys, "bandwidth")
    elif kind == "qs_andrews":
        bw = regime_andrews_bandwidth(sc, p, keys, regime)
    else:
        raise ValueError(kind)
    bw = cut_lineage(bw, "bandwidth")
    width = bw.withColumn("bandwidth", F.col("bandwidth") + 1) if kind in ("nw", "nw_auto") else bw
    meat = H.kernel_meat(sc, width, p, keys, "qs" if kind == "qs_andrews" else "bartlett", [regime])
    inverse = fit.select(*keys, regime, "xtx_inv", F.col("n_all").cast("double").alias("_n"), F.col("k_all").cast("double").alias("_k"))
    for side in "ab":
        own = inverse.select(*keys, F.col(regime).alias(f"{side}_{regime}"), F.col("xtx_inv").alias(f"_{side}"),
                             *(["_n", "_k"] if side == "a" else []))
        meat = meat.join(own, on=[*keys, f"{side}_{regime}"])
    return meat.join(bw, on=keys).select(*keys, f"a_{regime}", f"b_{regime}", "bandwidth",
                                         H.block_covariance_udf(adjust)("_a", "meat", "_b", "_n", "_k").alias("cov"))


def regime_andrews_bandwidth(sc: DataFrame, p: int, keys: Sequence[str], regime: str) -> DataFrame:
    """Andrews' rule over the scores of all slopes of all regimes. A slope's score is zero
    outside its regime, so its sums are those of its regime's rows, and a lag product
    needs both rows in it."""
    j = sc.select(*keys, regime, "pos", "u")
    past = j.select(*keys, regime, (F.col("pos") + 1).alias("pos"), F.col("u").alias("past"))
    last = sc.groupBy(*keys).agg(F.max("pos").alias("_n"))
    both = j.join(past, on=[*keys, regime, "pos"], how="left").join(last, on=list(keys))
    sums = []
    for i in range(1, p):
        u, b = F.col("u")[i], F.coalesce(F.col("past")[i], F.lit(0.0))
        # rows 2..n as current, rows 1..n-1 as past
        sums += [F.sum(F.when(F.col("pos") > 1, u * u)).alias(f"uu{i}"), F.sum(u * b).alias(f"ul{i}"),
                 F.sum(F.when(F.col("pos") < F.col("_n"), u * u)).alias(f"ll{i}")]
    g = both.groupBy(*keys, regime).agg(F.max("_n").cast("double").alias("_n"), *sums)
    num = den = F.lit(0.0)
    for i in range(1, p):
        rho = F.try_divide(F.col(f"ul{i}"), F.col(f"ll{i}"))
        s2 = F.pow(F.try_divide(F.col(f"uu{i}") - 2 * rho * F.col(f"ul{i}") + rho * rho * F.col(f"ll{i}"), F.col("_n") - 1), F.lit(2.0))
        num = num + F.coalesce(F.try_divide(4 * rho * rho * s2, F.pow(1 - rho, F.lit(8.0))), F.lit(0.0))
        den = den + F.coalesce(F.try_divide(s2, F.pow(1 - rho, F.lit(4.0))), F.lit(0.0))
    t = g.groupBy(*keys).agg(F.sum(num).alias("_num"), F.sum(den).alias("_den"), F.max("_n").alias("_n"))
    return t.select(*keys, (1.3221 * F.pow(F.try_divide(F.col("_num"), F.col("_den")) * F.col("_n"), F.lit(0.2))).alias("bandwidth"))


def se_table(se: DataFrame, fit: DataFrame, xs: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Long table: term, estimate, robust se, t, p (Student t with the model's df)."""
    names = F.array(*[F.lit(t) for t in O.terms(xs)])
    j = fit.select(*keys, "beta", "df_resid").join(se, on=list(keys))
    ex = j.select(*keys, "df_resid", F.posexplode(F.arrays_zip("beta", "se")).alias("pos", "z"))
    out = ex.select(*keys, F.element_at(names, F.col("pos") + 1).alias("term"),
                    F.col("z.beta").alias("estimate"), F.col("z.se").alias("se"), "df_resid")
    out = out.withColumn("t_stat", F.try_divide(F.col("estimate"), F.col("se")))
    return out.withColumn("p_value", t_pvalue_udf("t_stat", F.col("df_resid").cast("double")))
