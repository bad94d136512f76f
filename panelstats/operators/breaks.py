"""Structural break tests (SB1–SB9).

One running-sum window over each series (centred by the series mean) gives,
for every row i, the cross products of rows 1..i; the complement is total
minus prefix. The residual sum of squares of both segments at every
candidate split therefore comes from one window pass plus a batched k×k
solve per row (Arrow UDF) — no per-candidate re-fit, no self-join of the
series. CUSUM/MOSUM paths are running / moving sums of OLS residuals.

Bai–Perron needs the RSS of every admissible segment: tiles of joined prefix
sums, then rounds of join and minimum (:func:`bai_perron`).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dist import norm_cdf
from ..functions.linalg import alias_mask, masked_system, safe_inv, stack
from ..session import cut_lineage
from . import ols as O
from . import tiles as TL

# Fixed value: 95 % likelihood-ratio bound for a break date (Hansen 2000 form).
LR_CRIT_95 = -2.0 * math.log(1.0 - math.sqrt(0.95))


def prefix_sums(df: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str], order: str,
                buckets: str | None = None, bucket_size: int = 64) -> DataFrame:
    """Per row: pos, n_rows, prefix sums (rows 1..pos) and totals of
    [x…, y] and their cross products, on series-centred values.

    Default: one window per series (a panel series is bounded by its number of
    periods). ``buckets``: an integer column to cut a very long series into
    buckets — series means, totals and counts then come from aggregates and
    the running sums from :func:`windows.running_sums_long`, so no task holds
    a whole series.
    """
    xs = list(xs)
    d = df.filter(O.complete([y, *xs]))
    cols = [*xs, y]
    q = len(cols)
    pairs = [(a, b) for a in range(q) for b in range(a, q)]
    if buckets is None:
        wall = Window.partitionBy(*keys)
        w = Window.partitionBy(*keys).orderBy(order)
        run = w.rowsBetween(Window.unboundedPreceding, 0)
        d = d.select(*keys, order, *[(F.col(c) - F.avg(c).over(wall)).alias(f"_c_{c}") for c in cols])
        prods = [F.col(f"_c_{c}") for c in cols]
        first = [*prods, *[prods[a] * prods[b] for a, b in pairs]]
        return d.select(
            *keys, order,
            F.row_number().over(w).alias("pos"), F.count(F.lit(1)).over(wall).alias("n_rows"),
            F.array(*[F.sum(v).over(run) for v in first]).alias("pre"),
            F.array(*[F.sum(v).over(wall) for v in first]).alias("tot"),
        )
    from .windows import running_sums_long
    mu = d.groupBy(*keys).agg(*[F.avg(c).alias(f"_mu_{c}") for c in cols], F.count(F.lit(1)).alias("n_rows"))
    c = d.join(mu, on=list(keys)).select(*keys, order, buckets, "n_rows",
                                        *[(F.col(x) - F.col(f"_mu_{x}")).alias(f"_c_{x}") for x in cols])
    prods = [F.col(f"_c_{x}") for x in cols]
    first = [*prods, *[prods[a] * prods[b] for a, b in pairs]]
    vals = {f"_p{i}": v for i, v in enumerate(first)}
    r = running_sums_long(c, vals, keys, order, buckets, bucket_size)
    tot = c.groupBy(*keys).agg(F.array(*[F.sum(v) for v in first]).alias("tot"))
    return r.join(tot, on=list(keys)).select(
        *keys, order, "pos", "n_rows", F.array(*[F.col(n) for n in vals]).alias("pre"), "tot")


def _segment_rss(c, P, q):
    """RSS with intercept of a segment with count c and raw sums P (layout of prefix_sums)."""
    k = q - 1
    s1 = P[:, :q]
    idx = {}
    pos = q
    for a in range(q):
        for b in range(a, q):
            idx[(a, b)] = idx[(b, a)] = pos
            pos += 1
    with np.errstate(divide="ignore", invalid="ignore"):
        C = np.empty((len(c), q, q))
        for a in range(q):
            for b in range(q):
                C[:, a, b] = P[:, idx[(a, b)]] - s1[:, a] * s1[:, b] / c
        S = C[:, :k, :k]
        s = C[:, :k, k]
        syy = C[:, k, k]
        ok = c > k + 1
        # a column that is constant or collinear within a segment is aliased there
        S = np.where(ok[:, None, None], S, np.eye(k)[None])
        keep = alias_mask(S, c, s1[:, :k] / c[:, None])
        sk = np.where(keep, s, 0.0)
        b = np.linalg.solve(masked_system(S, keep), sk[..., None])[..., 0]
        rss = syy - np.einsum("gi,gi->g", b, sk)
    return np.where(ok, rss, np.nan)


_SPLIT = T.StructType([T.StructField("rss1", T.DoubleType()), T.StructField("rss2", T.DoubleType()),
                       T.StructField("rss", T.DoubleType())])


@F.pandas_udf(_SPLIT)
def split_rss_udf(pre: pd.Series, tot: pd.Series, pos: pd.Series, n: pd.Series) -> pd.DataFrame:
    width = len(pre.iloc[0])
    q = int((-3 + math.sqrt(9 + 8 * width)) / 2)  # width = q + q(q+1)/2
    P = stack(pre, width)
    Tt = stack(tot, width)
    c1 = pos.to_numpy(float)
    nn = n.to_numpy(float)
    r1 = _segment_rss(c1, P, q)
    r2 = _segment_rss(nn - c1, Tt - P, q)
    r = _segment_rss(nn, Tt, q)

    def clean(a):
        return [float(v) if np.isfinite(v) else None for v in a]
    return pd.DataFrame({"rss1": clean(r1), "rss2": clean(r2), "rss": clean(r)})


def split_path(df: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str], order: str,
               trim: float = 0.15) -> DataFrame:
    """SB4 path: Chow-type F at every candidate end of segment 1,
    i ∈ [floor(trim·n), n − floor(trim·n)]: F = (RSS − RSS1 − RSS2)/((RSS1+RSS2)/(n − 2p))."""
    p = len(xs) + 1
    ps = prefix_sums(df, y, xs, keys, order)
    n = F.col("n_rows")
    cand = ps.filter((F.col("pos") >= F.floor(n * trim)) & (F.col("pos") <= n - F.floor(n * trim)))
    cand = cand.withColumn("_s", split_rss_udf("pre", "tot", "pos", "n_rows"))
    u = F.col("_s.rss1") + F.col("_s.rss2")
    f = F.try_divide(F.col("_s.rss") - u, F.try_divide(u, n - 2 * p))
    return cand.select(*keys, order, "pos", "n_rows", F.col("_s.rss").alias("rss_full"), u.alias("rss_split"),
                       f.alias("f_stat"))


def sup_f(path: DataFrame, keys: Sequence[str], order: str, k: int | None = None) -> DataFrame:
    """SB4: sup F and the first position attaining it; with ``k`` (coefficients that may
    break) its asymptotic p-value."""
    out = path.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_cand"), F.max("f_stat").alias("sup_f"), F.max("n_rows").alias("_n"),
        F.min("pos").alias("_from"), F.max("pos").alias("_to"),
        F.min_by(F.struct("pos", order), F.struct((-F.col("f_stat")).alias("nf"), F.col("pos").alias("p"))).alias("_b"),
    )
    span = F.col("_to") / F.col("_from") * (F.col("_n") - F.col("_from")) / (F.col("_n") - F.col("_to"))
    p = [] if k is None else [sup_f_p(F.col("sup_f"), k, span).alias("p_value")]
    return out.select(*keys, "n_cand", "sup_f", F.col("_b.pos").alias("break_pos"), F.col(f"_b.{order}").alias(f"break_{order}"), *p)


def sup_f_p(x: F.Column, k: int, span: F.Column) -> F.Column:
    """Upper tail of the supremum of a squared Bessel bridge process of order k over
    [l1, l2] at x, span = l2 (1 − l1) / (l1 (1 − l2)) (DeLong 1981; Andrews 1993):
    x^(k/2) e^(−x/2) / (2^(k/2) Γ(k/2)) · ((1 − k/x) ln span + 2/x). The formula is for the
    tail; below x = k the p-value is 1."""
    density = F.exp(F.log(x) * (k / 2) - x / 2 - (k / 2 * math.log(2) + math.lgamma(k / 2)))
    return F.when(x <= k, F.lit(1.0)).otherwise(F.least(F.lit(1.0), density * ((1 - k / x) * F.log(span) + 2 / x)))


def chow_at(df: DataFrame, positions: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str],
            order: str) -> DataFrame:
    """SB5: Chow F at given split positions (last row of segment 1):
    F = ((RSS − RSS1 − RSS2)/p)/((RSS1 + RSS2)/(n − 2p))."""
    p = len(xs) + 1
    ps = prefix_sums(df, y, xs, keys, order)
    j = ps.join(positions, on=[*keys, "pos"])
    j = j.withColumn("_s", split_rss_udf("pre", "tot", "pos", "n_rows"))
    u = F.col("_s.rss1") + F.col("_s.rss2")
    f = F.try_divide((F.col("_s.rss") - u) / p, F.try_divide(u, F.col("n_rows") - 2 * p))
    from ..functions.dist import f_pvalue_udf
    out = j.select(*keys, *[c for c in positions.columns if c not in keys and c != "pos"], "pos", order,
                   f.alias("f_stat"), F.lit(p).alias("df1"), (F.col("n_rows") - 2 * p).alias("df2"))
    return out.withColumn("p_value", f_pvalue_udf("f_stat", F.col("df1").cast("double"), F.col("df2").cast("double")))


def break_conf_set(path: DataFrame, keys: Sequence[str]) -> DataFrame:
    """SB8 (re-aimed): candidates with n·log(RSS(τ)/RSS*) ≤ −2·log(1 − √0.95)."""
    best = path.groupBy(*keys).agg(F.min("rss_split").alias("_best"))
    j = path.join(best, on=list(keys))
    lr = F.col("n_rows") * F.log(F.try_divide(F.col("rss_split"), F.col("_best")))
    return j.filter(lr <= LR_CRIT_95).drop("_best")


# ------------------------------------------------- intervals of several breaks
def argmax_cdf(x: np.ndarray, xi: np.ndarray, phi: np.ndarray) -> np.ndarray:
    """Distribution function of the argmax of a two-sided Brownian motion with drift −|s|/2
    and variance 1 on the left, drift −xi |s|/2 and variance phi on the right (Bai 1997)."""
    s = np.sqrt(np.abs(x))
    left, ratio = x < 0, xi / phi
    log_tail = lambda z: _log_norm_cdf(-z)
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        below = (-s * np.exp(-s * s / 8) / math.sqrt(2 * math.pi)
                 - phi / xi * (phi + 2 * xi) / (phi + xi) * np.exp(ratio * (1 + ratio) * s * s / 2 + log_tail((0.5 + ratio) * s))
                 + (s * s / 2 - 2 + (phi + 2 * xi) ** 2 / ((phi + xi) * xi)) * np.exp(log_tail(s / 2)))
        a = xi * s / np.sqrt(phi)  # the right side, scaled to variance 1 and drift 1/2
        above = (1 + a * np.exp(-a * a / 8) / math.sqrt(2 * math.pi)
                 + xi / phi * (2 * phi + xi) / (phi + xi) * np.exp((phi + xi) * s * s / 2 + log_tail((phi + xi / 2) / np.sqrt(phi) * s))
                 - ((2 * phi + xi) ** 2 / ((phi + xi) * phi) - 2 + a * a / 2) * np.exp(log_tail(a / 2)))
    return np.where(left, below, above)


def _log_norm_cdf(z: np.ndarray) -> np.ndarray:
    """log Φ(z) for z ≤ 0, by the asymptotic series far out."""
    with np.errstate(divide="ignore", over="ignore"):
        near = np.log(np.maximum(norm_cdf(np.maximum(z, -12.0)), 1e-300))
        q = 1 / np.minimum(z, -1.0) ** 2
        far = -z * z / 2 - np.log(np.maximum(-z, 1.0)) - 0.5 * math.log(2 * math.pi) + np.log1p(-q + 3 * q * q - 15 * q ** 3)
    return np.where(z > -12.0, near, far)


def argmax_quantile(level: float, xi: np.ndarray, phi: np.ndarray) -> np.ndarray:
    """Quantile of :func:`argmax_cdf` for each row by bisection of all rows at once."""
    sign = np.where(argmax_cdf(np.zeros_like(xi), xi, phi) < level, 1.0, -1.0)
    lo, hi = np.zeros_like(xi), np.ones_like(xi)
    for _ in range(200):  # widen until the level is passed
        wide = sign * (argmax_cdf(sign * hi, xi, phi) - level) < 0
        if not wide.any():
            break
        hi = np.where(wide, 2 * hi, hi)
    for _ in range(200):
        mid = (lo + hi) / 2
        inside = sign * (argmax_cdf(sign * mid, xi, phi) - level) < 0
        lo, hi = np.where(inside, mid, lo), np.where(inside, hi, mid)
    return sign * (lo + hi) / 2


def break_interval_udf(level: float):
    """Arrow UDF: (δ'Q₁δ, δ'Q₂δ, σ₁², σ₂²) → rows before and after a break that its
    interval covers."""
    @F.pandas_udf("lower double, upper double")
    def _udf(q1: pd.Series, q2: pd.Series, s1: pd.Series, s2: pd.Series) -> pd.DataFrame:
        q1, q2, s1, s2 = (v.to_numpy(float) for v in (q1, q2, s1, s2))
        ok = (q1 > 0) & (q2 > 0) & (s1 > 0) & (s2 > 0)
        xi = np.where(ok, q2 / np.where(ok, q1, 1.0), 1.0)
        phi = np.where(ok, xi * s2 / np.where(ok, s1, 1.0), 1.0)
        scale = np.where(ok, s1 / np.where(ok, q1, 1.0), np.nan)
        tail = (1 - level) / 2
        low, high = argmax_quantile(tail, xi, phi), argmax_quantile(1 - tail, xi, phi)
        ok &= (low < 0) & (high > 0)  # else one side has no part in the interval
        low, high = np.where(ok, low * scale, np.nan), np.where(ok, high * scale, np.nan)
        return pd.DataFrame({"lower": pd.Series(np.floor(low)).where(ok, None), "upper": pd.Series(np.ceil(high)).where(ok, None)})

    return _udf


def break_intervals(reg: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str], order: str, level: float = 0.95) -> DataFrame:
    """SB8: interval of every break of a partition (Bai 1997). ``reg`` has ``pos`` and
    ``regime``. The change of coefficients δ between two neighbouring regimes, each
    regime's X'X/n and residual variance give the limit distribution of the estimated
    date; one row per break: ``break_no``, ``break_pos`` (last row of its regime), ``lower``,
    ``upper`` and the three as ``order`` (null outside the series). Perfect fits and breaks
    whose interval would lie on one side only have null bounds."""
    keys, k = list(keys), len(xs)
    st = O.sufficient_stats(reg, y, xs, [*keys, "regime"])
    fit = O.fit_from_stats(st, [*keys, "regime"]).select(*keys, "regime", "beta", "rss")
    ends = reg.groupBy(*keys, "regime").agg(F.max("pos").alias("break_pos"))
    one = st.join(fit, on=[*keys, "regime"]).join(ends, on=[*keys, "regime"]).select(
        *keys, "regime", "break_pos", F.transform("beta", lambda b: F.coalesce(b, F.lit(0.0))).alias("b"), "mx",
        F.transform("sxx", lambda v: v / F.col("n")).alias("q"), (F.col("rss") / F.col("n")).alias("s"))
    one = cut_lineage(one, "regime-moments")
    two = one.select(*keys, (F.col("regime") - 1).alias("regime"), *[F.col(c).alias(f"{c}2") for c in ("b", "mx", "q", "s")])
    j = one.join(two, on=[*keys, "regime"])
    d = [F.col("b2")[i] - F.col("b")[i] for i in range(k + 1)]

    def form(mx: str, q: str) -> F.Column:  # δ' (X'X/n) δ from centred moments
        level_ = reduce(lambda a, i: a + d[i + 1] * F.col(mx)[i], range(k), d[0])
        return reduce(lambda a, ij: a + d[ij[0] + 1] * d[ij[1] + 1] * F.col(q)[ij[0] * k + ij[1]],
                      [(i, l) for i in range(k) for l in range(k)], level_ * level_)

    j = j.withColumn("_i", break_interval_udf(level)(form("mx", "q"), form("mx2", "q2"), "s", "s2"))
    out = j.select(*keys, F.col("regime").alias("break_no"), "break_pos", (F.col("break_pos") - F.col("_i.upper")).cast("int").alias("lower"),
                   (F.col("break_pos") - F.col("_i.lower")).cast("int").alias("upper"))
    places = reg.select(*keys, "pos", order)
    for c in ("lower", "break_pos", "upper"):
        name = f"{c.replace('_pos', '')}_{order}"
        out = out.join(places.select(*keys, F.col("pos").alias(c), F.col(order).alias(name)), on=[*keys, c], how="left")
    return out.select(*keys, "break_no", "break_pos", "lower", "upper", f"lower_{order}", f"break_{order}", f"upper_{order}")


def regime_from_break(df: DataFrame, breaks: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """SB7/WN9: regime number from break positions (last row of each segment)."""
    from .windows import regime_label
    w = Window.partitionBy(*keys).orderBy(order)
    d = df.withColumn("pos", F.row_number().over(w))
    return regime_label(d, breaks, keys, "pos")


# ---------------------------------------------------------- CUSUM / MOSUM
def kolmogorov_p(x: F.Column, terms: int = 100) -> F.Column:
    """P(sup|Brownian bridge| > x) = 2 Σ_{j≥1} (−1)^{j+1} exp(−2 j² x²) (JVM-side); below
    1 by the dual series 1 − √(2π)/x Σ exp(−(2j − 1)² π² / 8x²), which converges there."""
    upper = 2 * F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0),
                            lambda acc, j: acc + F.pow(F.lit(-1.0), j + 1) * F.exp(-2 * j * j * x * x))
    lower = 1 - F.try_divide(F.lit(math.sqrt(2 * math.pi)), x) * F.aggregate(
        F.sequence(F.lit(1), F.lit(10)), F.lit(0.0),
        lambda acc, j: acc + F.exp(-F.try_divide((2 * j - 1) * (2 * j - 1) * F.lit(math.pi ** 2), 8 * x * x)))
    return F.when(x <= 0, F.lit(1.0)).when(x < 1, lower).otherwise(upper)


def ols_cusum(res: DataFrame, keys: Sequence[str], order: str, p: int,
              buckets: str | None = None, bucket_size: int = 64) -> DataFrame:
    """SB1: path cumsum(e)/(σ̂√n), σ̂² = Σe²/(n − p); sup |path| and its p-value.

    ``buckets`` (an integer column, e.g. the period number): for a single very
    long series the running sum is two-level (:func:`windows.running_sums_long`)
    and σ̂, n come from an aggregate — no task holds the whole series.
    """
    if buckets is None:
        wall = Window.partitionBy(*keys)
        w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        n = F.count(F.lit(1)).over(wall)
        sig = F.sqrt(F.try_divide(F.sum(F.col("resid") ** 2).over(wall), n - p))
        path = res.select(*keys, order, F.try_divide(F.sum("resid").over(w), sig * F.sqrt(n)).alias("cusum"))
    else:
        from .windows import running_sums_long
        st = res.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col("resid") ** 2).alias("_ss"))
        run = running_sums_long(res.select(*keys, order, buckets, "resid"), {"_cs": F.col("resid")},
                                keys, order, buckets, bucket_size)
        j = run.join(st, on=list(keys))
        sig = F.sqrt(F.try_divide(F.col("_ss"), F.col("_n") - p))
        path = j.select(*keys, order, F.try_divide(F.col("_cs"), sig * F.sqrt(F.col("_n"))).alias("cusum"))
    g = path.groupBy(*keys).agg(F.max(F.abs("cusum")).alias("statistic"))
    return g.withColumn("p_value", kolmogorov_p(F.col("statistic")))


def ols_mosum(res: DataFrame, keys: Sequence[str], order: str, p: int, h: float = 0.15) -> DataFrame:
    """SB2: moving sums of nh = floor(h·n) residuals over σ̂√n, sup |path|.

    The window width depends on each series' n, so the moving sum is
    S_t − S_{t−nh} with S the running sum, read by an equi-join on
    (keys, pos − nh)."""
    wall = Window.partitionBy(*keys)
    w = Window.partitionBy(*keys).orderBy(order)
    n = F.count(F.lit(1)).over(wall)
    d = res.select(*keys, order, F.row_number().over(w).alias("pos"), n.alias("n_rows"),
                   F.sum("resid").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("S"),
                   F.sqrt(F.try_divide(F.sum(F.col("resid") ** 2).over(wall), n - p)).alias("sigma"))
    d = d.withColumn("nh", F.floor(F.col("n_rows") * h).cast("int"))
    past = d.select(*keys, F.col("pos").alias("_pp"), F.col("S").alias("_Sp"))
    cur = d.filter(F.col("pos") >= F.col("nh"))
    j = cur.join(past, on=[*[cur[k] == past[k] for k in keys], cur["pos"] - cur["nh"] == past["_pp"]], how="left")
    mos = F.try_divide(cur["S"] - F.coalesce(F.col("_Sp"), F.lit(0.0)), cur["sigma"] * F.sqrt(cur["n_rows"]))
    j = j.select(*[cur[k] for k in keys], cur["nh"], mos.alias("mosum"))
    g = j.groupBy(*keys).agg(F.max(F.abs("mosum")).alias("statistic"), F.first("nh").alias("window"))
    return g.withColumn("p_value", mosum_p_udf("statistic", F.lit(float(h))))


@F.pandas_udf(T.DoubleType())
def mosum_p_udf(x: pd.Series, h: pd.Series) -> pd.Series:
    """P(sup |B(t + h) − B(t)| > x) for a Brownian bridge B. With u = x/√(h(1 − h)) the mean
    number of clumps above u on both sides is 2(1 − Φ(u) + u φ(u)/h) (Pickands 1969; Aldous
    1989: correlation 1 − |s|/(h(1 − h)) near 0 over a length of 1 − h), and p = 1 − e^−mean."""
    x, h = x.to_numpy(float), h.to_numpy(float)
    u = x / np.sqrt(h * (1 - h))
    with np.errstate(invalid="ignore", under="ignore"):
        mean = 2 * (norm_cdf(-u) + u * np.exp(-u * u / 2) / math.sqrt(2 * math.pi) / h)
    return pd.Series(-np.expm1(-mean)).where(np.isfinite(x), None)


@F.pandas_udf(T.DoubleType())
def recursive_resid_udf(pre_prev: pd.Series, row: pd.Series, pos: pd.Series) -> pd.Series:
    """w_t = (y_t − x_t'b_{t−1}) / sqrt(1 + x_t'(X'X)_{t−1}⁻¹ x_t) from raw prefix sums
    of rows 1..t−1 (layout: [1, x…, y] sums then cross products). Vectorised over
    the whole Arrow batch (batched inverse), no per-row Python."""
    q = len(row.iloc[0])
    width = q * (q + 1) // 2
    R = stack(row, q)
    P = stack(pre_prev, width)
    G = len(R)
    M = np.empty((G, q, q))
    k = 0
    for a in range(q):
        for b in range(a, q):
            M[:, a, b] = M[:, b, a] = P[:, k]
            k += 1
    XtX, Xty = M[:, :-1, :-1], M[:, :-1, -1]
    x, yv = R[:, :-1], R[:, -1]
    ok = np.isfinite(P).all(axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        # aliased columns drop out, as in ``ols``; a row that moves along a dropped
        # direction cannot be predicted from the rows before it
        inv, keep = safe_inv(np.where(ok[:, None, None], XtX, np.eye(q - 1)[None]))
        proj = np.einsum("gij,gjk->gik", inv, XtX)
        gap = np.abs(x - np.einsum("gik,gi->gk", proj, x)) > 1e-6 * np.maximum(1.0, np.abs(x))
        ok &= ~gap.any(axis=1)
        b = np.einsum("gij,gj->gi", inv, Xty)
        f = 1.0 + np.einsum("gi,gij,gj->g", x, inv, x)
        w = (yv - np.einsum("gi,gi->g", x, b)) / np.sqrt(f)
    ok &= f > 0
    return pd.Series(np.where(ok, w, np.nan)).where(ok, None)


def recursive_residuals(df: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str], order: str,
                        buckets: str | None = None, bucket_size: int = 64) -> DataFrame:
    """Recursive residuals for t = p+1..n from running sums of rows 1..t−1.

    ``buckets``: two-level running sums (inclusive sums minus the row's own
    products) and series means from an aggregate, for a single very long series.
    """
    xs = list(xs)
    d = df.filter(O.complete([y, *xs]))
    p = len(xs) + 1
    if buckets is None:
        wall = Window.partitionBy(*keys)
        w = Window.partitionBy(*keys).orderBy(order)
        cols = [F.lit(1.0), *[F.col(x) - F.avg(x).over(wall) for x in xs], F.col(y) - F.avg(y).over(wall)]
        q = len(cols)
        d = d.select(*keys, order, F.array(*cols).alias("_r"), F.row_number().over(w).alias("pos"))
        prods = [F.col("_r")[a] * F.col("_r")[b] for a in range(q) for b in range(a, q)]
        prev = w.rowsBetween(Window.unboundedPreceding, -1)
        d = d.select("*", F.array(*[F.sum(v).over(prev) for v in prods]).alias("_pp"))
    else:
        from .windows import running_sums_long
        mu = d.groupBy(*keys).agg(*[F.avg(c).alias(f"_mu_{c}") for c in [*xs, y]])
        c = d.join(mu, on=list(keys)).select(
            *keys, order, buckets,
            F.array(F.lit(1.0), *[F.col(x) - F.col(f"_mu_{x}") for x in xs], F.col(y) - F.col(f"_mu_{y}")).alias("_r"))
        q = p + 1
        pairs = [(a, b) for a in range(q) for b in range(a, q)]
        vals = {f"_s{i}": F.col("_r")[a] * F.col("_r")[b] for i, (a, b) in enumerate(pairs)}
        r = running_sums_long(c, vals, keys, order, buckets, bucket_size)
        own = [F.col("_r")[a] * F.col("_r")[b] for a, b in pairs]
        d = r.select(*keys, order, "_r", "pos",
                     F.when(F.col("pos") > 1, F.array(*[F.col(f"_s{i}") - own[i] for i in range(len(pairs))]))
                     .alias("_pp"))
    d = d.filter(F.col("pos") > p)
    return d.select(*keys, order, "pos", recursive_resid_udf("_pp", "_r", "pos").alias("w"))


def rec_cusum(rr: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """SB3: cumsum(w)/(sd(w)·√m) against the boundary 1 + 2t, t ∈ [0, 1]; p-value
    by the standard approximation for the recursive CUSUM statistic."""
    wall = Window.partitionBy(*keys)
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    m = F.count(F.lit(1)).over(wall)
    idx = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    path = rr.select(*keys, order, F.try_divide(F.sum("w").over(w), F.stddev_samp("w").over(wall) * F.sqrt(m)).alias("_proc"),
                     (idx / m).alias("_t"))
    g = path.groupBy(*keys).agg(F.max(F.abs("_proc") / (1 + 2 * F.col("_t"))).alias("statistic"))
    return g.withColumn("p_value", rec_cusum_p_udf("statistic"))


@F.pandas_udf(T.DoubleType())
def rec_cusum_p_udf(x: pd.Series) -> pd.Series:
    x = x.to_numpy(float)
    with np.errstate(over="ignore", invalid="ignore"):
        big = 2 * (1 - norm_cdf(3 * x) + np.exp(-4 * x * x) * (norm_cdf(x) + norm_cdf(5 * x) - 1)
                   - np.exp(-16 * x * x) * (1 - norm_cdf(x)))
    p = np.where(x < 0.3, 1 - 0.1464 * x, big)
    return pd.Series(np.clip(p, 0, 1))


# ------------------------------------------------------------ Bai–Perron
def cost_udf(width: int):
    """Arrow UDF: RSS of the rows after start ``a`` up to end ``b`` for all pairs of a tile,
    by end, then start; infinite where the segment is shorter than ``h``."""
    q = int((-3 + math.sqrt(9 + 8 * width)) / 2)  # width = q + q(q+1)/2

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def costs(a: pa.Array, b: pa.Array, a_at: pa.Array, b_at: pa.Array, h: pa.Array) -> pa.Array:
        out = np.full((len(a), TL.BUCKET, TL.BUCKET), np.inf)
        for lo, n in TL.pieces(len(a)):
            start, end = TL.dense(a.slice(lo, n), width, np.nan), TL.dense(b.slice(lo, n), width, np.nan)
            i, j = TL.dense(a_at.slice(lo, n), 1, np.inf)[:, None, :, 0], TL.dense(b_at.slice(lo, n), 1, -np.inf)
            t, e, f = np.nonzero(j - i >= h.slice(lo, n).to_numpy()[:, None, None])
            if len(t):
                rss = _segment_rss(j[t, e, 0] - i[t, 0, f], end[t, e] - start[t, f], q)
                out[lo + t, e, f] = np.where(np.isnan(rss), np.inf, rss)
        return TL.as_lists(out.reshape(len(a), -1))

    return costs


_STEP = T.StructType([T.StructField("value", T.ArrayType(T.DoubleType())), T.StructField("arg", T.ArrayType(T.IntegerType()))])


@F.arrow_udf(_STEP)
def best_start_udf(costs: pa.Array, values: pa.Array) -> pa.Array:
    """Per end of a tile: least ``value + cost`` over its starts, and which start (the first
    of equals)."""
    c = TL.dense(costs, TL.BUCKET, np.inf)
    least, arg = np.empty(c.shape[:2]), np.empty(c.shape[:2], np.int32)
    v = TL.dense(values, 1, np.inf)[:, None, :, 0]
    for lo, n in TL.pieces(len(c)):
        total = c[lo:lo + n] + v[lo:lo + n]
        arg[lo:lo + n] = total.argmin(axis=2)
        least[lo:lo + n] = total.min(axis=2)
    return pa.StructArray.from_arrays([TL.as_lists(least), TL.as_lists(arg)], names=["value", "arg"])


def prefix_buckets(ps: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Buckets of the prefix sums of rows 1..pos, pos = 0 included."""
    first = F.struct(F.lit(0).alias("pos"), F.array_repeat(F.lit(0.0), width).alias("pre"))
    own = F.struct("pos", "pre")
    rows = ps.select(*keys, "n_rows", F.explode(F.when(F.col("pos") == 1, F.array(first, own)).otherwise(F.array(own))).alias("_r"))
    return TL.buckets(rows.select(*keys, "n_rows", "_r.pos", "_r.pre"), keys, "pre", ["n_rows"])


def segment_costs(prefixes: DataFrame, keys: Sequence[str], h: F.Column, width: int) -> DataFrame:
    """Tiles of segment costs: a segment's sums are the difference of two prefixes, so a
    pair of positions is a segment."""
    t = TL.tiles(prefixes, keys, TL.bucket_of("n_rows")).withColumn("_h", h)
    t = t.filter((F.col("b_bucket") + 1 - F.col("a_bucket")) * TL.BUCKET > F.col("_h"))
    t = TL.spread(t, *keys, "a_bucket", "b_bucket")
    return t.select(*keys, "n_rows", "a_bucket", "b_bucket",
                    cost_udf(width)("a_flat", "b_flat", "a_places", "b_places", "_h").alias("costs"))


def partition_round(costs: DataFrame, best: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One round of the dynamic programme: from the least cost of rows 1..pos in m segments
    to that in m + 1 segments; ``path`` lists where the segments before the last end."""
    at = F.pmod(F.col("pos"), F.lit(TL.BUCKET))
    held = best.groupBy(*keys, TL.bucket_of("pos").alias("a_bucket")) \
        .agg(F.map_from_entries(F.collect_list(F.struct(at, F.struct("value", "path")))).alias("_m"))
    values = F.transform(F.sequence(F.lit(0), F.lit(TL.BUCKET - 1)),
                         lambda i: F.coalesce(F.element_at("_m", i)["value"], F.lit(float("inf"))))
    step = costs.join(held, on=[*keys, "a_bucket"]).withColumn("_s", best_start_udf("costs", values))
    ends = step.select(*keys, "n_rows", "a_bucket", "b_bucket", "_m", F.posexplode(F.arrays_zip("_s.value", "_s.arg")).alias("_e", "_s")) \
        .filter(F.col("_s.value") < float("inf"))
    start = F.col("a_bucket") * TL.BUCKET + F.col("_s.arg")
    cand = ends.select(*keys, "n_rows", (F.col("b_bucket") * TL.BUCKET + F.col("_e")).alias("pos"), F.struct(
        F.col("_s.value").alias("value"), start.alias("start"),
        F.concat(F.element_at("_m", F.col("_s.arg"))["path"], F.array(start)).alias("path")).alias("_c"))
    return cand.groupBy(*keys, "n_rows", "pos").agg(F.min("_c").alias("_c")).select(*keys, "n_rows", "pos", "_c.value", "_c.path")


def bai_perron(df: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str], order: str,
               h: float = 0.15, max_breaks: int = 5, buckets: str | None = None) -> DataFrame:
    """SB6: optimal 0..max_breaks break partitions per series, RSS, BIC, AIC.

    Segment costs come from joined prefix sums, in tiles of position buckets
    (:mod:`tiles`), and are written once; the dynamic programme is one round of join and
    minimum per number of breaks, each written, so that no task holds a series. All
    pairs of positions of a series are costs: their number grows with the square of its
    length. ``buckets``: an integer column, for prefix sums of a very long series
    (:func:`prefix_sums`).

    BIC/AIC: ll = −n/2 (log RSS + 1 − log n + log 2π), df = (p+1)(m+1). A series too short
    for one segment has a row without figures; a perfect fit has no likelihood."""
    keys, xs = list(keys), list(xs)
    p = len(xs) + 1
    ps = prefix_sums(df, y, xs, keys, order, buckets=buckets)
    least = F.greatest(F.floor(F.col("n_rows") * h), F.lit(p + 1))
    width = p + p * (p + 1) // 2
    prefixes = cut_lineage(prefix_buckets(ps, keys, width), "prefix-buckets")
    costs = cut_lineage(segment_costs(prefixes, keys, least, width), "segment-costs")
    lengths = prefixes.filter("bucket = 0").select(*keys, "n_rows")
    best = lengths.select(*keys, F.lit(0).alias("pos"), F.lit(0.0).alias("value"), F.array().cast("array<int>").alias("path"))
    found = []
    for m in range(max_breaks + 1):
        best = cut_lineage(partition_round(costs, best, keys), "partitions")
        found.append(best.filter("pos = n_rows").withColumn("breaks", F.lit(m)))
    rows = reduce(DataFrame.unionByName, found).select(
        *keys, "breaks", F.greatest("value", F.lit(0.0)).alias("rss"), F.slice("path", 2, max_breaks + 1).alias("break_pos"))
    whole = lengths.join(rows, on=keys, how="left").withColumn("breaks", F.coalesce("breaks", F.lit(0)))
    n, k = F.col("n_rows"), (p + 1) * (F.col("breaks") + 1)
    ll = F.when(F.col("rss") > 0, -n / 2 * (F.log("rss") + 1 - F.log(n) + math.log(2 * math.pi)))
    places = df.filter(O.complete([y, *xs])).select(*keys, order)
    if buckets is None:
        places = places.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    else:
        places = ps.select(*keys, order, "pos")
    when = whole.select(*keys, "breaks", F.explode("break_pos").alias("pos")).join(places, on=[*keys, "pos"]) \
        .groupBy(*keys, "breaks").agg(F.array_sort(F.collect_list(order)).alias(f"break_{order}"))
    none = F.array().cast(T.ArrayType(df.schema[order].dataType))
    return whole.join(when, on=[*keys, "breaks"], how="left").select(
        *keys, "breaks", "rss", (-2 * ll + k * F.log(n)).alias("bic"), (-2 * ll + 2 * k).alias("aic"),
        F.coalesce("break_pos", F.array().cast("array<int>")).alias("break_pos"), F.coalesce(f"break_{order}", none).alias(f"break_{order}"))
