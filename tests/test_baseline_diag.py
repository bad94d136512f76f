
import numpy as np
import pytest
from pyspark.sql import functions as F

from panelstats.operators import breaks as B
from panelstats.operators import describe as DS
from panelstats.operators import diagnostics as DG
from panelstats.operators import joins as J
from panelstats.operators import ols as O
from panelstats.operators import windows as WN

K = ["entity"]
XS = ["x1", "x2"]

# The reference's four crisis windows (months inclusive).
REF_WINDOWS = (("W1", "2008-01", "2010-12"), ("W2", "2011-01", "2013-12"),
               ("W3", "2020-03", "2021-12"), ("W4", "2022-02", "2024-12"))


def close(a, b, tol=1e-6):
    np.testing.assert_allclose(np.asarray(a, dtype=float), np.asarray(b, dtype=float), rtol=0, atol=tol)


@pytest.fixture(scope="module")
def static(ref_series):
    fit = O.ols(ref_series, "y", XS, K).cache()
    res = DG.resid_series(ref_series, "y", XS, K, "m", fit).cache()
    return fit, res


def test_bp_white_gq(ref_series, static):
    fit, res = static
    close(DG.breusch_pagan(res, XS, K).collect()[0].statistic, 21.504796, 1e-5)
    close(DG.white(res, XS, K).collect()[0].statistic, 29.843223, 1e-5)
    gq = DG.goldfeld_quandt(ref_series, "y", XS, K, "x1", "m").collect()[0]
    close(gq.statistic, 1.339372, 1e-5)
    assert (gq.df1, gq.df2) == (135, 136)


def test_lag1_bp_gq(ref_series):
    d = WN.lags(ref_series, "y", K, "m", [1]).filter(F.col("y_l1").isNotNull())
    xs = [*XS, "y_l1"]
    res = DG.resid_series(d, "y", xs, K, "m")
    close(DG.breusch_pagan(res, xs, K).collect()[0].statistic, 30.731209, 1e-5)
    gq = DG.goldfeld_quandt(d, "y", xs, K, "x1", "m").collect()[0]
    close(gq.statistic, 1.556605, 1e-5)
    assert (gq.df1, gq.df2) == (134, 134)


def test_ljung_box_jb_acf(static):
    fit, res = static
    close(DG.ljung_box(res, K, 12).collect()[0].statistic, 1906.857146, 1e-4)
    jb = DG.jarque_bera(res, K).collect()[0]
    close([jb.statistic, jb.p_value], [0.444725, 0.800625], 1e-6)
    acf = DG.autocorrelations(res, K).orderBy("lag").collect()
    assert len(acf) == int(np.floor(10 * np.log10(277)))
    close([r.acf for r in acf[:3]], [0.98534968, 0.96051456, 0.92604661])


def test_durbin_watson(static):
    fit, res = static
    dw = DG.durbin_watson(res, fit, XS, K, "m").collect()[0]
    close(dw.statistic, 0.021866, 1e-6)
    close([dw.mean, dw.var, dw.z], [2.01442491, 0.01433454, -16.64252426], 1e-6)


def test_breusch_godfrey(static):
    fit, res = static
    got = [DG.breusch_godfrey(res, XS, K, "m", q).collect()[0].statistic for q in (3, 4, 6, 8, 12)]
    close(got, [272.5560, 272.9435, 272.9588, 273.0068, 273.0706], 1e-4)


def test_adf(ref_series):
    got = [DG.adf(ref_series, c, K, "m").collect()[0].statistic for c in ("y", "x1", "x2")]
    close(got, [-2.39011984, -3.70882942, -3.43792193])


def test_describe(ref_series):
    full = {r.variable: r for r in DS.describe_full(ref_series, ["y", "x1", "x2"], K).collect()}
    basic = {r.variable: r for r in DS.describe_basic(ref_series, ["y", "x1", "x2"], K).collect()}
    for v, mean, sd, g1, g2, mad, tm, q in (
        ("y", 1.47184116, 1.49103038, 0.61984043, -0.99615351, 1.4826, 1.31591928, (0, 1, 2.5)),
        ("x1", 0.14981949, 1.90123195, 2.10249510, 5.62695795, 0.88956, -0.14304933, (-0.9, 0, 0.5)),
        ("x2", -0.64529681, 1.82448154, -0.37140267, -0.47957258, 1.89469037, -0.59828390,
         (-2.11835635, -0.13451103, 0.64920153)),
    ):
        r = full[v]
        close([r.mean, r.sd, r.mad, r.trimmed_mean], [mean, sd, mad, tm])
        n = r.n
        # type-3 skew/kurtosis back to population g1, g2
        close(r.skew / ((n - 1) / n) ** 1.5, g1)
        close((r.kurtosis + 3) / (1 - 1 / n) ** 2 - 3, g2)
        close([basic[v].q1, basic[v].median, basic[v].q3], q)


def test_correlations(ref_series):
    c = {(r.var_a, r.var_b): r.r for r in DS.corr_long(ref_series, ["y", "x1", "x2"], K).collect()}
    close([c[("y", "x1")], c[("y", "x2")], c[("x1", "x2")]], [0.32408936, 0.64162519, 0.38460523])


def test_window_counts_and_shift_model(ref_series):
    f = J.window_flags(ref_series, REF_WINDOWS)
    counts = f.agg(*[F.sum(w[0]) for w in REF_WINDOWS]).collect()[0]
    assert list(counts) == [36, 36, 22, 35]
    labels = [w[0] for w in REF_WINDOWS]
    fu = O.ols(f, "y", [*XS, *labels], K)
    r = fu.collect()[0]
    close(r.beta[:3], [1.27287986, -0.24699605, 0.67949209])
    close(r.beta[3:], [1.12007553, 1.16642845, 0.89024653, 2.42629621])
    close(r.r2, 0.58603861)
    from panelstats.operators.models import joint_f
    jf = joint_f(fu, O.ols(f, "y", XS, K), K).collect()[0]
    close(jf.f_stat, 27.28624768, 1e-5)
    assert (jf.q, jf.df_u) == (4, 270)


def test_chow_supf_conf(ref_series, spark):
    pos = spark.createDataFrame([("ref", "E", 82)], "entity string, label string, pos int")
    ch = B.chow_at(ref_series, pos, "y", XS, K, "m").collect()[0]
    close(ch.f_stat, 23.751054, 1e-5)
    path = B.split_path(ref_series, "y", XS, K, "m")
    s = B.sup_f(path, K, "m").collect()[0]
    close(s.sup_f, 268.398642, 1e-5)
    t = ref_series.filter(F.col("m") == s.break_m).collect()[0].t
    assert (t.year, t.month) == (2021, 7)
    cs = B.break_conf_set(path, K).collect()
    assert any(r.m == s.break_m for r in cs)


def test_cusum_mosum_reccusum(static, ref_series):
    fit, res = static
    close(B.ols_cusum(res, K, "m", 3).collect()[0].statistic, 3.25728959)
    mo = B.ols_mosum(res, K, "m", 3).collect()[0]
    assert mo.window == 41
    close(mo.statistic, 3.94700368)
    rr = B.recursive_residuals(ref_series, "y", XS, K, "m")
    ssq = rr.agg(F.sum(F.col("w") ** 2)).collect()[0][0]
    close(ssq, fit.collect()[0].rss, 1e-8)       # Σ w² = RSS
    close(B.rec_cusum(rr, K, "m").collect()[0].statistic, 2.11738539)


def test_bai_perron(ref_series):
    bp = sorted(B.bai_perron(ref_series, "y", XS, K, "m").collect(), key=lambda r: r.breaks)
    close([r.rss for r in bp], [356.6839, 179.2020, 28.0291, 16.3324, 15.3224, 15.0316], 1e-4)
    close([r.bic for r in bp], [878.6226, 710.4496, 219.0356, 91.9255, 96.7395, 113.9277], 1e-4)
    best = min(bp, key=lambda r: r.bic)
    assert best.breaks == 3
    months = [(m // 12, m % 12 + 1) for m in best.break_m]
    assert months == [(2008, 11), (2013, 10), (2021, 7)]


def test_regimes_from_bai_perron(ref_series):
    """SB7/RG21: the BIC-best partition labels rows 1..4 and each regime is fitted."""
    bp = B.bai_perron(ref_series, "y", XS, K, "m")
    best = bp.groupBy(*K).agg(F.min_by(F.col("break_pos"), F.struct("bic", "breaks")).alias("_bp"))
    breaks = best.select(*K, F.explode("_bp").alias("break_pos"))
    reg = B.regime_from_break(ref_series, breaks, K, "m")
    ends = sorted(r.break_pos for r in breaks.collect())
    counts = [r["count"] for r in reg.groupBy("regime").count().orderBy("regime").collect()]
    assert counts == [ends[0], ends[1] - ends[0], ends[2] - ends[1], 277 - ends[2]]
    fit = O.ols(reg, "y", XS, [*K, "regime"]).collect()
    assert len(fit) == 4 and all(r.n == c for r, c in zip(sorted(fit, key=lambda r: r.regime), counts))
