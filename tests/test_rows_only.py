"""Numpy checks for operators without a SQL oracle (rows-only in the driver gate)."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelstats.functions.dist import norm_ppf, t_sf2
from panelstats.operators import diagnostics as DG
from panelstats.operators import hac as H
from panelstats.operators import models as MD
from panelstats.operators import ols as O

K = ["entity"]
XS = ["x1", "x2"]


@pytest.fixture(scope="module")
def ref_np(ref_series):
    pdf = ref_series.orderBy("m").toPandas()
    X = np.column_stack([np.ones(len(pdf)), pdf.x1, pdf.x2])
    y = pdf.y.to_numpy()
    b = np.linalg.solve(X.T @ X, X.T @ y)
    return pdf, X, y, b, y - X @ b


def test_durbin_levinson_matches_yule_walker():
    rng = np.random.default_rng(2)
    x = np.zeros(400)
    for t in range(2, 400):
        x[t] = 0.6 * x[t - 1] - 0.2 * x[t - 2] + rng.normal()
    x = x - x.mean()
    r = np.array([(x[k:] * x[:-k]).sum() for k in range(1, 9)]) / (x * x).sum()
    pac = DG.durbin_levinson(r)
    full = np.concatenate([[1.0], r])
    for k in range(1, 9):
        R = np.array([[full[abs(i - j)] for j in range(k)] for i in range(k)])
        phi = np.linalg.solve(R, full[1:k + 1])
        assert pac[k - 1] == pytest.approx(phi[-1], abs=1e-10)


def test_pacf_query_path(ref_series, ref_np):
    res = DG.resid_series(ref_series, "y", XS, K, "m")
    got = [r.pacf for r in DG.partial_autocorrelations(DG.autocorrelations(res, K), K).orderBy("lag").collect()]
    e = ref_np[4] - ref_np[4].mean()
    L = int(math.floor(10 * math.log10(len(e))))
    r = np.array([(e[k:] * e[:-k]).sum() for k in range(1, L + 1)]) / (e * e).sum()
    np.testing.assert_allclose(got, DG.durbin_levinson(r), atol=1e-10)


def test_qq_pairs(ref_series, ref_np):
    res = DG.resid_series(ref_series, "y", XS, K, "m")
    q = DG.qq_pairs(res, K).orderBy("i").toPandas()
    e = np.sort(ref_np[4])
    n = len(e)
    np.testing.assert_allclose(q["sample"], e, atol=1e-9)
    np.testing.assert_allclose(q["theoretical"], norm_ppf((np.arange(1, n + 1) - 0.5) / n), atol=1e-12)


def test_coef_vs_benchmark(ref_series, ref_np):
    _, X, y, b, e = ref_np
    n, p = X.shape
    se = np.sqrt(np.diag(np.linalg.inv(X.T @ X)) * (e @ e) / (n - p))
    fit = O.ols(ref_series, "y", XS, K)
    bm = (("(Intercept)", 2.0, "two"), ("x1", 0.5, "two"), ("x2", 0.5, "two"), ("x1", 1.0, "greater"))
    rows = {(r.term, r.b0): r for r in MD.coef_vs_benchmark(O.coef_table(fit, XS, K), bm, K).collect()}
    t0 = (b[0] - 2.0) / se[0]
    assert rows[("(Intercept)", 2.0)].t_stat == pytest.approx(t0, rel=1e-9)
    assert rows[("(Intercept)", 2.0)].p_value == pytest.approx(float(t_sf2(t0, n - p)), rel=1e-9)
    t1 = (b[1] - 1.0) / se[1]
    assert rows[("x1", 1.0)].p_value == pytest.approx(float(0.5 * t_sf2(t1, n - p)) if t1 >= 0
                                                      else 1 - float(0.5 * t_sf2(t1, n - p)), rel=1e-9)


def test_rank_check(spark):
    df = spark.createDataFrame(
        [("a", float(i), float(i % 3), 0.0, float(i * 2)) for i in range(10)],
        "entity string, y double, x1 double, z double, x2 double")
    r = MD.rank_check(df, "y", ["x1", "z", "x2"], K).collect()[0]
    assert r.aliased_terms == ["z"] and r.rank == 2 and r.k == 3


def _direct_hac(X, e, weights_fn, adjust=True):
    U = X * e[:, None]
    n, p = U.shape
    S = np.zeros((p, p))
    for t in range(n):
        for s in range(n):
            w = weights_fn(abs(t - s))
            if w != 0.0:
                S += w * np.outer(U[t], U[s])
    M = np.linalg.inv(X.T @ X)
    return np.sqrt(np.diag(M @ S @ M * (n / (n - p) if adjust else 1.0)))


def test_qs_andrews_against_direct_sum(ref_series, ref_np):
    pdf, X, y, b, e = ref_np
    fit = O.ols(ref_series, "y", XS, K)
    got = MD.series_robust_se(ref_series, fit, "y", XS, K, "m", "qs_andrews").collect()[0]
    U = X * e[:, None]
    x, xl = U[1:, 1:], U[:-1, 1:]  # Andrews' AR(1) rule over the slopes' scores
    rho = (x * xl).sum(0) / (xl * xl).sum(0)
    s2 = (((x - rho * xl) ** 2).sum(0) / (len(e) - 1)) ** 2
    bw = 1.3221 * ((4 * rho ** 2 * s2 / (1 - rho) ** 8).sum() / (s2 / (1 - rho) ** 4).sum() * len(e)) ** 0.2
    assert got.bandwidth == pytest.approx(bw, rel=1e-9)

    def weight(lag):
        a = 6 * np.pi * lag / bw / 5
        return 25 / (12 * np.pi ** 2 * (lag / bw) ** 2) * (np.sin(a) / a - np.cos(a)) if lag else 1.0
    np.testing.assert_allclose(got.se, _direct_hac(X, e, weight), rtol=1e-7)


def test_nw_auto_against_direct_sum(ref_series, ref_np):
    pdf, X, y, b, e = ref_np
    fit = O.ols(ref_series, "y", XS, K)
    got = MD.series_robust_se(ref_series, fit, "y", XS, K, "m", "nw_auto").collect()[0]
    n = len(e)
    uw = (X * e[:, None])[:, 1:].sum(axis=1)
    m = int(math.floor(4 * (n / 100) ** (2 / 9)))
    sig = np.array([(uw[j:] * uw[:n - j]).sum() / n for j in range(m + 1)])
    s0, s1 = sig[0] + 2 * sig[1:].sum(), 2 * (np.arange(1, m + 1) * sig[1:]).sum()
    lag = 1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)
    assert got.bandwidth == pytest.approx(lag, rel=1e-12)
    direct = _direct_hac(X, e, lambda l: max(0.0, 1 - l / (lag + 1)))
    assert got.se[0] == pytest.approx(0.279693, abs=5e-7)
    np.testing.assert_allclose(got.se, direct, rtol=1e-9)


def test_paths_and_residuals_consistent(spark):
    """SB9/DG12: actual − fitted of each model equals that model's residual."""
    from panelstats.plans.registry import queries
    q = queries()
    paths = q["model_paths_long"](spark, "/root/testdata/sf0.001").groupBy("entity", "m").pivot(
        "path", ["actual", "static", "shift"]).agg(F.first("value"))
    res = q["residual_compare"](spark, "/root/testdata/sf0.001").groupBy("entity", "m").pivot(
        "model", ["static", "shift"]).agg(F.first("resid")).withColumnsRenamed({"static": "r_static", "shift": "r_shift"})
    rows = paths.join(res, ["entity", "m"]).collect()
    assert rows
    for r in rows:  # registered outputs are rounded to 6 decimals
        assert r.actual - r.static == pytest.approx(r.r_static, abs=2e-6)
        assert r.actual - r["shift"] == pytest.approx(r.r_shift, abs=2e-6)
