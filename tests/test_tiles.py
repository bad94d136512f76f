"""Series longer than a bucket: partitions, kernel sums and the regression over regimes
against direct numpy."""

import math
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelstats.operators import breaks as B
from panelstats.operators import models as MD
from panelstats.operators import ols as O

K, XS = ["entity"], ["x1", "x2"]


@pytest.fixture(scope="module")
def long_series(spark):
    rng = np.random.default_rng(4)
    rows = []
    for name, n in (("a", 137), ("b", 64), ("c", 33)):
        x, e = rng.standard_normal((n, 2)), rng.standard_normal(n)
        for t in range(1, n):
            e[t] += 0.5 * e[t - 1]
        shift = np.where(np.arange(n) < n // 3, 0.0, np.where(np.arange(n) < 2 * n // 3, 3.0, -2.0))
        y = 1 + x @ [0.5, -1.0] + shift + e
        rows += [(name, t, float(y[t]), float(x[t, 0]), float(x[t, 1]), 1 + 3 * t // n) for t in range(n)]
    df = spark.createDataFrame(rows, "entity string, m int, y double, x1 double, x2 double, regime int")
    return df, {k: np.array([r[1:] for r in rows if r[0] == k], float) for k in "abc"}


def rss_of(a, i, j):
    X = np.column_stack([np.ones(j - i), a[i:j, 2:4]])
    return float(((a[i:j, 1] - X @ np.linalg.lstsq(X, a[i:j, 1], rcond=None)[0]) ** 2).sum())


def best_partitions(a, most):
    n = len(a)
    h = max(int(0.15 * n), 4)
    cost = {(i, j): rss_of(a, i, j) for i in range(n) for j in range(i + h, n + 1)}
    best = {j: (cost[0, j], []) for j in range(h, n + 1)}
    out = [best[n]]
    for _ in range(most):
        best = {j: min((best[i][0] + cost[i, j], best[i][1] + [i]) for i in best if (i, j) in cost)
                for j in range(n + 1) if any((i, j) in cost for i in best)}
        if n in best:
            out.append(best[n])
    return out


@pytest.mark.parametrize("buckets", [None, "m"])
def test_partitions_equal_the_recursion(long_series, buckets):
    df, arrays = long_series
    got = {(r.entity, r.breaks): r for r in B.bai_perron(df, "y", XS, K, "m", max_breaks=3, buckets=buckets).collect()}
    for name, a in arrays.items():
        want = best_partitions(a, 3)
        n = len(a)
        assert sum(k[0] == name for k in got) == len(want)
        for m, (rss, path) in enumerate(want):
            r = got[name, m]
            assert r.rss == pytest.approx(rss, rel=1e-9) and r.break_pos == path and r.break_m == [p - 1 for p in path]
            ll = -n / 2 * (math.log(rss) + 1 - math.log(n) + math.log(2 * math.pi))
            assert r.bic == pytest.approx(-2 * ll + 4 * (m + 1) * math.log(n)) and r.aic == pytest.approx(-2 * ll + 8 * (m + 1))


def direct(a, weight, regimes=False):
    """Design, residuals, (X'X)⁻¹ and S from all pairs of rows."""
    X = np.column_stack([np.ones(len(a)), a[:, 2:4]])
    if regimes:
        X = np.column_stack([X * (a[:, 4] == r)[:, None] for r in (1, 2, 3)])
    e = a[:, 1] - X @ np.linalg.lstsq(X, a[:, 1], rcond=None)[0]
    U = X * e[:, None]
    lag = np.abs(np.subtract.outer(np.arange(len(a)), np.arange(len(a))))
    return X, e, U, np.linalg.inv(X.T @ X), lag


def qs(z):
    a = 6 * np.pi * np.where(z == 0, 1, z) / 5
    return np.where(z == 0, 1.0, 25 / (12 * np.pi ** 2 * np.where(z == 0, 1, z) ** 2) * (np.sin(a) / a - np.cos(a)))


def andrews(U, slopes):
    x, xl = U[1:, slopes], U[:-1, slopes]
    rho = (x * xl).sum(0) / (xl * xl).sum(0)
    s2 = (((x - rho * xl) ** 2).sum(0) / (len(U) - 1)) ** 2
    return 1.3221 * ((4 * rho ** 2 * s2 / (1 - rho) ** 8).sum() / (s2 / (1 - rho) ** 4).sum() * len(U)) ** 0.2


def auto_lag(U, slopes):
    w, n = U[:, slopes].sum(1), len(U)
    sig = [(w[j:] * w[:n - j]).sum() for j in range(int(4 * (n / 100) ** (2 / 9)) + 1)]
    s0, s1 = sig[0] + 2 * sum(sig[1:]), 2 * sum(j * s for j, s in enumerate(sig))
    return 1.1447 * ((s1 / s0) ** 2 * n) ** (1 / 3)


@pytest.mark.parametrize("kind", ["nw_auto", "qs_andrews"])
@pytest.mark.parametrize("buckets", [None, "m"])
def test_data_driven_kernels_over_many_tiles(long_series, kind, buckets):
    df, arrays = long_series
    got = {r.entity: r for r in MD.series_robust_se(df, O.ols(df, "y", XS, K), "y", XS, K, "m", kind, buckets=buckets).collect()}
    for name, a in arrays.items():
        X, _, U, M, lag = direct(a, None)
        bw = andrews(U, [1, 2]) if kind == "qs_andrews" else auto_lag(U, [1, 2])
        w = qs(lag / bw) if kind == "qs_andrews" else np.maximum(0, 1 - lag / (bw + 1))
        V = M @ U.T @ w @ U @ M * len(a) / (len(a) - 3)
        assert got[name].bandwidth == pytest.approx(bw, rel=1e-9)
        np.testing.assert_allclose(got[name].se, np.sqrt(np.diag(V)), rtol=1e-6)


@pytest.mark.parametrize("kind,param", [("nw", 12), ("bartlett", 12), ("nw_auto", 0), ("qs_andrews", 0)])
def test_regression_over_regimes_with_all_blocks(long_series, kind, param):
    df, arrays = long_series
    fit = MD.regime_fit(df, "y", XS, K, materialize=True)
    cov = MD.regime_covariance(df, fit, "y", XS, K, "m", kind, param).collect()
    slopes = [1, 2, 4, 5, 7, 8]
    for name, a in arrays.items():
        X, e, U, M, lag = direct(a, None, regimes=True)
        bw = {"nw": param, "bartlett": param, "nw_auto": auto_lag(U, slopes), "qs_andrews": andrews(U, slopes)}[kind]
        w = qs(lag / bw) if kind == "qs_andrews" else np.maximum(0, 1 - lag / (bw + (kind != "bartlett")))
        V = M @ U.T @ w @ U @ M * len(a) / (len(a) - 9)
        full = np.zeros((9, 9))
        for r in cov:
            if r.entity == name:
                assert r.bandwidth == pytest.approx(bw, rel=1e-9)
                full[3 * r.a_regime - 3:3 * r.a_regime, 3 * r.b_regime - 3:3 * r.b_regime] = np.array(r["cov"]).reshape(3, 3)
        np.testing.assert_allclose(full, V, rtol=1e-6, atol=1e-9 * np.abs(V).max())
        rows = {r.regime: r for r in fit.filter(F.col("entity") == name).collect()}
        beta = np.linalg.lstsq(X, a[:, 1], rcond=None)[0]
        s2 = e @ e / (len(a) - 9)
        for r in (1, 2, 3):
            np.testing.assert_allclose(rows[r].beta, beta[3 * r - 3:3 * r], rtol=1e-9)
            np.testing.assert_allclose(rows[r].se, np.sqrt(s2 * np.diag(M)[3 * r - 3:3 * r]), rtol=1e-9)
            assert rows[r].r2 == pytest.approx(1 - e @ e / ((a[:, 1] - a[:, 1].mean()) ** 2).sum())


def test_no_operator_takes_a_series_into_one_python_call():
    folder = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "panelstats", "operators")
    for name in os.listdir(folder):
        if name.endswith(".py"):
            assert not re.search(r"\.applyIn(Pandas|Arrow)\(", open(os.path.join(folder, name)).read()), name
