"""Diagnostics of several models at once, Shapiro-Wilk against published values, Q-Q line."""

import numpy as np
import pytest

from panelstats.operators import diagnostics as DG
from panelstats.operators import ols as O
from panelstats.operators import windows as WN
from panelstats.plans.q_diag import MODELS

# published examples (20 values each): W and p
SKEWED = [0.11, 7.87, 4.61, 10.14, 7.95, 3.14, 0.46, 4.43, 0.21, 4.75, 0.71, 1.52, 3.24, 0.93, 0.42, 4.97, 9.53, 4.55, 0.47, 6.66]
EVEN = [1.36, 1.14, 2.92, 2.55, 1.46, 1.06, 5.27, -1.11, 3.48, 1.10, 0.88, -0.51, 1.46, 0.52, 6.20, 1.69, 0.08, 3.67, 2.81, 3.49]


def test_shapiro_published_values(spark):
    rows = [("skewed", v) for v in SKEWED] + [("even", v) for v in EVEN] + [("skewed", None)]
    got = {r["entity"]: r for r in DG.shapiro_wilk(spark.createDataFrame(rows, "entity string, v double"), "v", ["entity"]).collect()}
    assert got["skewed"]["n"] == 20
    assert got["skewed"]["statistic"] == pytest.approx(0.900473, abs=2e-5)
    assert got["skewed"]["p_value"] == pytest.approx(0.04209, abs=1e-4)
    assert got["even"]["statistic"] == pytest.approx(0.959027, abs=2e-5)
    assert got["even"]["p_value"] == pytest.approx(0.52460, abs=1e-3)


def test_shapiro_sizes_and_degenerate_groups(spark):
    rng = np.random.default_rng(1)
    rows = [(f"n{n}", float(v)) for n in (3, 4, 5, 6, 11, 12, 400, 5000) for v in rng.normal(size=n)]
    rows += [("line", float(v)) for v in range(3)] + [("one", 1.0), ("two", 1.0), ("two", 2.0), ("gone", None)]
    rows += [("flat", 7.0)] * 10 + [("big", float(v)) for v in rng.normal(size=5001)]
    got = {r["entity"]: r for r in DG.shapiro_wilk(spark.createDataFrame(rows, "entity string, v double"), "v", ["entity"]).collect()}
    for n in (3, 4, 5, 6, 11, 12, 400, 5000):
        assert 0.7 < got[f"n{n}"]["statistic"] <= 1 and 0.001 < got[f"n{n}"]["p_value"] <= 1, n
    assert got["line"]["statistic"] == pytest.approx(1.0)
    for name in ("one", "two", "flat", "big"):
        assert got[name]["statistic"] is None and got[name]["p_value"] is None
    assert "gone" not in got


def test_shapiro_p_is_uniform_under_normal_values(spark):
    rng = np.random.default_rng(3)
    rows = [(g, float(v)) for g in range(400) for v in rng.normal(size=30)]
    p = DG.shapiro_wilk(spark.createDataFrame(rows, "g int, v double"), "v", ["g"]).toPandas()["p_value"]
    assert np.mean(p < 0.05) == pytest.approx(0.05, abs=0.035)
    assert np.mean(p < 0.5) == pytest.approx(0.5, abs=0.08)


def test_lag_model_recorded_values(ref_series):
    d = WN.lags(ref_series, "y", ["entity"], "m", [1])
    d = WN.diffs(d, "y", ["entity"], "m", 2)
    specs = {"lag1": ("y", ["x1", "x2", "y_l1"]), "diff2": ("d_y", ["x1", "x2", "d_y_l1", "d_y_l2"])}
    got = {(r["model"], r["test"]): r for r in DG.model_diagnostics(DG.model_rows(d, specs, ["entity"], "m"), ["entity"], "m").collect()}
    assert len(got) == 12
    gq, bp = got["lag1", "goldfeld_quandt"], got["lag1", "breusch_pagan"]
    assert gq["df"] == 134
    assert gq["statistic"] == pytest.approx(1.556605, abs=1e-5)
    assert (bp["statistic"], bp["df"]) == (pytest.approx(30.731209, abs=1e-5), 3)


def dense_dw(X, y):
    """Durbin-Watson with mean and variance from the dense projection."""
    n, k = X.shape
    A = 2 * np.eye(n) - np.eye(n, k=1) - np.eye(n, k=-1)
    A[0, 0] = A[-1, -1] = 1
    M = np.eye(n) - X @ np.linalg.inv(X.T @ X) @ X.T
    e, B = M @ y, M @ A
    mean = np.trace(B) / (n - k)
    var = 2 * (np.trace(B @ B) - np.trace(B) * mean) / ((n - k) * (n - k + 2))
    return e @ A @ e / (e @ e), mean, var


def test_durbin_watson_moments_with_aliased_slots(spark):
    rng = np.random.default_rng(8)
    n = 50
    a, b, y = rng.normal(size=n), rng.normal(size=n), rng.normal(size=n)
    df = spark.createDataFrame([("s", i, float(y[i]), float(a[i]), float(b[i])) for i in range(n)], "entity string, m int, y double, a double, b double")
    rows = DG.model_rows(df, {"one": ("y", ["a"]), "both": ("y", ["a", "b"])}, ["entity"], "m")
    mk, xs = ["entity", "model"], DG.model_slots(rows)
    fit = O.ols(rows, "_y", xs, mk)
    got = {r["model"]: r for r in DG.durbin_watson(O.residuals(rows, fit, "_y", xs, mk), fit, xs, mk, "m").collect()}
    for name, X in (("one", np.stack([np.ones(n), a], 1)), ("both", np.stack([np.ones(n), a, b], 1))):
        st, mean, var = dense_dw(X, y)
        assert (got[name]["statistic"], got[name]["mean"], got[name]["var"]) == (
            pytest.approx(st), pytest.approx(mean), pytest.approx(var))


def test_model_rows_are_complete_per_model(spark):
    df = spark.createDataFrame([("s", 1, 1.0, None, 2.0), ("s", 2, 2.0, 3.0, None), ("s", 3, None, 3.0, 1.0)],
                               "entity string, m int, y double, a double, b double")
    rows = DG.model_rows(df, {"a": ("y", ["a"]), "ab": ("y", ["a", "b"]), "b": ("y", ["b"])}, ["entity"], "m")
    assert sorted((r["model"], r["m"]) for r in rows.collect()) == [("a", 2), ("b", 1)]


def test_qq_line_matches_numpy(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(3, 2, 101)
    df = spark.createDataFrame([("s", float(x)) for x in v], "entity string, resid double")
    r = DG.qq_line(df, ["entity"]).first()
    lo, hi = np.quantile(v, [0.25, 0.75])
    assert r["slope"] == pytest.approx((hi - lo) / 1.3489795003921634)
    assert r["intercept"] == pytest.approx((hi + lo) / 2)


def test_models_of_the_query():
    assert list(MODELS) == ["lag1", "diff1", "diff2", "diff3", "diff4", "shift"]
