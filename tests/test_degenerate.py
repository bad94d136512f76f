"""Singular and very short series: figures missing in that series only, no crash."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelstats.operators import breaks as B
from panelstats.operators import diagnostics as DG
from panelstats.operators import models as MD
from panelstats.operators import ols as O

K, XS = ["entity"], ["x1", "x2"]


@pytest.fixture(scope="module")
def panel(spark):
    """good: ordinary; flat: x2 constant; step: x2 a step; flag: x2 a single 1; s1..s3: short."""
    rng = np.random.default_rng(0)
    rows = []
    for e, n in (("good", 60), ("flat", 60), ("step", 60), ("flag", 60), ("s1", 1), ("s2", 2), ("s3", 3)):
        for m in range(n):
            x1 = float(rng.normal())
            x2 = {"flat": 3.0, "step": float(m >= 30), "flag": float(m == 12)}.get(e, float(rng.normal()))
            rows.append((e, m, 1 + 2 * x1 - x2 + float(rng.normal()), x1, x2))
    return spark.createDataFrame(rows, "entity string, m int, y double, x1 double, x2 double").cache()


def alone(panel, fn):
    """The good entity's result is the same with and without the others around."""
    with_others = [tuple(r) for r in fn(panel).where("entity = 'good'").collect()]
    by_itself = [tuple(r) for r in fn(panel.where("entity = 'good'")).collect()]
    flat = lambda rows: np.array([[v for v in r if isinstance(v, float)] for r in sorted(rows)])
    assert with_others
    np.testing.assert_allclose(flat(with_others), flat(by_itself), rtol=1e-9)


def path(p):
    return B.split_path(p, "y", XS, K, "m")


@pytest.mark.parametrize("fn", [
    lambda p: B.sup_f(path(p), K, "m"),
    lambda p: B.break_conf_set(path(p), K),
    lambda p: B.rec_cusum(B.recursive_residuals(p, "y", XS, K, "m"), K, "m"),
    lambda p: MD.robust_se(p, O.ols(p, "y", XS, K), "y", XS, K, "m", "nw_prewhite", 6)
        .select("entity", F.explode("se").alias("se")),
    lambda p: MD.series_robust_se(p, O.ols(p, "y", XS, K), "y", XS, K, "m", "nw_auto")
        .select("entity", F.explode("se").alias("se")),
    lambda p: MD.series_robust_se(p, O.ols(p, "y", XS, K), "y", XS, K, "m", "qs_andrews")
        .select("entity", F.explode("se").alias("se")),
], ids=["sup_f", "conf_set", "rec_cusum", "nw_prewhite", "nw_auto", "qs_andrews"])
def test_singular_series_do_not_stop_the_others(panel, fn):
    fn(panel).collect()
    alone(panel, fn)


def test_bai_perron_keeps_short_series(panel):
    got = B.bai_perron(panel, "y", XS, K, "m").collect()
    assert {r.entity for r in got} == {"good", "flat", "step", "flag", "s1", "s2", "s3"}
    for r in got:
        if r.entity in ("s1", "s2"):
            assert r.breaks == 0 and r.rss is None and r.bic is None and r.break_pos == []
    alone(panel, lambda p: B.bai_perron(p, "y", XS, K, "m").select("entity", "rss", "bic"))


def adf_numpy(y):
    n, k = len(y), int(math.floor((len(y) - 1) ** (1 / 3)))
    dy = np.diff(y)
    rows = range(k + 1, n)
    X = np.array([[y[t - 1], 1.0, t + 1.0, *[dy[t - 1 - j] for j in range(1, k + 1)]] for t in rows])
    z = np.array([dy[t - 1] for t in rows])
    b, *_ = np.linalg.lstsq(X, z, rcond=None)
    e = z - X @ b
    se = np.sqrt(e @ e / (len(z) - X.shape[1]) * np.linalg.inv(X.T @ X)[0, 0])
    return b[0] / se, k


def test_adf_of_long_and_mixed_series(spark):
    rng = np.random.default_rng(3)
    series = {"long": np.cumsum(rng.normal(size=3000)), "mid": rng.normal(size=400), "short": np.cumsum(rng.normal(size=60))}
    rows = [(e, m, float(v)) for e, ys in series.items() for m, v in enumerate(ys)]
    df = spark.createDataFrame(rows, "entity string, m int, y double")
    got = {r.entity: r for r in DG.adf(df, "y", K, "m").collect()}
    for e, ys in series.items():
        stat, k = adf_numpy(ys)
        assert got[e].lag_order == k
        assert got[e].statistic == pytest.approx(stat, rel=1e-7)
    assert got["long"].lag_order == 14


def test_adf_pvalues_are_vectorised_interpolation():
    crit = [np.interp(83, DG.ADF_SIZES, [-v for v in row]) for row in DG.ADF_TABLE]
    stats = np.linspace(-5, 0, 41)
    np.testing.assert_allclose(DG.adf_pvalue(stats, np.full(41, 83.0)), np.interp(stats, crit, DG.ADF_PROBS))


def test_kolmogorov_near_zero(spark):
    p = spark.createDataFrame([(x,) for x in (0.0, 0.005, 0.1, 0.5, 0.999999, 1.000001, 1.358)], "x double") \
        .select(B.kolmogorov_p(F.col("x")).alias("p")).collect()
    p = [r.p for r in p]
    assert p[:3] == pytest.approx([1, 1, 1], abs=1e-12)
    assert p[4] == pytest.approx(p[5], abs=1e-5) and p[6] == pytest.approx(0.05, abs=1e-3)
