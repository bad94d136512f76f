"""Global spline fill (two and more levels of elimination) and the local regression smoother."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelstats.operators import smooth as SM
from panelstats.operators import spline as SP


def dense_spline(x, v, at, ends):
    """Interpolating cubic by a dense solve for the second derivatives."""
    n = len(x)
    if n == 2:
        return v[0] + (at - x[0]) * (v[1] - v[0]) / (x[1] - x[0])
    A, b, h = np.zeros((n, n)), np.zeros(n), np.diff(x)
    for i in range(1, n - 1):
        A[i, i - 1:i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        b[i] = 6 * ((v[i + 1] - v[i]) / h[i] - (v[i] - v[i - 1]) / h[i - 1])
    if ends == "natural":
        A[0, 0] = A[-1, -1] = 1
    else:
        third = [6 * np.polyfit(x[s] - x[s][0], v[s], 3)[0] if n > 3 else 0.0 for s in (slice(0, 4), slice(n - 4, n))]
        A[0, :2], A[-1, -2:] = (-1, 1), (-1, 1)
        b[0], b[-1] = h[0] * third[0], h[-1] * third[1]
    m = np.linalg.solve(A, b)
    j = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    t, s, hj = at - x[j], x[j + 1] - at, h[j]
    out = (m[j] * s ** 3 + m[j + 1] * t ** 3) / (6 * hj) + (v[j] / hj - m[j] * hj / 6) * s + (v[j + 1] / hj - m[j + 1] * hj / 6) * t
    if ends == "natural":
        first = (v[1] - v[0]) / h[0] - h[0] * m[1] / 6
        last = (v[-1] - v[-2]) / h[-1] + h[-1] * m[-2] / 6
        out = np.where(at < x[0], v[0] + (at - x[0]) * first, np.where(at > x[-1], v[-1] + (at - x[-1]) * last, out))
    return out


def series(name, n, known, rng):
    v = np.cumsum(rng.normal(size=n))
    return [(name, i, float(v[i]) if i in known else None) for i in range(n)]


@pytest.mark.parametrize("ends,bucket", [("fitted", 64), ("natural", 64), ("fitted", 3), ("natural", 2)])
def test_spline_equals_dense_solve(spark, ends, bucket):
    rng = np.random.default_rng(4)
    rows = []
    shapes = {"long": (400, set(range(5, 395, 3))), "gappy": (90, set(rng.choice(90, 20, replace=False).tolist())),
              "four": (12, {1, 4, 5, 10}), "three": (9, {2, 3, 7}), "two": (8, {2, 5}), "one": (5, {3}), "none": (4, set())}
    for name, (n, known) in shapes.items():
        rows += series(name, n, known, rng)
    df = spark.createDataFrame(rows, "entity string, m int, v double")
    got = SP.fill_spline(df, "v", ["entity"], "m", ends=ends, bucket=bucket).toPandas()
    assert len(got) == len(rows)
    for name, g in got.groupby("entity"):
        g = g.sort_values("m")
        kn = g["v"].notna().to_numpy()
        have = g["v_spline"].to_numpy(float)
        if kn.sum() < 2:
            np.testing.assert_array_equal(have, g["v"].to_numpy(float))
            continue
        pos = np.arange(1, len(g) + 1, dtype=float)
        want = dense_spline(pos[kn], g["v"].to_numpy(float)[kn], pos, ends)
        np.testing.assert_allclose(have, want, rtol=1e-8, atol=1e-8, err_msg=name)


def test_spline_without_known_points_and_empty(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, None)], "entity string, m int, v double")
    assert [r["v_spline"] for r in SP.fill_spline(df, "v", ["entity"], "m").collect()] == [None, None]
    assert SP.fill_spline(df.limit(0), "v", ["entity"], "m").count() == 0


def direct(x, y, grid, span):
    """Local quadratic regression over the rows themselves, by least squares per point."""
    q = int(np.floor(len(x) * span + 1e-5))
    out = []
    for g in grid:
        d = np.abs(x - g)
        h = np.sort(d)[q - 1]
        w = np.sqrt(np.clip(1 - (d / h) ** 3, 0, None) ** 3)
        X = np.stack([np.ones_like(x), x - g, (x - g) ** 2], axis=1)
        out.append(np.linalg.lstsq(X * w[:, None], y * w, rcond=None)[0][0])
    return np.array(out)


@pytest.mark.parametrize("n,span", [(60, 0.75), (5000, 0.3)])
def test_smoother_near_direct_fit(spark, n, span):
    rng = np.random.default_rng(n)
    x = rng.gamma(2.0, 1.5, n)
    y = np.sin(x) + 0.2 * rng.normal(size=n)
    df = spark.createDataFrame([("a", float(a), float(b)) for a, b in zip(x, y)], "entity string, x double, y double")
    got = SM.local_regression(df, "x", "y", ["entity"], span=span).orderBy("point").toPandas()
    assert len(got) == 80
    want = direct(x, y, got["x"].to_numpy(), span)
    assert np.abs(got["fit"].to_numpy() - want).max() < 1e-3 * (y.max() - y.min())


def test_smoother_degenerate_groups(spark):
    rows = [("one", 2.0, 1.0), ("one", 2.0, 3.0), ("two", 0.0, 1.0), ("two", 1.0, 2.0), ("gone", None, 1.0),
            ("gone", 1.0, None), ("flat", 0.0, 5.0), ("flat", 1.0, 5.0), ("flat", 2.0, 5.0), ("flat", 3.0, 5.0)]
    df = spark.createDataFrame(rows, "entity string, x double, y double")
    got = SM.local_regression(df, "x", "y", ["entity"], points=5).toPandas()
    fit = {k: g.sort_values("point") for k, g in got.groupby("entity")}
    assert set(fit) == {"one", "two", "flat"}
    assert fit["one"][["x", "fit"]].values.tolist() == [[2.0, 2.0]]
    np.testing.assert_allclose(fit["flat"]["fit"], 5.0)
    assert np.isfinite(fit["two"]["fit"].to_numpy(float)).all()
    assert SM.local_regression(df.drop("entity"), "x", "y", points=5).count() == 5
    assert SM.local_regression(df.limit(0), "x", "y").count() == 0


def test_smoother_reduces_before_the_shuffle(spark):
    df = spark.range(1000).select(F.lit("a").alias("entity"), F.rand(1).alias("x"), F.rand(2).alias("y"))
    plan = SM.local_regression(df, "x", "y", ["entity"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "collect_list" in plan and "partial_count" in plan
