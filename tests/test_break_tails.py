"""Tail formulas of break tests and intervals of break dates against simulation."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelstats.operators import breaks as B


def bridges(rng, reps, n, k=1):
    w = np.cumsum(rng.standard_normal((reps, k, n)), axis=2) / math.sqrt(n)
    return w - np.arange(1, n + 1) / n * w[:, :, -1:]


def test_mosum_tail(spark):
    rng = np.random.default_rng(2)
    b = np.concatenate([bridges(rng, 500, 4000)[:, 0] for _ in range(6)])
    b = np.concatenate((np.zeros((len(b), 1)), b), axis=1)
    for h in (0.15, 0.3):
        m = int(h * 4000)
        sups = np.abs(b[:, m:] - b[:, :-m]).max(axis=1)
        for q in (0.8, 0.9, 0.95):
            x = float(np.quantile(sups, q))
            got = spark.range(1).select(B.mosum_p_udf(F.lit(x), F.lit(h))).first()[0]
            assert got == pytest.approx(1 - q, abs=0.02)


def test_sup_f_tail(spark):
    rng = np.random.default_rng(3)
    n = 2000
    t = np.arange(1, n + 1) / n
    inside = (t >= 0.15) & (t <= 0.85)
    sups = np.concatenate([((bridges(rng, 300, n, 3) ** 2).sum(1)[:, inside] / (t * (1 - t))[inside]).max(1) for _ in range(8)])
    span = (0.85 / 0.15) ** 2
    for q in (0.8, 0.9, 0.95):
        x = float(np.quantile(sups, q))
        got = spark.range(1).select(B.sup_f_p(F.lit(x), 3, F.lit(span))).first()[0]
        assert got == pytest.approx(1 - q, abs=0.035 if q < 0.9 else 0.02)


@pytest.mark.parametrize("xi,phi", [(1.0, 1.0), (0.8, 1.5), (2.0, 0.7)])
def test_argmax_distribution(xi, phi):
    a = np.linspace(-600, 600, 24001)
    f = B.argmax_cdf(a, np.full_like(a, xi), np.full_like(a, phi))
    assert (np.diff(f) > -1e-9).all() and f[0] < 2e-3 and f[-1] > 1 - 2e-3
    assert abs(f[12000] - B.argmax_cdf(np.array([-1e-9]), np.array([xi]), np.array([phi]))[0]) < 1e-4
    rng = np.random.default_rng(5)
    step, n = 0.02, 3000
    s = step * np.arange(1, n + 1)
    at = []
    for _ in range(8):
        left = np.cumsum(rng.standard_normal((500, n)), axis=1) * math.sqrt(step) - s / 2
        right = np.cumsum(rng.standard_normal((500, n)), axis=1) * math.sqrt(step * phi) - xi * s / 2
        lm, rm = left.max(1), right.max(1)
        at.append(np.where(np.maximum(lm, rm) < 0, 0.0, np.where(lm > rm, -s[left.argmax(1)], s[right.argmax(1)])))
    at = np.concatenate(at)
    for x in (-10.0, -3.0, -1.0, 1.0, 3.0, 10.0):
        assert (at <= x).mean() == pytest.approx(B.argmax_cdf(np.array([x]), np.array([xi]), np.array([phi]))[0], abs=0.035)
    for level in (0.025, 0.3, 0.7, 0.975):
        q = B.argmax_quantile(level, np.array([xi]), np.array([phi]))
        assert B.argmax_cdf(q, np.array([xi]), np.array([phi]))[0] == pytest.approx(level, abs=1e-9)


def test_intervals_of_each_break(spark):
    rng = np.random.default_rng(6)
    n, ends = 180, (60, 110)
    reg = np.digitize(np.arange(1, n + 1), [e + 1 for e in ends]) + 1
    x = rng.standard_normal(n) + 1
    y = np.array([0.0, 1.0, -0.5])[reg - 1] + np.array([1.0, 1.5, 1.0])[reg - 1] * x + rng.standard_normal(n) * 0.8
    rows = [("a", i + 1, 2000 + i, float(y[i]), float(x[i]), int(reg[i])) for i in range(n)]
    rows += [("flat", i + 1, i, 1.0, float(x[i]), 1 + i // 20) for i in range(40)]
    df = spark.createDataFrame(rows, "entity string, pos int, m int, y double, x double, regime int")
    got = {(r.entity, r.break_no): r for r in B.break_intervals(df, "y", ["x"], ["entity"], "m").collect()}
    assert set(got) == {("a", 1), ("a", 2), ("flat", 1)} and got["flat", 1].lower is None
    part = {}
    for r in (1, 2, 3):
        X = np.column_stack([np.ones((reg == r).sum()), x[reg == r]])
        beta = np.linalg.lstsq(X, y[reg == r], rcond=None)[0]
        part[r] = beta, X.T @ X / len(X), ((y[reg == r] - X @ beta) ** 2).mean()
    for r, end in zip((1, 2), ends):
        (b1, q1, s1), (b2, q2, s2) = part[r], part[r + 1]
        d = b2 - b1
        xi = d @ q2 @ d / (d @ q1 @ d)
        low, high = (B.argmax_quantile(v, np.array([xi]), np.array([xi * s2 / s1]))[0] * s1 / (d @ q1 @ d) for v in (0.025, 0.975))
        row = got["a", r]
        assert (row.break_pos, row.lower, row.upper) == (end, end - math.ceil(high), end - math.floor(low))
        assert row.lower < end < row.upper and (row.lower_m, row.break_m, row.upper_m) == tuple(1999 + v for v in (row.lower, end, row.upper))
