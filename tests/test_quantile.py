"""Exact quantiles without sorting raw rows: hot values, hot groups, ties, nulls."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelstats.operators import describe as DS
from panelstats.operators import quantile as Q


def frames(spark):
    rng = np.random.default_rng(5)
    rows = [("hot", 7.0)] * 7000 + [("hot", float(v)) for v in rng.normal(size=3000)]
    rows += [("cont", float(v)) for v in rng.exponential(size=20000)]
    rows += [("few", float(v)) for v in rng.integers(0, 5, 4000)]
    rows += [("large", float(v)) for v in rng.normal(size=130_000)]  # beyond the size that is its own bracket
    rows += [("one", 3.0), ("two", 1.0), ("two", 2.0), ("same", 4.0), ("same", 4.0), ("same", 4.0), ("null", None)]
    rows += [("tails", float(v)) for v in np.concatenate([rng.normal(size=3000), [1e12, -1e12] * 20])]
    return rows, spark.createDataFrame(rows, "g string, v double").repartition(6)


def test_quantiles_and_trimmed_mean(spark):
    rows, df = frames(spark)
    probs = [0.0, 0.013, 0.25, 0.5, 0.75, 0.999, 1.0]
    names = [f"p{i}" for i in range(len(probs))]
    got = {r.g: r for r in Q.quantiles(df, "v", ["g"], probs, names).collect()}
    trim = {r.g: r.trimmed_mean for r in Q.trimmed_mean(df, "v", ["g"], 0.1).collect()}
    for g in ("hot", "cont", "few", "large", "one", "two", "same", "tails"):
        x = np.sort([v for k, v in rows if k == g])
        np.testing.assert_allclose([got[g][n] for n in names], np.quantile(x, probs), rtol=1e-12, atol=1e-12)
        cut = int(len(x) * 0.1)
        assert trim[g] == pytest.approx(x[cut:len(x) - cut].mean(), rel=1e-9)


def test_without_keys(spark):
    rows, df = frames(spark)
    x = [v for _, v in rows if v is not None]
    assert Q.quantiles(df, "v", [], [0.5], ["m"]).first().m == pytest.approx(np.median(x))


def test_a_hot_value_is_reduced_before_the_shuffle(spark):
    """70 % of the rows share one value; no shuffle carries the raw rows."""
    df = spark.range(400_000).select(F.lit("k").alias("g"), F.when(F.col("id") % 10 < 7, 5.0).otherwise(F.rand(1)).alias("v"))
    plan = Q.quantiles(df, "v", ["g"], [0.25, 0.5], ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
    got = DS.describe_basic(df, ["v"], ["g"]).first()
    assert got.median == 5.0 and got.n == 400_000


def test_all_null_variables_stay(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("a", 2.0, None)], "g string, x double, y double")
    got = {r.variable: r for r in DS.describe_full(df, ["x", "y"], ["g"]).collect()}
    assert set(got) == {"x", "y"} and got["y"].n == 0 and got["y"].median is None


def test_brackets_of_large_groups_close_in_round_by_round(spark, monkeypatch):
    """With a limit of 50 kinds of value the last window sees some hundred rows of 130,000."""
    rows, df = frames(spark)
    monkeypatch.setattr(Q, "FEW", 50)
    rounds = []
    narrow = Q._narrowed
    monkeypatch.setattr(Q, "_narrowed", lambda *a: rounds.append(1) or narrow(*a))
    probs = [0.0, 0.013, 0.25, 0.5, 0.75, 0.999, 1.0]
    names = [f"p{i}" for i in range(len(probs))]
    out = Q.quantiles(df, "v", ["g"], probs, names)
    got = {r.g: r for r in out.collect()}
    for g in ("hot", "cont", "few", "large", "one", "two", "same", "tails"):
        x = np.sort([v for k, v in rows if k == g])
        np.testing.assert_allclose([got[g][n] for n in names], np.quantile(x, probs), rtol=1e-12, atol=1e-12)
    assert 2 <= len(rounds) <= 6
    b = Q.cut_lineage(df.where("g = 'large'"), "one")
    ranks = Q.type7_ranks([0.25, 0.5])
    tables = []
    keep = Q.cut_lineage
    monkeypatch.setattr(Q, "cut_lineage", lambda d, name="t": tables.append(keep(d, name)) or tables[-1])
    Q.order_statistics(b, "v", ["g"], ranks).collect()
    last = tables[-1].first()
    v = [r.v for r in b.collect()]
    for i in range(4):
        assert sum(last[f"_lo{i}"] <= x <= last[f"_hi{i}"] for x in v) <= 200
