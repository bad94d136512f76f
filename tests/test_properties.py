"""Property tests and edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelstats.operators import breaks as B
from panelstats.operators import ols as O
from panelstats.operators import quantile as Q
from panelstats.operators import windows as WN
from panelstats.sources import views

from conftest import SF_SMALL

K = ["entity"]
XS = ["x1", "x2"]


@pytest.fixture(scope="module")
def panel(spark):
    return views.panel(spark, SF_SMALL, materialize=True)


def _sorted(df, *cols):
    return [tuple(r) for r in df.orderBy(*cols).collect()]


def test_lag_window_equals_selfjoin(panel):
    a = WN.lags(panel.select("entity", "m", "y"), "y", K, "m", [1])
    b = WN.lag_selfjoin(panel.select("entity", "m", "y"), "y", K, "m", 1)
    assert _sorted(a.select("entity", "m", "y_l1"), "entity", "m") == \
        _sorted(b.select("entity", "m", "y_l1"), "entity", "m")


def test_shuffled_input_same_fit(panel):
    a = O.ols(panel, "y", XS, K).select("entity", "beta").orderBy("entity").collect()
    b = O.ols(panel.repartition(7, F.rand(3)), "y", XS, K).select("entity", "beta").orderBy("entity").collect()
    for x, y in zip(a, b):
        np.testing.assert_allclose(x.beta, y.beta, rtol=1e-10)


def test_per_entity_equals_alone(panel):
    allfit = {r.entity: r.beta for r in O.ols(panel, "y", XS, K).collect()}
    one = panel.filter(F.col("entity") == "NO")
    alone = O.ols(one, "y", XS, K).collect()[0].beta
    np.testing.assert_allclose(allfit["NO"], alone, rtol=1e-10)


def test_ols_matches_numpy(panel):
    pdf = panel.filter(F.col("entity") == "AF").toPandas()
    X = np.column_stack([np.ones(len(pdf)), pdf.x1, pdf.x2])
    b, *_ = np.linalg.lstsq(X, pdf.y.to_numpy(), rcond=None)
    got = O.ols(panel.filter(F.col("entity") == "AF"), "y", XS, K).collect()[0].beta
    np.testing.assert_allclose(got, b, rtol=1e-9)


def test_degenerate_groups_give_null(spark):
    df = spark.createDataFrame(
        [("a", None, 1.0, 2.0), ("b", 1.0, 2.0, 3.0), ("c", 1.0, 2.0, 3.0), ("c", 2.0, 3.0, 5.0),
         ("d", 1.0, 1.0, 1.0), ("d", 2.0, 1.0, 2.0), ("d", 3.0, 1.0, 3.0), ("d", 5.0, 1.0, 4.5)],
        "entity string, y double, x1 double, x2 double")
    rows = {r.entity: r for r in O.ols(df, "y", XS, K).collect()}
    assert rows["a"].n == 0 and rows["a"].beta[0] is None           # all-null group kept, NULL
    assert rows["b"].se[0] is None                                  # one row: no SE
    assert rows["c"].se[0] is None                                  # two rows, 3 params: no SE
    assert rows["d"].aliased == [True, False]                       # constant x1 dropped here only
    assert rows["d"].beta[1] is None and rows["d"].beta[2] is not None


def test_fill_passes_through_known_points(spark):
    p = views.panel_sparse(spark, SF_SMALL, materialize=True)
    f = WN.fill_linear(p, "x2", K, "m", hold_edges=True)
    bad = f.filter(F.col("x2").isNotNull() & (F.col("x2") != F.col("x2_filled"))).count()
    assert bad == 0
    interior = WN.fill_linear(p, "x2", K, "m")
    # interior fill keeps leading rows (before the first December) NULL
    assert interior.filter(F.col("x2_filled").isNull()).count() > 0


def test_fill_needs_two_points(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 5.0), ("a", 3, None)], "entity string, m int, x double")
    out = WN.fill_linear(df, "x", K, "m", hold_edges=True).orderBy("m").collect()
    assert [r.x_filled for r in out] == [None, 5.0, None]


def test_exact_quantiles_on_a_hot_key(spark):
    rng = np.random.default_rng(0)
    hot = rng.normal(size=5000)
    cold = rng.normal(size=50)
    rows = [("hot", float(v)) for v in hot] + [("cold", float(v)) for v in cold]
    df = spark.createDataFrame(rows, "entity string, v double").repartition(16)
    q = {r.entity: r for r in Q.quantiles(df, "v", K, [0.1, 0.5, 0.9], ["a", "b", "c"]).collect()}
    for name, arr in (("hot", hot), ("cold", cold)):
        np.testing.assert_allclose([q[name].a, q[name].b, q[name].c],
                                   np.quantile(arr, [0.1, 0.5, 0.9]), rtol=1e-12)
    r = Q.rank_within(df, "v", K)
    assert r.filter(F.col("entity") == "hot").agg(F.countDistinct("_rank")).collect()[0][0] == 5000


def test_supf_equals_one_break_optimum(ref_series):
    path = B.split_path(ref_series, "y", XS, K, "m")
    best_split = path.agg(F.min("rss_split")).collect()[0][0]
    bp = [r for r in B.bai_perron(ref_series, "y", XS, K, "m").collect() if r.breaks == 1][0]
    np.testing.assert_allclose(best_split, bp.rss, rtol=1e-9)


def test_long_series_running_sum_equals_window(ref_series):
    a = B.prefix_sums(ref_series, "y", XS, K, "m").select("m", "pre").orderBy("m").collect()
    b = B.prefix_sums(ref_series, "y", XS, K, "m", buckets="m").select("m", "pre").orderBy("m").collect()
    for x, y in zip(a, b):
        np.testing.assert_allclose(x.pre, y.pre, rtol=1e-9, atol=1e-9)


def test_hot_key_ranks_spread_over_tasks(spark):
    """A group holding most rows is ranked by many tasks, not one."""
    rng = np.random.default_rng(1)
    rows = [("hot", float(v)) for v in rng.normal(size=20000)] + [("cold", 1.0)] * 10
    df = spark.createDataFrame(rows, "entity string, v double")
    d = df.repartitionByRange(Q.range_partitions(df), "entity", "v").withColumn("_pid", F.spark_partition_id())
    assert d.filter(F.col("entity") == "hot").select("_pid").distinct().count() > 4
    r = Q.rank_within(df, "v", K).filter(F.col("entity") == "hot")
    assert r.agg(F.min("_rank"), F.max("_rank"), F.countDistinct("_rank")).collect()[0] == (1, 20000, 20000)


def test_prebinned_density_close_to_exact(panel):
    from panelstats.operators import describe as DS
    ex = {(r.entity, r.i): r.density for r in DS.density_grid(panel, "y", K).collect()}
    pb = {(r.entity, r.i): r.density for r in DS.density_grid(panel, "y", K, prebin=4096).collect()}
    assert ex.keys() == pb.keys()
    diff = max(abs(ex[k] - pb[k]) for k in ex)
    assert diff < 1e-3 * max(ex.values())


def test_degenerate_groups_do_not_raise_under_ansi(spark):
    """Perfect fits, constant series and empty groups give NULLs, not DIVIDE_BY_ZERO."""
    from panelstats.operators import describe as DS
    from panelstats.operators import diagnostics as DG
    from panelstats.operators import models as MD
    from panelstats.operators.transforms import zscore
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
    rows = []
    for m in range(40):
        x1, x2 = float(m % 7), float((m * 3) % 5)
        rows.append(("perfect", m, 1 + 2 * x1 + 3 * x2, x1, x2))   # zero residuals
        rows.append(("flat", m, 5.0, x1, x2))                        # constant y
        rows.append(("empty", m, None, x1, x2))                      # no complete row
    df = spark.createDataFrame(rows, "entity string, m int, y double, x1 double, x2 double")
    fit = O.ols(df, "y", XS, K)
    res = DG.resid_series(df, "y", XS, K, "m", fit)
    outs = [
        O.coef_table(fit, XS, K), O.fit_table(fit, K), MD.information_criteria(fit, K),
        DG.durbin_watson(res, fit, XS, K, "m"), DG.ljung_box(res, K, 12), DG.autocorrelations(res, K),
        DG.jarque_bera(res, K), DG.breusch_pagan(res, XS, K), DG.goldfeld_quandt(df, "y", XS, K, "x1", "m"),
        B.ols_cusum(res, K, "m", 3), B.ols_mosum(res, K, "m", 3), B.split_path(df, "y", XS, K, "m"),
        B.rec_cusum(B.recursive_residuals(df, "y", XS, K, "m"), K, "m"),
        zscore(df.filter(F.col("entity") == "flat"), "y", K), DS.density_grid(df, "y", K),
        MD.robust_se(df, fit, "y", XS, K, "m", "hc1"),
    ]
    for o in outs:
        o.collect()


def test_long_series_cusum_equals_window(ref_series):
    from panelstats.operators import diagnostics as DG
    res = DG.resid_series(ref_series, "y", XS, K, "m")
    a = B.ols_cusum(res, K, "m", 3).collect()[0]
    b = B.ols_cusum(res, K, "m", 3, buckets="m", bucket_size=16).collect()[0]
    assert a.statistic == pytest.approx(b.statistic, rel=1e-12)
    assert a.p_value == pytest.approx(b.p_value, rel=1e-9)


def test_long_series_recursive_residuals_equal_window(ref_series):
    a = {r.m: r.w for r in B.recursive_residuals(ref_series, "y", XS, K, "m").collect()}
    b = {r.m: r.w for r in B.recursive_residuals(ref_series, "y", XS, K, "m", buckets="m", bucket_size=16).collect()}
    assert a.keys() == b.keys() and len(a) == 274
    for m in a:
        assert a[m] == pytest.approx(b[m], rel=1e-7, abs=1e-9)


@pytest.mark.parametrize("edges", [False, True])
def test_long_series_fill_equals_window(spark, edges):
    p = views.panel_sparse(spark, SF_SMALL, materialize=True).select("entity", "t", "m", "x2")
    a = {(r.entity, r.m): r.x2_filled for r in WN.fill_linear(p, "x2", K, "m", hold_edges=edges).collect()}
    b = {(r.entity, r.m): r.x2_filled
         for r in WN.fill_linear_long(p, "x2", K, "m", "m", bucket_size=5, hold_edges=edges).collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert (a[k] is None and b[k] is None) or a[k] == pytest.approx(b[k], rel=1e-12)
