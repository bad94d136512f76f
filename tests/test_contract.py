"""Driver contract: entry(), queries(), oracle_sql() — and the oracle on sf0.001."""

import pytest

import __spark_entry__ as E
from oracle_check import compare, duck_con
from panelstats.plans import registry

from conftest import SF_SMALL


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert {"entity", "term", "estimate", "se", "t_stat"} <= set(df.columns)


EXPECTED = set("""
acf adf_test asof_forward asof_nearest bai_perron bg_test
binned_trend boxplot_by_month bp_rows bp_test break_conf_set canonical_panel
chow_test coef_compare coef_vs_benchmark complete_cases corr_complete corr_pairwise
dedupe_first density_grid describe_basic describe_by_period describe_full diff_features
dw_test effect_labels fill_cubic_local fill_linear fill_linear_edges flag_counts
flag_first_rows format_labels fraction_windows gq_test head_tail histogram30
fill_spline jarque_bera jarque_bera_rows joint_f local_trend local_trend_rows model_diagnostics
ols_spline_fill qq_line shapiro_wilk known_points lag_features lag_selfjoin
ljung_box model_paths_long model_select model_table month_extract month_parse
month_parts null_profile ols_alt_fill ols_by_bp_regime ols_by_regime ols_coef
ols_cusum ols_fit ols_lag_diff ols_lag_level ols_mosum ols_panel_wide
ols_residuals ols_rows ols_shifts ols_static pacf period_label
qq_pairs rank_check rec_cusum recode_labels regime_counts regime_label
rename_positional residual_compare rolling_mean12 rule_score scan_csv scan_csv_locale
scan_dirty_numeric se_hac_qs se_hc1 se_hc1_rows se_kernel_bartlett se_newey_west
se_newey_west6 se_nw_auto se_nw_prewhite sink_csv sup_f time_span
union_models unpivot_series vif white_test window_flags zscore_long
""".split())


def test_every_sql_key_is_a_query():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    missing = EXPECTED - set(q)
    assert not missing, f"registered queries lost: {sorted(missing)}"


@pytest.fixture(scope="module")
def con():
    return duck_con(SF_SMALL)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle_small(spark, con, name):
    probs, _ = compare(spark, con, name, E.queries()[name], E.oracle_sql()[name], SF_SMALL, tol=1.5e-6)
    assert not probs, probs


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_rows_only_queries_run(spark, name):
    assert E.queries()[name](spark, SF_SMALL).count() >= 0


def test_runs_from_another_directory(tmp_path):
    """Workers must import the package even when the driver runs elsewhere
    (the zip shipped by ``session.ship_package``)."""
    import subprocess
    import sys
    script = tmp_path / "run.py"
    script.write_text(
        "import sys\n"
        "sys.path.insert(0, '/root/repo')\n"
        "from pyspark.sql import SparkSession\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "import __spark_entry__ as E\n"
        "print('ROWS', len(E.entry(spark).collect()))\n"
        "print('QQ', E.queries()['qq_pairs'](spark, '/root/testdata/sf0.001').count())\n")
    out = subprocess.run([sys.executable, str(script)], cwd=str(tmp_path), capture_output=True, text=True,
                         timeout=600, env={k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"})
    assert out.returncode == 0, out.stderr[-2000:]
    assert "ROWS 18" in out.stdout and "QQ" in out.stdout
