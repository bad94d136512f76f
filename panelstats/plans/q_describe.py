"""Registered description queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import describe as DS
from ..sources import views
from . import sql as S
from .registry import register, rounded

VARS = ["y", "x1", "x2"]

_LONG = """l as (
  select entity, m, t, 'y' as variable, y as value from {src} union all
  select entity, m, t, 'x1', x1 from {src} union all
  select entity, m, t, 'x2', x2 from {src})"""


@register("describe_basic", sql=S.with_(S.PANEL, _LONG.format(src="panel")) + """
select entity, variable, count(value) as n, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as sd,
       round(min(value), 6) as min, round(quantile_cont(value, 0.25), 6) as q1,
       round(quantile_cont(value, 0.5), 6) as median, round(quantile_cont(value, 0.75), 6) as q3,
       round(max(value), 6) as max
from l group by entity, variable""")
def q_describe_basic(spark, sf_dir):
    """AG1/RS2: n, mean, sd, min, quartiles, max per (entity, variable); exact quantiles."""
    return rounded(DS.describe_basic(views.panel(spark, sf_dir, materialize=True), VARS, ["entity"]))


@register("describe_full", sql=S.with_(S.PANEL, _LONG.format(src="panel"), """mo as (
  select entity, variable, count(value) as n, avg(value) as mean, stddev_samp(value) as sd,
         quantile_cont(value, 0.5) as median, min(value) as mn, max(value) as mx, var_pop(value) as m2
  from l group by entity, variable)""", """c as (
  select l.entity, l.variable, avg(power(value - mean, 3)) as m3, avg(power(value - mean, 4)) as m4,
         quantile_cont(abs(value - median), 0.5) as mad_raw
  from l join mo using (entity, variable) group by l.entity, l.variable)""", """r as (
  select l.*, mo.n, row_number() over (partition by l.entity, l.variable order by value) as rk
  from l join mo using (entity, variable))""", """tm as (
  select entity, variable, avg(value) as trimmed_mean from r
  where rk >= floor(n * 0.1::double) + 1 and rk <= n + 1 - (floor(n * 0.1::double) + 1) group by entity, variable)""") + """
select mo.entity, mo.variable, mo.n, round(mean, 6) as mean, round(sd, 6) as sd, round(median, 6) as median,
       round(trimmed_mean, 6) as trimmed_mean, round(mad_raw * 1.4826, 6) as mad, round(mn, 6) as min,
       round(mx, 6) as max, round(mx - mn, 6) as range,
       round(m3 / power(m2, 1.5) * power((n - 1) / n, 1.5), 6) as skew,
       round((m4 / (m2 * m2) - 3 + 3) * power(1 - 1 / n, 2) - 3, 6) as kurtosis,
       round(sd / sqrt(n), 6) as se
from mo join c using (entity, variable) join tm using (entity, variable)""")
def q_describe_full(spark, sf_dir):
    """AG2: full description (trimmed mean, MAD, range, type-3 skew/kurtosis, se)."""
    return rounded(DS.describe_full(views.panel(spark, sf_dir, materialize=True), VARS, ["entity"]))


_PERIOD_SQL = ("case when t < date '1996-01-01' then 'before 1996' "
               "when t >= date '1996-01-01' and t < date '1998-01-01' then '1996-1997' "
               "when t >= date '1998-01-01' and t < date '2000-01-01' then '1998-1999' "
               "when t >= date '2000-01-01' then 'since 2000' end")


@register("describe_by_period", sql=S.with_(S.PANEL, _LONG.format(src="panel")) + f"""
select entity, {_PERIOD_SQL} as period, variable, count(value) as n, round(avg(value), 6) as mean,
       round(stddev_samp(value), 6) as sd
from l group by all""")
def q_describe_by_period(spark, sf_dir):
    """AG3: mean and sd per (entity, period, variable)."""
    p = views.panel(spark, sf_dir, materialize=True)
    return rounded(DS.describe_by_group(p, VARS, L.period_label(F.col("t")), "period", ["entity"]))


@register("null_profile", sql=S.with_(S.PANEL_SPARSE) + """
select entity, 'y' as variable, count(*) filter (where y is null) as n_null, count(y) as n_valid from panel_sparse group by entity
union all select entity, 'x1', count(*) filter (where x1 is null), count(x1) from panel_sparse group by entity
union all select entity, 'x2', count(*) filter (where x2 is null), count(x2) from panel_sparse group by entity""")
def q_null_profile(spark, sf_dir):
    """AG4: NULL and valid counts per column and entity."""
    return DS.null_profile(views.panel_sparse(spark, sf_dir, materialize=True), VARS, ["entity"])


def _corr_sql(where: str) -> tuple[str, str]:
    cells = []
    for a in VARS:
        for b in VARS:
            if a == b:
                r = "1.0"
            else:
                x, y = (a, b) if VARS.index(a) < VARS.index(b) else (b, a)
                r = f"corr({x}, {y})"
            cells.append(f"select entity, '{a}' as var_a, '{b}' as var_b, round({r}, 6) as r from src group by entity")
    return f"src as (select * from panel_sparse {where})", "\nunion all ".join(cells)


_cc_cte, _cc_sel = _corr_sql("where y is not null and x1 is not null and x2 is not null")
_cp_cte, _cp_sel = _corr_sql("")


@register("corr_complete", sql=S.with_(S.PANEL_SPARSE, _cc_cte) + _cc_sel)
def q_corr_complete(spark, sf_dir):
    """AG5/RS3: correlation matrix on complete rows, as long triples."""
    return rounded(DS.corr_long(views.panel_sparse(spark, sf_dir, materialize=True), VARS, ["entity"], listwise=True))


@register("corr_pairwise", sql=S.with_(S.PANEL_SPARSE, _cp_cte) + _cp_sel)
def q_corr_pairwise(spark, sf_dir):
    """AG6/RS3: correlation matrix, each pair on its own complete rows."""
    return rounded(DS.corr_long(views.panel_sparse(spark, sf_dir, materialize=True), VARS, ["entity"], listwise=False))


@register("boxplot_by_month", sql=S.with_(S.PANEL, """q as (
  select entity, cast(month(t) as integer) as month, quantile_cont(y, 0.25) as q1, quantile_cont(y, 0.5) as median,
         quantile_cont(y, 0.75) as q3 from panel group by all)""", """j as (
  select p.y, q.*, p.y >= q.q1 - 1.5 * (q.q3 - q.q1) and p.y <= q.q3 + 1.5 * (q.q3 - q.q1) as inside
  from panel p join q on p.entity = q.entity and cast(month(p.t) as integer) = q.month)""") + """
select entity, month, count(y) as n, round(any_value(q1), 6) as q1, round(any_value(median), 6) as median,
       round(any_value(q3), 6) as q3, round(min(y) filter (where inside), 6) as whisker_lo,
       round(max(y) filter (where inside), 6) as whisker_hi, count(y) filter (where not inside) as n_out
from j group by entity, month""")
def q_boxplot_by_month(spark, sf_dir):
    """AG7: per calendar month: quartiles, 1.5·IQR whiskers, outlier count."""
    p = views.panel(spark, sf_dir, materialize=True).withColumn("month", F.month("t"))
    return rounded(DS.boxplot_stats(p, "y", ["entity", "month"]))


@register("histogram30", sql=S.with_(S.PANEL, """r as (select entity, min(y) as lo, max(y) as hi from panel group by entity)""",
                                     """b as (
  select p.entity, r.lo, r.hi,
         cast(case when (r.hi - r.lo) / 30 > 0 then least(floor((p.y - r.lo) / ((r.hi - r.lo) / 30)), 29) else 0 end as integer) as bin
  from panel p join r using (entity))""") + """
select entity, bin, count(*) as count, round(any_value(lo) + bin * (any_value(hi) - any_value(lo)) / 30, 6) as bin_lo
from b group by entity, bin""")
def q_histogram30(spark, sf_dir):
    """AG8: 30 equal-width bins of y per entity."""
    return rounded(DS.histogram(views.panel(spark, sf_dir, materialize=True), "y", ["entity"], 30))


@register("density_grid", sql=S.with_(S.PANEL, """par0 as (
  select entity, count(y) as n, stddev_samp(y) as sd, min(y) as lo, max(y) as hi,
         quantile_cont(y, 0.25) as q1, quantile_cont(y, 0.75) as q3 from panel group by entity)""", """par as (
  select entity, n, lo, hi, 0.9 * least(sd, (q3 - q1) / 1.34) * power(cast(n as double), -0.2) as bw from par0)""",
                                     """par2 as (select entity, n, bw, lo - 3.0 * bw as g0, (hi - lo + 6.0 * bw) / 511 as step from par)""",
                                     """vals as (select entity, y as v, count(*) as c from panel group by entity, y)""",
                                     """g as (select par2.*, cast(r.range as integer) as i from par2, range(512) r)""") + """
select g.entity, g.i, round(any_value(g0 + i * step), 6) as x,
       round(sum(c * exp(-0.5 * ((g0 + i * step - v) / bw) * ((g0 + i * step - v) / bw))) / (any_value(n) * any_value(bw) * 2.5066282746310002), 6) as density
from g join vals using (entity) group by g.entity, g.i""")
def q_density_grid(spark, sf_dir):
    """AG9: Gaussian kernel density of y on a 512-point grid per entity."""
    return rounded(DS.density_grid(views.panel(spark, sf_dir, materialize=True), "y", ["entity"]))


@register("time_span", sql=S.with_(S.SERIES) + """
select entity, min(t) as t_first, max(t) as t_last, count(*) as n from series group by entity""")
def q_time_span(spark, sf_dir):
    """AG10: first/last time and row count per series."""
    return DS.time_span(views.series(spark, sf_dir, materialize=True), "t", ["entity"])


@register("binned_trend", sql=S.with_(S.PANEL, """b as (
  select entity, x1, y, ntile(20) over (partition by entity order by x1, m) as bin from panel)""") + """
select entity, cast(bin as integer) as bin, count(*) as n, round(avg(x1), 6) as mean_x, round(avg(y), 6) as mean_y
from b group by entity, bin""")
def q_binned_trend(spark, sf_dir):
    """AG12 (re-aimed smoother): 20 equal-count bins of x1, mean x1 and y per bin."""
    return rounded(DS.binned_trend(views.panel(spark, sf_dir, materialize=True), "x1", "y", ["entity"], tie="m", bins=20))
