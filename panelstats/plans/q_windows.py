"""Registered window / fill queries."""

from __future__ import annotations

from ..operators import windows as WN
from ..sources import views
from . import sql as S
from .registry import register, rounded

_W = "(partition by entity order by m)"


@register("rolling_mean12", sql=S.with_(S.PANEL) + f"""
select entity, m, round(y, 6) as y,
       round(case when count(*) over (partition by entity order by m rows between 11 preceding and current row) = 12
                  then avg(y) over (partition by entity order by m rows between 11 preceding and current row) end, 6) as y_ma12
from panel""")
def q_rolling_mean12(spark, sf_dir):
    """WN1: 12-period right-aligned moving mean, NULL until the window is full."""
    p = views.panel(spark, sf_dir).select("entity", "m", "y")
    return rounded(WN.rolling_mean(p, "y", ["entity"], "m", 12))


@register("lag_features", sql=S.with_(S.PANEL) + f"""
select entity, m, round(y, 6) as y, round(lag(y, 1) over {_W}, 6) as y_l1, round(lag(y, 2) over {_W}, 6) as y_l2,
       round(lag(y, 3) over {_W}, 6) as y_l3, round(lag(y, 4) over {_W}, 6) as y_l4
from panel""")
def q_lag_features(spark, sf_dir):
    """WN2: positional lags 1..4 of y."""
    p = views.panel(spark, sf_dir).select("entity", "m", "y")
    return rounded(WN.lags(p, "y", ["entity"], "m", [1, 2, 3, 4]))


@register("diff_features", sql=S.with_(S.PANEL) + f"""
select entity, m, round(y, 6) as y, round(y - lag(y, 1) over {_W}, 6) as d_y,
       round(lag(y, 1) over {_W} - lag(y, 2) over {_W}, 6) as d_y_l1,
       round(lag(y, 2) over {_W} - lag(y, 3) over {_W}, 6) as d_y_l2,
       round(lag(y, 3) over {_W} - lag(y, 4) over {_W}, 6) as d_y_l3
from panel""")
def q_diff_features(spark, sf_dir):
    """WN3: first difference of y and its lags 1..3."""
    p = views.panel(spark, sf_dir).select("entity", "m", "y")
    return rounded(WN.diffs(p, "y", ["entity"], "m", 3))


_FILL_CTE = """k as (
  select entity, t, m, x2, cast(row_number() over (partition by entity order by m) as integer) as pos
  from panel_sparse)""", """n as (
  select *,
    last(case when x2 is not null then pos end ignore nulls) over (partition by entity order by m rows between unbounded preceding and current row) as p0,
    last(x2 ignore nulls) over (partition by entity order by m rows between unbounded preceding and current row) as v0,
    first(case when x2 is not null then pos end ignore nulls) over (partition by entity order by m rows between current row and unbounded following) as p1,
    first(x2 ignore nulls) over (partition by entity order by m rows between current row and unbounded following) as v1,
    count(x2) over (partition by entity) as nk
  from k)"""

_INTERIOR = ("case when x2 is not null then x2 when p0 is not null and p1 is not null "
             "then v0 + (v1 - v0) * ((pos - p0) / (p1 - p0)) end")


@register("fill_linear", sql=S.with_(S.PANEL_SPARSE, *_FILL_CTE)
          + f"select entity, t, m, round(x2, 6) as x2, round({_INTERIOR}, 6) as x2_filled from n")
def q_fill_linear(spark, sf_dir):
    """WN4/WN11: linear interpolation on row position, interior gaps only."""
    p = views.panel_sparse(spark, sf_dir).select("entity", "t", "m", "x2")
    return rounded(WN.fill_linear(p, "x2", ["entity"], "m"))


@register("fill_linear_edges", sql=S.with_(S.PANEL_SPARSE, *_FILL_CTE) + f"""
select entity, t, m, round(x2, 6) as x2,
       round(case when nk >= 2 then coalesce({_INTERIOR}, v0, v1) else x2 end, 6) as x2_filled from n""")
def q_fill_linear_edges(spark, sf_dir):
    """WN5: linear fill plus constant edge hold (needs two known points)."""
    p = views.panel_sparse(spark, sf_dir).select("entity", "t", "m", "x2")
    return rounded(WN.fill_linear(p, "x2", ["entity"], "m", hold_edges=True))


CUBIC_CTES = [S.PANEL_SPARSE, """k as (
  select entity, t, m, y, x1, x2, cast(row_number() over (partition by entity order by m) as integer) as pos
  from panel_sparse)""", """kn as (
  select entity, pos, lag(pos) over w as pp, lag(x2) over w as pv, lead(pos) over w as np, lead(x2) over w as nv
  from k where x2 is not null window w as (partition by entity order by pos))""", """j as (
  select k.*, kn.pp, kn.pv, kn.np, kn.nv from k left join kn using (entity, pos))""", """n as (
  select *,
    last(case when x2 is not null then pos end ignore nulls) over wb as p0,
    last(x2 ignore nulls) over wb as v0,
    last(case when x2 is not null then pp end ignore nulls) over wb as a2p,
    last(case when x2 is not null then pv end ignore nulls) over wb as a2v,
    first(case when x2 is not null then pos end ignore nulls) over wf as p1,
    first(x2 ignore nulls) over wf as v1,
    first(case when x2 is not null then np end ignore nulls) over wf as b2p,
    first(case when x2 is not null then nv end ignore nulls) over wf as b2v
  from j window wb as (partition by entity order by m rows between unbounded preceding and current row),
                wf as (partition by entity order by m rows between current row and unbounded following))""",
                       """h as (
  select *, p1 - p0 as h, (pos - p0) / (p1 - p0) as s, (v1 - v0) / (p1 - p0) as sec from n)""", """c as (
  select *, coalesce((v1 - a2v) / (p1 - a2p), sec) as m0, coalesce((b2v - v0) / (b2p - p0), sec) as m1 from h)"""]

CUBIC_EXPR = """case when x2 is not null then x2 when p0 is not null and p1 is not null then
         (2 * s * s * s - 3 * s * s + 1) * v0 + (s * s * s - 2 * s * s + s) * h * m0
         + (-2 * s * s * s + 3 * s * s) * v1 + (s * s * s - s * s) * h * m1 end"""

_CUBIC_SQL = S.with_(*CUBIC_CTES) + f"""
select entity, t, m, round(x2, 6) as x2, round({CUBIC_EXPR}, 6) as x2_cubic from c"""


@register("fill_cubic_local", sql=_CUBIC_SQL)
def q_fill_cubic_local(spark, sf_dir):
    """WN6 (re-aimed): local cubic Hermite fill from two known points each side."""
    p = views.panel_sparse(spark, sf_dir).select("entity", "t", "m", "x2")
    return rounded(WN.fill_cubic_local(p, "x2", ["entity"], "m"))


# Shares are applied in double arithmetic (as Spark and the reference do):
# DuckDB would otherwise multiply by an exact DECIMAL literal (720 * 0.7 = 504,
# while 720 * 0.7 in double is 503.99999999999994).
@register("fraction_windows", sql=S.with_(S.SERIES, """p as (
  select entity, t, cast(row_number() over (partition by entity order by t) as integer) as pos,
         count(*) over (partition by entity) as n_rows from series)""") + """
select entity, t, pos, n_rows,
  cast(n_rows > 100 and pos <= greatest(1, floor(n_rows * 0.25::double)) as integer) as w1,
  cast(n_rows > 100 and pos >= floor(n_rows * 0.25::double) + 1 and pos <= floor(n_rows * 0.5::double) as integer) as w2,
  cast(n_rows > 100 and n_rows > 200 and pos >= floor(n_rows * 0.7::double) and pos <= floor(n_rows * 0.85::double) as integer) as w3,
  cast(n_rows > 100 and n_rows > 200 and pos >= floor(n_rows * 0.9::double) as integer) as w4
from p""")
def q_fraction_windows(spark, sf_dir):
    """WN10: labels by share of rows on the hourly series (size guards 100/200)."""
    s = views.series(spark, sf_dir).select("entity", "t")
    return WN.fraction_windows(s, ["entity"], "t")
