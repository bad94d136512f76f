"""Registered structural-break queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import breaks as B
from ..operators import joins as J
from ..operators import ols as O
from ..operators.describe import long_values
from ..sources import views
from . import literals as LIT
from . import sql as S
from .q_diag import _RES, shift_resid_ctes
from .q_models import bp_regimes, shift_model
from .registry import register, rounded

K = ["entity"]
XS = ["x1", "x2"]

_PRE, _seg_rss, _NAMES = S.PREFIX_SUMS, S.seg_rss, S.SUM_NAMES
_PFX = {k: f"p{k}" for k in _NAMES}
_TOT = {k: f"t{k}" for k in _NAMES}
_REST = {k: f"(t{k} - p{k})" for k in _NAMES}
_RSS_CTE = f"""rs as (select *, {_seg_rss('pos', _PFX)} as rss1, {_seg_rss('(n - pos)', _REST)} as rss2,
  {_seg_rss('n', _TOT)} as rss from pre)"""
_PATH = [*_PRE, _RSS_CTE, """path as (
  select entity, m, pos, n, rss, rss1 + rss2 as u, (rss - (rss1 + rss2)) / ((rss1 + rss2) / (n - 6)) as f
  from rs where pos >= floor(n * 0.15::double) and pos <= n - floor(n * 0.15::double))"""]


@register("sup_f", sql=S.with_(*_PATH, """r as (
  select *, row_number() over (partition by entity order by f desc, pos) as rk, count(*) over (partition by entity) as n_cand
  from path)""") + """
select r.entity, r.n_cand, round(f, 6) as sup_f, pos as break_pos, m as break_m,
       round(case when f <= 3 then 1.0 else least(1.0, pow(f, 1.5) * exp(-f / 2) / (pow(2, 1.5) * exp(lgamma(1.5)))
         * ((1 - 3 / f) * ln(b * (n - a) / (a * (n - b))) + 2 / f)) end, 6) as p_value
from r join (select entity, min(pos) as a, max(pos) as b from path group by entity) c on c.entity = r.entity where rk = 1""")
def q_sup_f(spark, sf_dir):
    """SB4: F at every candidate split (15 % trim) from one prefix-sum window; sup and its date."""
    p = views.panel(spark, sf_dir, materialize=True)
    return rounded(B.sup_f(B.split_path(p, "y", XS, K, "m"), K, "m", k=3))


@register("break_conf_set", sql=S.with_(*_PATH, "b as (select entity, min(u) as best from path group by entity)") + f"""
select entity, m, pos from path join b using (entity) where n * ln(u / best) <= {B.LR_CRIT_95!r}""")
def q_break_conf_set(spark, sf_dir):
    """SB8 (re-aimed): break dates inside the 95 % likelihood-ratio set."""
    p = views.panel(spark, sf_dir, materialize=True)
    return B.break_conf_set(B.split_path(p, "y", XS, K, "m"), K).select("entity", "m", "pos")


@register("regime_label", sql=S.with_(*_PATH, """r as (
  select *, row_number() over (partition by entity order by f desc, pos) as rk from path)""",
                                      "b as (select entity, pos as bp from r where rk = 1)",
                                      "pp as (select entity, m, cast(row_number() over (partition by entity order by m) as integer) as pos from panel)") + """
select entity, m, pos, cast(case when pos > bp then 2 else 1 end as integer) as regime from pp join b using (entity)""")
def q_regime_label(spark, sf_dir):
    """SB7/WN9: regime number per period from the sup-F break date."""
    p = views.panel(spark, sf_dir, materialize=True)
    br = B.sup_f(B.split_path(p, "y", XS, K, "m"), K, "m").select("entity", F.col("break_pos"))
    return B.regime_from_break(p.select("entity", "m"), br, K, "m").select("entity", "m", "pos", "regime")


_EV_POS = [S.PANEL, """p as (select *, cast(row_number() over (partition by entity order by m) as integer) as pos,
         count(*) over (partition by entity) as n_rows from panel)""", LIT.events_sql(), """cc as (
  select p.*, ev.label, row_number() over (partition by p.entity, ev.label order by p.m) as rn
  from p, ev where p.m >= ev.ev_m)""", "evpos as (select entity, label, pos from cc where rn = 1 and pos > 10 and pos < n_rows - 10)"]


@register("chow_test", sql=S.with_(*_EV_POS, *_PRE[1:], _RSS_CTE) + """
select entity, label, pos, m, round(((rss - (rss1 + rss2)) / 3) / ((rss1 + rss2) / (n - 6)), 6) as f_stat,
       3 as df1, n - 6 as df2, round(""" + S.f_p("((rss - (rss1 + rss2)) / 3) / ((rss1 + rss2) / (n - 6))", "3", "n - 6") + """, 6) as p_value
from rs join evpos using (entity, pos)""")
def q_chow_test(spark, sf_dir):
    """SB5: Chow F at the (edge-guarded) event dates, with p."""
    p = views.panel(spark, sf_dir, materialize=True)
    pos = J.asof_forward(p, LIT.EVENTS, K, "m", ["t"], guard=10).select("entity", "label", "pos")
    return rounded(B.chow_at(p, pos, "y", XS, K, "m"))


_KOLMOGOROV_SQL = "2 * (select sum(power(-1.0, j + 1) * exp(-2 * j * j * s.statistic * s.statistic)) from range(1, 101) r(j))"


@register("ols_cusum", sql=S.with_(*_RES, """s as (
  select entity, max(abs(cs)) as statistic from (
    select entity, sum(e) over (partition by entity order by m rows between unbounded preceding and current row)
           / (sqrt(sum(e * e) over (partition by entity) / (count(*) over (partition by entity) - 3))
              * sqrt(count(*) over (partition by entity))) as cs from res) group by entity)""") + f"""
select entity, round(statistic, 6) as statistic, round({_KOLMOGOROV_SQL}, 6) as p_value from s""")
def q_ols_cusum(spark, sf_dir):
    """SB1: OLS-CUSUM sup statistic and its Brownian-bridge p-value."""
    _, _, res = _static_res(spark, sf_dir)
    return rounded(B.ols_cusum(res, K, "m", 3))


def _static_res(spark, sf_dir):
    p = views.panel(spark, sf_dir, materialize=True)
    fit = O.ols(p, "y", XS, K)
    return p, fit, O.residuals(p, fit, "y", XS, K)


@register("ols_mosum", sql=S.with_(*_RES, """q as (
  select entity, m, cast(row_number() over (partition by entity order by m) as integer) as pos, count(*) over (partition by entity) as n,
         sum(e) over (partition by entity order by m rows between unbounded preceding and current row) as s,
         sqrt(sum(e * e) over (partition by entity) / (count(*) over (partition by entity) - 3)) as sigma from res)""",
                                       "h as (select *, cast(floor(n * 0.15::double) as integer) as nh from q)") + """
select entity, round(st, 6) as statistic, nh as window,
       round(1 - exp(-2 * (1 - """ + S.norm_cdf("u") + """ + u * exp(-u * u / 2) / sqrt(2 * pi()) / 0.15)), 6) as p_value
from (select *, st / sqrt(0.15 * 0.85) as u from (
  select a.entity, max(abs((a.s - coalesce(b.s, 0.0)) / (a.sigma * sqrt(a.n)))) as st, any_value(a.nh) as nh
  from h a left join h b on a.entity = b.entity and b.pos = a.pos - a.nh
  where a.pos >= a.nh group by a.entity))""")
def q_ols_mosum(spark, sf_dir):
    """SB2: OLS-MOSUM sup statistic (window floor(0.15 n))."""
    _, _, res = _static_res(spark, sf_dir)
    return rounded(B.ols_mosum(res, K, "m", 3))


_REC_P = (f"case when x < 0.3 then 1 - 0.1464 * x else least(1, greatest(0, 2 * (1 - {S.norm_cdf('3 * x')} "
          f"+ exp(-4 * x * x) * ({S.norm_cdf('x')} + {S.norm_cdf('5 * x')} - 1) "
          f"- exp(-16 * x * x) * (1 - {S.norm_cdf('x')})))) end")
_REC_SQL = S.with_(S.PANEL, """c as (
  select entity, m, x1 - avg(x1) over (partition by entity) as a1, x2 - avg(x2) over (partition by entity) as a2,
         y - avg(y) over (partition by entity) as ay from panel)""", """pr as (
  select entity, m, a1, a2, ay, row_number() over w as pos,
    sum(a1) over wp as p1, sum(a2) over wp as p2, sum(ay) over wp as py, sum(a1 * a1) over wp as p11,
    sum(a1 * a2) over wp as p12, sum(a2 * a2) over wp as p22, sum(a1 * ay) over wp as p1y, sum(a2 * ay) over wp as p2y
  from c window w as (partition by entity order by m),
                wp as (partition by entity order by m rows between unbounded preceding and 1 preceding))""", """st as (
  select entity, m, a1, a2, ay, pos, pos - 1 as cn,
    p11 - p1 * p1 / (pos - 1) as s11, p12 - p1 * p2 / (pos - 1) as s12, p22 - p2 * p2 / (pos - 1) as s22,
    p1y - p1 * py / (pos - 1) as s1y, p2y - p2 * py / (pos - 1) as s2y,
    a1 - p1 / (pos - 1) as d1, a2 - p2 / (pos - 1) as d2, ay - py / (pos - 1) as dy
  from pr where pos > 3)""", """rr as (
  select entity, m, (dy - ((s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12)) * d1
                        - ((s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12)) * d2)
         / sqrt(1 + 1.0 / cn + (s22 * d1 * d1 - 2 * s12 * d1 * d2 + s11 * d2 * d2) / (s11 * s22 - s12 * s12)) as w
  from st)""", """pth as (
  select entity, sum(w) over (partition by entity order by m rows between unbounded preceding and current row)
           / (stddev_samp(w) over (partition by entity) * sqrt(count(*) over (partition by entity))) as proc,
         row_number() over (partition by entity order by m) / count(*) over (partition by entity) as tt
  from rr)""") + """
select entity, round(x, 6) as statistic, round(""" + _REC_P + """, 6) as p_value
from (select entity, max(abs(proc) / (1 + 2 * tt)) as x from pth group by entity)"""


@register("rec_cusum", sql=_REC_SQL)
def q_rec_cusum(spark, sf_dir):
    """SB3: recursive residuals from running sums, recursive CUSUM sup over 1 + 2t, p."""
    p = views.panel(spark, sf_dir, materialize=True)
    return rounded(B.rec_cusum(B.recursive_residuals(p, "y", XS, K, "m"), K, "m"))


@register("bai_perron", sql=S.with_(*S.bai_perron_ctes()) + """
select entity, cast(breaks as integer) as breaks, round(rss, 6) as rss, round(bic, 6) as bic, round(aic, 6) as aic,
       array_to_string(path, ',') as break_pos,
       coalesce((select string_agg(cast(p.m as varchar), ',' order by p.pos) from pre p
                 where p.entity = part.entity and list_contains(part.path, p.pos)), '') as break_m
from part""")
def q_bai_perron(spark, sf_dir):
    """SB6: optimal 0..5 break partitions per entity (h = 15 %), RSS, BIC, AIC, dates."""
    p = views.panel(spark, sf_dir, materialize=True)
    out = B.bai_perron(p, "y", XS, K, "m")
    listed = [F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("break_pos", "break_m")]
    return rounded(out.select("entity", "breaks", "rss", "bic", "aic", *listed))


@register("break_intervals")
def q_break_intervals(spark, sf_dir):
    """SB8: 95 % interval of each break of the Bai–Perron partition with two breaks."""
    reg = bp_regimes(views.panel(spark, sf_dir, materialize=True), 2)
    return B.break_intervals(reg, "y", XS, K, "m")


@register("model_paths_long", sql=S.with_(*shift_resid_ctes()) + """
select entity, m, 'actual' as path, round(y, 6) as value from res
union all select entity, m, 'static', round(y - e, 6) from res
union all select entity, m, 'shift', round(y - e_shift, 6) from shr""")
def q_model_paths_long(spark, sf_dir):
    """SB9: actual, static-model and shift-model paths per period, long form."""
    p = views.panel(spark, sf_dir, materialize=True)
    f, fu, xs = shift_model(p)
    base = O.residuals(p, O.ols(p, "y", XS, K), "y", XS, K).select("entity", "m", "y", F.col("fitted").alias("static"))
    shift = O.residuals(f, fu, "y", xs, K).select("entity", "m", F.col("fitted").alias("shift"))
    wide = base.join(shift, on=["entity", "m"]).withColumnRenamed("y", "actual")
    return rounded(long_values(wide, ["actual", "static", "shift"], ["entity", "m"], "path", "value"))


@register("regime_counts", sql=S.with_(*_PATH, """r as (
  select *, row_number() over (partition by entity order by f desc, pos) as rk from path)""",
                                       "b as (select entity, pos as bp from r where rk = 1)",
                                       "pp as (select entity, m, cast(row_number() over (partition by entity order by m) as integer) as pos from panel)") + """
select entity, cast(case when pos > bp then 2 else 1 end as integer) as regime, count(*) as n
from pp join b using (entity) group by all""")
def q_regime_counts(spark, sf_dir):
    """AG11/RG19: rows per regime of the sup-F split."""
    p = views.panel(spark, sf_dir, materialize=True)
    br = B.sup_f(B.split_path(p, "y", XS, K, "m"), K, "m").select("entity", F.col("break_pos"))
    reg = B.regime_from_break(p.select("entity", "m"), br, K, "m")
    return reg.groupBy("entity", "regime").agg(F.count(F.lit(1)).alias("n"))
