"""Registered diagnostic queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diagnostics as DG
from ..operators import joins as J
from ..operators import ols as O
from ..operators import windows as WN
from ..operators.describe import long_values
from ..sources import views
from . import literals as LIT
from . import sql as S
from .q_models import shift_model
from .registry import register, rounded

K = ["entity"]
XS = ["x1", "x2"]

# residuals of the static model, positions and centred residuals, as oracle CTEs
_RES = [S.PANEL, *S.ols_ctes("f", "panel", "y", XS), """res as (
  select p.entity, p.m, p.t, p.x1, p.x2, p.y, p.y - (f.b0 + f.b1 * p.x1 + f.b2 * p.x2) as e
  from panel p join f using (entity))""", """rp as (
  select *, row_number() over (partition by entity order by m) as pos, e - avg(e) over (partition by entity) as c,
         count(*) over (partition by entity) as nn
  from res)"""]


def _static(spark, sf_dir):
    p = views.panel(spark, sf_dir, materialize=True)
    fit = O.ols(p, "y", XS, K)
    return p, fit, DG.resid_series(p, "y", XS, K, "m", fit)


@register("bp_test", sql=S.with_(*_RES, "e2 as (select entity, x1, x2, e * e as e2 from res)",
                                 *S.ols_ctes("a", "e2", "e2", XS)) + """
select entity, 'breusch_pagan' as test, round(n * (1 - rss / syy), 6) as statistic, 2 as df,
       round(exp(-(n * (1 - rss / syy)) / 2), 6) as p_value
from a""")
def q_bp_test(spark, sf_dir):
    """DG1: studentised Breusch–Pagan (n·R² of e² on x1, x2); χ²(2) p-value."""
    _, _, res = _static(spark, sf_dir)
    return rounded(DG.breusch_pagan(res, XS, K))


_WHITE_SQL = S.with_(*_RES, """w as (select entity, e * e as e2, x1, x2, x1 * x1 as x1_sq, x1 * x2 as x1_x_x2,
  x2 * x2 as x2_sq from res)""", *S.mgs_ctes("a", "w", "e2", ["x1", "x2", "x1_sq", "x1_x_x2", "x2_sq"])) + """
select entity, 'white' as test, round(n * (1 - rss / tss), 6) as statistic, 5 as df,
       round(""" + S.chi2_p("(n * (1 - rss / tss))", 5) + """, 6) as p_value from a"""


@register("white_test", sql=_WHITE_SQL)
def q_white_test(spark, sf_dir):
    """DG2: White test (levels, squares, cross product), n·R², χ²(5) p."""
    _, _, res = _static(spark, sf_dir)
    return rounded(DG.white(res, XS, K))


@register("gq_test", sql=S.with_(S.PANEL, """g as (
  select *, row_number() over (partition by entity order by x1, m) as r, count(*) over (partition by entity) as nn from panel)""",
                                 "gs as (select *, case when r <= floor(nn * 0.5::double) then 1 else 2 end as segment from g)",
                                 *S.ols_ctes("f", "gs", "y", XS, keys="entity, segment")) + """
select entity, round(st, 6) as statistic, df1, df2, round(""" + S.f_p("st", "df2", "df1") + """, 6) as p_value from (
select entity, max(case when segment = 2 then rss / df end) / max(case when segment = 1 then rss / df end) as st,
       cast(max(case when segment = 1 then df end) as bigint) as df1,
       cast(max(case when segment = 2 then df end) as bigint) as df2
from f group by entity)""")
def q_gq_test(spark, sf_dir):
    """DG3: Goldfeld–Quandt ordered by x1, split at half, p."""
    p = views.panel(spark, sf_dir, materialize=True)
    return rounded(DG.goldfeld_quandt(p, "y", XS, K, "x1", "m"))


@register("dw_test", sql=S.with_(S.PANEL, *S.mgs_ctes("f", "panel", "y", XS, carry=("m",)), *S.dw_ctes("dw", "f", 2)) + f"""
select entity, round(st, 6) as statistic, round(mean, 6) as mean, round(var, 6) as var, round(z, 6) as z,
       round({S.norm_cdf('greatest(z, -40)')}, 6) as p_value from dw""")
def q_dw_test(spark, sf_dir):
    """DG4: Durbin–Watson statistic, its exact mean and variance under H0, z and p = Φ(z)."""
    _, fit, res = _static(spark, sf_dir)
    return rounded(DG.durbin_watson(res, fit, XS, K, "m"))


def _bg_sql() -> str:
    parts, ctes = [], []
    for q in (3, 6, 12):
        lags = ", ".join(f"coalesce(lag(e, {l}) over (partition by entity order by m), 0) as el{l}" for l in range(1, q + 1))
        ctes.append(f"bg{q}_in as (select entity, e, x1, x2, {lags} from res)")
        ctes += S.mgs_ctes(f"bg{q}", f"bg{q}_in", "e", ["x1", "x2", *[f"el{l}" for l in range(1, q + 1)]])
        parts.append(f"select entity, 'breusch_godfrey_{q}' as test, round(n * (1 - rss / tss), 6) as statistic, "
                     f"{q} as df, round({S.chi2_p('(n * (1 - rss / tss))', q)}, 6) as p_value from bg{q}")
    return S.with_(*_RES, *ctes) + "\nunion all ".join(parts)


@register("bg_test", sql=_bg_sql())
def q_bg_test(spark, sf_dir):
    """DG5: Breusch–Godfrey of orders 3, 6 and 12 (zero-filled lags), n·R², χ²(q) p."""
    _, _, res = _static(spark, sf_dir)
    out = None
    for q in (3, 6, 12):
        t = DG.breusch_godfrey(res, XS, K, "m", q)
        out = t if out is None else out.unionByName(t)
    return rounded(out)


_LB_SQL = S.with_(*_RES, """ac as (
  select a.entity, l.k as lag, sum(a.c * b.c) as num from rp a cross join range(1, 13) l(k)
  join rp b on a.entity = b.entity and b.pos = a.pos - l.k group by a.entity, l.k)""",
                  "den as (select entity, sum(c * c) as d, any_value(nn) as n from rp group by entity)",
                  """q as (select ac.entity, any_value(n) * (any_value(n) + 2) * sum((num / d) * (num / d) / (n - lag)) as statistic
  from ac join den using (entity) group by ac.entity)""") + """
select entity, round(statistic, 6) as statistic, 12 as df,
       round(exp(-statistic / 2) * (1 + statistic / 2 + power(statistic / 2, 2) / 2 + power(statistic / 2, 3) / 6
             + power(statistic / 2, 4) / 24 + power(statistic / 2, 5) / 120), 6) as p_value
from q"""


@register("ljung_box", sql=_LB_SQL)
def q_ljung_box(spark, sf_dir):
    """DG6: Ljung–Box Q at lag 12 on the static residuals, χ²(12)."""
    _, _, res = _static(spark, sf_dir)
    return rounded(DG.ljung_box(res, K, 12))


@register("jarque_bera", sql=S.with_(*_RES, """mo as (
  select entity, count(*) as n, avg(c * c) as m2, avg(c * c * c) as m3, avg(c * c * c * c) as m4 from rp group by entity)""",
                                     """st as (select entity, n, m3 / power(m2, 1.5) as s, m4 / (m2 * m2) as k from mo)""") + """
select entity, round(n / 6 * (s * s + (k - 3) * (k - 3) / 4), 6) as statistic, round(s, 6) as skewness,
       round(k, 6) as kurtosis, round(exp(-(n / 6 * (s * s + (k - 3) * (k - 3) / 4)) / 2), 6) as p_value
from st""")
def q_jarque_bera(spark, sf_dir):
    """DG7: Jarque–Bera on the static residuals, χ²(2)."""
    _, _, res = _static(spark, sf_dir)
    return rounded(DG.jarque_bera(res, K))


_ACF_CTE = """ac as (
  select a.entity, cast(l.k as integer) as lag, sum(a.c * b.c) as num
  from rp a join (select entity, any_value(nn) as nn from rp group by entity) z using (entity)
  cross join range(1, 200) l(k)
  join rp b on a.entity = b.entity and b.pos = a.pos - l.k
  where l.k <= least(floor(10 * log10(z.nn)), z.nn - 1) group by a.entity, l.k)"""
_DEN_CTE = "den as (select entity, sum(c * c) as d, any_value(nn) as n from rp group by entity)"


@register("acf", sql=S.with_(*_RES, _ACF_CTE, _DEN_CTE) + """
select ac.entity, lag, n, round(num / d, 6) as acf from ac join den using (entity)""")
def q_acf(spark, sf_dir):
    """DG8: residual autocorrelations to lag floor(10·log10 n) (equi-join on position − lag)."""
    _, _, res = _static(spark, sf_dir)
    return rounded(DG.autocorrelations(res, K))


_PACF_SQL = S.with_(*_RES, _ACF_CTE, _DEN_CTE, """rr as materialized (
  select entity, list(num / d order by lag) as r from ac join den using (entity) group by entity)""", """dl as (
  select entity, r, 1 as k, [r[1]] as phi from rr
  union all select entity, r, k + 1, list_append(list_transform(range(1, k + 1), lambda i: phi[i] - a * phi[k + 1 - i]), a)
  from (select *, (r[k + 1] - list_sum(list_transform(range(1, k + 1), lambda i: phi[i] * r[k + 1 - i])))
    / (1 - list_sum(list_transform(range(1, k + 1), lambda i: phi[i] * r[i]))) as a from dl where k < len(r)))""") + """
select entity, cast(k as integer) as lag, round(phi[k], 6) as pacf from dl"""


@register("pacf", sql=_PACF_SQL.replace("with ", "with recursive ", 1))
def q_pacf(spark, sf_dir):
    """DG9: partial autocorrelations by Durbin–Levinson on the acf."""
    _, _, res = _static(spark, sf_dir)
    return rounded(DG.partial_autocorrelations(DG.autocorrelations(res, K), K))


def _interp_sql(x: str, xp: list[float], fp: list[float]) -> str:
    """Piecewise-linear interpolation clamped at both ends (numpy ``interp``)."""
    parts = [f"case when {x} <= {xp[0]!r} then {fp[0]!r}"]
    for i in range(1, len(xp)):
        parts.append(f"when {x} <= {xp[i]!r} then {fp[i - 1]!r} + ({x} - {xp[i - 1]!r}) * "
                     f"({fp[i]!r} - {fp[i - 1]!r}) / ({xp[i]!r} - {xp[i - 1]!r})")
    parts.append(f"else {fp[-1]!r} end")
    return " ".join(parts)


def _adf_sql() -> str:
    maxk = 26  # lags written out; a series that needs more is an error, never a cut
    dls = ", ".join(f"case when kk >= {l} then lag(value, {l}) over w - lag(value, {l + 1}) over w else 0.0 end as dl{l}"
                    for l in range(1, maxk))
    long = """l as (
  select entity, m, 'y' as variable, y as value from panel union all
  select entity, m, 'x1', x1 from panel union all select entity, m, 'x2', x2 from panel)"""
    base = f"""b as (select *, row_number() over w as pos, count(*) over (partition by entity, variable) as nn,
  cast(floor(pow(count(*) over (partition by entity, variable) - 1, 1.0 / 3)) as integer) as kk
  from l window w as (partition by entity, variable order by m))"""
    feat = f"""ff as (select entity, variable, kk, nn, pos, value - lag(value, 1) over w as dy, lag(value, 1) over w as lvl,
  case when kk >= {maxk} then error('series needs more lags') else cast(pos as double) end as tpos, {dls}
  from b window w as (partition by entity, variable order by m))"""
    xs = ["tpos", *[f"dl{l}" for l in range(1, maxk)], "lvl"]
    ctes = [S.PANEL, long, base, feat, "fz as (select * from ff where pos > kk + 1)",
            *S.mgs_ctes("adf", "fz", "dy", xs, keys="entity, variable", carry=("kk", "nn"), df_params="max(kk) + 3")]
    # the per-group lag count rides along in the carried column
    ctes[-1] = ctes[-1].replace("count(*) as n,", "count(*) as n, max(kk) as kk, max(nn) as nn,")
    crit = [_interp_sql("(nn - 1)", list(map(float, DG.ADF_SIZES)), [-v for v in row]) for row in DG.ADF_TABLE]
    ctes.append("st as (select *, b_last / se_last as stat, " + ", ".join(f"{c} as c{i}" for i, c in enumerate(crit))
                + " from adf)")
    pv = [f"when stat <= c0 then {DG.ADF_PROBS[0]!r}"]
    for i in range(1, len(DG.ADF_PROBS)):
        pv.append(f"when stat <= c{i} then {DG.ADF_PROBS[i - 1]!r} + (stat - c{i - 1}) * "
                  f"({DG.ADF_PROBS[i]!r} - {DG.ADF_PROBS[i - 1]!r}) / (c{i} - c{i - 1})")
    ctes.append(f"pv as (select *, case {' '.join(pv)} else {DG.ADF_PROBS[-1]!r} end as p from st)")
    return S.with_(*ctes) + """
select entity, variable, round(stat, 6) as statistic, kk as lag_order, round(p, 6) as p_value,
       case when p < 0.05 then 'yes' else 'no' end as stationary
from pv"""


@register("adf_test", sql=_adf_sql())
def q_adf_test(spark, sf_dir):
    """DG10: augmented Dickey–Fuller (trend) for y, x1, x2 per entity."""
    p = views.panel(spark, sf_dir, materialize=True)
    long = long_values(p, ["y", "x1", "x2"], ["entity", "m"])
    return rounded(DG.adf(long, "value", ["entity", "variable"], "m"))


def shift_resid_ctes() -> list[str]:
    """Static residuals (closed form) and shift-model residuals (Gram–Schmidt) per row."""
    flags = ", ".join(f"case when m >= {LIT.month_number(a)} and m <= {LIT.month_number(b)} then 1.0 else 0.0 end as {l}"
                      for l, a, b in LIT.WINDOWS)
    labels = [w[0] for w in LIT.WINDOWS]
    return [*_RES, f"fl as (select entity, m, y, x1, x2, {flags} from panel)",
            *S.mgs_ctes("sh", "fl", "y", [*XS, *labels], carry=("m", "y")),
            f"shr as (select entity, m, y, ry as e_shift from sh_{len(XS) + len(labels)})"]


@register("residual_compare", sql=S.with_(*shift_resid_ctes()) + """
select entity, m, 'static' as model, round(e, 6) as resid from res
union all select entity, m, 'shift', round(e_shift, 6) from shr""")
def q_residual_compare(spark, sf_dir):
    """DG12: residuals of the static and the intercept-shift model side by side, long form."""
    p = views.panel(spark, sf_dir, materialize=True)
    f, fu, xs = shift_model(p)
    base = O.residuals(p, O.ols(p, "y", XS, K), "y", XS, K).select("entity", "m", F.col("resid").alias("static"))
    shift = O.residuals(f, fu, "y", xs, K).select("entity", "m", F.col("resid").alias("shift"))
    wide = base.join(shift, on=["entity", "m"])
    return rounded(long_values(wide, ["static", "shift"], ["entity", "m"], "model", "resid"))


_QQ_SQL = S.with_(*_RES, """rk as (select entity, e, row_number() over (partition by entity order by e) as i,
  count(*) over (partition by entity) as n from res)""",
                  """pr as (select *, (i - (case when n <= 10 then 0.375 else 0.5 end)::double)
  / (n + 1 - 2 * (case when n <= 10 then 0.375 else 0.5 end)::double) as p from rk)""", *S.norm_ppf_ctes("qz", "pr", "p")) + """
select entity, i, round(e, 6) as sample, round(z, 6) as theoretical from qz"""


@register("qq_pairs", sql=_QQ_SQL)
def q_qq_pairs(spark, sf_dir):
    """AG13: normal Q–Q pairs of the static residuals (exact ranks, Arrow inverse normal)."""
    _, _, res = _static(spark, sf_dir)
    return rounded(DG.qq_pairs(res, K))


@register("qq_line", sql=S.with_(*_RES, """q as (select entity, quantile_cont(e, 0.25) as lo, quantile_cont(e, 0.75) as hi
  from res group by entity)""") + """
select entity, round((hi - lo) / (2 * 0.6744897501960817), 6) as slope, round((hi + lo) / 2, 6) as intercept from q""")
def q_qq_line(spark, sf_dir):
    """AG13: line through the quartiles of the static residuals and of the normal."""
    _, _, res = _static(spark, sf_dir)
    return rounded(DG.qq_line(res, K))


def _shapiro_sql() -> str:
    def poly(c, x):
        return " + ".join(f"({v!r} * power({x}, {i}))" for i, v in enumerate(c))

    small = (f"(-ln({poly(DG.SW_SMALL_GAMMA, 'n')} - ln(1 - w)) - ({poly(DG.SW_SMALL_MEAN, 'n')})) / exp({poly(DG.SW_SMALL_LOG_SD, 'n')})")
    large = f"(ln(1 - w) - ({poly(DG.SW_MEAN, 'ln(n)')})) / exp({poly(DG.SW_LOG_SD, 'ln(n)')})"
    return S.with_(*shift_resid_ctes(), """rk as (select entity, e_shift as e, row_number() over (partition by entity order by e_shift) as i,
  count(*) over (partition by entity) as n from shr)""", "pr as (select *, (i - 0.375::double) / (n + 0.25::double) as p from rk)",
                   *S.norm_ppf_ctes("sz", "pr", "p"), """mm as (
  select *, sum(z * z) over g as mm, max(z) over g as m1, max(case when i = n - 1 then z end) over g as m2
  from sz window g as (partition by entity))""", f"""ab as (select *,
  case when n = 3 then sqrt(0.5) else {poly(DG.SW_OUTER, '(1 / sqrt(n))')} + m1 / sqrt(mm) end as a1,
  {poly(DG.SW_SECOND, '(1 / sqrt(n))')} + m2 / sqrt(mm) as a2 from mm)""", """wt as (select entity, n, e, case
  when i = n then a1 when i = 1 then -a1 when n = 3 then 0
  when n > 5 and i = n - 1 then a2 when n > 5 and i = 2 then -a2
  when n <= 5 then z / sqrt((mm - 2 * m1 * m1) / (1 - 2 * a1 * a1))
  else z / sqrt((mm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)) end as a from ab)""", """st as (
  select entity, any_value(n) as n, case when any_value(n) between 3 and 5000 and max(e) > min(e)
    then least(power(sum(a * e), 2) / (var_pop(e) * count(*)), 1) end as w from wt group by entity)""",
                   f"sp as (select *, case when n <= 11 then {small} else {large} end as z from st)") + f"""
select entity, n, round(w, 6) as statistic, round(case when n = 3 then greatest(6 / pi() * (asin(sqrt(w)) - asin(sqrt(0.75))), 0)
  else 1 - {S.norm_cdf('least(greatest(z, -40), 40)')} end, 6) as p_value from sp"""


@register("shapiro_wilk", sql=_shapiro_sql())
def q_shapiro_wilk(spark, sf_dir):
    """DG7, small samples: Shapiro–Wilk W and p of the shift model's residuals."""
    f, fu, xs = shift_model(views.panel(spark, sf_dir, materialize=True))
    return rounded(DG.shapiro_wilk(O.residuals(f, fu, "y", xs, K), "resid", K))


# ------------------------------------------------- the dynamic, differenced and shift models
_DIFFS = LIT.LAG_ORDERS
MODELS = {"lag1": ("y", [*XS, "y_l1"]),
          **{f"diff{k}": ("d_y", [*XS, *[f"d_y_l{i}" for i in range(1, k + 1)]]) for k in _DIFFS},
          "shift": ("y", [*XS, *[w[0] for w in LIT.WINDOWS]])}


def _model_diag_sql() -> str:
    w = "over (partition by entity order by m)"
    flags = ", ".join(f"case when m >= {LIT.month_number(a)} and m <= {LIT.month_number(b)} then 1.0 else 0.0 end as {l}"
                      for l, a, b in LIT.WINDOWS)
    dl = ", ".join(f"lag(y, {k}) {w} - lag(y, {k + 1}) {w} as d_y_l{k}" for k in _DIFFS)
    ctes = [S.PANEL, f"mf as (select entity, m, y, x1, x2, lag(y) {w} as y_l1, y - lag(y) {w} as d_y, {dl}, {flags} from panel)"]
    parts, res = [], []
    for name, (y, xs) in MODELS.items():
        k, cols = len(xs), ", ".join(xs)
        ctes += S.mgs_ctes(name, "mf", y, xs, carry=("m", *xs))
        ctes.append(f"res_{name} as materialized (select entity, m, {cols}, ry as e, ry * ry as e2 from {name}_{k})")
        res.append(f"select entity, '{name}' as model, m, e from res_{name}")

        ctes += S.mgs_ctes(f"bp_{name}", f"res_{name}", "e2", xs)
        ctes.append(f"bpu_{name} as (select entity, {S.used(k)} as u from bp_{name}_0 group by entity)")
        lm = "(n * (1 - rss / tss))"
        p = "case u " + " ".join(f"when {i} then {S.chi2_p(lm, i)}" for i in range(1, k + 1)) + " end"
        parts.append(f"select entity, '{name}' as model, 'breusch_pagan' as test, {lm} as st, u as df, {p} as p "
                     f"from bp_{name} join bpu_{name} using (entity)")

        lags = ", ".join(f"coalesce(lag(e, {l}) {w}, 0) as el{l}" for l in range(1, 7))
        ctes.append(f"bgi_{name} as (select *, {lags} from res_{name})")
        ctes += S.mgs_ctes(f"bg_{name}", f"bgi_{name}", "e", [*xs, *[f"el{l}" for l in range(1, 7)]])
        parts.append(f"select entity, '{name}', 'breusch_godfrey_6', {lm}, 6, {S.chi2_p(lm, 6)} from bg_{name}")

        ctes += S.dw_ctes(f"dw_{name}", name, k)
        parts.append(f"select entity, '{name}', 'durbin_watson', st, null, {S.norm_cdf('greatest(least(z, 40), -40)')} from dw_{name}")

        ctes.append(f"""gqi_{name} as (select *, case when row_number() over (partition by entity order by x1, m)
  <= floor(count(*) over (partition by entity) * 0.5::double) then 1 else 2 end as segment
  from mf where {y} is not null and {' and '.join(f'{x} is not null' for x in xs)})""")
        ctes += S.mgs_ctes(f"gq_{name}", f"gqi_{name}", y, xs, keys="entity, segment")
        ctes.append(f"""gqs_{name} as (select entity, max(case when segment = 2 then s end) / max(case when segment = 1 then s end) as st,
  max(case when segment = 1 then df end) as df1, max(case when segment = 2 then df end) as df2 from (
  select entity, segment, df, rss / df as s from gq_{name} join (
    select entity, segment, count(*) - 1 - ({S.used(k)}) as df from gq_{name}_0 group by entity, segment) using (entity, segment))
  group by entity)""")
        parts.append(f"select entity, '{name}', 'goldfeld_quandt', st, df2, {S.f_p('st', 'df2', 'df1')} from gqs_{name}")
    prods = ", ".join(f"sum(c * lag{l}) as s{l}" for l in range(1, 13))
    q = " + ".join(f"power(s{l} / d, 2) / (n - {l})" for l in range(1, 13))
    ctes += ["allres as (" + " union all ".join(res) + ")",
             "cen as (select *, e - avg(e) over (partition by entity, model) as c from allres)",
             "lagged as (select *, " + ", ".join(f"lag(c, {l}) over (partition by entity, model order by m) as lag{l}"
                                                 for l in range(1, 13)) + " from cen)",
             f"lbs as (select entity, model, count(*) as n, sum(c * c) as d, {prods} from lagged group by entity, model)",
             f"lb as (select entity, model, n * (n + 2) * ({q}) as st from lbs)",
             "mo as (select entity, model, count(*) as n, avg(c * c) as m2, avg(c * c * c) as m3, avg(c * c * c * c) as m4 "
             "from cen group by entity, model)",
             "jb as (select entity, model, n / 6 * (power(m3 / power(m2, 1.5), 2) + power(m4 / (m2 * m2) - 3, 2) / 4) as st from mo)"]
    parts.append(f"select entity, model, 'ljung_box_12', st, 12, {S.chi2_p('st', 12)} from lb")
    parts.append("select entity, model, 'jarque_bera', st, 2, exp(-st / 2) from jb")
    return S.with_(*ctes) + ("select entity, model, test, round(st, 6) as statistic, cast(df as integer) as df, round(p, 6) as p_value from (\n"
                             + "\nunion all ".join(parts) + ")")


@register("model_diagnostics", sql=_model_diag_sql())
def q_model_diagnostics(spark, sf_dir):
    """DG1, DG3–DG7 of the lag-1 model, the differenced models 1..4 and the shift model: one
    residual frame keyed by model (`ols_lag_diff` names the best differenced one by criterion)."""
    p = views.panel(spark, sf_dir, materialize=True)
    d = WN.diffs(WN.lags(p, "y", K, "m", [1]), "y", K, "m", max(_DIFFS))
    rows = DG.model_rows(J.window_flags(d, LIT.WINDOWS), MODELS, K, "m")
    return rounded(DG.model_diagnostics(rows, K, "m"))


_RES_ROWS = [S.ROWS, *S.ols_ctes("f", "rows", "y", XS), """res as (
  select p.entity, p.x1, p.x2, p.y - (f.b0 + f.b1 * p.x1 + f.b2 * p.x2) as e from rows p join f using (entity))"""]


@register("bp_rows", sql=S.with_(*_RES_ROWS, "e2 as (select entity, x1, x2, e * e as e2 from res)",
                                 *S.ols_ctes("a", "e2", "e2", XS)) + """
select entity, 'breusch_pagan' as test, round(n * (1 - rss / syy), 6) as statistic, 2 as df,
       round(exp(-(n * (1 - rss / syy)) / 2), 6) as p_value
from a""")
def q_bp_rows(spark, sf_dir):
    """DG1 on raw rows (hot groups): Breusch–Pagan of the row-level regression."""
    r = views.rows(spark, sf_dir)
    res = O.residuals(r, O.ols(r, "y", XS, K, materialize=True), "y", XS, K)
    return rounded(DG.breusch_pagan(res, XS, K))


@register("jarque_bera_rows", sql=S.with_(*_RES_ROWS, """c as (select entity, e - avg(e) over (partition by entity) as c from res)""",
                                          """mo as (select entity, count(*) as n, avg(c * c) as m2, avg(c * c * c) as m3,
  avg(c * c * c * c) as m4 from c group by entity)""",
                                          "st as (select entity, n, m3 / power(m2, 1.5) as s, m4 / (m2 * m2) as k from mo)") + """
select entity, round(n / 6 * (s * s + (k - 3) * (k - 3) / 4), 6) as statistic, round(s, 6) as skewness,
       round(k, 6) as kurtosis, round(exp(-(n / 6 * (s * s + (k - 3) * (k - 3) / 4)) / 2), 6) as p_value
from st""")
def q_jarque_bera_rows(spark, sf_dir):
    """DG7 on raw rows (hot groups): Jarque–Bera of the row-level residuals."""
    r = views.rows(spark, sf_dir)
    res = O.residuals(r, O.ols(r, "y", XS, K, materialize=True), "y", XS, K)
    return rounded(DG.jarque_bera(res, K))
