"""Registered regression queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import joins as J
from ..operators import models as MD
from ..operators import ols as O
from ..operators import windows as WN
from ..operators.transforms import union_by_name
from ..sources import views
from . import literals as LIT
from . import sql as S
from .q_windows import CUBIC_CTES, CUBIC_EXPR
from .registry import register, rounded

K = ["entity"]
XS = ["x1", "x2"]
_W = "(partition by entity order by m)"


def _wide_select(k: int, name: str = "f", keys: str = "entity") -> str:
    b = ", ".join(f"round(b{i}, 6) as b{i}" for i in range(k + 1))
    se = ", ".join(f"round(se{i}, 6) as se{i}" for i in range(k + 1))
    return (f"select {keys}, n, {b}, {se}, round(1 - rss / syy, 6) as r2, "
            f"round(1 - (rss / syy) * (n - 1) / (n - {k + 1}), 6) as adj_r2, round(sqrt(rss / (n - {k + 1})), 6) as sigma, "
            f"round(rss, 6) as rss, round(((syy - rss) / {k}) / (rss / (n - {k + 1})), 6) as f_stat from {name}")


def ols_wide(fit, keys=("entity",), k: int = 2):
    """Flatten coefficients/SEs of a k-regressor fit into b0..bk, se0..sek."""
    return fit.select(
        *keys, "n",
        *[F.col("beta")[i].alias(f"b{i}") for i in range(k + 1)],
        *[F.col("se")[i].alias(f"se{i}") for i in range(k + 1)],
        "r2", "adj_r2", "sigma", "rss", "f_stat",
    )


@register("ols_static", sql=S.with_(S.PANEL, *S.ols_ctes("f", "panel", "y", XS)) + _wide_select(2))
def q_ols_static(spark, sf_dir):
    """RG1: static OLS y ~ x1 + x2 per entity from one aggregate + batched solve."""
    fit = O.ols(views.panel(spark, sf_dir, materialize=True), "y", XS, K)
    return rounded(ols_wide(fit))


@register("ols_rows", sql=S.with_(S.ROWS, *S.ols_ctes("f", "rows", "y", XS))
          + "select * exclude (rss) from (" + _wide_select(2) + ")")
def q_ols_rows(spark, sf_dir):
    """RG1 on raw rows: price ~ quantity + discount per return flag over all of
    lineitem. Few, hot groups: the partial aggregate reduces them map-side.
    (RSS is ~1e13 here; ``sigma`` carries it at a magnitude a 6-decimal check can compare.)"""
    fit = O.ols(views.rows(spark, sf_dir), "y", XS, K)
    return rounded(ols_wide(fit).drop("rss"))


_COEF_SQL = S.with_(S.PANEL, *S.ols_ctes("f", "panel", "y", XS)) + """
select entity, '(Intercept)' as term, round(b0, 6) as estimate, round(se0, 6) as se, round(b0 / se0, 6) as t_stat from f
union all select entity, 'x1', round(b1, 6), round(se1, 6), round(b1 / se1, 6) from f
union all select entity, 'x2', round(b2, 6), round(se2, 6), round(b2 / se2, 6) from f"""


@register("ols_coef", sql=S.add_t_p(_COEF_SQL, "n - 3"))
def q_ols_coef(spark, sf_dir):
    """RG4: coefficient table (estimate, se, t, p)."""
    fit = O.ols(views.panel(spark, sf_dir, materialize=True), "y", XS, K)
    return rounded(O.coef_table(fit, XS, K).select("entity", "term", "estimate", "se", "t_stat", "p_value"))


@register("ols_fit", sql=S.with_(S.PANEL, *S.ols_ctes("f", "panel", "y", XS)) + """
select entity, n, cast(3 as integer) as k, cast(n - 3 as bigint) as df_resid, round(rss, 6) as rss,
       round(1 - rss / syy, 6) as r2, round(1 - (rss / syy) * (n - 1) / (n - 3), 6) as adj_r2,
       round(sqrt(rss / (n - 3)), 6) as sigma, round(((syy - rss) / 2) / (rss / (n - 3)), 6) as f_stat,
       cast(2 as integer) as df_model,
       round(""" + S.f_p("((syy - rss) / 2) / (rss / (n - 3))", "2", "n - 3") + """, 6) as p_f
from f""")
def q_ols_fit(spark, sf_dir):
    """RG5: fit table (R², adj. R², F, df, sigma, RSS, p of F)."""
    fit = O.ols(views.panel(spark, sf_dir, materialize=True), "y", XS, K)
    return rounded(O.fit_table(fit, K))


@register("ols_residuals", sql=S.with_(S.PANEL, *S.ols_ctes("f", "panel", "y", XS)) + """
select p.entity, p.m, round(p.y, 6) as y, round(f.b0 + f.b1 * p.x1 + f.b2 * p.x2, 6) as fitted,
       round(p.y - (f.b0 + f.b1 * p.x1 + f.b2 * p.x2), 6) as resid
from panel p join f using (entity)""")
def q_ols_residuals(spark, sf_dir):
    """RG3/DG11: fitted values and residuals joined back to the rows."""
    p = views.panel(spark, sf_dir, materialize=True)
    fit = O.ols(p, "y", XS, K)
    return rounded(O.residuals(p, fit, "y", XS, K).select("entity", "m", "y", "fitted", "resid"))


_PERIOD_SQL = ("case when t < date '1996-01-01' then 'before 1996' "
               "when t >= date '1996-01-01' and t < date '1998-01-01' then '1996-1997' "
               "when t >= date '1998-01-01' and t < date '2000-01-01' then '1998-1999' "
               "when t >= date '2000-01-01' then 'since 2000' end")


@register("ols_by_regime", sql=S.with_(S.PANEL, f"pp as (select *, {_PERIOD_SQL} as regime from panel)",
                                       *S.ols_ctes("f", "pp", "y", XS, keys="entity, regime"))
          + _wide_select(2, keys="entity, regime"))
def q_ols_by_regime(spark, sf_dir):
    """RG21: the model fitted separately per (entity, regime); regime = period label."""
    p = views.panel(spark, sf_dir, materialize=True).withColumn("regime", L.period_label(F.col("t")))
    fit = O.ols(p, "y", XS, ["entity", "regime"])
    return rounded(ols_wide(fit, ("entity", "regime")))


@register("ols_alt_fill", sql=S.with_(*CUBIC_CTES, f"filled as (select entity, m, y, x1, {CUBIC_EXPR} as x2c from c)",
                                      *S.ols_ctes("f", "filled", "y", ["x1", "x2c"])) + _wide_select(2))
def q_ols_alt_fill(spark, sf_dir):
    """RG2: static model on the sparse gap filled by the local cubic (alternative) fill."""
    p = WN.fill_cubic_local(views.panel_sparse(spark, sf_dir, materialize=True), "x2", K, "m", out="x2c")
    fit = O.ols(p, "y", ["x1", "x2c"], K)
    return rounded(ols_wide(fit))


@register("vif", sql=S.with_(S.PANEL, """c as (select entity, 1 / (1 - corr(x1, x2) * corr(x1, x2)) as v from panel group by entity)""") + """
select entity, 'x1' as term, round(v, 6) as vif, case when v >= 10 then 'high' when v >= 5 then 'moderate' else 'low' end as band from c
union all select entity, 'x2', round(v, 6), case when v >= 10 then 'high' when v >= 5 then 'moderate' else 'low' end from c""")
def q_vif(spark, sf_dir):
    """RG20: variance inflation factors from the inverse correlation matrix, bands 5/10."""
    return rounded(MD.vif(views.panel(spark, sf_dir, materialize=True), "y", XS, K))


def _hc1_sql(k: int, src_cte: str = S.PANEL, src: str = "panel") -> str:
    c, det = S._inverse_terms(k)
    p = k + 1

    def M(a, b):
        if a == 0 and b == 0:
            quad = " + ".join(f"m{i} * m{j} * {c[(i, j)]}" for i in range(k) for j in range(k))
            return f"(1.0 / n + ({quad}) / {det})"
        if a == 0 or b == 0:
            j = (b if a == 0 else a) - 1
            return f"(-({' + '.join(f'{c[(j, i)]} * m{i}' for i in range(k))}) / {det})"
        return f"({c[(a - 1, b - 1)]} / {det})"

    xs = ["1"] + [f"x{i + 1}" for i in range(k)]
    meat = {}
    for a in range(p):
        for b in range(a, p):
            meat[(a, b)] = meat[(b, a)] = f"h{a}_{b}"
    hsum = ", ".join(f"sum(e * e * {xs[a]} * {xs[b]}) as h{a}_{b}" for a in range(p) for b in range(a, p))
    ses = []
    for j in range(p):
        terms = " + ".join(f"{M(j, a)} * {meat[(a, b)]} * {M(b, j)}" for a in range(p) for b in range(p))
        ses.append(f"round(sqrt(n / (n - {p}) * ({terms})), 6) as se{j}")
    return S.with_(src_cte, *S.ols_ctes("f", src, "y", XS),
                   f"r as (select p.entity, p.x1, p.x2, p.y - (f.b0 + f.b1 * p.x1 + f.b2 * p.x2) as e from {src} p join f using (entity))",
                   f"mt as (select entity, {hsum} from r group by entity)") + \
        f"select entity, {', '.join(ses)} from f join mt using (entity)"


def _hac_sql(weights: list[float], adjust: bool) -> str:
    """Static-model sandwich with S = w0·Γ0 + Σ_l w_l (Γ_l + Γ_l'), Γ_l(a,b) = Σ_t u_ta u_(t−l)b,
    u = x·e (x with the constant), lags by window ``lag`` over the series."""
    k = 2
    c, det = S._inverse_terms(k)
    p = k + 1

    def M(a, b):
        if a == 0 and b == 0:
            quad = " + ".join(f"m{i} * m{j} * {c[(i, j)]}" for i in range(k) for j in range(k))
            return f"(1.0 / n + ({quad}) / {det})"
        if a == 0 or b == 0:
            j = (b if a == 0 else a) - 1
            return f"(-({' + '.join(f'{c[(j, i)]} * m{i}' for i in range(k))}) / {det})"
        return f"({c[(a - 1, b - 1)]} / {det})"

    L = len(weights) - 1
    u = ["e", "e * x1", "e * x2"]
    lagged = ", ".join(f"lag({u[b]}, {l}) over (partition by entity order by m) as u{b}_l{l}"
                       for l in range(1, L + 1) for b in range(p))
    base = ", ".join(f"{u[a]} as u{a}_l0" for a in range(p))
    sums = []
    for l in range(L + 1):
        for a in range(p):
            for b in range(p):
                sums.append(f"coalesce(sum(u{a}_l0 * u{b}_l{l}), 0) as g{l}_{a}_{b}")
    meat = {}
    for a in range(p):
        for b in range(p):
            terms = [f"{weights[0]!r} * g0_{a}_{b}"] + [f"{weights[l]!r} * (g{l}_{a}_{b} + g{l}_{b}_{a})"
                                                        for l in range(1, L + 1)]
            meat[(a, b)] = "(" + " + ".join(terms) + ")"
    scale = "n / (n - 3.0)" if adjust else "1.0"
    ses = []
    for j in range(p):
        body = " + ".join(f"{M(j, a)} * {meat[(a, b)]} * {M(b, j)}" for a in range(p) for b in range(p))
        ses.append(f"sqrt({scale} * ({body})) as hse{j}")
    return S.with_(S.PANEL, *S.ols_ctes("f", "panel", "y", XS),
                   "r as (select p.entity, p.m, p.x1, p.x2, p.y - (f.b0 + f.b1 * p.x1 + f.b2 * p.x2) as e from panel p join f using (entity))",
                   f"ru as (select entity, m, {base}, {lagged} from r)",
                   f"g as (select entity, {', '.join(sums)} from ru group by entity)",
                   f"hs as (select f.*, {', '.join(ses)} from f join g using (entity))")


def _se_table_sql(weights: list[float], adjust: bool) -> str:
    return _hac_sql(weights, adjust) + """
select entity, '(Intercept)' as term, round(b0, 6) as estimate, round(hse0, 6) as se, n - 3 as df_resid, round(b0 / hse0, 6) as t_stat from hs
union all select entity, 'x1', round(b1, 6), round(hse1, 6), n - 3, round(b1 / hse1, 6) from hs
union all select entity, 'x2', round(b2, 6), round(hse2, 6), n - 3, round(b2 / hse2, 6) from hs"""


def _nw(L: int) -> list[float]:
    return [1.0 - l / (L + 1.0) for l in range(L + 1)]


def _bartlett(bw: float) -> list[float]:
    return [1.0 - l / bw for l in range(int(math.ceil(bw)))]


@register("se_hc1", sql=_hc1_sql(2))
def q_se_hc1(spark, sf_dir):
    """RG13: HC1 sandwich standard errors (Σe²xx' aggregate, n/(n−k))."""
    p = views.panel(spark, sf_dir, materialize=True)
    fit = O.ols(p, "y", XS, K)
    se = MD.robust_se(p, fit, "y", XS, K, "m", "hc1")
    return rounded(se.select("entity", *[F.col("se")[i].alias(f"se{i}") for i in range(3)]))


_LAG1_CTE = f"lg as (select *, lag(y, 1) over {_W} as y_l1 from panel)"


@register("ols_lag_level", sql=S.with_(S.PANEL, _LAG1_CTE, *S.ols_ctes("f", "lg", "y", ["x1", "x2", "y_l1"]))
          + _wide_select(3))
def q_ols_lag_level(spark, sf_dir):
    """RG9: y ~ x1 + x2 + L(y, 1) (window lag; the first row of each series drops)."""
    d = WN.lags(views.panel(spark, sf_dir, materialize=True), "y", K, "m", [1])
    fit = O.ols(d, "y", [*XS, "y_l1"], K)
    return rounded(ols_wide(fit, k=3))


# ------------------------------------------------------- rows-only (numpy-tested)
def lag_level_models(p, keys=K, lags=LIT.LAG_ORDERS):
    """RG8 on RG9: y ~ x1 + x2 + L(y, k), k = 1..4 — one exploded aggregate."""
    d = WN.lags(p, "y", keys, "m", list(lags))
    specs = {f"lag{k}": {"x1": F.col("x1"), "x2": F.col("x2"), "ylag": F.col(f"y_l{k}")} for k in lags}
    st, slots = MD.stacked_specs(d, "y", specs, keys)
    fit = O.ols(st, "_y", slots, [*keys, "model"])
    return MD.model_select(MD.information_criteria(fit, [*keys, "model"]), keys)


def diff_frame(p, k: int, keys=K):
    d = WN.diffs(p, "y", keys, "m", k)
    return d, [*XS, *[f"d_y_l{i}" for i in range(1, k + 1)]]


def lag_diff_models(p, keys=K, lags=LIT.LAG_ORDERS):
    """RG10 + RG8: Δy ~ x1 + x2 + Δy lags 1..k for k = 1..4, one aggregate."""
    d = WN.diffs(p, "y", keys, "m", max(lags))
    specs = {f"diff{k}": {"x1": F.col("x1"), "x2": F.col("x2"),
                          **{f"dl{i}": (F.col(f"d_y_l{i}") if i <= k else None) for i in range(1, max(lags) + 1)}}
             for k in lags}
    st, slots = MD.stacked_specs(d, "d_y", specs, keys)
    fit = O.ols(st, "_y", slots, [*keys, "model"])
    return MD.model_select(MD.information_criteria(fit, [*keys, "model"]), keys)


def _model_select_sql() -> str:
    ctes = [S.PANEL, "lg as (select *, " + ", ".join(f"lag(y, {k}) over {_W} as l{k}" for k in LIT.LAG_ORDERS)
            + " from panel)"]
    for k in LIT.LAG_ORDERS:
        ctes += S.ols_ctes(f"m{k}", "lg", "y", ["x1", "x2", f"l{k}"])
    ctes.append("u as (" + " union all ".join(f"select entity, 'lag{k}' as model, n, rss from m{k}"
                                                for k in LIT.LAG_ORDERS) + ")")
    ctes.append(f"ic as (select *, (-n / 2.0) * ({MD.LOG_2PI!r} + ln(rss / n) + 1) as ll from u)")
    ctes.append("ic2 as (select *, -2 * ll + 2 * (4 + 1) as aic, -2 * ll + ln(n) * (4 + 1) as bic from ic)")
    ctes.append("""b as (select entity, min(aic) as amin, min(bic) as bmin,
  max(case when ra = 1 then model end) as best_aic, max(case when rb = 1 then model end) as best_bic
  from (select *, row_number() over (partition by entity order by aic, model) as ra,
               row_number() over (partition by entity order by bic, model) as rb from ic2) group by entity)""")
    return S.with_(*ctes) + """
select entity, model, n, cast(4 as integer) as k, round(rss, 6) as rss, round(ll, 6) as loglik, round(aic, 6) as aic,
       round(bic, 6) as bic, round(aic - amin, 6) as d_aic, round(bic - bmin, 6) as d_bic, best_aic, best_bic
from ic2 join b using (entity)"""


@register("model_select", sql=_model_select_sql())
def q_model_select(spark, sf_dir):
    """RG8/PR16/SO4: AIC/BIC of the lag-1..4 level models, deltas, best per criterion."""
    return rounded(lag_level_models(views.panel(spark, sf_dir, materialize=True)))


def _lag_diff_sql() -> str:
    lags = LIT.LAG_ORDERS
    dl = ", ".join(f"lag(y, {k}) over {_W} - lag(y, {k + 1}) over {_W} as dl{k}" for k in lags)
    ctes = [S.PANEL, f"dd as (select entity, x1, x2, y - lag(y, 1) over {_W} as d_y, {dl} from panel)"]
    for k in lags:
        ctes += S.mgs_ctes(f"d{k}", "dd", "d_y", ["x1", "x2", *[f"dl{i}" for i in range(1, k + 1)]])
    ctes.append("u as (" + " union all ".join(f"select entity, 'diff{k}' as model, n, {k + 3} as kk, rss from d{k}"
                                                for k in lags) + ")")
    ctes.append(f"ic as (select *, (-n / 2.0) * ({MD.LOG_2PI!r} + ln(rss / n) + 1) as ll from u)")
    ctes.append("ic2 as (select *, -2 * ll + 2 * (kk + 1) as aic, -2 * ll + ln(n) * (kk + 1) as bic from ic)")
    ctes.append("""b as (select entity, min(aic) as amin, min(bic) as bmin,
  max(case when ra = 1 then model end) as best_aic, max(case when rb = 1 then model end) as best_bic
  from (select *, row_number() over (partition by entity order by aic, model) as ra,
               row_number() over (partition by entity order by bic, model) as rb from ic2) group by entity)""")
    return S.with_(*ctes) + """
select entity, model, n, cast(kk as integer) as k, round(rss, 6) as rss, round(ll, 6) as loglik, round(aic, 6) as aic,
       round(bic, 6) as bic, round(aic - amin, 6) as d_aic, round(bic - bmin, 6) as d_bic, best_aic, best_bic
from ic2 join b using (entity)"""


@register("ols_lag_diff", sql=_lag_diff_sql())
def q_ols_lag_diff(spark, sf_dir):
    """RG10: differenced lag models 1..4 with information criteria and the best one."""
    return rounded(lag_diff_models(views.panel(spark, sf_dir, materialize=True)))


def shift_model(p, keys=K):
    """RG6: y ~ x1 + x2 + window indicators (constant indicators drop per group)."""
    f = J.window_flags(p, LIT.WINDOWS)
    labels = [w[0] for w in LIT.WINDOWS]
    return f, O.ols(f, "y", [*XS, *labels], keys), [*XS, *labels]


def _shift_coef_sql() -> str:
    labels = [w[0] for w in LIT.WINDOWS]
    flags = ", ".join(f"case when m >= {LIT.month_number(a)} and m <= {LIT.month_number(b)} then 1.0 else 0.0 end as {l}"
                      for l, a, b in LIT.WINDOWS)
    terms = [*XS, *labels]
    ctes = [S.PANEL, f"f as (select entity, y, x1, x2, 1.0 as one, {flags} from panel)"]
    parts = []
    for i, t in enumerate(terms):  # each slope: its own chain with that regressor last
        ctes += S.mgs_ctes(f"c{i}", "f", "y", [x for x in terms if x != t] + [t])
        parts.append(f"select entity, '{t}' as term, round(b_last, 6) as estimate, round(se_last, 6) as se, "
                     f"round(b_last / se_last, 6) as t_stat from c{i}")
    ctes += S.mgs_ctes("c_int", "f", "y", [*terms, "one"], center=False)
    parts.insert(0, "select entity, '(Intercept)' as term, round(b_last, 6) as estimate, round(se_last, 6) as se, "
                    "round(b_last / se_last, 6) as t_stat from c_int")
    return S.with_(*ctes) + "\nunion all ".join(parts)


@register("ols_shifts", sql=S.add_t_p(_shift_coef_sql(), f"n - {3 + len(LIT.WINDOWS)}"))
def q_ols_shifts(spark, sf_dir):
    """RG6: intercept-shift model with the four window indicators (coefficient
    table; constant indicators drop per group)."""
    f, fit, xs = shift_model(views.panel(spark, sf_dir, materialize=True))
    return rounded(O.coef_table(fit, xs, K).select("entity", "term", "estimate", "se", "t_stat", "p_value"))


def _joint_f_sql() -> str:
    labels = [w[0] for w in LIT.WINDOWS]
    flags = ", ".join(f"case when m >= {LIT.month_number(a)} and m <= {LIT.month_number(b)} then 1.0 else 0.0 end as {l}"
                      for l, a, b in LIT.WINDOWS)
    return S.with_(S.PANEL, f"f as (select entity, y, x1, x2, {flags} from panel)",
                   *S.mgs_ctes("u", "f", "y", [*XS, *labels]),
                   *S.mgs_ctes("r", "f", "y", XS)) + f"""
select entity, cast({len(labels)} as integer) as q, u.n - {len(labels) + 3} as df_u,
       round(((r.rss - u.rss) / {len(labels)}) / (u.rss / (u.n - {len(labels) + 3})), 6) as f_stat,
       round((1 - u.rss / u.tss) - (1 - r.rss / r.tss), 6) as d_r2,
       round({S.f_p(f"((r.rss - u.rss) / {len(labels)}) / (u.rss / (u.n - {len(labels) + 3}))", str(len(labels)), f"u.n - {len(labels) + 3}")}, 6) as p_value
from u join r using (entity)"""


@register("joint_f", sql=_joint_f_sql())
def q_joint_f(spark, sf_dir):
    """RG7: joint F test that all window-indicator coefficients are zero; ΔR², p."""
    p = views.panel(spark, sf_dir, materialize=True)
    f, fu, _ = shift_model(p)
    fr = O.ols(f, "y", XS, K)
    return rounded(MD.joint_f(fu, fr, K))


def _alt_p(t: str, alternative: str) -> str:
    two = S.t_p(t, "n - 3")
    if alternative != "greater":
        return two
    return f"(case when {t} >= 0 then {two} / 2 else 1 - {two} / 2 end)"


def _benchmark_sql() -> str:
    idx = {"(Intercept)": 0, "x1": 1, "x2": 2}
    rows = [f"select entity, '{t}' as term, cast({b0!r} as double) as b0, '{alt}' as alternative, round(b{idx[t]}, 6) as estimate, "
            f"round(se{idx[t]}, 6) as se, n - 3 as df_resid, round((b{idx[t]} - {b0!r}) / se{idx[t]}, 6) as t_stat, "
            f"round({_alt_p(f'((b{idx[t]} - {b0!r}) / se{idx[t]})', alt)}, 6) as p_value from f"
            for t, b0, alt in LIT.BENCHMARKS]
    return S.with_(S.PANEL, *S.ols_ctes("f", "panel", "y", XS)) + "\nunion all ".join(rows)


@register("coef_vs_benchmark", sql=_benchmark_sql())
def q_coef_vs_benchmark(spark, sf_dir):
    """RG12: t tests of the static coefficients against fixed values (two-sided /
    greater)."""
    fit = O.ols(views.panel(spark, sf_dir, materialize=True), "y", XS, K)
    return rounded(MD.coef_vs_benchmark(O.coef_table(fit, XS, K), LIT.BENCHMARKS, K))


def _coef_compare_sql() -> str:
    rows = []
    for model, se in (("ols", "se"), ("newey_west_12", "hse")):
        for i, x in enumerate(XS, start=1):
            lab = L.VARIABLE_LABELS.get(x, x)
            rows.append(f"select entity, '{model}' as model, '{x}' as term, '{lab}' as label, round(b{i}, 6) as estimate, "
                        f"round({se}{i}, 6) as se, round(b{i} - 1.96 * {se}{i}, 6) as lower, "
                        f"round(b{i} + 1.96 * {se}{i}, 6) as upper from hs")
    return _hac_sql(_nw(12), True) + "\nunion all ".join(rows)


@register("coef_compare", sql=_coef_compare_sql())
def q_coef_compare(spark, sf_dir):
    """RG11: static model with classical SE vs. Newey–West(12) SE, ±1.96·se, no intercept."""
    p = views.panel(spark, sf_dir, materialize=True)
    fit = O.ols(p, "y", XS, K)
    a = O.coef_table(fit, XS, K).withColumn("model", F.lit("ols"))
    nw = MD.robust_se(p, fit, "y", XS, K, "m", "nw", 12, adjust=True)
    b = MD.se_table(nw, fit, XS, K).withColumn("model", F.lit("newey_west_12"))
    return rounded(MD.coef_compare(a, b, L.VARIABLE_LABELS, K))


@register("rank_check")
def q_rank_check(spark, sf_dir):
    """RG19: rank, condition number and aliased terms of the shift-model design."""
    f = J.window_flags(views.panel(spark, sf_dir, materialize=True), LIT.WINDOWS)
    return MD.rank_check(f, "y", [*XS, *[w[0] for w in LIT.WINDOWS]], K)


def _union_models_sql() -> str:
    fit_cols = ("n, cast({p} as integer) as k, cast(n - {p} as bigint) as df_resid, round(rss, 6) as rss, "
                "round(1 - rss / syy, 6) as r2, round(1 - (rss / syy) * (n - 1) / (n - {p}), 6) as adj_r2, "
                "round(sqrt(rss / (n - {p})), 6) as sigma, round(((syy - rss) / {q}) / (rss / (n - {p})), 6) as f_stat, "
                "cast({q} as integer) as df_model, round({p_f}, 6) as p_f")

    def p_f(p, q):
        return S.f_p(f"((syy - rss) / {q}) / (rss / (n - {p}))", str(q), f"n - {p}")

    return S.with_(S.PANEL, *S.ols_ctes("a", "panel", "y", XS), _LAG1_CTE,
                   *S.ols_ctes("b", "lg", "y", ["x1", "x2", "y_l1"])) + f"""
select entity, {fit_cols.format(p=3, q=2, p_f=p_f(3, 2))}, 'static' as model, cast(null as integer) as lag_order from a
union all select entity, {fit_cols.format(p=4, q=3, p_f=p_f(4, 3))}, 'lag1' as model, cast(1 as integer) as lag_order from b"""


@register("union_models", sql=_union_models_sql())
def q_union_models(spark, sf_dir):
    """ST1: fit tables of the static and lag-1 models stacked by column name
    (the lag model's extra column is NULL for the static one)."""
    p = views.panel(spark, sf_dir, materialize=True)
    a = O.fit_table(O.ols(p, "y", XS, K), K).withColumn("model", F.lit("static"))
    d = WN.lags(p, "y", K, "m", [1])
    b = O.fit_table(O.ols(d, "y", [*XS, "y_l1"], K), K).withColumn("model", F.lit("lag1")) \
        .withColumn("lag_order", F.lit(1))
    return rounded(union_by_name(a, b))


def _robust(kind, param=0, adjust=True):
    def q(spark, sf_dir):
        p = views.panel(spark, sf_dir, materialize=True)
        fit = O.ols(p, "y", XS, K)
        out = MD.se_table(MD.robust_se(p, fit, "y", XS, K, "m", kind, param, adjust), fit, XS, K)
        return rounded(out)
    q.__doc__ = f"Robust standard errors ({kind}, {param}) with t and p."
    return q


def _inv3_general(m) -> dict:
    """Symbolic inverse of a general 3×3 matrix given entry names m(i, j)."""
    def minor(i, j):
        r = [a for a in range(3) if a != i]
        c = [b for b in range(3) if b != j]
        return f"({m(r[0], c[0])} * {m(r[1], c[1])} - {m(r[0], c[1])} * {m(r[1], c[0])})"
    det = f"({m(0, 0)} * {minor(0, 0)} - {m(0, 1)} * {minor(0, 1)} + {m(0, 2)} * {minor(0, 2)})"
    inv = {}
    for i in range(3):
        for j in range(3):
            sign = "" if (i + j) % 2 == 0 else "-"
            inv[(i, j)] = f"({sign}{minor(j, i)} / {det})"
    return inv


def _prewhite_sql(L: int = 12) -> str:
    """VAR(1)-prewhitened Newey–West sandwich of the static model (oracle)."""
    k, p = 2, 3
    w = _nw(L)
    c2, det2 = S._inverse_terms(k)

    def M(a, b):
        if a == 0 and b == 0:
            quad = " + ".join(f"m{i} * m{j} * {c2[(i, j)]}" for i in range(k) for j in range(k))
            return f"(1.0 / n + ({quad}) / {det2})"
        if a == 0 or b == 0:
            j = (b if a == 0 else a) - 1
            return f"(-({' + '.join(f'{c2[(j, i)]} * m{i}' for i in range(k))}) / {det2})"
        return f"({c2[(a - 1, b - 1)]} / {det2})"

    u = ["e", "e * x1", "e * x2"]
    ru = ("ru as (select entity, m, " + ", ".join(f"{u[a]} as u{a}" for a in range(p)) + ", "
          + ", ".join(f"lag({u[a]}, 1) over (partition by entity order by m) as l{a}" for a in range(p)) + " from r)")
    cl = ("cl as (select entity, " + ", ".join(f"sum(u{a} * l{b}) as c{a}{b}" for a in range(p) for b in range(p)) + ", "
          + ", ".join(f"sum(l{a} * l{b}) as q{a}{b}" for a in range(p) for b in range(p)) + " from ru group by entity)")
    qinv = _inv3_general(lambda i, j: f"q{i}{j}")
    am = ("am as (select entity, " + ", ".join(
        f"({' + '.join(f'c{a}{kk} * {qinv[(kk, b)]}' for kk in range(p))}) as a{a}{b}" for a in range(p) for b in range(p))
        + " from cl)")
    ia = _inv3_general(lambda i, j: f"({'1.0' if i == j else '0.0'} - a{i}{j})")
    dm = "dm as (select *, " + ", ".join(f"{ia[(i, j)]} as d{i}{j}" for i in range(p) for j in range(p)) + " from am)"
    vr = ("vr as (select ru.entity, ru.m, " + ", ".join(
        f"u{a} - ({' + '.join(f'a{a}{b} * l{b}' for b in range(p))}) as v{a}" for a in range(p))
        + " from ru join am using (entity))")
    lagged = ", ".join(f"lag(v{b}, {l}) over (partition by entity order by m) as v{b}_l{l}"
                       for l in range(1, L + 1) for b in range(p))
    vl = f"vl as (select entity, m, v0, v1, v2, v0 as v0_l0, v1 as v1_l0, v2 as v2_l0, {lagged} from vr)"
    gs = ("gv as (select entity, " + ", ".join(f"coalesce(sum(v{a} * v{b}_l{l}), 0) as g{l}_{a}_{b}"
                                                for l in range(L + 1) for a in range(p) for b in range(p))
          + " from vl group by entity)")
    sv = {}
    for a in range(p):
        for b in range(p):
            terms = [f"{w[0]!r} * g0_{a}_{b}"] + [f"{w[l]!r} * (g{l}_{a}_{b} + g{l}_{b}_{a})" for l in range(1, L + 1)]
            sv[(a, b)] = "(" + " + ".join(terms) + ")"
    smat = ("sm as (select gv.entity, " + ", ".join(
        f"({' + '.join(f'd{a}{i} * {sv[(i, j)]} * d{b}{j}' for i in range(p) for j in range(p))}) as s{a}{b}"
        for a in range(p) for b in range(p)) + " from gv join dm using (entity))")
    ses = []
    for j in range(p):
        body = " + ".join(f"{M(j, a)} * s{a}{b} * {M(b, j)}" for a in range(p) for b in range(p))
        ses.append(f"sqrt(n / (n - 3.0) * ({body})) as hse{j}")
    return S.with_(S.PANEL, *S.ols_ctes("f", "panel", "y", XS),
                   "r as (select p.entity, p.m, p.x1, p.x2, p.y - (f.b0 + f.b1 * p.x1 + f.b2 * p.x2) as e from panel p join f using (entity))",
                   ru, cl, am, dm, vr, vl, gs, smat,
                   f"hs as (select f.*, {', '.join(ses)} from f join sm using (entity))") + """
select entity, '(Intercept)' as term, round(b0, 6) as estimate, round(hse0, 6) as se, n - 3 as df_resid, round(b0 / hse0, 6) as t_stat from hs
union all select entity, 'x1', round(b1, 6), round(hse1, 6), n - 3, round(b1 / hse1, 6) from hs
union all select entity, 'x2', round(b2, 6), round(hse2, 6), n - 3, round(b2 / hse2, 6) from hs"""


register("se_newey_west", sql=S.add_t_p(_se_table_sql(_nw(12), True), "n - 3"))(_robust("nw", 12, True))
register("se_newey_west6", sql=S.add_t_p(_se_table_sql(_nw(6), False), "n - 3"))(_robust("nw", 6, False))
register("se_kernel_bartlett", sql=S.add_t_p(_se_table_sql(_bartlett(12), True), "n - 3"))(_robust("bartlett", 12, True))
register("se_nw_prewhite", sql=S.add_t_p(_prewhite_sql(12), "n - 3"))(_robust("nw_prewhite", 12, True))


def _series_robust(kind):
    def q(spark, sf_dir):
        p = views.panel(spark, sf_dir, materialize=True)
        fit = O.ols(p, "y", XS, K)
        se = MD.series_robust_se(p, fit, "y", XS, K, "m", kind)
        return MD.se_table(se.drop("bandwidth"), fit, XS, K).join(se.select(*K, "bandwidth"), K)
    return q


def _nw_auto_sql() -> str:
    """Newey–West with the automatic (1994) Bartlett lag, via a position self-join (oracle)."""
    k, p = 2, 3
    c2, det2 = S._inverse_terms(k)

    def M(a, b):
        if a == 0 and b == 0:
            quad = " + ".join(f"m{i} * m{j} * {c2[(i, j)]}" for i in range(k) for j in range(k))
            return f"(1.0 / n + ({quad}) / {det2})"
        if a == 0 or b == 0:
            j = (b if a == 0 else a) - 1
            return f"(-({' + '.join(f'{c2[(j, i)]} * m{i}' for i in range(k))}) / {det2})"
        return f"({c2[(a - 1, b - 1)]} / {det2})"

    u = ["e", "e * x1", "e * x2"]
    ru = ("ru as (select entity, row_number() over (partition by entity order by m) as pos, "
          + ", ".join(f"{u[a]} as u{a}" for a in range(p)) + ", e * x1 + e * x2 as uw, "
          "count(*) over (partition by entity) as nn from r)")
    nl = "nl as (select entity, any_value(nn) as nn, cast(floor(4 * pow(any_value(nn) / 100.0, 2.0 / 9)) as integer) as nlag from ru group by entity)"
    sg = """sg as (select a.entity, a.pos - b.pos as j, sum(a.uw * b.uw) / any_value(nl.nn) as sig
  from ru a join ru b on a.entity = b.entity and b.pos <= a.pos join nl on nl.entity = a.entity
  where a.pos - b.pos <= nl.nlag group by a.entity, a.pos - b.pos)"""
    bw = """bw as (select sg.entity, any_value(nl.nn) as nn,
  sum(case when j = 0 then sig else 2 * sig end) as s0, sum(2 * j * sig) as s1
  from sg join nl using (entity) group by sg.entity)"""
    lg = "lg as (select entity, 1.1447 * pow(pow(s1 / s0, 2), 1.0 / 3) * pow(nn, 1.0 / 3) as lag from bw)"
    pairs = []
    for a in range(p):
        for b in range(p):
            pairs.append(f"sum(case when x.pos = y.pos then x.u{a} * y.u{b} else (1 - (x.pos - y.pos) / (lg.lag + 1)) "
                         f"* (x.u{a} * y.u{b} + x.u{b} * y.u{a}) end) as s{a}{b}")
    sm = ("sm as (select x.entity, " + ", ".join(pairs) + " from ru x join ru y on x.entity = y.entity and y.pos <= x.pos "
          "join lg on lg.entity = x.entity where x.pos - y.pos < lg.lag + 1 group by x.entity)")
    ses = []
    for j in range(p):
        body = " + ".join(f"{M(j, a)} * s{a}{b} * {M(b, j)}" for a in range(p) for b in range(p))
        ses.append(f"sqrt(n / (n - 3.0) * ({body})) as hse{j}")
    return S.with_(S.PANEL, *S.ols_ctes("f", "panel", "y", XS),
                   "r as (select p.entity, p.m, p.x1, p.x2, p.y - (f.b0 + f.b1 * p.x1 + f.b2 * p.x2) as e from panel p join f using (entity))",
                   ru, nl, sg, bw, lg, sm,
                   f"hs as (select f.*, lg.lag as bandwidth, {', '.join(ses)} from f join sm using (entity) join lg using (entity))") + """
select entity, '(Intercept)' as term, round(b0, 6) as estimate, round(hse0, 6) as se, n - 3 as df_resid, round(b0 / hse0, 6) as t_stat, round(bandwidth, 6) as bandwidth from hs
union all select entity, 'x1', round(b1, 6), round(hse1, 6), n - 3, round(b1 / hse1, 6), round(bandwidth, 6) from hs
union all select entity, 'x2', round(b2, 6), round(hse2, 6), n - 3, round(b2 / hse2, 6), round(bandwidth, 6) from hs"""


def _nw_auto_query(spark, sf_dir):
    """RG16: Newey–West with the automatic Bartlett lag, per series."""
    p = views.panel(spark, sf_dir, materialize=True)
    fit = O.ols(p, "y", XS, K)
    se = MD.series_robust_se(p, fit, "y", XS, K, "m", "nw_auto")
    out = MD.se_table(se.drop("bandwidth"), fit, XS, K).join(se.select(*K, "bandwidth"), K)
    return rounded(out)


def _qs_sql() -> str:
    """Quadratic-spectral HAC with Andrews' AR(1) bandwidth (scores of x1, x2),
    all lags up to the last weight above 1e-7, via a position self-join (oracle)."""
    k, p = 2, 3
    c2, det2 = S._inverse_terms(k)

    def M(a, b):
        if a == 0 and b == 0:
            quad = " + ".join(f"m{i} * m{j} * {c2[(i, j)]}" for i in range(k) for j in range(k))
            return f"(1.0 / n + ({quad}) / {det2})"
        if a == 0 or b == 0:
            j = (b if a == 0 else a) - 1
            return f"(-({' + '.join(f'{c2[(j, i)]} * m{i}' for i in range(k))}) / {det2})"
        return f"({c2[(a - 1, b - 1)]} / {det2})"

    u = ["e", "e * x1", "e * x2"]
    ru = ("ru as (select entity, row_number() over (partition by entity order by m) as pos, "
          + ", ".join(f"{u[a]} as u{a}" for a in range(p)) + ", count(*) over (partition by entity) as nn, "
          + ", ".join(f"lag({u[a]}, 1) over (partition by entity order by m) as l{a}" for a in (1, 2)) + " from r)")
    rho = ("rh as (select entity, any_value(nn) as nn, " + ", ".join(
        f"sum(u{a} * l{a}) / sum(l{a} * l{a}) as rho{a}" for a in (1, 2)) + " from ru group by entity)")
    sg = ("sg as (select ru.entity, any_value(rh.nn) as nn, " + ", ".join(
        f"any_value(rho{a}) as rho{a}, sum((u{a} - rho{a} * l{a}) * (u{a} - rho{a} * l{a})) / (any_value(rh.nn) - 1) as s{a}"
        for a in (1, 2)) + " from ru join rh using (entity) group by ru.entity)")
    num = " + ".join(f"4 * rho{a} * rho{a} * s{a} * s{a} / pow(1 - rho{a}, 8)" for a in (1, 2))
    den = " + ".join(f"s{a} * s{a} / pow(1 - rho{a}, 4)" for a in (1, 2))
    bw = f"bw as (select entity, nn, 1.3221 * pow(({num}) / ({den}) * nn, 0.2) as bw from sg)"
    wl = ("case when l = 0 then 1.0 else 25 / (12 * pi() * pi() * (l / bw) * (l / bw)) * "
          "(sin(6 * pi() * (l / bw) / 5) / (6 * pi() * (l / bw) / 5) - cos(6 * pi() * (l / bw) / 5)) end")
    ww = f"ww as (select bw.entity, r.range as l, {wl} as w from bw, range(0, 100000) r where r.range < bw.nn)"
    cut = "cut as (select entity, max(l) as lcut from ww where abs(w) > 1e-7 group by entity)"
    pairs = []
    for a in range(p):
        for b in range(p):
            pairs.append(f"sum(case when x.pos = y.pos then x.u{a} * y.u{b} else ww.w * (x.u{a} * y.u{b} + x.u{b} * y.u{a}) end) as s{a}{b}")
    sm = ("sm as (select x.entity, " + ", ".join(pairs) + " from ru x join ru y on x.entity = y.entity and y.pos <= x.pos "
          "join cut on cut.entity = x.entity join ww on ww.entity = x.entity and ww.l = x.pos - y.pos "
          "where x.pos - y.pos <= cut.lcut group by x.entity)")
    ses = []
    for j in range(p):
        body = " + ".join(f"{M(j, a)} * s{a}{b} * {M(b, j)}" for a in range(p) for b in range(p))
        ses.append(f"sqrt(n / (n - 3.0) * ({body})) as hse{j}")
    return S.with_(S.PANEL, *S.ols_ctes("f", "panel", "y", XS),
                   "r as (select p.entity, p.m, p.x1, p.x2, p.y - (f.b0 + f.b1 * p.x1 + f.b2 * p.x2) as e from panel p join f using (entity))",
                   ru, rho, sg, bw, ww, cut, sm,
                   f"hs as (select f.*, bw.bw as bandwidth, {', '.join(ses)} from f join sm using (entity) join bw using (entity))") + """
select entity, '(Intercept)' as term, round(b0, 6) as estimate, round(hse0, 6) as se, n - 3 as df_resid, round(b0 / hse0, 6) as t_stat, round(bandwidth, 6) as bandwidth from hs
union all select entity, 'x1', round(b1, 6), round(hse1, 6), n - 3, round(b1 / hse1, 6), round(bandwidth, 6) from hs
union all select entity, 'x2', round(b2, 6), round(hse2, 6), n - 3, round(b2 / hse2, 6), round(bandwidth, 6) from hs"""


def _qs_query(spark, sf_dir):
    """RG17: quadratic-spectral HAC with Andrews' bandwidth, per series."""
    p = views.panel(spark, sf_dir, materialize=True)
    fit = O.ols(p, "y", XS, K)
    se = MD.series_robust_se(p, fit, "y", XS, K, "m", "qs_andrews")
    out = MD.se_table(se.drop("bandwidth"), fit, XS, K).join(se.select(*K, "bandwidth"), K)
    return rounded(out)


register("se_hac_qs", sql=S.add_t_p(_qs_sql(), "n - 3"))(_qs_query)
register("se_nw_auto", sql=S.add_t_p(_nw_auto_sql(), "n - 3"))(_nw_auto_query)


def _effect_sql() -> str:
    lab = "case term " + " ".join(f"when '{k}' then '{v}'" for k, v in L.VARIABLE_LABELS.items()) + " else term end"
    sig = "case when p <= 0.05 then 'significant' else 'not significant' end"
    rows = " union all ".join(f"select entity, '{t}' as term, b{i} as estimate, {S.t_p(f'(b{i} / se{i})', 'n - 3')} as p from f"
                              for i, t in enumerate(["(Intercept)", *XS]))
    return S.with_(S.PANEL, *S.ols_ctes("f", "panel", "y", XS), f"c as ({rows})") + f"""
select entity, term, {lab} as label, round(estimate, 6) as estimate, round(p, 6) as p_value, {sig} as significance,
       (case when estimate > 0 then 'positive' when estimate < 0 then 'negative' else 'zero' end) || ' and ' || {sig} as effect
from c"""


@register("effect_labels", sql=_effect_sql())
def q_effect_labels(spark, sf_dir):
    """PR18: sign and significance wording of every coefficient (p from the t tail)."""
    fit = O.ols(views.panel(spark, sf_dir, materialize=True), "y", XS, K)
    c = O.coef_table(fit, XS, K)
    return rounded(c.select("entity", "term", L.recode(F.col("term")).alias("label"), "estimate", "p_value",
                            L.significance_label(F.col("p_value")).alias("significance"),
                            L.effect_label(F.col("estimate"), F.col("p_value")).alias("effect")))


def _model_table_sql() -> str:
    labels = [w[0] for w in LIT.WINDOWS]
    flags = ", ".join(f"case when m >= {LIT.month_number(a)} and m <= {LIT.month_number(b)} then 1.0 else 0.0 end as {l}"
                      for l, a, b in LIT.WINDOWS)
    lab = ("case term " + " ".join(f"when '{k}' then '{v}'" for k, v in L.VARIABLE_LABELS.items()) + " else term end")
    terms = [*XS, *labels]
    ctes = [S.PANEL, *S.ols_ctes("fs", "panel", "y", XS), _LAG1_CTE, *S.ols_ctes("fl", "lg", "y", ["x1", "x2", "y_l1"]),
            f"f as (select entity, y, x1, x2, 1.0 as one, {flags} from panel)"]
    parts = []
    for i, t in enumerate(["(Intercept)", *XS]):
        parts.append(f"select entity, 'static' as model, '{t}' as term, b{i} as estimate, se{i} as se, n - 3 as df from fs")
    for i, t in enumerate(["(Intercept)", *XS, "y_l1"]):
        parts.append(f"select entity, 'lag1', '{t}', b{i}, se{i}, n - 4 from fl")
    ctes += S.mgs_ctes("ci", "f", "y", [*terms, "one"], center=False)
    parts.append(f"select entity, 'shift', '(Intercept)', b_last, se_last, n - {len(terms) + 1} from ci")
    for i, t in enumerate(terms):
        ctes += S.mgs_ctes(f"c{i}", "f", "y", [x for x in terms if x != t] + [t])
        parts.append(f"select entity, 'shift', '{t}', b_last, se_last, n - {len(terms) + 1} from c{i}")
    ctes.append("u as (" + " union all ".join(parts) + ")")
    return S.with_(*ctes) + f"""
select entity, model, term, {lab} as label, round(estimate, 6) as estimate, round(se, 6) as se,
       round(estimate / se, 6) as t_stat from u"""


@register("model_table", sql=S.add_t_p(_model_table_sql(), "df"))
def q_model_table(spark, sf_dir):
    """SC8: tidy comparison table of the static, lag-1 and shift models (terms × models),
    written as Parquet to the shared scratch folder and read back."""
    from ..sources import csv as C
    p = views.panel(spark, sf_dir, materialize=True)
    d = WN.lags(p, "y", K, "m", [1])
    f, fu, xs_shift = shift_model(p)
    parts = [
        O.coef_table(O.ols(p, "y", XS, K), XS, K).withColumn("model", F.lit("static")),
        O.coef_table(O.ols(d, "y", [*XS, "y_l1"], K), [*XS, "y_l1"], K).withColumn("model", F.lit("lag1")),
        O.coef_table(fu, xs_shift, K).withColumn("model", F.lit("shift")),
    ]
    tidy = union_by_name(*parts).select("entity", "model", "term", L.recode(F.col("term")).alias("label"),
                                        "estimate", "se", "t_stat", "p_value")
    path = C.scratch_path(spark, "model-table")
    tidy.write.mode("overwrite").parquet(path)
    return rounded(spark.read.parquet(path))

@register("se_hc1_rows", sql=_hc1_sql(2, S.ROWS, "rows"))
def q_se_hc1_rows(spark, sf_dir):
    """RG13 on raw rows (all of lineitem, 3 hot groups): HC1 standard errors.
    Fit = one partial aggregate; the residual meat is a second aggregate over the
    rows joined to the (3-row, AQE-broadcast) coefficient table."""
    r = views.rows(spark, sf_dir)
    fit = O.ols(r, "y", XS, K, materialize=True)
    se = MD.robust_se(r, fit, "y", XS, K, "m", "hc1")
    return rounded(se.select("entity", *[F.col("se")[i].alias(f"se{i}") for i in range(3)]))


@register("ols_panel_wide", sql=S.with_(S.PANEL_WIDE, *S.ols_ctes("f", "panel_wide", "y", XS)) + _wide_select(2))
def q_ols_panel_wide(spark, sf_dir):
    """RG1 on the supplier panel: one model per supplier (entity count grows with
    the scale factor) from one aggregate and one batched solve."""
    fit = O.ols(views.panel_wide(spark, sf_dir), "y", XS, K)
    return rounded(ols_wide(fit))


def bp_regimes(p, breaks: int | None = None):
    """SB7: regimes of each entity's Bai–Perron partition: the BIC-best, or that with a
    given number of breaks."""
    from ..operators import breaks as B
    parts = B.bai_perron(p, "y", XS, K, "m", max_breaks=5 if breaks is None else breaks)
    best = (parts if breaks is None else parts.filter(F.col("breaks") == breaks)).groupBy(*K) \
        .agg(F.min_by(F.col("break_pos"), F.struct("bic", "breaks")).alias("_bp"))
    return B.regime_from_break(p, best.select(*K, F.explode("_bp").alias("break_pos")), K, "m")


@register("ols_by_bp_regime", sql=S.with_(*S.bp_regimes(), *S.ols_ctes("f", "reg", "y", XS, keys="entity, regime"))
          + _wide_select(2, keys="entity, regime"))
def q_ols_by_bp_regime(spark, sf_dir):
    """RG21/SB7: regimes from the BIC-best Bai–Perron partition of each entity,
    then the model fitted per (entity, regime)."""
    fit = O.ols(bp_regimes(views.panel(spark, sf_dir, materialize=True)), "y", XS, [*K, "regime"])
    return rounded(ols_wide(fit, (*K, "regime")))
