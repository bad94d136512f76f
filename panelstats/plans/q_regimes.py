"""Registered queries of the regression over regimes (RG21 with RG14, RG16–RG18) and of
tests against fixed values with robust errors (RG12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models as MD
from ..operators import ols as O
from ..operators import windows as WN
from ..sources import views
from . import literals as LIT
from . import sql as S
from .q_models import bp_regimes
from .registry import register, rounded

K = ["entity"]
XS = ["x1", "x2"]
R = "entity, regime"
BREAKS = 2  # the partition whose regimes are modelled: three per entity at every scale


def inverse_cell(k: int):
    """SQL of entry (a, b) of (X'X)⁻¹, intercept first, over the columns of ``ols_ctes``."""
    c, det = S._inverse_terms(k)

    def cell(a: int, b: int) -> str:
        if a == 0 and b == 0:
            return f"(1.0 / f.n + ({' + '.join(f'm{i} * m{j} * {c[(i, j)]}' for i in range(k) for j in range(k))}) / {det})"
        if a == 0 or b == 0:
            return f"(-({' + '.join(f'{c[(max(a, b) - 1, i)]} * m{i}' for i in range(k))}) / {det})"
        return f"({c[(a - 1, b - 1)]} / {det})"
    return cell


def kernel_ctes(src: str, xs: list[str], keys: str, kind: str, param: float = 0) -> list[str]:
    """CTEs up to ``hs``: the fit ``f`` per ``keys`` and robust errors ``hse0..``, from all
    pairs of positions of ``src`` (entity, pos, y, xs) within the same keys, with weights by
    distance. ``nn``, ``kk``: rows and coefficients of the whole model of an entity."""
    k, p = len(xs), len(xs) + 1
    u = ["e", *[f"e * {x}" for x in xs]]
    fitted = " + ".join(["f.b0", *[f"f.b{i + 1} * s.{x}" for i, x in enumerate(xs)]])
    cols = ", ".join(f"s.{c.strip()}" for c in keys.split(","))
    ctes = [*S.ols_ctes("f", src, "y", xs, keys=keys),
            f"r as (select {cols}, s.pos, {', '.join(f's.{x}' for x in xs)}, s.y - ({fitted}) as e from {src} s join f using ({keys}))",
            "ru as (select *, " + ", ".join(f"{v} as u{i}" for i, v in enumerate(u)) + f", {' + '.join(u[1:])} as uw from r)",
            f"tot as (select entity, sum(n) as nn, count(*) * {p} as kk, sum(rss) as rss_all from f group by entity)"]
    if kind in ("nw", "bartlett"):
        ctes.append(f"bw as (select entity, nn, cast({param!r} as double) as bandwidth from tot)")
    elif kind == "nw_auto":
        ctes.append("""sg as (select a.entity, a.pos - b.pos as j, sum(a.uw * b.uw) as s from ru a join ru b on a.entity = b.entity and b.pos <= a.pos
  join tot on tot.entity = a.entity where a.pos - b.pos <= floor(4 * pow(nn / 100.0, 2.0 / 9)) group by all)""")
        ctes.append("""bw as (select entity, nn, 1.1447 * pow(pow(s1 / s0, 2) * nn, 1.0 / 3) as bandwidth
  from (select entity, sum(case when j = 0 then s else 2 * s end) as s0, sum(2 * j * s) as s1 from sg group by entity) join tot using (entity))""")
    else:
        sums = ", ".join(f"sum(case when a.pos > 1 then a.u{i} * a.u{i} end) as uu{i}, coalesce(sum(a.u{i} * b.u{i}), 0) as ul{i}, "
                         f"sum(case when a.pos < nn then a.u{i} * a.u{i} end) as ll{i}" for i in range(1, p))
        pair = " and ".join(f"a.{c.strip()} = b.{c.strip()}" for c in keys.split(","))
        ctes.append(f"ar as (select {', '.join(f'a.{c.strip()}' for c in keys.split(','))}, any_value(nn) as nn, {sums} from ru a "
                    f"left join ru b on {pair} and b.pos = a.pos - 1 join tot on tot.entity = a.entity group by all)")
        rho = {i: f"(ul{i} / ll{i})" for i in range(1, p)}
        s2 = {i: f"pow((uu{i} - 2 * {rho[i]} * ul{i} + {rho[i]} * {rho[i]} * ll{i}) / (nn - 1), 2)" for i in range(1, p)}
        num = " + ".join(f"4 * pow({rho[i]}, 2) * {s2[i]} / pow(1 - {rho[i]}, 8)" for i in range(1, p))
        den = " + ".join(f"{s2[i]} / pow(1 - {rho[i]}, 4)" for i in range(1, p))
        ctes.append(f"bw as (select entity, any_value(nn) as nn, 1.3221 * pow(sum({num}) / sum({den}) * any_value(nn), 0.2) as bandwidth "
                    "from ar group by entity)")
    z = {"nw": "(l / (bandwidth + 1))", "nw_auto": "(l / (bandwidth + 1))", "bartlett": "(l / bandwidth)", "qs": "(l / bandwidth)"}[kind]
    weight = (f"25 / (12 * pi() * pi() * {z} * {z}) * (sin(6 * pi() * {z} / 5) / (6 * pi() * {z} / 5) - cos(6 * pi() * {z} / 5))"
              if kind == "qs" else f"greatest(0.0, 1 - {z})")
    cell = inverse_cell(k)
    same = " and ".join(f"x.{c.strip()} = y.{c.strip()}" for c in keys.split(","))
    meat = ", ".join(f"sum(wk.w * x.u{a} * y.u{b}) as v{a}{b}" for a in range(p) for b in range(p))
    ses = ", ".join("sqrt(tot.nn / cast(tot.nn - tot.kk as double) * (" + " + ".join(f"{cell(j, a)} * v{a}{b} * {cell(b, j)}" for a in range(p) for b in range(p))
                    + f")) as hse{j}" for j in range(p))
    return [*ctes, f"wk as (select entity, g.range as l, case when g.range = 0 then 1.0 else {weight.replace('(l /', '(g.range /')} end as w "
            "from bw, range(0, 20000) g where g.range < nn)",
            f"sm as (select {', '.join(f'x.{c.strip()}' for c in keys.split(','))}, {meat} from ru x join ru y on {same} "
            "join wk on wk.entity = x.entity and wk.l = abs(x.pos - y.pos) group by all)",
            f"hs as (select f.*, tot.nn, tot.kk, tot.rss_all, bw.bandwidth, {ses} from f join sm using ({keys}) join tot using (entity) "
            "join bw on bw.entity = f.entity)"]


def _terms(xs: list[str], keys: str, se: str, extra: str = "", src: str = "hs") -> str:
    rows = [f"select {keys}, '{t}' as term, round(b{i}, 6) as estimate, round({se.format(i)}, 6) as se, nn - kk as df_resid, "
            f"round(b{i} / {se.format(i)}, 6) as t_stat, round({S.t_p(f'(b{i} / {se.format(i)})', 'nn - kk')}, 6) as p_value{extra} from {src}"
            for i, t in enumerate(["(Intercept)", *xs])]
    return "\nunion all ".join(rows)


def _pooled_sql() -> str:
    cell = inverse_cell(2)
    ses = ", ".join(f"sqrt(rss_all / (nn - kk) * {cell(j, j)}) as pse{j}" for j in range(3))
    return S.with_(*S.bp_regimes(BREAKS), *S.ols_ctes("f", "reg", "y", XS, keys=R),
                   "tot as (select entity, sum(n) as nn, count(*) * 3 as kk, sum(rss) as rss_all from f group by entity)",
                   f"hs as (select f.*, nn, kk, {ses} from f join tot using (entity))") + _cast_df(_terms(XS, R, "pse{}"))


def _cast_df(sql: str) -> str:
    return sql.replace("nn - kk as df_resid", "cast(nn - kk as bigint) as df_resid")


@register("ols_regime_pooled", sql=_pooled_sql())
def q_ols_regime_pooled(spark, sf_dir):
    """RG21: one regression of y on regime and regime × (x1, x2) over the Bai–Perron regimes
    of each entity; pooled residual variance."""
    fit = MD.regime_fit(bp_regimes(views.panel(spark, sf_dir, materialize=True), BREAKS), "y", XS, K)
    return rounded(MD.se_table(fit.select(*K, "regime", "se"), fit.drop("se"), XS, [*K, "regime"]))


@register("regime_paths", sql=S.with_(*S.bp_regimes(BREAKS), *S.ols_ctes("f", "reg", "y", XS, keys=R)) + """
select reg.entity, m, reg.regime, round(y, 6) as y, round(b0 + b1 * x1 + b2 * x2, 6) as y_hat_bp
from reg join f on f.entity = reg.entity and f.regime = reg.regime""")
def q_regime_paths(spark, sf_dir):
    """RG21/SB9: fitted path of the regression over regimes beside the series."""
    reg = bp_regimes(views.panel(spark, sf_dir, materialize=True), BREAKS)
    fit = MD.regime_fit(reg, "y", XS, K)
    res = O.residuals(reg, fit, "y", XS, [*K, "regime"])
    return rounded(res.select("entity", "m", "regime", "y", F.col("fitted").alias("y_hat_bp")))


def _regime_robust(kind: str, param: float = 0):
    def q(spark, sf_dir):
        reg = bp_regimes(views.panel(spark, sf_dir, materialize=True), BREAKS)
        fit = MD.regime_fit(reg, "y", XS, K, materialize=True)
        se = MD.regime_robust_se(reg, fit, "y", XS, K, "m", kind, param)
        out = MD.se_table(se.select(*K, "regime", "se"), fit.drop("se"), XS, [*K, "regime"])
        return rounded(out.join(se.select(*K, "regime", "bandwidth"), [*K, "regime"]))
    q.__doc__ = f"RG21: robust errors ({kind}, {param}) of the regression over the Bai–Perron regimes, with t and p."
    return q


def _regime_sql(kind: str, param: float = 0) -> str:
    return S.with_(*S.bp_regimes(BREAKS), *kernel_ctes("reg", XS, R, kind, param)) + _cast_df(_terms(XS, R, "hse{}", ", round(bandwidth, 6) as bandwidth"))


register("se_regime_newey_west", sql=_regime_sql("nw", 12.0))(_regime_robust("nw", 12))
register("se_regime_kernel_bartlett", sql=_regime_sql("bartlett", 12.0))(_regime_robust("bartlett", 12))
register("se_regime_nw_auto", sql=_regime_sql("nw_auto"))(_regime_robust("nw_auto"))
register("se_regime_hac_qs", sql=_regime_sql("qs"))(_regime_robust("qs_andrews"))


def _benchmark_hac_sql() -> str:
    xs = [*XS, "y_l1"]
    at = {"(Intercept)": 0, "x1": 1, "x2": 2}
    rows = []
    for t, b0, alt in LIT.BENCHMARKS:
        stat = f"((b{at[t]} - {b0!r}) / hse{at[t]})"
        two = S.t_p(stat, "nn - kk")
        p = two if alt != "greater" else f"(case when {stat} >= 0 then {two} / 2 else 1 - {two} / 2 end)"
        rows.append(f"select entity, '{t}' as term, cast({b0!r} as double) as b0, '{alt}' as alternative, round(b{at[t]}, 6) as estimate, "
                    f"round(hse{at[t]}, 6) as se, cast(nn - kk as bigint) as df_resid, round({stat}, 6) as t_stat, round({p}, 6) as p_value from hs")
    lag = """lg as (select *, row_number() over (partition by entity order by m) as pos from (
  select *, lag(y, 1) over (partition by entity order by m) as y_l1 from panel) where y_l1 is not null)"""
    return S.with_(S.PANEL, lag, *kernel_ctes("lg", xs, "entity", "qs")) + "\nunion all ".join(rows)


@register("coef_vs_benchmark_hac", sql=_benchmark_hac_sql())
def q_coef_vs_benchmark_hac(spark, sf_dir):
    """RG12: t tests of the lag-1 model's coefficients against fixed values, errors from the
    quadratic-spectral kernel with Andrews' bandwidth."""
    xs = [*XS, "y_l1"]
    d = WN.lags(views.panel(spark, sf_dir, materialize=True), "y", K, "m", [1])
    fit = O.ols(d, "y", xs, K, materialize=True)
    se = MD.series_robust_se(d, fit, "y", xs, K, "m", "qs_andrews")
    coef = MD.se_table(se.drop("bandwidth"), fit, xs, K)
    return rounded(MD.coef_vs_benchmark(coef, LIT.BENCHMARKS, K))
