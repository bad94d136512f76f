"""Registered queries of the global spline fill and the local regression smoother."""

from __future__ import annotations

from ..operators import ols as O
from ..operators import smooth as SM
from ..operators import spline as SP
from ..sources import views
from . import sql as S
from .q_models import _wide_select, ols_wide
from .registry import register, rounded

K = ["entity"]


def _third(cols: list[int]) -> str:
    """Third divided difference times 6 of four points (columns x{i}, v{i})."""
    parts = []
    for i in cols:
        den = " * ".join(f"(x{i} - x{j})" for j in cols if j != i)
        parts.append(f"v{i} / ({den})")
    return f"coalesce(6 * ({' + '.join(parts)}), 0)"


def spline_ctes() -> list[str]:
    """``filled``: entity, t, m, y, x1, x2, x2_spline, by forward elimination and back
    substitution one known point at a time (recursive)."""
    four = ", ".join(f"max(case when k = {i} then x end) as x{i}, max(case when k = {i} then v end) as v{i}, "
                     f"max(case when k = n - 4 + {i} then x end) as x{4 + i}, "
                     f"max(case when k = n - 4 + {i} then v end) as v{4 + i}" for i in range(4))
    return [S.PANEL_SPARSE, """numbered as (
  select *, row_number() over w as pos, count(x2) over w as seen from panel_sparse window w as (partition by entity order by m))""",
            """pts as (select entity, seen - 1 as k, cast(pos as double) as x, x2 as v,
  count(*) over (partition by entity) as n from numbered where x2 is not null)""",
            f"e4 as (select entity, {four} from pts group by entity)",
            f"""ends as (select entity, {_third([0, 1, 2, 3])} as d0, {_third([4, 5, 6, 7])} as d1 from e4)""",
            """nb as (select pts.*, d0, d1, x - lag(x) over w as hl, lead(x) over w - x as hr,
  v - lag(v) over w as vl, lead(v) over w - v as vr from pts join ends using (entity) window w as (partition by entity order by k))""",
            """eq as materialized (select entity, k, n, x, v,
  case when n <= 2 then 0 when k = 0 then 0 when k = n - 1 then -1 else hl end as lo,
  case when n <= 2 then 1 when k = 0 then -1 when k = n - 1 then 1 else 2 * (hl + hr) end as di,
  case when n <= 2 then 0 when k = 0 then 1 when k = n - 1 then 0 else hr end as up,
  case when n <= 2 then 0 when k = 0 then hr * d0 when k = n - 1 then hl * d1 else 6 * (vr / hr - vl / hl) end as rhs from nb)""",
            """fw as (select entity, k, n, up / di as c, rhs / di as d from eq where k = 0
  union all select e.entity, e.k, e.n, e.up / (e.di - e.lo * f.c), (e.rhs - e.lo * f.d) / (e.di - e.lo * f.c)
  from eq e join fw f on e.entity = f.entity and e.k = f.k + 1)""",
            """bw as (select entity, k, d as b from fw where k = n - 1
  union all select f.entity, f.k, f.d - f.c * b.b from fw f join bw b on f.entity = b.entity and f.k = b.k - 1)""",
            """piece as (select entity, k, n, x as p0, v as v0, b as b0, lead(x) over w as p1, lead(v) over w as v1,
  lead(b) over w as b1 from eq join bw using (entity, k) window w as (partition by entity order by k))""",
            """filled as (select r.entity, r.t, r.m, r.y, r.x1, r.x2, coalesce(r.x2,
  (b0 * (p1 - pos) * (p1 - pos) * (p1 - pos) + b1 * (pos - p0) * (pos - p0) * (pos - p0)) / (6 * (p1 - p0))
  + (v0 / (p1 - p0) - b0 * (p1 - p0) / 6) * (p1 - pos) + (v1 / (p1 - p0) - b1 * (p1 - p0) / 6) * (pos - p0)) as x2_spline
  from numbered r left join piece q on r.entity = q.entity and q.p1 is not null and q.k = greatest(0, least(r.seen - 1, q.n - 2)))"""]


def _recursive(sql: str) -> str:
    return sql.replace("with ", "with recursive ", 1)


@register("fill_spline", sql=_recursive(S.with_(*spline_ctes())) + """
select entity, t, m, round(x2, 6) as x2, round(x2_spline, 6) as x2_spline from filled""")
def q_fill_spline(spark, sf_dir):
    """WN6: global cubic spline through the known points, outer cubics continued to the edges."""
    p = views.panel_sparse(spark, sf_dir).select("entity", "t", "m", "x2")
    return rounded(SP.fill_spline(p, "x2", K, "m"))


@register("ols_spline_fill", sql=_recursive(S.with_(*spline_ctes(), *S.ols_ctes("f", "filled", "y", ["x1", "x2_spline"])))
          + _wide_select(2))
def q_ols_spline_fill(spark, sf_dir):
    """RG2: y ~ x1 + spline-filled x2."""
    d = SP.fill_spline(views.panel_sparse(spark, sf_dir), "x2", K, "m")
    return rounded(ols_wide(O.ols(d, "y", ["x1", "x2_spline"], K)))


def _loess_sql(src_cte: str, src: str, bins: int = 1024, points: int = 80, span: float = 0.75) -> str:
    s = [f"sum(w * power(u, {i}))" for i in range(5)]
    t = [f"sum(w * power(u, {i}) * my)" for i in range(3)]
    sums = ", ".join([f"{e} as s{i}" for i, e in enumerate(s)] + [f"{e} as t{i}" for i, e in enumerate(t)])
    return S.with_(src_cte, f"e as (select entity, min(x1) as lo, max(x1) as hi from {src} group by entity)", f"""b as (
  select entity, least(coalesce(floor((x1 - lo) / nullif((hi - lo) / {float(bins)!r}, 0)), 0), {bins - 1}) as cell,
         cast(count(*) as double) as c, avg(x1) as mx, avg(y) as my from {src} join e using (entity) group by all)""", f"""g as (
  select entity, cast(i as integer) as point, lo + (hi - lo) * cast(i as double) / {points - 1} as gx
  from e, range(0, {points}) r(i) where hi > lo or i = 0)""", """d as (
  select entity, point, gx, cell, c, mx, my, abs(mx - gx) as dist, sum(c) over (partition by entity, point) as n,
         sum(c) over (partition by entity, point order by abs(mx - gx)) as near from g join b using (entity))""", f"""h as (
  select *, min(case when near >= least(greatest(floor(n * {span!r}::double + 0.00001::double), 1), n) then dist end)
    over (partition by entity, point) as h0 from d)""", """k as (
  select *, (mx - gx) / h as u, c * power(greatest(1 - power(dist / h, 3), 0), 3) as w0
  from (select *, case when h0 > 0 then h0 else 1.0 end as h from h))""", """k2 as (
  select *, case when sum(w0) over (partition by entity, point) > 0 then w0 else c * cast(dist <= h as integer) end as w from k)""",
                   f"s as (select entity, point, gx, {sums} from k2 group by entity, point, gx)", """dt as (
  select *, s2 * s4 - s3 * s3 as c0, s2 * s3 - s1 * s4 as c1, s1 * s3 - s2 * s2 as c2, s0 * s2 - s1 * s1 as d1 from s)""") + """
select entity, point, round(gx, 6) as x, round(case
  when s0 * c0 + s1 * c1 + s2 * c2 > 1e-10 * s0 * s0 * s0 then (t0 * c0 + t1 * c1 + t2 * c2) / (s0 * c0 + s1 * c1 + s2 * c2)
  when d1 > 1e-10 * s0 * s0 then (t0 * s2 - t1 * s1) / d1 else t0 / s0 end, 6) as fit
from dt"""


@register("local_trend", sql=_loess_sql(S.PANEL, "panel"))
def q_local_trend(spark, sf_dir):
    """AG12: local quadratic regression of y on x1 (nearest 75 % of the months), 80 points per entity."""
    return rounded(SM.local_regression(views.panel(spark, sf_dir, materialize=True), "x1", "y", K))


@register("local_trend_rows", sql=_loess_sql(S.ROWS, "rows"))
def q_local_trend_rows(spark, sf_dir):
    """AG12 on raw rows (hot groups): local quadratic regression of price on quantity."""
    return rounded(SM.local_regression(views.rows(spark, sf_dir), "x1", "y", K))
