"""DuckDB oracle building blocks: the stand-in views as CTE text."""

from __future__ import annotations

import math
import re

PANEL = """panel as (
  select l_returnflag || l_linestatus as entity,
         cast(date_trunc('month', l_shipdate) as date) as t,
         cast(year(l_shipdate) * 12 + month(l_shipdate) - 1 as integer) as m,
         cast(sum(cast(l_extendedprice as decimal(18,2))) as double) / count(*) / 1000 as y,
         cast(sum(cast(l_discount as decimal(18,2))) as double) / count(*) * 100 - 5 as x1,
         cast(sum(cast(l_quantity as decimal(18,2))) as double) / count(*) - 25.5 as x2
  from lineitem group by 1, 2, 3)"""

PANEL_WIDE = """panel_wide as (
  select cast(l_suppkey as varchar) as entity,
         cast(date_trunc('month', l_shipdate) as date) as t,
         cast(year(l_shipdate) * 12 + month(l_shipdate) - 1 as integer) as m,
         cast(sum(cast(l_extendedprice as decimal(18,2))) as double) / count(*) / 1000 as y,
         cast(sum(cast(l_discount as decimal(18,2))) as double) / count(*) * 100 - 5 as x1,
         cast(sum(cast(l_quantity as decimal(18,2))) as double) / count(*) - 25.5 as x2
  from lineitem group by 1, 2, 3)"""

PANEL_SPARSE = PANEL + """,
panel_sparse as (
  select entity, t, m, y, x1, case when month(t) = 12 then x2 end as x2 from panel)"""

SERIES = """series as (
  select event_type as entity, date_trunc('hour', ts) as t,
         cast(sum(cast(value as decimal(18,2))) as double) / count(*) as y, count(*) as n
  from events group by 1, 2)"""

ROWS = """rows as (
  select l_returnflag as entity, l_extendedprice as y, l_quantity as x1, l_discount as x2
  from lineitem)"""


def with_(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"


def stats2(src: str, y: str = "y", x1: str = "x1", x2: str = "x2", keys: str = "entity",
           where: str = "") -> str:
    """Two-regressor sufficient statistics (centred, via covar_pop/var_pop)."""
    w = f"where {y} is not null and {x1} is not null and {x2} is not null" + (f" and {where}" if where else "")
    return f"""select {keys}, count(*) as n, avg({y}) as my, avg({x1}) as m1, avg({x2}) as m2,
         var_pop({x1}) * count(*) as s11, var_pop({x2}) * count(*) as s22,
         covar_pop({x1}, {x2}) * count(*) as s12, covar_pop({x1}, {y}) * count(*) as s1y,
         covar_pop({x2}, {y}) * count(*) as s2y, var_pop({y}) * count(*) as syy
  from {src} {w} group by {keys}"""


def solve2(stats: str, keys: str = "entity") -> str:
    """Closed-form 2-regressor OLS over a ``stats2`` relation."""
    return f"""select {keys}, n, my, m1, m2, s11, s22, s12, syy,
         (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) as b1,
         (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) as b2,
         s11 * s22 - s12 * s12 as det, s1y, s2y
  from ({stats})"""


def _inverse_terms(k: int) -> tuple[dict, str]:
    """Symbolic adjugate entries ``C[i,j]`` and determinant of the symmetric
    centred matrix with entries ``s{i}_{j}`` (i <= j), for k = 1, 2, 3."""
    s = lambda i, j: f"s{min(i, j)}_{max(i, j)}"
    if k == 1:
        return {(0, 0): "1.0"}, s(0, 0)
    if k == 2:
        c = {(0, 0): s(1, 1), (1, 1): s(0, 0), (0, 1): f"(-{s(0, 1)})"}
        c[(1, 0)] = c[(0, 1)]
        return c, f"({s(0, 0)} * {s(1, 1)} - {s(0, 1)} * {s(0, 1)})"
    if k == 3:
        c = {
            (0, 0): f"({s(1, 1)} * {s(2, 2)} - {s(1, 2)} * {s(1, 2)})",
            (0, 1): f"(-({s(0, 1)} * {s(2, 2)} - {s(0, 2)} * {s(1, 2)}))",
            (0, 2): f"({s(0, 1)} * {s(1, 2)} - {s(0, 2)} * {s(1, 1)})",
            (1, 1): f"({s(0, 0)} * {s(2, 2)} - {s(0, 2)} * {s(0, 2)})",
            (1, 2): f"(-({s(0, 0)} * {s(1, 2)} - {s(0, 1)} * {s(0, 2)}))",
            (2, 2): f"({s(0, 0)} * {s(1, 1)} - {s(0, 1)} * {s(0, 1)})",
        }
        for (i, j) in list(c):
            c[(j, i)] = c[(i, j)]
        det = f"({s(0, 0)} * {c[(0, 0)]} + {s(0, 1)} * {c[(0, 1)]} + {s(0, 2)} * {c[(0, 2)]})"
        return c, det
    raise ValueError("closed form only for k <= 3")


def ols_ctes(name: str, src: str, y: str, xs: list[str], keys: str = "entity", where: str = "") -> list[str]:
    """CTEs ``{name}_s`` (centred sums) and ``{name}`` with keys, n, b0..bk,
    se0..sek, rss, syy, df — closed-form OLS with intercept for k <= 3."""
    k = len(xs)
    conds = [f"{c} is not null" for c in [y, *xs]] + ([where] if where else [])
    sums = [f"count(*) as n", f"avg({y}) as my", f"var_pop({y}) * count(*) as syy"]
    sums += [f"avg({x}) as m{i}" for i, x in enumerate(xs)]
    sums += [f"covar_pop({x}, {y}) * count(*) as sy{i}" for i, x in enumerate(xs)]
    for i in range(k):
        for j in range(i, k):
            f = f"var_pop({xs[i]})" if i == j else f"covar_pop({xs[i]}, {xs[j]})"
            sums.append(f"{f} * count(*) as s{i}_{j}")
    cte_s = f"{name}_s as (select {keys}, {', '.join(sums)} from {src} where {' and '.join(conds)} group by {keys})"
    c, det = _inverse_terms(k)
    b = [f"({' + '.join(f'{c[(i, j)]} * sy{j}' for j in range(k))}) / {det}" for i in range(k)]
    cte_b = (f"{name}_b as (select *, {', '.join(f'{bi} as b{i + 1}' for i, bi in enumerate(b))}, {det} as det "
             f"from {name}_s)")
    rss = "syy - " + " - ".join(f"b{i + 1} * sy{i}" for i in range(k))
    b0 = "my - " + " - ".join(f"b{i + 1} * m{i}" for i in range(k))
    quad = " + ".join(f"m{i} * m{j} * {c[(i, j)]}" for i in range(k) for j in range(k))
    se = [f"sqrt(rss / (n - {k + 1}) * (1.0 / n + ({quad}) / det)) as se0"]
    se += [f"sqrt(rss / (n - {k + 1}) * {c[(i, i)]} / det) as se{i + 1}" for i in range(k)]
    cte_r = f"{name}_r as (select *, {b0} as b0, {rss} as rss, n - {k + 1} as df from {name}_b)"
    cte = f"{name} as (select *, {', '.join(se)} from {name}_r)"
    return [cte_s, cte_b, cte_r, cte]


def mgs_ctes(name: str, src: str, y: str, xs: list[str], keys: str = "entity", where: str = "",
             center: bool = True, carry: tuple[str, ...] = (), df_params: str | None = None) -> list[str]:
    """OLS for any number of regressors by modified Gram–Schmidt over window
    sums (oracle only). Ends in ``{name}`` with one row per group: keys, n,
    tss, rss, and ``b_last``/``se_last`` of the LAST regressor (Frisch–Waugh:
    its coefficient is the projection on its orthogonalised part).
    ``center=True``: intercept model (columns centred first, df = n − k − 1);
    ``center=False``: no implicit intercept — pass a constant column in ``xs``
    (df = n − k), e.g. last, to get the intercept and its standard error.
    ``carry``: row columns passed through; ``{name}_{len(xs)}`` then holds each
    row's residual ``ry`` next to them. All-zero columns (unused slots) are
    skipped; ``df_params`` overrides the parameter count (SQL over carried columns).
    """
    k = len(xs)
    g = f"over (partition by {keys})"
    conds = [f"{c} is not null" for c in [y, *xs]] + ([where] if where else [])
    if center:
        cols = ", ".join([f"{y} - avg({y}) {g} as ry", f"{y} - avg({y}) {g} as y0"]
                         + [f"{x} - avg({x}) {g} as r{i}" for i, x in enumerate(xs)])
    else:
        cols = ", ".join([f"{y} as ry", f"{y} - avg({y}) {g} as y0", f"{y} as ry0"]
                         + [f"{x} as r{i}" for i, x in enumerate(xs)])
    dfp = k + 1 if center else k
    kc = ", ".join([keys, *carry])
    ctes = [f"{name}_0 as (select {kc}, {cols} from (select * from {src} where {' and '.join(conds)}))"]
    for step in range(k):
        q = f"r{step}"
        den = f"nullif(sum({q} * {q}) {g}, 0)"
        upd = [f"ry - coalesce(sum(ry * {q}) {g} / {den}, 0) * {q} as ry", "y0", *([] if center else ["ry0"])]
        upd += [f"r{j} - coalesce(sum(r{j} * {q}) {g} / {den}, 0) * {q} as r{j}" if j > step else f"r{j}"
                for j in range(k)]
        ctes.append(f"{name}_{step + 1} as (select {kc}, {', '.join(upd)} from {name}_{step})")
    last = f"r{k - 1}"
    dfx = f"({df_params})" if df_params else str(dfp)
    ctes.append(f"""{name} as (select {keys}, count(*) as n, sum(y0 * y0) as tss, sum(ry * ry) as rss,
  sum({"y0" if center else "ry0"} * {last}) / sum({last} * {last}) as b_last,
  sqrt(sum(ry * ry) / (count(*) - {dfx}) / sum({last} * {last})) as se_last
  from {name}_{k} group by {keys})""")
    return ctes


# ------------------------------------------------------- tail probabilities
def _simpson(f: str, lo: str, hi: str, steps: int) -> str:
    """∫ f over [lo, hi] by Simpson's rule; ``f`` is SQL in ``z``."""
    h = f"(({hi} - {lo}) / {float(steps)!r})"
    body = f.replace("{z}", f"({lo} + i * {h})")
    return (f"({h} / 3 * list_sum(list_transform(range(0, {steps + 1}), lambda i: "
            f"(case when i = 0 or i = {steps} then 1 when i % 2 = 1 then 4 else 2 end) * {body})))")


def t_p(t: str, df: str, steps: int = 2000) -> str:
    """Two-sided Student-t p: ∫ cos^(df−1) over the angles beyond atan(|t|/√df)."""
    area = _simpson(f"power(cos({{z}}), ({df}) - 1)", f"atan(abs({t}) / sqrt({df}))", "(pi() / 2)", steps)
    return f"(2 * exp(lgamma((({df}) + 1) / 2.0) - lgamma(({df}) / 2.0)) / sqrt(pi()) * {area})"


def f_p(f: str, d1: str, d2: str, steps: int = 2000) -> str:
    """Upper F tail as an integral of sin^(d2−1) cos^(d1−1) up to atan √(d2/(d1 F))."""
    area = _simpson(f"power(sin({{z}}), ({d2}) - 1) * power(cos({{z}}), ({d1}) - 1)", "0.0",
                    f"atan(sqrt(({d2}) / (({d1}) * ({f}))))", steps)
    beta = f"(lgamma(({d1}) / 2.0) + lgamma(({d2}) / 2.0) - lgamma((({d1}) + ({d2})) / 2.0))"
    return f"(2 * exp(-{beta}) * {area})"


def norm_cdf(z: str, steps: int = 2000) -> str:
    return f"(0.5 + {_simpson('exp(-0.5 * {z} * {z})', '0.0', f'({z})', steps)} / sqrt(2 * pi()))"


def norm_ppf_ctes(name: str, src: str, p: str, steps: int = 4) -> list[str]:
    """``{name}``: ``src`` with ``z``, the normal quantile of ``p``: a power start and Halley steps."""
    ctes = [f"{name}_0 as materialized (select *, (power({p}, 0.135) - power(1 - {p}, 0.135)) / 0.1975 as z from {src})"]
    for i in range(1, steps + 1):
        u = f"(({norm_cdf('z', 400)} - {p}) * sqrt(2 * pi()) * exp(z * z / 2))"
        ctes.append(f"{name}_{i} as materialized (select * exclude (z, u), z - u / (1 + z * u / 2) as z "
                    f"from (select *, {u} as u from {name}_{i - 1}))")
    return [*ctes, f"{name} as (select * from {name}_{steps})"]


def used(k: int) -> str:
    """Number of regressors that vary, from the centred columns of ``mgs_ctes`` step 0."""
    return " + ".join(f"cast(max(abs(r{i})) > 0 as integer)" for i in range(k))


def dw_ctes(name: str, chain: str, k: int, keys: str = "entity", order: str = "m") -> list[str]:
    """Durbin-Watson with exact moments from the orthogonal columns that ``mgs_ctes`` leaves
    (the traces are sums over an orthonormal basis); ends in ``{name}``: st, mean, var, z."""
    w = f"over (partition by {keys} order by {order})"
    g = f"over (partition by {keys})"
    q = ", ".join(f"coalesce(r{j} / nullif(sqrt(sum(r{j} * r{j}) {g}), 0), 0) as q{j}" for j in range(k))
    d = ", ".join(f"q{j} - lag(q{j}) {w} as d{j}, 2 * q{j} - coalesce(lag(q{j}) {w}, q{j}) - coalesce(lead(q{j}) {w}, q{j}) as a{j}, q{j}"
                  for j in range(k))
    t1 = " + ".join(f"sum(d{j} * d{j})" for j in range(k))
    t2 = " + ".join(f"sum(a{j} * a{j})" for j in range(k))
    t3 = " + ".join(f"power(sum(d{i} * d{j}), 2)" for i in range(k) for j in range(k))
    p = " + ".join(f"cast(max(abs(q{j})) > 0 as integer)" for j in range(k))
    return [f"{name}_q as (select {keys}, {order}, ry, {q} from {chain}_{k})",
            f"{name}_d as (select {keys}, ry, ry - lag(ry) {w} as de, {d} from {name}_q)",
            f"""{name}_t as (select {keys}, sum(de * de) / sum(ry * ry) as st, count(*) as n, count(*) - 1 - ({p}) as df,
  2 * (count(*) - 1) - ({t1}) as t_p, 2 * (3 * count(*) - 4) - 2 * ({t2}) + ({t3}) as t_q from {name}_d group by {keys})""",
            f"{name}_m as (select *, t_p / df as mean, 2 * (t_q - t_p * t_p / df) / (df * (df + 2)) as var from {name}_t)",
            f"{name} as (select *, (st - mean) / sqrt(var) as z from {name}_m)"]


def chi2_p(x: str, k: int) -> str:
    """Upper χ² tail: a finite sum for even k; for odd k the normal tail plus such a sum."""
    half = f"(({x}) / 2)"
    first = 1 if k % 2 else 0
    terms = [f"power({half}, {j / 2!r}) / {math.gamma(j / 2 + 1)!r}" for j in range(first, k - 1, 2)]
    series = f"exp(-{half}) * ({' + '.join(terms) or '0'})"
    return f"(2 * (1 - {norm_cdf(f'sqrt({x})')}) + {series})" if k % 2 else f"({series})"


def add_t_p(sql: str, df: str, steps: int = 2000) -> str:
    """Append a two-sided p after every rounded ``estimate / se`` of a coefficient table."""
    def tail(m):
        return f"{m[0]}, round({t_p(f'({m[1]} / {m[2]})', df, steps)}, 6)" + (" as p_value" if m[3] else "")

    return re.sub(r"round\((\w+) / (\w*se\w*), 6\)( as t_stat)?", tail, sql)


# ---------------------------------------------------------- structural breaks
PREFIX_SUMS = [PANEL, """c as (
  select entity, m, x1 - avg(x1) over (partition by entity) as a1, x2 - avg(x2) over (partition by entity) as a2,
         y - avg(y) over (partition by entity) as ay from panel)""", """pre as (
  select entity, m, cast(row_number() over w as integer) as pos, count(*) over (partition by entity) as n,
    sum(a1) over wr as p1, sum(a2) over wr as p2, sum(ay) over wr as py, sum(a1 * a1) over wr as p11,
    sum(a1 * a2) over wr as p12, sum(a1 * ay) over wr as p1y, sum(a2 * a2) over wr as p22,
    sum(a2 * ay) over wr as p2y, sum(ay * ay) over wr as pyy,
    sum(a1) over g as t1, sum(a2) over g as t2, sum(ay) over g as ty, sum(a1 * a1) over g as t11,
    sum(a1 * a2) over g as t12, sum(a1 * ay) over g as t1y, sum(a2 * a2) over g as t22,
    sum(a2 * ay) over g as t2y, sum(ay * ay) over g as tyy
  from c window w as (partition by entity order by m),
                wr as (partition by entity order by m rows between unbounded preceding and current row),
                g as (partition by entity))"""]


def seg_rss(c: str, s: dict) -> str:
    """Segment RSS with intercept from raw (series-centred) sums; 2 regressors."""
    S11 = f"({s['11']} - {s['1']} * {s['1']} / {c})"
    S12 = f"({s['12']} - {s['1']} * {s['2']} / {c})"
    S22 = f"({s['22']} - {s['2']} * {s['2']} / {c})"
    s1 = f"({s['1y']} - {s['1']} * {s['y']} / {c})"
    s2 = f"({s['2y']} - {s['2']} * {s['y']} / {c})"
    syy = f"({s['yy']} - {s['y']} * {s['y']} / {c})"
    det = f"({S11} * {S22} - {S12} * {S12})"
    b1 = f"(({S22} * {s1} - {S12} * {s2}) / {det})"
    b2 = f"(({S11} * {s2} - {S12} * {s1}) / {det})"
    return f"({syy} - {b1} * {s1} - {b2} * {s2})"


SUM_NAMES = ["1", "2", "y", "11", "12", "1y", "22", "2y", "yy"]


def bai_perron_ctes(most: int = 5) -> list[str]:
    """Least-squares partitions into 1..most + 1 segments (h = 15 %, at least 4 rows) by the
    textbook recursion over all pairs of positions; ``part``: entity, n, breaks, rss, path,
    bic, aic; ``best``: the path of least BIC."""
    zero = "select distinct entity, null as m, 0 as pos, n" + "".join(f", 0.0 as p{k}" for k in SUM_NAMES) + " from pre"
    own = "select entity, m, pos, n" + "".join(f", p{k}" for k in SUM_NAMES) + " from pre"
    diff = {k: f"(j.p{k} - i.p{k})" for k in SUM_NAMES}
    ctes = [*PREFIX_SUMS, f"at0 as materialized ({zero} union all {own})", f"""seg as materialized (
  select j.entity, i.pos as i, j.pos as j, {seg_rss('(j.pos - i.pos)', diff)} as cost
  from at0 i join at0 j on i.entity = j.entity and j.pos - i.pos >= greatest(floor(j.n * 0.15::double), 4))""",
            "v0 as materialized (select entity, j, cost as value, cast([] as integer[]) as path from seg where i = 0)"]
    for k in range(1, most + 1):
        ctes.append(f"""v{k} as materialized (select entity, j, value, path from (
  select s.entity, s.j, v.value + s.cost as value, list_append(v.path, s.i) as path,
         row_number() over (partition by s.entity, s.j order by v.value + s.cost, s.i) as rk
  from v{k - 1} v join seg s on s.entity = v.entity and s.i = v.j) where rk = 1)""")
    every = " union all ".join(f"select entity, j, {k} as breaks, value as rss, path from v{k}" for k in range(most + 1))
    ctes.append(f"""part as materialized (select v.entity, l.n, breaks, rss, path,
         l.n * (ln(rss) + 1 - ln(l.n) + ln(2 * pi())) + 4 * (breaks + 1) * ln(l.n) as bic,
         l.n * (ln(rss) + 1 - ln(l.n) + ln(2 * pi())) + 8 * (breaks + 1) as aic
  from ({every}) v join (select entity, any_value(n) as n from pre group by entity) l on l.entity = v.entity and l.n = v.j)""")
    ctes.append("best as (select entity, path from (select *, row_number() over (partition by entity order by bic, breaks) as rk "
                "from part) where rk = 1)")
    return ctes


def bp_regimes(breaks: int | None = None) -> list[str]:
    """Panel rows with the regime of the BIC-best partition, or that of ``breaks`` breaks."""
    part = "best" if breaks is None else f"(select entity, path from part where breaks = {breaks})"
    return [*bai_perron_ctes(5 if breaks is None else breaks), f"""reg as (
  select p.*, pre.pos, cast(1 + len(list_filter(b.path, lambda e: e < pre.pos)) as integer) as regime
  from panel p join pre using (entity, m) join {part} b using (entity))"""]
