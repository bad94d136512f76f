"""Registered queries: sources, projections, filters, joins, reshaping
(SURVEY §2.1–2.5)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates as D
from ..functions import labels as L
from ..operators import describe as DS
from ..operators import joins as J
from ..operators import windows as WN
from ..sources import csv as C
from ..sources import views
from . import literals as LIT
from . import sql as S
from .registry import register, rounded

PANEL_SCHEMA = T.StructType([
    T.StructField("entity", T.StringType()), T.StructField("t", T.DateType()),
    T.StructField("m", T.IntegerType()), T.StructField("y", T.DoubleType()),
    T.StructField("x1", T.DoubleType()), T.StructField("x2", T.DoubleType()),
])

_PANEL_ROUNDED = """select entity, t, m, round(y, 6) as y, round(x1, 6) as x1, round(x2, 6) as x2 from {src}"""


# ------------------------------------------------------------------ sources
@register("scan_csv", sql=S.with_(S.PANEL) + _PANEL_ROUNDED.format(src="panel"))
def q_scan_csv(spark, sf_dir):
    """SC1/SC7: write the panel as header CSV, read it back with an explicit schema."""
    path = C.write_csv(views.panel(spark, sf_dir), C.scratch_path(spark, "panel-csv"))
    return rounded(C.read_csv(spark, path, PANEL_SCHEMA))


def _num_text(c):
    return c.cast("string")


@register("scan_csv_locale", sql=S.with_(S.PANEL) + _PANEL_ROUNDED.format(src="panel"))
def q_scan_csv_locale(spark, sf_dir):
    """SC2/SC4: ';'-separated text, decimal comma in one column and decimal
    point in the others, a leading zero, two unnamed trailing columns."""
    p = views.panel(spark, sf_dir)
    gap = _num_text(F.col("x2"))
    fixture = p.select(
        "entity",
        F.date_format("t", "yyyy-MM").alias("date"),
        F.translate(_num_text(F.col("y")), ".", ",").alias("rate"),
        _num_text(F.col("x1")).alias("discount"),
        F.when(F.col("x2") >= 0, F.concat(F.lit("0"), gap)).otherwise(gap).alias("quantity"),
        F.lit(None).cast("string").alias("_c6"), F.lit(None).cast("string").alias("_c7"),
    )
    path = C.write_csv(fixture, C.scratch_path(spark, "panel-locale"), sep=";")
    raw = C.drop_unnamed(C.read_text_table(spark, path, sep=";"))
    typed = C.convert_columns(raw, {"rate": ",", "discount": ".", "quantity": "."}, month_col="date")
    out = typed.select("entity", F.col("date").alias("t"), views.month_index(F.col("date")).alias("m"),
                       F.col("rate").alias("y"), F.col("discount").alias("x1"), F.col("quantity").alias("x2"))
    return rounded(out)


@register("scan_dirty_numeric", sql=S.with_(S.PANEL_SPARSE) + _PANEL_ROUNDED.format(src="panel_sparse"))
def q_scan_dirty_numeric(spark, sf_dir):
    """SC3/SC5: empty first header renamed by position; quoted numbers with a
    trailing tab; 'NA' as the NULL token."""
    p = views.panel_sparse(spark, sf_dir)
    fixture = p.select(
        F.date_format("t", "yyyy-MM").alias(""), "entity",
        F.concat(_num_text(F.col("y")), F.lit("\t")).alias("Rate"),
        _num_text(F.col("x1")).alias("discount"),
        F.concat(_num_text(F.col("x2")), F.lit("\t")).alias("mean quantity"),
    )
    path = C.write_csv(fixture, C.scratch_path(spark, "panel-dirty"), null_value="NA")
    raw = C.rename_positional(C.read_text_table(spark, path), ["month_text", "entity", "y", "x1", "x2"])
    typed = C.convert_columns(raw, {"y": ".", "x1": ".", "x2": "."}, month_col="month_text")
    out = typed.select("entity", F.col("month_text").alias("t"), views.month_index(F.col("month_text")).alias("m"),
                       "y", "x1", "x2")
    return rounded(out)


@register("rename_positional", sql=S.with_(S.PANEL) + _PANEL_ROUNDED.format(src="panel"))
def q_rename_positional(spark, sf_dir):
    """SC3: header kept verbatim (first name empty), first four columns renamed by
    position after an arity check, later columns keep their names."""
    p = views.panel(spark, sf_dir)
    fixture = p.select(F.date_format("t", "yyyy-MM").alias(""), _num_text(F.col("y")).alias("mean price"),
                       _num_text(F.col("x1")).alias("discount"), _num_text(F.col("x2")).alias("mean quantity"), "entity")
    path = C.write_csv(fixture, C.scratch_path(spark, "panel-positional"))
    raw = C.rename_positional(C.read_text_table(spark, path), ["month_text", "y", "x1", "x2"])
    typed = C.convert_columns(raw, {"y": ".", "x1": ".", "x2": "."}, month_col="month_text")
    return rounded(typed.select("entity", F.col("month_text").alias("t"),
                                views.month_index(F.col("month_text")).alias("m"), "y", "x1", "x2"))


@register("sink_csv", sql=S.with_(S.PANEL, *S.ols_ctes("f", "panel", "y", ["x1", "x2"])) + """
select entity, n, round(b0, 6) as b0, round(b1, 6) as b1, round(b2, 6) as b2, round(r2, 6) as r2
from (select *, 1 - rss / syy as r2 from f)""")
def q_sink_csv(spark, sf_dir):
    """SC7: a result table written as header CSV (no row names) and read back typed."""
    from ..operators import ols as O
    fit = O.ols(views.panel(spark, sf_dir, materialize=True), "y", ["x1", "x2"], ["entity"])
    out = fit.select("entity", "n", *[F.col("beta")[i].alias(f"b{i}") for i in range(3)], "r2")
    path = C.write_csv(out, C.scratch_path(spark, "ols-csv"))
    schema = "entity string, n long, b0 double, b1 double, b2 double, r2 double"
    return rounded(C.read_csv(spark, path, schema))


@register("head_tail", sql=S.with_(S.PANEL, """r as (
  select entity, t, m, y,
         cast(row_number() over (partition by entity order by m) as integer) as rn_head,
         cast(row_number() over (partition by entity order by m desc) as integer) as rn_tail
  from panel)""") + "select entity, t, m, round(y, 6) as y, rn_head, rn_tail from r where rn_head <= 3 or rn_tail <= 3")
def q_head_tail(spark, sf_dir):
    """SC9/SO3: first and last three periods per entity (top-k is the feature)."""
    p = views.panel(spark, sf_dir)
    w = Window.partitionBy("entity")
    d = p.select("entity", "t", "m", "y",
                 F.row_number().over(w.orderBy("m")).alias("rn_head"),
                 F.row_number().over(w.orderBy(F.desc("m"))).alias("rn_tail"))
    return rounded(d.filter((F.col("rn_head") <= 3) | (F.col("rn_tail") <= 3)))


# -------------------------------------------------------------- projections
_MONTH_TEXT_SQL = "case when m % 2 = 0 then strftime(t, '%b %Y') else strftime(t, '%Y-%m') end"


@register("month_parse", sql=S.with_(S.PANEL, f"""x as (select entity, m, {_MONTH_TEXT_SQL} as month_text from panel)""") + """
select entity, m, month_text,
       cast(coalesce(try_strptime(month_text, '%b %Y'), try_strptime(month_text || '-01', '%Y-%m-%d')) as date) as t_parsed
from x""")
def q_month_parse(spark, sf_dir):
    """PR1/PR2: month text in two formats ('Jan 1995', '1995-01') → DATE."""
    p = views.panel(spark, sf_dir)
    txt = F.when(F.col("m") % 2 == 0, D.month_label(F.col("t"))).otherwise(F.date_format("t", "yyyy-MM"))
    x = p.select("entity", "m", txt.alias("month_text"))
    return x.select("entity", "m", "month_text", D.month_parse(F.col("month_text")).alias("t_parsed"))


@register("month_parts", sql=S.with_(S.PANEL) + """
select entity, m, cast(year(t) as integer) as year, cast(month(t) as integer) as month,
       strftime(t, '%b') as month_abbr, strftime(t, '%b %Y') as month_label, strftime(t, '%m/%Y') as month_slash
from panel""")
def q_month_parts(spark, sf_dir):
    """PR3/PR5: year, month number and labels."""
    p = views.panel(spark, sf_dir)
    return p.select("entity", "m", F.year("t").alias("year"), F.month("t").alias("month"),
                    F.date_format("t", "MMM").alias("month_abbr"), D.month_label(F.col("t")).alias("month_label"),
                    D.month_slash(F.col("t")).alias("month_slash"))


_EXTRACT_TEXT_SQL = ("case when m % 3 = 0 then strftime(t, '%Y-%m') when m % 3 = 1 then strftime(t, '%Y%m') "
                     "else strftime(t, '%m/%Y') end")


@register("month_extract", sql=S.with_(S.PANEL, f"x as (select entity, m, {_EXTRACT_TEXT_SQL} as txt from panel)",
                                       """y as (select *, case when length(substr(txt, 1, 4)) = 4 then try_cast(substr(txt, 1, 4) as double) end as yr,
         try_cast(substr(txt, 6, 2) as double) as c1, try_cast(substr(txt, 5, 2) as double) as c2,
         try_cast(substr(txt, 1, 2) as double) as c3 from x)""") + """
select entity, m, txt, cast(yr as integer) as year,
       cast(case when yr is null then null when length(txt) < 7 then 1.0
                 when c1 >= 1 and c1 <= 12 then c1 when c2 >= 1 and c2 <= 12 then c2
                 when c3 >= 1 and c3 <= 12 then c3 else 1.0 end as integer) as month
from y""")
def q_month_extract(spark, sf_dir):
    """PR6: tolerant year/month from mixed text layouts."""
    p = views.panel(spark, sf_dir)
    txt = (F.when(F.col("m") % 3 == 0, F.date_format("t", "yyyy-MM"))
           .when(F.col("m") % 3 == 1, F.date_format("t", "yyyyMM"))
           .otherwise(F.date_format("t", "MM/yyyy")))
    x = p.select("entity", "m", txt.alias("txt"))
    yr, mo = D.month_extract(F.col("txt"))
    return x.select("entity", "m", "txt", yr.alias("year"), mo.alias("month"))


@register("canonical_panel", sql=S.with_(S.PANEL) + """
select entity, t, m, round(y, 6) as rate, round(x1 + 5.0, 6) as inflation, 5.0::double as target,
       round((x1 + 5.0) - 5.0, 6) as deviation, round(x2, 6) as gap
from panel""")
def q_canonical_panel(spark, sf_dir):
    """PR7/PR9: rename to the canonical schema, constant target, deviation."""
    p = views.panel(spark, sf_dir)
    infl = L.inflation(F.col("x1"))
    return rounded(p.select("entity", "t", "m", F.col("y").alias("rate"), infl.alias("inflation"),
                            F.lit(L.TARGET).alias("target"), (infl - F.lit(L.TARGET)).alias("deviation"),
                            F.col("x2").alias("gap")))


@register("rule_score", sql=S.with_(S.PANEL, """r as (
  select entity, m, y, 2.0 + (x1 + 5.0) + 0.5 * ((x1 + 5.0) - 5.0) + 0.5 * x2 as rule from panel)""") + """
select entity, m, round(y, 6) as rate, round(rule, 6) as rule, round(y - rule, 6) as diff from r""")
def q_rule_score(spark, sf_dir):
    """PR10: linear policy rule c + π + a(π−π*) + b·gap against the actual rate."""
    p = views.panel(spark, sf_dir)
    infl = L.inflation(F.col("x1"))
    rule = L.rule_score(infl, infl - F.lit(L.TARGET), F.col("x2"))
    d = p.select("entity", "m", F.col("y").alias("rate"), rule.alias("rule"))
    return rounded(d.withColumn("diff", F.col("rate") - F.col("rule")))


_PERIOD_SQL = ("case when t < date '1996-01-01' then 'before 1996' "
               "when t >= date '1996-01-01' and t < date '1998-01-01' then '1996-1997' "
               "when t >= date '1998-01-01' and t < date '2000-01-01' then '1998-1999' "
               "when t >= date '2000-01-01' then 'since 2000' end")
_PERIOD_ORDER_SQL = ("cast(case period when 'before 1996' then 1 when '1996-1997' then 2 "
                     "when '1998-1999' then 3 when 'since 2000' then 4 end as integer)")


@register("period_label", sql=S.with_(S.PANEL, f"x as (select entity, m, t, {_PERIOD_SQL} as period from panel)")
          + f"select entity, m, t, period, {_PERIOD_ORDER_SQL} as period_order from x")
def q_period_label(spark, sf_dir):
    """PR11/SO2: first-true-branch period label and its position in the label list."""
    p = views.panel(spark, sf_dir)
    x = p.select("entity", "m", "t", L.period_label(F.col("t")).alias("period"))
    return x.withColumn("period_order", L.label_order(F.col("period")))


@register("recode_labels", sql=S.with_(S.PANEL, """l as (
  select entity, m, 'y' as variable from panel union all select entity, m, 'x1' from panel
  union all select entity, m, 'x2' from panel union all select entity, m, 'm' from panel)""") + """
select entity, m, variable,
       case variable """ + " ".join(f"when '{k}' then '{v}'" for k, v in L.VARIABLE_LABELS.items()) + """ else variable end as label
from l""")
def q_recode_labels(spark, sf_dir):
    """PR12: dictionary recode of variable names; unmatched names ('m') kept."""
    p = views.panel(spark, sf_dir).withColumn("m_d", F.col("m").cast("double"))
    long = DS.long_values(p, ["y", "x1", "x2", "m_d"], ["entity", "m"])
    long = long.withColumn("variable", F.when(F.col("variable") == "m_d", F.lit("m")).otherwise(F.col("variable")))
    return long.select("entity", "m", "variable", L.recode(F.col("variable")).alias("label"))


@register("zscore_long", sql=S.with_(S.PANEL, """l as (
  select entity, m, 'y' as variable, y as value from panel union all select entity, m, 'x1', x1 from panel
  union all select entity, m, 'x2', x2 from panel)""") + """
select entity, m, variable, round(value, 6) as value,
       round((value - avg(value) over (partition by entity, variable))
             / stddev_samp(value) over (partition by entity, variable), 6) as z
from l""")
def q_zscore_long(spark, sf_dir):
    """PR15: z-score per (entity, variable): aggregate moments, join back."""
    from ..operators.transforms import zscore
    long = DS.long_values(views.panel(spark, sf_dir, materialize=True), ["y", "x1", "x2"], ["entity", "m"])
    return rounded(zscore(long, "value", ["entity", "variable"]).select("entity", "m", "variable", "value", "z"))


@register("format_labels", sql=S.with_(S.PANEL, f"st as ({S.solve2(S.stats2('panel'))})") + """
select entity, printf('b1=%.3f, b2=%.3f, n=%d', b1, b2, n) as label from st""")
def q_format_labels(spark, sf_dir):
    """PR17: formatted model summary text per entity."""
    from ..operators import ols as O
    fit = O.ols(views.panel(spark, sf_dir, materialize=True), "y", ["x1", "x2"], ["entity"])
    return fit.select("entity", F.format_string("b1=%.3f, b2=%.3f, n=%d", F.col("beta")[1], F.col("beta")[2],
                                                F.col("n")).alias("label"))


# ------------------------------------------------------------------ filters
@register("known_points", sql=S.with_(S.PANEL_SPARSE)
          + "select entity, t, m, round(x2, 6) as x2 from panel_sparse where x2 is not null")
def q_known_points(spark, sf_dir):
    """FL1: rows where the sparse column is known."""
    p = views.panel_sparse(spark, sf_dir)
    return rounded(p.filter(F.col("x2").isNotNull()).select("entity", "t", "m", "x2"))


@register("complete_cases", sql=S.with_(S.PANEL_SPARSE) + """
select entity, count(*) as n_rows,
       count(*) filter (where y is not null and x1 is not null and x2 is not null) as n_complete
from panel_sparse group by entity""")
def q_complete_cases(spark, sf_dir):
    """FL2: rows and complete rows per entity (one aggregate)."""
    from ..operators.ols import complete
    p = views.panel_sparse(spark, sf_dir)
    return p.groupBy("entity").agg(F.count(F.lit(1)).alias("n_rows"),
                                   F.count(F.when(complete(["y", "x1", "x2"]), 1)).alias("n_complete"))


@register("dedupe_first", sql=S.with_(S.SERIES) + """
select entity, cast(t as date) as day, min(t) as t, round(arg_min(y, t), 6) as y, count(*) as n_dup
from series group by entity, cast(t as date)""")
def q_dedupe_first(spark, sf_dir):
    """FL5: one row per (entity, day), the first in time; duplicate count kept.

    ``min(struct(order, payload))`` is a partial aggregate, so a hot key is
    reduced on the map side instead of being sorted in one task.
    """
    from ..operators.transforms import dedupe_first
    s = views.series(spark, sf_dir).withColumn("day", F.to_date("t"))
    return rounded(dedupe_first(s, ["entity", "day"], ["t"], ["y"]))


# -------------------------------------------------------------------- joins
_POS_CTE = """p as (select *, cast(row_number() over (partition by entity order by m) as integer) as pos,
         count(*) over (partition by entity) as n_rows from panel)"""


@register("asof_nearest", sql=S.with_(S.PANEL, _POS_CTE, LIT.events_sql(), """c as (
  select p.*, ev.label, ev.ev_m,
         row_number() over (partition by p.entity, ev.label order by abs(p.m - ev.ev_m), p.m) as rn
  from p, ev)""") + "select entity, label, ev_m as event_m, m, pos, n_rows, t, round(y, 6) as y from c where rn = 1")
def q_asof_nearest(spark, sf_dir):
    """JN1: nearest period to each event month (earlier row on a tie)."""
    p = views.panel(spark, sf_dir, materialize=True)
    return rounded(J.asof_nearest(p, LIT.EVENTS, ["entity"], "m", ["t", "y"]))


@register("asof_forward", sql=S.with_(S.PANEL, _POS_CTE, LIT.events_sql(), """c as (
  select p.*, ev.label, ev.ev_m, row_number() over (partition by p.entity, ev.label order by p.m) as rn
  from p, ev where p.m >= ev.ev_m)""") + """
select entity, label, ev_m as event_m, m, pos, n_rows, t, round(y, 6) as y
from c where rn = 1 and pos > 10 and pos < n_rows - 10""")
def q_asof_forward(spark, sf_dir):
    """JN2/JN6/FL6: first period at or after each event, edge-guarded (±10 rows)."""
    p = views.panel(spark, sf_dir, materialize=True)
    return rounded(J.asof_forward(p, LIT.EVENTS, ["entity"], "m", ["t", "y"], guard=10))


def _flags_sql():
    cols = ",\n  ".join(
        f"cast(case when m >= {LIT.month_number(s)} and m <= {LIT.month_number(e)} then 1 else 0 end as integer) as {l}"
        for l, s, e in LIT.WINDOWS)
    return f"f as (select entity, t, m, y, {cols} from panel)"


@register("window_flags", sql=S.with_(S.PANEL, _flags_sql())
          + "select entity, t, m, round(y, 6) as y, W1, W2, W3, W4 from f")
def q_window_flags(spark, sf_dir):
    """JN3/FL4/PR4: 0/1 indicators for labelled month windows (end month inclusive)."""
    p = views.panel(spark, sf_dir).select("entity", "t", "m", "y")
    return rounded(J.window_flags(p, LIT.WINDOWS))


@register("flag_counts", sql=S.with_(S.PANEL, _flags_sql()) + """
select entity, flag, n from (
  select entity, 'W1' as flag, sum(W1)::bigint as n from f group by entity union all
  select entity, 'W2', sum(W2)::bigint from f group by entity union all
  select entity, 'W3', sum(W3)::bigint from f group by entity union all
  select entity, 'W4', sum(W4)::bigint from f group by entity)""")
def q_flag_counts(spark, sf_dir):
    """AG11: periods inside each window per entity."""
    p = views.panel(spark, sf_dir).select("entity", "t", "m", "y")
    f = J.window_flags(p, LIT.WINDOWS)
    labels = [w[0] for w in LIT.WINDOWS]
    g = f.groupBy("entity").agg(*[F.sum(l).cast("long").alias(l) for l in labels])
    return g.unpivot(["entity"], labels, "flag", "n")


@register("flag_first_rows", sql=S.with_(S.PANEL, _flags_sql(), """l as (
  select entity, m, 'W1' as flag, W1 as v from f union all select entity, m, 'W2', W2 from f
  union all select entity, m, 'W3', W3 from f union all select entity, m, 'W4', W4 from f)""", """r as (
  select entity, flag, m, cast(row_number() over (partition by entity, flag order by m) as integer) as rn
  from l where v = 1)""") + "select entity, flag, m, rn from r where rn <= 3")
def q_flag_first_rows(spark, sf_dir):
    """AG11: the first three periods inside each window per entity (top-k is the feature)."""
    p = views.panel(spark, sf_dir).select("entity", "t", "m", "y")
    f = J.window_flags(p, LIT.WINDOWS)
    labels = [w[0] for w in LIT.WINDOWS]
    long = f.unpivot(["entity", "m"], labels, "flag", "v").filter(F.col("v") == 1)
    w = Window.partitionBy("entity", "flag").orderBy("m")
    return long.select("entity", "flag", "m", F.row_number().over(w).alias("rn")).filter(F.col("rn") <= 3)


@register("lag_selfjoin", sql=S.with_(S.PANEL) + """
select entity, m, round(y, 6) as y, round(lag(y, 1) over (partition by entity order by m), 6) as y_l1 from panel""")
def q_lag_selfjoin(spark, sf_dir):
    """JN5: lag 1 by an equi-join on (entity, m-1) — equals the window lag on a gapless panel."""
    p = views.panel(spark, sf_dir, materialize=True).select("entity", "m", "y")
    return rounded(WN.lag_selfjoin(p, "y", ["entity"], "m", 1).select("entity", "m", "y", "y_l1"))


# ---------------------------------------------------------------- reshaping
@register("unpivot_series", sql=S.with_(S.PANEL_SPARSE) + """
select entity, m, 'y' as variable, round(y, 6) as value from panel_sparse union all
select entity, m, 'x1', round(x1, 6) from panel_sparse union all
select entity, m, 'x2', round(x2, 6) from panel_sparse""")
def q_unpivot_series(spark, sf_dir):
    """RS1: wide → long with NULLs kept."""
    p = views.panel_sparse(spark, sf_dir)
    return rounded(DS.long_values(p, ["y", "x1", "x2"], ["entity", "m"]))
