"""Time matching of events and windows to series (JN1–JN4, JN6).

No theta or cross join is used:

* as-of matches (nearest / forward) union the event markers into the series
  and read the neighbouring series row with ``first/last(ignorenulls)`` over
  the series window — one sort per series, any number of events;
* interval membership explodes each window into its months (bounded by the
  window length) and equi-joins on the month number; per-month flags are
  pre-aggregated so the big side joins one row per month.

Events/windows that apply to every entity are attached by exploding a
literal array on the distinct entities, not by a join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.views import month_index


def events_per_entity(df: DataFrame, events: Sequence[tuple[str, str]], keys: Sequence[str]) -> DataFrame:
    """(keys, label, ev_m) for every entity × event month ``('label', 'YYYY-MM')``."""
    arr = F.array(*[F.struct(F.lit(lbl).alias("label"),
                             month_index(F.to_date(F.lit(ym + "-01"))).alias("ev_m"))
                    for lbl, ym in events])
    return df.select(*keys).distinct().select(*keys, F.explode(arr).alias("e")).select(*keys, "e.*")


def _marked(df: DataFrame, ev: DataFrame, keys: Sequence[str], order: str, payload: Sequence[str]):
    w = Window.partitionBy(*keys).orderBy(order)
    rows = (df.select(*keys, order, *payload)
            .withColumn("pos", F.row_number().over(w))
            .withColumn("n_rows", F.count(F.lit(1)).over(Window.partitionBy(*keys))))
    row_struct = F.struct(*[F.col(c) for c in [order, "pos", "n_rows", *payload]])
    r = rows.select(*keys, F.col(order).alias("_o"), F.lit(1).alias("_is_row"), F.lit(None).cast("string").alias("label"),
                    row_struct.alias("_r"))
    e = ev.select(*keys, F.col("ev_m").alias("_o"), F.lit(0).alias("_is_row"), "label",
                  F.lit(None).cast(r.schema["_r"].dataType).alias("_r"))
    u = r.unionByName(e)
    # events sort before rows at the same time so "forward" includes an exact hit
    uw = Window.partitionBy(*keys).orderBy("_o", "_is_row")
    return u, uw


def asof_forward(df: DataFrame, events: Sequence[tuple[str, str]], keys: Sequence[str], order: str,
                 payload: Sequence[str], guard: int | None = 10) -> DataFrame:
    """JN2/JN6: first row with ``order >= event`` per (entity, event).

    ``guard``: keep only matches with position > guard and < n - guard
    (FL6); events with no such row are dropped.
    """
    ev = events_per_entity(df, events, keys)
    u, uw = _marked(df, ev, keys, order, payload)
    nxt = F.first("_r", ignorenulls=True).over(uw.rowsBetween(0, Window.unboundedFollowing))
    m = u.withColumn("_m", nxt).filter(F.col("_is_row") == 0).filter(F.col("_m").isNotNull())
    out = m.select(*keys, "label", F.col("_o").alias("event_m"), "_m.*")
    if guard is not None:
        out = out.filter((F.col("pos") > guard) & (F.col("pos") < F.col("n_rows") - guard))
    return out


def asof_nearest(df: DataFrame, events: Sequence[tuple[str, str]], keys: Sequence[str], order: str,
                 payload: Sequence[str]) -> DataFrame:
    """JN1: row minimising |order - event|; on a tie the earlier row wins."""
    ev = events_per_entity(df, events, keys)
    u, uw = _marked(df, ev, keys, order, payload)
    prev = F.last("_r", ignorenulls=True).over(uw.rowsBetween(Window.unboundedPreceding, 0))
    nxt = F.first("_r", ignorenulls=True).over(uw.rowsBetween(0, Window.unboundedFollowing))
    m = u.select("*", prev.alias("_p"), nxt.alias("_n")).filter(F.col("_is_row") == 0)
    dp = F.col("_o") - F.col(f"_p.{order}")
    dn = F.col(f"_n.{order}") - F.col("_o")
    pick = F.when(F.col("_n").isNull(), F.col("_p")).when(F.col("_p").isNull(), F.col("_n")) \
        .when(dp <= dn, F.col("_p")).otherwise(F.col("_n"))
    return m.select(*keys, "label", F.col("_o").alias("event_m"), pick.alias("_m")) \
        .filter(F.col("_m").isNotNull()).select(*keys, "label", "event_m", "_m.*")


def month_flags(spark, windows: Sequence[tuple[str, str, str]]) -> DataFrame:
    """One row per month covered by any window, 0/1 column per window label.

    ``windows``: (label, first month 'YYYY-MM', last month 'YYYY-MM'), inclusive.
    Size is bounded by the total window length in months (literal input).
    """
    labels = [w[0] for w in windows]
    arr = F.array(*[F.struct(F.lit(lbl).alias("label"),
                             F.to_date(F.lit(s + "-01")).alias("start"),
                             F.add_months(F.to_date(F.lit(e + "-01")), 1).alias("stop"))
                    for lbl, s, e in windows])
    w = spark.range(1).select(F.explode(arr).alias("w")).select("w.*")
    months = w.select("label", F.explode(F.sequence(month_index(F.col("start")),
                                                    month_index(F.col("stop")) - 1)).alias("m"))
    return months.groupBy("m").agg(*[F.max((F.col("label") == lbl).cast("int")).alias(lbl) for lbl in labels])


def window_flags(df: DataFrame, windows: Sequence[tuple[str, str, str]], month_col: str = "m") -> DataFrame:
    """JN3: 0/1 indicator per labelled window (start <= t < add_months(end, 1))."""
    flags = month_flags(df.sparkSession, windows)
    labels = [w[0] for w in windows]
    j = df.join(F.broadcast(flags.withColumnRenamed("m", month_col)), on=month_col, how="left")
    return j.select(*df.columns, *[F.coalesce(F.col(lbl), F.lit(0)).alias(lbl) for lbl in labels])


def lookup(df: DataFrame, table: DataFrame, on: Sequence[str]) -> DataFrame:
    """JN4: left lookup against a small keyed table (literal → broadcast)."""
    return df.join(F.broadcast(table), on=list(on), how="left")
