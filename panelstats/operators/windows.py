"""Ordered per-series operators (WN1–WN11, JN5).

A series is one ``entity`` ordered by ``m`` (month number) or any order
column. In a panel a series holds one row per period, so a window partition
is bounded by the number of periods, never by the raw row count: the heavy
reduction (raw rows → periods) happens before, in a partial hash aggregate.
All windows of one query share the same ``partitionBy/orderBy`` so Spark
sorts once and evaluates them in a single ``Window`` operator.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def series_window(keys: Sequence[str], order: str | Sequence[str]):
    order = [order] if isinstance(order, str) else list(order)
    return Window.partitionBy(*keys).orderBy(*order)


def rolling_mean(df: DataFrame, col: str, keys: Sequence[str], order: str, width: int = 12,
                 name: str | None = None) -> DataFrame:
    """WN1: right-aligned moving mean, NULL until ``width`` rows are present."""
    w = series_window(keys, order).rowsBetween(-(width - 1), 0)
    name = name or f"{col}_ma{width}"
    full = F.count(F.lit(1)).over(w) == width
    return df.withColumn(name, F.when(full, F.avg(col).over(w)))


def lags(df: DataFrame, col: str, keys: Sequence[str], order: str, ks: Sequence[int]) -> DataFrame:
    """WN2: positional lags ``{col}_l{k}``."""
    w = series_window(keys, order)
    return df.select("*", *[F.lag(col, k).over(w).alias(f"{col}_l{k}") for k in ks])


def diffs(df: DataFrame, col: str, keys: Sequence[str], order: str, max_lag: int) -> DataFrame:
    """WN3: first difference ``d_{col}`` and its lags ``d_{col}_l1..l{max_lag}``."""
    w = series_window(keys, order)
    d = F.col(col) - F.lag(col, 1).over(w)
    lagged = [(F.lag(col, k).over(w) - F.lag(col, k + 1).over(w)).alias(f"d_{col}_l{k}")
              for k in range(1, max_lag + 1)]
    return df.select("*", d.alias(f"d_{col}"), *lagged)


def lag_selfjoin(df: DataFrame, col: str, keys: Sequence[str], step_col: str, k: int) -> DataFrame:
    """JN5: lag by an equi-join on ``(keys, step - k)`` — for gapless integer steps.

    Splits a long series over many tasks (hash join on the composite key), and
    equals the window ``lag`` when ``step_col`` has no gaps.
    """
    past = df.select(*keys, (F.col(step_col) + k).alias(step_col), F.col(col).alias(f"{col}_l{k}"))
    return df.join(past, on=[*keys, step_col], how="left")


def position(df: DataFrame, keys: Sequence[str], order: str, name: str = "pos") -> DataFrame:
    """WN11: 1-based row position and series length."""
    w = series_window(keys, order)
    return df.withColumn(name, F.row_number().over(w)).withColumn(
        "n_rows", F.count(F.lit(1)).over(Window.partitionBy(*keys)))


def fill_linear(df: DataFrame, col: str, keys: Sequence[str], order: str,
                hold_edges: bool = False, out: str | None = None) -> DataFrame:
    """WN4/WN5: linear interpolation on row position.

    Interior gaps: y0 + (y1 - y0) * ((pos - p0) / (p1 - p0)) between the
    nearest known rows. With ``hold_edges`` leading/trailing gaps take the
    nearest known value, but only when the series has at least two known
    points (otherwise it is returned unchanged).
    """
    out = out or f"{col}_filled"
    w = series_window(keys, order)
    d = df.withColumn("_pos", F.row_number().over(w))
    known = F.when(F.col(col).isNotNull(), F.struct(F.col("_pos").alias("p"), F.col(col).alias("v")))
    d = d.withColumn("_k", known)
    before = w.rowsBetween(Window.unboundedPreceding, 0)
    after = w.rowsBetween(0, Window.unboundedFollowing)
    d = d.select("*", F.last("_k", ignorenulls=True).over(before).alias("_a"),
                 F.first("_k", ignorenulls=True).over(after).alias("_b"),
                 F.count(col).over(Window.partitionBy(*keys)).alias("_nk"))
    a_p, a_v, b_p, b_v = F.col("_a.p"), F.col("_a.v"), F.col("_b.p"), F.col("_b.v")
    interior = a_v + (b_v - a_v) * ((F.col("_pos") - a_p) / (b_p - a_p))
    filled = F.when(F.col(col).isNotNull(), F.col(col)).when(a_p.isNotNull() & b_p.isNotNull(), interior)
    if hold_edges:
        filled = F.when(F.col("_nk") >= 2, F.coalesce(filled, a_v, b_v)).otherwise(F.col(col))
    return d.withColumn(out, filled).drop("_pos", "_k", "_a", "_b", "_nk")


def fill_cubic_local(df: DataFrame, col: str, keys: Sequence[str], order: str,
                     out: str | None = None) -> DataFrame:
    """WN6 (re-aimed smooth fill): local cubic Hermite between the two known
    neighbours, slopes by finite differences to the next known point on each
    side (Catmull–Rom on positions). Edges stay NULL. Windows only.
    """
    out = out or f"{col}_cubic"
    w = series_window(keys, order)
    d = df.withColumn("_pos", F.row_number().over(w))
    d = d.withColumn("_k", F.when(F.col(col).isNotNull(), F.struct(F.col("_pos").alias("p"), F.col(col).alias("v"))))
    before = w.rowsBetween(Window.unboundedPreceding, 0)
    after = w.rowsBetween(0, Window.unboundedFollowing)
    before_x = w.rowsBetween(Window.unboundedPreceding, -1)
    after_x = w.rowsBetween(1, Window.unboundedFollowing)
    d = d.select("*", F.last("_k", ignorenulls=True).over(before).alias("_a"),
                 F.first("_k", ignorenulls=True).over(after).alias("_b"))
    # known point before _a and after _b: carry the previous known struct along
    d = d.withColumn("_kprev", F.last("_k", ignorenulls=True).over(before_x))
    d = d.withColumn("_knext", F.first("_k", ignorenulls=True).over(after_x))
    d = d.withColumn("_a2", F.last(F.when(F.col("_k").isNotNull(), F.col("_kprev")), ignorenulls=True).over(before))
    d = d.withColumn("_b2", F.first(F.when(F.col("_k").isNotNull(), F.col("_knext")), ignorenulls=True).over(after))
    p0, v0, p1, v1 = F.col("_a.p"), F.col("_a.v"), F.col("_b.p"), F.col("_b.v")
    h = p1 - p0
    s = (F.col("_pos") - p0) / h
    sec = (v1 - v0) / h
    m0 = F.coalesce((v1 - F.col("_a2.v")) / (p1 - F.col("_a2.p")), sec)
    m1 = F.coalesce((F.col("_b2.v") - v0) / (F.col("_b2.p") - p0), sec)
    h00 = 2 * s * s * s - 3 * s * s + 1
    h10 = s * s * s - 2 * s * s + s
    h01 = -2 * s * s * s + 3 * s * s
    h11 = s * s * s - s * s
    cubic = h00 * v0 + h10 * h * m0 + h01 * v1 + h11 * h * m1
    filled = F.when(F.col(col).isNotNull(), F.col(col)).when(p0.isNotNull() & p1.isNotNull(), cubic)
    return d.withColumn(out, filled).drop("_pos", "_k", "_a", "_b", "_kprev", "_knext", "_a2", "_b2")


def regime_label(df: DataFrame, breaks: DataFrame, keys: Sequence[str], pos_col: str = "pos") -> DataFrame:
    """WN9: regime number = 1 + number of break positions strictly before the row.

    ``breaks`` has (keys, break_pos) with ``break_pos`` = last row of a
    segment. Joined as (keys, regime) boundaries: small per series.
    """
    b = breaks.groupBy(*keys).agg(F.sort_array(F.collect_list("break_pos")).alias("_bp"))
    j = df.join(b, on=list(keys), how="left")
    cnt = F.size(F.filter(F.coalesce(F.col("_bp"), F.array().cast("array<int>")),
                          lambda p: p < F.col(pos_col)))
    return j.withColumn("regime", (cnt + 1).cast("int")).drop("_bp")


def fraction_windows(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """WN10: positional 0/1 labels by share of rows (n = rows in the series).

    Only when n > 100: ``w1`` rows 1 … max(1, floor(0.25n)); ``w2`` rows
    floor(0.25n)+1 … floor(0.5n). Only when n > 200 as well: ``w3`` rows
    floor(0.7n) … floor(0.85n); ``w4`` rows floor(0.9n) … n.
    """
    w = series_window(keys, order)
    d = df.withColumn("pos", F.row_number().over(w)).withColumn(
        "n_rows", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    n, p = F.col("n_rows"), F.col("pos")
    fl = lambda f: F.floor(n * f)
    big, bigger = n > 100, n > 200
    return d.select(
        "*",
        (big & (p <= F.greatest(F.lit(1), fl(0.25)))).cast("int").alias("w1"),
        (big & (p >= fl(0.25) + 1) & (p <= fl(0.5))).cast("int").alias("w2"),
        (big & bigger & (p >= fl(0.7)) & (p <= fl(0.85))).cast("int").alias("w3"),
        (big & bigger & (p >= fl(0.9))).cast("int").alias("w4"),
    )


def running_sums_long(df: DataFrame, values: dict, keys: Sequence[str], order: str,
                      bucket_col: str, bucket_size: int = 64) -> DataFrame:
    """Running sums and row positions for series too long for one task.

    Two levels: rows are cut into buckets ``floor(bucket_col / bucket_size)``;
    the window runs per (keys, bucket) only; bucket totals and counts form a
    small table whose running totals (a window over keys on that small table)
    are joined back as offsets. Equals the one-window result for any series.

    ``values``: {output name: Column}. Adds ``pos`` and one column per value.
    """
    keys = list(keys)
    b = F.floor(F.col(bucket_col) / bucket_size).alias("_bk")
    d = df.select("*", b, *[c.alias(f"_v_{n}") for n, c in values.items()])
    wb = Window.partitionBy(*keys, "_bk").orderBy(order)
    run = wb.rowsBetween(Window.unboundedPreceding, 0)
    local = d.select("*", F.row_number().over(wb).alias("_lpos"),
                     *[F.sum(f"_v_{n}").over(run).alias(f"_l_{n}") for n in values])
    tot = d.groupBy(*keys, "_bk").agg(F.count(F.lit(1)).alias("_bc"),
                                      *[F.sum(f"_v_{n}").alias(f"_bt_{n}") for n in values])
    wk = Window.partitionBy(*keys).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(*keys, "_bk", F.coalesce(F.sum("_bc").over(wk), F.lit(0)).alias("_oc"),
                     *[F.coalesce(F.sum(f"_bt_{n}").over(wk), F.lit(0.0)).alias(f"_o_{n}") for n in values])
    j = local.join(off, on=[*keys, "_bk"])
    out = j.select(*df.columns, (F.col("_oc") + F.col("_lpos")).cast("int").alias("pos"),
                   *[(F.col(f"_o_{n}") + F.col(f"_l_{n}")).alias(n) for n in values])
    return out


def fill_linear_long(df: DataFrame, col: str, keys: Sequence[str], order: str, bucket_col: str,
                     bucket_size: int = 64, hold_edges: bool = False, out: str | None = None) -> DataFrame:
    """WN4/WN5 for a single very long series: same result as :func:`fill_linear`.

    Positions come from :func:`running_sums_long`; each bucket's first and last
    known points are an aggregate; a window over that small bucket table carries
    the nearest known point across bucket boundaries; inside a bucket the
    ``last/first(ignorenulls)`` windows run per (keys, bucket) only.
    """
    keys = list(keys)
    out = out or f"{col}_filled"
    base = running_sums_long(df, {"_one": F.lit(1)}, keys, order, bucket_col, bucket_size).drop("_one")
    base = base.withColumn("_bk", F.floor(F.col(bucket_col) / bucket_size))
    known = F.when(F.col(col).isNotNull(), F.struct(F.col("pos").alias("p"), F.col(col).alias("v")))
    base = base.withColumn("_k", known)
    bt = base.groupBy(*keys, "_bk").agg(F.max("_k").alias("_last"), F.min("_k").alias("_first"),
                                        F.count(col).alias("_cnt"))
    wk = Window.partitionBy(*keys).orderBy("_bk")
    bt = bt.select(*keys, "_bk",
                   F.last("_last", ignorenulls=True).over(wk.rowsBetween(Window.unboundedPreceding, -1)).alias("_cp"),
                   F.first("_first", ignorenulls=True).over(wk.rowsBetween(1, Window.unboundedFollowing)).alias("_cn"),
                   F.sum("_cnt").over(Window.partitionBy(*keys)).alias("_nk"))
    j = base.join(bt, on=[*keys, "_bk"])
    wb = Window.partitionBy(*keys, "_bk").orderBy(order)
    j = j.select("*",
                 F.coalesce(F.last("_k", ignorenulls=True).over(wb.rowsBetween(Window.unboundedPreceding, 0)),
                            F.col("_cp")).alias("_a"),
                 F.coalesce(F.first("_k", ignorenulls=True).over(wb.rowsBetween(0, Window.unboundedFollowing)),
                            F.col("_cn")).alias("_b"))
    a_p, a_v, b_p, b_v = F.col("_a.p"), F.col("_a.v"), F.col("_b.p"), F.col("_b.v")
    interior = a_v + (b_v - a_v) * ((F.col("pos") - a_p) / (b_p - a_p))
    filled = F.when(F.col(col).isNotNull(), F.col(col)).when(a_p.isNotNull() & b_p.isNotNull(), interior)
    if hold_edges:
        filled = F.when(F.col("_nk") >= 2, F.coalesce(filled, a_v, b_v)).otherwise(F.col(col))
    return j.select(*df.columns, filled.alias(out))
