"""Stand-in inputs derived from the driver tables.

``panel``         entity x month panel from ``lineitem`` (decimal sums, exact)
``panel_sparse``  ``panel`` with ``x2`` kept in Decembers only (gaps to fill)
``panel_wide``    as ``panel`` but one entity per supplier (entity count grows
                  with the scale factor; used by the bench)
``series``        hourly irregular series from ``events``
``rows``          row-level regression input (all of ``lineitem``)

Every view is a lazy plan: the scan keeps only the named columns and the
monthly aggregate is a partial + final hash aggregate (map-side combine), so a
hot entity does not land in one task before the data is reduced.

``materialize=True`` writes the (small: entities × periods) aggregate once as
a Parquet table under the shared checkpoint folder and returns a plan that
reads it. Queries that
use a panel several times (fit, join back, several tests) pass it, so the raw
table is scanned once instead of once per branch — Spark does not reuse the
exchanges here because join-inferred filters differ between branches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .tables import table

PANEL_COLUMNS = ("entity", "t", "m", "y", "x1", "x2")


def month_index(d: Column) -> Column:
    """Integer month number ``year*12 + month - 1`` used for lag arithmetic."""
    return (F.year(d) * 12 + F.month(d) - 1).cast("int")


def month_start(m: Column) -> Column:
    """Inverse of :func:`month_index` — first day of the month as DATE."""
    return F.make_date(F.floor(m / 12).cast("int"), (m % 12 + 1).cast("int"), F.lit(1))


def _exact_mean(c: str) -> Column:
    """Mean of a 2-decimal column, exact and independent of summation order.

    Values are summed as integer cents (``bigint``) and divided once: for inputs
    with at most two decimals this is the same double as ``cast(sum(cast(c as
    decimal(18,2))) as double) / count(*)`` (both are the correctly rounded
    S/100/count), but runs on longs instead of BigDecimal — ~2× faster.
    """
    cents = F.floor(F.col(c) * 100 + 0.5).cast("long")
    return F.sum(cents).cast("double") / 100 / F.count(F.lit(1))


def _monthly(li: DataFrame, entity: Column) -> DataFrame:
    agg = (
        li.groupBy(entity.alias("entity"), month_index(F.to_date("l_shipdate")).alias("m"))
        .agg(
            (_exact_mean("l_extendedprice") / 1000).alias("y"),
            (_exact_mean("l_discount") * 100 - 5).alias("x1"),
            (_exact_mean("l_quantity") - 25.5).alias("x2"),
        )
    )
    return agg.select("entity", month_start(F.col("m")).alias("t"), "m", "y", "x1", "x2")


def _maybe(df: DataFrame, materialize: bool) -> DataFrame:
    return cut_lineage(df) if materialize else df


def panel(spark: SparkSession, sf_dir: str, materialize: bool = False) -> DataFrame:
    li = table(spark, sf_dir, "lineitem", "l_returnflag", "l_linestatus", "l_shipdate",
               "l_extendedprice", "l_discount", "l_quantity")
    return _maybe(_monthly(li, F.concat("l_returnflag", "l_linestatus")), materialize)


def panel_wide(spark: SparkSession, sf_dir: str, materialize: bool = False) -> DataFrame:
    li = table(spark, sf_dir, "lineitem", "l_suppkey", "l_shipdate",
               "l_extendedprice", "l_discount", "l_quantity")
    return _maybe(_monthly(li, F.col("l_suppkey").cast("string")), materialize)


def panel_sparse(spark: SparkSession, sf_dir: str, materialize: bool = False) -> DataFrame:
    p = panel(spark, sf_dir)
    return _maybe(p.withColumn("x2", F.when(F.month("t") == 12, F.col("x2"))), materialize)


def series(spark: SparkSession, sf_dir: str, materialize: bool = False) -> DataFrame:
    ev = table(spark, sf_dir, "events", "event_type", "ts", "value")
    # hour start built from the fields: time-zone free for TIMESTAMP_NTZ
    # (date_trunc would round-trip through the session zone)
    ts = F.col("ts")
    hour = F.make_timestamp_ntz(F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts), F.lit(0), F.lit(0))
    return _maybe(
        ev.groupBy(F.col("event_type").alias("entity"), hour.alias("t"))
        .agg(_exact_mean("value").alias("y"), F.count(F.lit(1)).alias("n")), materialize)


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem", "l_returnflag", "l_extendedprice",
               "l_quantity", "l_discount")
    return li.select(
        F.col("l_returnflag").alias("entity"),
        F.col("l_extendedprice").alias("y"),
        F.col("l_quantity").alias("x1"),
        F.col("l_discount").alias("x2"),
    )
