"""Row transforms that need a group statistic (PR15, FL5, ST1).

Group statistics are computed by a hash aggregate (partial on the map side)
and joined back; AQE turns the join into a broadcast when the aggregate is
small and splits skewed partitions otherwise. No group is sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def zscore(df: DataFrame, value: str, keys: Sequence[str], out: str = "z") -> DataFrame:
    """PR15: (x - mean) / sd (n-1) within ``keys``."""
    st = df.groupBy(*keys).agg(F.avg(value).alias("_mu"), F.stddev_samp(value).alias("_sd"))
    j = df.join(st, on=list(keys), how="left")
    return j.withColumn(out, F.try_divide(F.col(value) - F.col("_mu"), F.col("_sd"))).drop("_mu", "_sd")


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[str], payload: Sequence[str],
                 count_col: str = "n_dup") -> DataFrame:
    """FL5: keep the first row per key by ``order`` (ties: payload values), count duplicates."""
    first = F.min(F.struct(*[F.col(c) for c in [*order, *payload]])).alias("_f")
    g = df.groupBy(*keys).agg(first, F.count(F.lit(1)).alias(count_col))
    return g.select(*keys, *[F.col(f"_f.{c}").alias(c) for c in [*order, *payload]], count_col)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """FL5: keys that occur more than once."""
    return df.groupBy(*keys).count().filter(F.col("count") > 1)


def union_by_name(*dfs: DataFrame) -> DataFrame:
    """ST1: union by column name, missing columns filled with NULL."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out
