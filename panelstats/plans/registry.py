"""Registry of named queries and their DuckDB oracle SQL.

Each query is ``fn(spark, sf_dir) -> DataFrame``. ``sql`` is ANSI SQL that
DuckDB runs over the driver's tables; it is ``None`` for operators whose
result is checked by unit tests against numpy instead (rows-only in the
driver's gate).
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ready

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name!r}")

        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ready(spark)  # shared checkpoint folder + package importable in workers
            return fn(spark, sf_dir)

        _QUERIES[name] = run
        if sql is not None:
            _SQL[name] = sql
        return fn
    return deco


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every DOUBLE column (same rule is applied in the oracle SQL)."""
    return df.select(*[
        F.round(F.col(f.name), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType)
        else F.col(f.name)
        for f in df.schema.fields
    ])


def _load_all() -> None:
    # Importing the modules registers their queries.
    from . import q_prep, q_describe, q_windows, q_models, q_diag, q_breaks, q_regimes, q_smooth  # noqa: F401


def queries() -> dict[str, QueryFn]:
    _load_all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(_SQL)
