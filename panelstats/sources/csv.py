"""Delimited text sources and sinks (SC1–SC9).

Numbers are read as text and converted per column — one column may use a
decimal comma while the next uses a decimal point, so there is never a single
global locale. ``try_cast`` keeps dirty cells as NULL under ANSI mode.
Scratch output goes below the session's shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir

_UNNAMED = re.compile(r"^(_c\d+|\s*)$")


def scratch_path(spark: SparkSession, name: str) -> str:
    """Fresh folder under the shared checkpoint dir (valid on every executor)."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "scratch", f"{name}-{uuid.uuid4().hex[:12]}")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, sep: str = ",",
             null_value: str | None = None) -> DataFrame:
    """SC1: header CSV with an explicit schema (no inference pass)."""
    r = spark.read.option("header", True).option("sep", sep)
    if null_value is not None:
        r = r.option("nullValue", null_value)
    if schema is not None:
        r = r.schema(schema)
    return r.csv(path)


def read_text_table(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """All columns as STRING (positional names kept as Spark gives them)."""
    return spark.read.option("header", True).option("sep", sep).option("inferSchema", False).csv(path)


def drop_unnamed(df: DataFrame) -> DataFrame:
    """SC4: drop columns whose header was empty (Spark names them ``_c<i>``)."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if not _UNNAMED.match(c)])


def rename_positional(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """SC3: rename the first ``len(names)`` columns by position; arity checked."""
    if len(df.columns) < len(names):
        raise ValueError(f"expected at least {len(names)} columns, got {len(df.columns)}")
    rest = df.columns[len(names):]
    return df.select(*[F.col(f"`{old}`").alias(new) for old, new in zip(df.columns, names)],
                     *[F.col(f"`{c}`") for c in rest])


def clean_number(c: Column, decimal: str = ".") -> Column:
    """SC5/PR8: trim blanks and tabs, 'NA' → NULL, decimal mark → '.', try_cast."""
    s = F.regexp_replace(c, r"^[\s\"]+|[\s\"]+$", "")
    s = F.when(s.isin("NA", ""), F.lit(None)).otherwise(s)
    if decimal != ".":
        s = F.translate(s, decimal, ".")
    return s.try_cast("double")


def convert_columns(df: DataFrame, numeric: Mapping[str, str], month_col: str | None = None) -> DataFrame:
    """SC2: per-column decimal mark ``{column: ',' or '.'}``; month text → DATE."""
    from ..functions.dates import month_parse
    out = []
    for c in df.columns:
        if c in numeric:
            out.append(clean_number(F.col(f"`{c}`"), numeric[c]).alias(c))
        elif c == month_col:
            out.append(month_parse(F.col(f"`{c}`")).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return df.select(*out)


def write_csv(df: DataFrame, path: str, sep: str = ",", null_value: str | None = None) -> str:
    """SC7: header CSV without row names; one file per partition."""
    w = df.write.mode("overwrite").option("header", True).option("sep", sep)
    if null_value is not None:
        w = w.option("nullValue", null_value)
    w.csv(path)
    return path


def require_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """FL7/ST2: fail at plan-building time if a column is missing."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df
