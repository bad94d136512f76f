"""Month parsing and formatting (PR1–PR6) as JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_parse(c: Column) -> Column:
    """'Dec 2001' or '2001-12' (or 'YYYY-MM-DD') → DATE of the first of the month.

    ANSI mode raises on bad input in ``to_date``; ``try_to_timestamp`` returns
    NULL instead, so formats are tried in turn.
    """
    s = F.trim(c)
    return F.trunc(F.to_date(F.coalesce(
        F.try_to_timestamp(s, F.lit("MMM yyyy")),
        F.try_to_timestamp(F.concat(s, F.lit("-01")), F.lit("yyyy-MM-dd")),
        F.try_to_timestamp(s, F.lit("yyyy-MM-dd")),
    )), "MM")


def month_label(d: Column) -> Column:
    """'%b %Y' style label, e.g. 'Jan 1995'."""
    return F.date_format(d, "MMM yyyy")


def month_slash(d: Column) -> Column:
    """'%m/%Y' style label, e.g. '01/1995'."""
    return F.date_format(d, "MM/yyyy")


def month_extract(c: Column) -> tuple[Column, Column]:
    """PR6: tolerant (year, month) from free text.

    year = characters 1-4 if they form a number; month = the first of
    characters 6-7, 5-6, 1-2 that is a number in 1..12 (only for texts of
    at least 7 characters), else 1. Year NULL → month NULL.
    """
    ys = F.substring(c, 1, 4)
    year = F.when(F.length(ys) == 4, ys.try_cast("double"))
    cands = [F.substring(c, 6, 2), F.substring(c, 5, 2), F.substring(c, 1, 2)]
    nums = [x.try_cast("double") for x in cands]
    ok = [(v >= 1) & (v <= 12) for v in nums]
    month = F.when(ok[0], nums[0]).when(ok[1], nums[1]).when(ok[2], nums[2]).otherwise(F.lit(1.0))
    month = F.when(F.length(c) >= 7, month).otherwise(F.lit(1.0))
    month = F.when(year.isNotNull(), month)
    return year.cast("int"), month.cast("int")
