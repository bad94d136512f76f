"""Literal relations of the stand-in views (FIXTURES.md §4).

Fixed values: dates re-based to the 1995–2001 span of the driver tables.
"""

from __future__ import annotations

# (label, first month, last month), inclusive
WINDOWS = (
    ("W1", "1996-01", "1996-12"),
    ("W2", "1997-01", "1997-12"),
    ("W3", "1998-03", "1999-06"),
    ("W4", "2000-02", "2001-11"),
)

# (label, month)
EVENTS = (
    ("E1", "1996-09"),
    ("E2", "1997-05"),
    ("E3", "1998-03"),
    ("E4", "2000-03"),
    ("E5", "2001-10"),
)

# (term, benchmark value, alternative) — 'two' two-sided, 'greater' one-sided
BENCHMARKS = (
    ("(Intercept)", 2.0, "two"),
    ("x1", 0.5, "two"),
    ("x2", 0.5, "two"),
    ("x1", 1.0, "greater"),
)

LAG_ORDERS = (1, 2, 3, 4)


def month_number(ym: str) -> int:
    y, m = ym.split("-")
    return int(y) * 12 + int(m) - 1


def windows_sql() -> str:
    rows = ", ".join(f"('{l}', {month_number(s)}, {month_number(e)})" for l, s, e in WINDOWS)
    return f"wins(label, s_m, e_m) as (values {rows})"


def events_sql() -> str:
    rows = ", ".join(f"('{l}', {month_number(m)})" for l, m in EVENTS)
    return f"ev(label, ev_m) as (values {rows})"
