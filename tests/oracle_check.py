"""Compare registered Spark queries with their DuckDB oracle SQL.

Mirrors the driver's gate: column names sorted, row count, column types and
an order-insensitive comparison of values. Run as a script:

    python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

import duckdb  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

_SPARK_TO_DUCK = {
    T.LongType: "BIGINT", T.IntegerType: "INTEGER", T.DoubleType: "DOUBLE",
    T.StringType: "VARCHAR", T.DateType: "DATE", T.TimestampNTZType: "TIMESTAMP",
    T.BooleanType: "BOOLEAN", T.ShortType: "SMALLINT", T.FloatType: "FLOAT",
}


def duck_con(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"create view {t} as select * from read_parquet('{p}')")
    return con


def _norm(v):
    if isinstance(v, float) and math.isnan(v):
        return "NaN"
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    return v


def _key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def _close(x, y, tol):
    if x == y:
        return True
    if tol and isinstance(x, float) and isinstance(y, float):
        return abs(x - y) <= tol
    return False


def compare(spark, con, name, fn, sql, sf_dir, tol: float = 0.0):
    """Problems found (empty list = match). ``tol`` > 0 allows that much on doubles
    (used by the small-scale pytest run, where 6-decimal rounding ties can flip)."""
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_types = {f.name: _SPARK_TO_DUCK.get(type(f.dataType), f.dataType.simpleString())
               for f in sdf.schema.fields}
    s_rows = [tuple(_norm(v) for v in r) for r in sdf.collect()]
    s_cols = sdf.columns
    t1 = time.time()
    rel = con.sql(sql)
    d_cols = rel.columns
    d_types = {c: str(t) for c, t in zip(d_cols, rel.types)}
    d_rows = [tuple(_norm(v) for v in r) for r in rel.fetchall()]
    problems = []
    if sorted(s_cols) != sorted(d_cols):
        problems.append(f"columns spark={sorted(s_cols)} duck={sorted(d_cols)}")
        return problems, t1 - t0
    for c in s_cols:
        if s_types[c] != d_types[c]:
            problems.append(f"type {c}: spark={s_types[c]} duck={d_types[c]}")
    if len(s_rows) != len(d_rows):
        problems.append(f"rows spark={len(s_rows)} duck={len(d_rows)}")
    order = sorted(s_cols)
    si = [s_cols.index(c) for c in order]
    di = [d_cols.index(c) for c in order]
    a = sorted((tuple(r[i] for i in si) for r in s_rows), key=_key)
    b = sorted((tuple(r[i] for i in di) for r in d_rows), key=_key)
    bad = 0
    for ra, rb in zip(a, b):
        if not all(_close(x, y, tol) for x, y in zip(ra, rb)):
            bad += 1
            if bad <= 3:
                diffs = [(c, x, y) for c, x, y in zip(order, ra, rb) if not _close(x, y, tol)]
                problems.append(f"value diff {diffs[:4]}")
    if bad:
        problems.append(f"{bad} differing rows of {len(a)}")
    return problems, t1 - t0


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    import __spark_entry__ as E
    from panelstats.session import get_spark
    spark = get_spark()
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck_con(sf_dir)
    failed = 0
    for name in names or sorted(qs):
        if name not in sqls:
            t0 = time.time()
            n = qs[name](spark, sf_dir).count()
            print(f"ROWS  {name:28s} rows={n} {time.time() - t0:.1f}s", flush=True)
            continue
        try:
            probs, sec = compare(spark, con, name, qs[name], sqls[name], sf_dir)
        except Exception as e:  # report and continue
            probs, sec = [f"error {type(e).__name__}: {str(e)[:300]}"], 0.0
        failed += bool(probs)
        print(f"{'FAIL' if probs else 'OK  '}  {name:28s} {sec:.1f}s", flush=True)
        for p in probs:
            print("      ", p, flush=True)
    print(f"failed={failed}")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
