"""Physical-plan guards for every registered query.

* no Cartesian product / nested-loop join (no cross joins, no theta joins);
* no row-at-a-time Python UDF (``BatchEvalPython``) — only Arrow UDFs;
* the raw ``lineitem`` table is scanned at most once per plan (multi-use
  panels are materialised, rank frames are written once);
* every raw-table scan reads a pruned column set.
"""

import re

import pytest

from conftest import SF_SMALL
from panelstats.plans import registry

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_plan_shape(spark, name):
    df = registry.queries()[name](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in FORBIDDEN:
        assert bad not in plan, f"{name}: {bad}"
    raw = re.findall(r"FileScan parquet \[([^\]]*)\][^\n]*lineitem\.parquet", plan)
    assert len(raw) <= 1, f"{name}: lineitem scanned {len(raw)} times"
    for cols in raw:
        assert len(cols.split(",")) <= 6, f"{name}: wide scan {cols}"
