"""The registered queries run, and agree with their SQL where they have one."""

import pytest

from oracle_check import compare, duck_con
from panelstats.llm import queries

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    problems, _ = compare(spark, duck_con(SMALL), name, queries.queries()[name], queries.oracle_sql()[name], SMALL, tol=0)
    assert not problems, problems


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_rows(spark, name):
    source = "pages" if name.startswith("op6_") else "documents"
    rows = spark.read.parquet(f"{SMALL}/{source}.parquet").count()
    assert queries.queries()[name](spark, SMALL).count() == rows
