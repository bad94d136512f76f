"""Arrow batches of texts."""

from __future__ import annotations

from panelstats.llm import common


def test_batches_of_texts_are_bounded(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    try:
        spark.conf.unset(name)
        common.ready(spark)
        assert int(spark.conf.get(name)) == common.BATCH_ROWS
        spark.conf.set(name, "77")
        common.ready(spark)
        assert spark.conf.get(name) == "77"
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
