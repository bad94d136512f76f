import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"
FIXTURE = os.path.join(ROOT, "tests", "data", "series277.csv")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from panelstats.session import ensure_checkpoint_dir
    s = (SparkSession.builder.master("local[*]").appName("panelstats-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(s)
    yield s


@pytest.fixture(scope="session")
def ref_series(spark):
    """The 277-row monthly reference series as a one-entity panel."""
    from pyspark.sql import functions as F

    from panelstats.sources.views import month_index
    df = spark.read.option("header", True).schema("t date, y double, x1 double, x2 double").csv(FIXTURE)
    return df.select(F.lit("ref").alias("entity"), "t", month_index(F.col("t")).alias("m"), "y", "x1", "x2").cache()
