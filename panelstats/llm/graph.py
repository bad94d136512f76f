"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stage_table


def _is_stars(e: DataFrame) -> bool:
    """Every node hangs on one node at most, and one that hangs carries none."""
    ends = e.select(F.col("a").alias("u"), F.lit(1).alias("hangs"), F.lit(0).alias("carries")) \
        .unionByName(e.select(F.col("b").alias("u"), F.lit(0).alias("hangs"), F.lit(1).alias("carries")))
    return ends.groupBy("u").agg(F.sum("hangs").alias("h"), F.max("carries").alias("c")) \
        .where((F.col("h") > 1) | (F.col("h") > 0) & (F.col("c") > 0)).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``node, comp`` for every node of ``edges`` (columns ``a``, ``b``); ``comp`` is the
    least node of its component. Each round is written, so that its plan does not
    grow; a node's many neighbours are only ever reduced by a partial minimum."""
    lowest = edges.where(F.col("a") != F.col("b")) \
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = stage_table(lowest, "edges")
    while not _is_stars(e):
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")) \
            .unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")) \
            .select("u", F.least("m", "u").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        near = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        old, e = e, stage_table(near.select(F.explode(F.array(
            F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
            .where(F.col("a") != F.col("b")).distinct(), "edges")
        discard(old)
    return e.select(F.col("a").alias("node"), F.col("b").alias("comp")) \
        .unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())
