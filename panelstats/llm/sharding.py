"""Operator 5: two-pass external shuffle into shards (DataFrame functions only).

Pass 1 gives every row its shard and a bucket inside the shard, by seeded
hashes, and writes that assignment with the row to a table in the shared
checkpoint folder; a lost executor re-reads it and sees the same draw. The
number of buckets follows from the bytes present, so that one bucket is about
``bucket_bytes`` however large the input is. Pass 2 brings each bucket together,
puts it in the order of the written draws, so that a repeated task finds the
same list, and applies Spark's Fisher-Yates ``shuffle`` to it; a shard is its
shuffled buckets one after another.

The shard is the row of highest random weight: ``argmax over s of hash(id, s)``.
Only the id and the number of shards decide, and one more shard takes rows
solely into itself (law ``key``). The bucket also hashes a per-row draw, so
neither equal texts nor a repeated id can fill one bucket.

Defined results: a null text has 0 bytes and the CRC of the empty string; null
ids share the shard that hash(null) picks; repeated rows each keep a slot; an
empty table gives an empty result; columns named ``shard``, ``slot`` or
``grown_shard`` in the input are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage_table

ROW_OVERHEAD = 16


def row_bytes(text: str) -> Column:
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + F.lit(ROW_OVERHEAD)


def heaviest_shard(key: str, shards: int, seed: int) -> Column:
    """Highest-random-weight shard of a key."""
    draws = [F.struct(F.xxhash64(F.lit(seed), F.lit(s), F.col(key)).alias("w"), F.lit(s).alias("s"))
             for s in range(shards)]
    return F.array_max(F.array(*draws))["s"]


def scatter(rows: DataFrame, shards: int = 40, seed: int = 17, key: str = "doc_id", text: str = "text",
            bucket_bytes: int = 8 << 20) -> DataFrame:
    """Pass 1: rows with ``shard``, ``grown_shard`` and ``bucket``, written once."""
    rows = rows.drop("shard", "grown_shard", "bucket", "slot", "draw")
    total = rows.agg(F.sum(row_bytes(text))).first()[0] or 0
    per_shard = max(1, -(-total // (shards * bucket_bytes)))
    drawn = (rows
             .withColumn("shard", heaviest_shard(key, shards, seed))
             .withColumn("grown_shard", F.when(
                 F.xxhash64(F.lit(seed), F.lit(shards), F.col(key))
                 > F.xxhash64(F.lit(seed), F.col("shard"), F.col(key)), F.lit(shards)).otherwise(F.col("shard")))
             .withColumn("draw", F.rand(seed))
             .withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 1), F.col(key), F.col("draw")), F.lit(per_shard))))
    return stage_table(drawn, "scatter")


def shuffle_buckets(scattered: DataFrame, seed: int = 17) -> DataFrame:
    """Pass 2: every bucket shuffled; ``slot`` numbers the rows of a shard from 0."""
    names = [c for c in scattered.columns if c not in ("shard", "bucket", "draw")]
    counts = scattered.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n_rows"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("start"))
    item = F.struct("draw", F.struct(*names).alias("row")).alias("item")
    together = (scattered.select("shard", "bucket", item).repartition("shard", "bucket")
                .groupBy("shard", "bucket").agg(F.array_sort(F.collect_list("item")).alias("items")))
    placed = (together.join(offsets, ["shard", "bucket"])
              .select("shard", "start", F.posexplode(F.shuffle(F.col("items"), seed)).alias("pos", "item")))
    return placed.select(*[F.col(f"item.row.{c}").alias(c) for c in names], "shard",
                         (F.col("start") + F.col("pos")).cast("long").alias("slot"))


def shuffle_into_shards(rows: DataFrame, shards: int = 40, seed: int = 17, key: str = "doc_id",
                        text: str = "text", bucket_bytes: int = 8 << 20) -> DataFrame:
    """All columns of ``rows`` plus ``grown_shard``, ``shard`` and ``slot``."""
    return shuffle_buckets(scatter(rows, shards, seed, key, text, bucket_bytes), seed)


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard; files hold runs of slots in order."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot") \
        .write.partitionBy("shard").mode("errorifexists").parquet(path)


def shard_report(sharded: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The digest columns of the contract, from the shuffled rows themselves."""
    return sharded.select(
        F.col(key).alias("doc_id"), row_bytes(text).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
        F.col("grown_shard").cast("int").alias("grown_shard"))
