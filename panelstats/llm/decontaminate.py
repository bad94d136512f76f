"""Operator 3: benchmark decontamination (DataFrame and SQL functions only).

Words are runs of ASCII letters and digits and of all non-ASCII characters,
with A-Z lower-cased. Every item gives its windows of ``n`` consecutive words;
an item of fewer words gives one shorter window. The distinct windows, hashed,
are broadcast if their number is within ``broadcast_windows`` (checked by a
count) and are joined by a shuffle beyond it. Documents are scanned once: each
word position gives the hash of the window that starts there, hits are verified
by comparing the words themselves, and a hit marks its words.

Defined results: null and wordless texts have no words and no hits; an empty
benchmark marks nothing; rows with equal id and text share their marks and each
keep a row; an item that is null or wordless has no window; other columns are
ignored (``clean_documents`` keeps them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_WINDOWS = 200_000


def ascii_lower(c: Column) -> Column:
    """A-Z only; lower() is the fast way where every character is ASCII."""
    return F.when(F.char_length(c) == F.octet_length(c), F.lower(c)) \
        .otherwise(F.translate(c, UPPER, LOWER))


def words(c: Column) -> Column:
    found = F.split(ascii_lower(F.coalesce(c, F.lit(""))), SPLIT)
    return F.filter(found, lambda w: w != "")


def item_windows(benchmark: DataFrame, n: int, item: str, text: str) -> DataFrame:
    """One row per distinct window: its length, words, hash and the items that have it."""
    w = benchmark.select(F.col(item).cast("string").alias("item"), words(F.col(text)).alias("words")) \
        .where(F.size("words") > 0)
    w = w.withColumn("span", F.least(F.size("words"), F.lit(n)))
    each = w.select("item", "span", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("words") - F.col("span") + 1),
        lambda i: F.slice("words", i, F.col("span")))).alias("window"))
    return each.groupBy("span", "window").agg(F.collect_set("item").alias("items")) \
        .select("span", F.col("window").alias("item_window"), F.xxhash64("window").alias("h"), "items")


def hits(documents: DataFrame, benchmark: DataFrame, n: int = 10, key: str = "doc_id", text: str = "text",
         item: str = "item_id", item_text: str = "text", broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """Verified occurrences by document: ``key, text_hash, spans, items`` where spans are
    (first word from 0, number of words)."""
    from .common import stage_table

    windows = stage_table(item_windows(benchmark, n, item, item_text), "item-windows")
    lengths = sorted(r["span"] for r in windows.select("span").distinct().collect())  # at most n values
    if windows.count() <= broadcast_windows:
        windows = F.broadcast(windows)
    docs = documents.select(F.col(key).alias("key"), F.xxhash64(text).alias("text_hash"),
                            words(F.col(text)).alias("words"))
    docs = docs.where(F.size("words") >= (lengths[0] if lengths else 1))
    at = docs.select("key", "text_hash", "words", F.explode(F.sequence(F.lit(1), F.size("words"))).alias("at"))
    found = None
    for m in lengths:
        w = at.where(F.col("at") <= F.size("words") - m + 1) \
            .select("key", "text_hash", "at", F.slice("words", F.col("at"), F.lit(m)).alias("window"))
        w = w.withColumn("h", F.xxhash64("window"))
        hit = w.join(windows.where(F.col("span") == m), "h").where(F.col("window") == F.col("item_window")) \
            .select("key", "text_hash", (F.col("at") - 1).alias("start"), F.lit(m).alias("n_span"), "items")
        found = hit if found is None else found.unionByName(hit)
    if found is None:
        found = docs.limit(0).select("key", "text_hash", F.lit(0).alias("start"), F.lit(0).alias("n_span"),
                                     F.array().cast("array<string>").alias("items"))
    return found.groupBy("key", "text_hash").agg(
        F.array_sort(F.collect_set(F.struct("start", "n_span"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))


def covered(spans: Column) -> Column:
    """Number of words inside sorted (start, length) spans; overlaps count once."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def step(acc, s):
        end = s["start"] + s["n_span"]
        return F.struct(F.greatest(acc["end"], end).alias("end"),
                        (acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], s["start"]))).alias("n"))

    return F.aggregate(spans, zero, step, lambda a: a["n"])


def mark(documents: DataFrame, benchmark: DataFrame, n: int = 10, key: str = "doc_id", text: str = "text",
         item: str = "item_id", item_text: str = "text", broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """One row per document: words, hit words, items and their digest, verdict."""
    found = hits(documents, benchmark, n, key, text, item, item_text, broadcast_windows)
    found = found.select(F.col("key").alias("hit_key"), F.col("text_hash").alias("hit_hash"),
                         covered(F.col("spans")).alias("n_hit"), "items")
    lean = documents.select(
        F.col(key).alias("doc_id"), F.xxhash64(text).alias("text_hash"),
        F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
        .cast("long").alias("n_words"))
    out = lean.join(found, F.col("doc_id").eqNullSafe(F.col("hit_key")) & (F.col("text_hash") == F.col("hit_hash")),
                    "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                      F.size(items).cast("long").alias("n_items"),
                      F.sha2(F.concat_ws(",", items).cast("binary"), 256).alias("items_sha256"),
                      (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), items.alias("items"))


def clean_documents(documents: DataFrame, benchmark: DataFrame, n: int = 10, key: str = "doc_id",
                    text: str = "text", item: str = "item_id", item_text: str = "text",
                    min_hit: int = 1) -> DataFrame:
    """Documents with fewer than ``min_hit`` hit words, all columns kept."""
    found = hits(documents, benchmark, n, key, text, item, item_text)
    bad = found.where(covered(F.col("spans")) >= min_hit) \
        .select(F.col("key").alias("_hit_key"), F.col("text_hash").alias("_hit_hash"))
    return documents.join(bad, F.col(key).eqNullSafe(F.col("_hit_key"))
                          & (F.xxhash64(F.col(text)) == F.col("_hit_hash")), "left_anti")


def cut_spans(documents: DataFrame, benchmark: DataFrame, n: int = 10, key: str = "doc_id", text: str = "text",
              item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The other remedy: ``key`` and the document's normalised words without the hit ones."""
    found = hits(documents, benchmark, n, key, text, item, item_text)
    docs = documents.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("text_hash"),
                            words(F.col(text)).alias("w"))
    out = docs.join(found, F.col("doc_id").eqNullSafe(F.col("key"))
                    & docs["text_hash"].eqNullSafe(found["text_hash"]), "left")
    kept = F.filter("w", lambda w, i: F.coalesce(~F.exists(
        "spans", lambda s: (i >= s["start"]) & (i < s["start"] + s["n_span"])), F.lit(True)))
    return out.select("doc_id", F.concat_ws(" ", kept).alias("text"))
