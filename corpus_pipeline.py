"""Corpus pipeline: five stages, each of which works on all that the one before kept.

1. quality rules: documents that break a base rule or that the trees reject go;
2. n-gram Jaccard join on 5-word shingles at 0.8: one document of each group stays
   (the one of least id);
3. suffix-array dedup: strings of ``REPEAT_BYTES`` bytes that start in more than one
   place are cut out (a passage of over 50 words is longer than that);
4. benchmark decontamination: documents with a benchmark window of ten words go;
5. BPE: ids of what is left, and the text they decode to.

Every stage but the last returns the columns of ``documents``; ``n_chars`` follows
the text. An empty table passes through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelstats.llm import bpe, decontaminate, ngram_join, quality, suffix_dedup
from panelstats.llm.common import ready, stage_table
from panelstats.sources.tables import table

REPEAT_BYTES = 200


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    labels = table(spark, sf_dir, "labels", "doc_id", "quality")
    return quality.keep_good(docs, quality.train(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return ngram_join.one_per_group(docs, n=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    out = suffix_dedup.without_repeats(docs, REPEAT_BYTES)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark", "item_id", "text"), n=10)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ready(spark)
    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json")) \
        .withColumn("n_tokens", F.size("ids").cast("long"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    ready(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
