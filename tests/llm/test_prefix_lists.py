"""Lists of the n-gram join: found in one pass, joined under the parities."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelstats.llm import common, ngram_join


@pytest.fixture
def rng():
    return np.random.default_rng(5)


def test_parities_bound_the_difference(rng):
    for _ in range(50):
        a = rng.integers(0, 1 << 63, 300).astype(np.uint64)
        b = np.concatenate((a[rng.integers(0, 40):], rng.integers(0, 1 << 63, rng.integers(0, 40)).astype(np.uint64)))
        d = np.repeat([0, 1], [len(a), len(b)])
        odd = ngram_join._parities(d, np.concatenate((a, b)), 3)
        unlike = sum(int(x).bit_count() for x in (odd[0] ^ odd[1]).view(np.uint64))
        assert unlike <= len(set(a.tolist()) ^ set(b.tolist()))
        assert not odd[2].any()


def test_lists_of_unlike_classes_make_no_pairs(spark):
    """Members of one short list that share nothing but its token: no row leaves the join."""
    words = np.random.default_rng(9).integers(0, 10**6, (24, 200))
    rows = [(i, "the same rare start " + " ".join(f"w{x}" for x in own)) for i, own in enumerate(words)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    profiles = ngram_join.profile(docs, 3, "doc_id", "text")
    own = profiles.where(F.col("cls").isNotNull()).select("cls", "size", *ngram_join.SKETCH)
    lists = own.select(F.lit(1).alias("token"), F.struct("cls", F.col("size").cast("int").alias("size"), F.lit(0).alias("pos"),
                                                         F.lit(0).alias("shared"), *ngram_join.SKETCH).alias("m"))
    a, b = (lists.select("token", F.col("m").alias(c)) for c in "ab")
    met = a.join(b, "token").where(F.col("a.cls") < F.col("b.cls"))
    assert met.count() == 24 * 23 // 2
    assert met.where(ngram_join._fits("a", "b", 90)).count() == 0


@pytest.mark.parametrize("rows", [1, 3, 1000])
def test_shared_lists_across_batches(spark, rng, rows):
    found = [(int(t), int(c), int(c) + 50, 0) for t, c in zip(rng.integers(0, 40, 300), rng.integers(0, 12, 300), strict=True)]
    found += [(99, 1, 51, 0)] * 20 + [(100, c, c + 50, 0) for c in range(12)] * 2 + [(101, 3, 53, 0)]
    post = spark.createDataFrame(found, "token long, cls long, size int, pos int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        got = sorted(map(tuple, ngram_join.shared_lists(post).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    classes = {t: {r[1] for r in found if r[0] == t} for t, *_ in found}
    assert got == sorted({r for r in found if len(classes[r[0]]) > 1})


def test_order_within_a_document(rng):
    d = np.sort(rng.integers(0, 7, 500))
    g = rng.integers(0, 1 << 62, 500).astype(np.uint64)
    g[100:200] = (g[100:200] >> np.uint64(20) << np.uint64(20)) | g[300:400] & np.uint64(7)
    g[200:260] = g[199] ^ np.arange(60).astype(np.uint64)  # alike but for the low bits
    for docs in (d, d + (1 << 20)):
        order = common.order_within(docs, g)
        want = np.lexsort((g, docs))
        assert (g[order] == g[want]).all() and (docs[order] == docs[want]).all()
