"""What the n-gram join counts, orders and writes for classes in long lists."""

from __future__ import annotations

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from panelstats.llm import ngram_join


def texts(own, common, n_docs=40):
    """Documents of ``own`` words of their own and ``common`` that every one has."""
    passage = " ".join(f"c{k}" for k in range(common))
    return [" ".join(f"d{i}w{k}" for k in range(own)) + " " + passage for i in range(n_docs)]


def frame(spark, docs, ids=None):
    ids = range(len(docs)) if ids is None else ids
    return spark.createDataFrame(list(zip(ids, docs, strict=True)), "doc_id long, text string").repartition(3)


def linked(spark, df):
    full = ngram_join.profile(df, 3, "doc_id", "text")
    return ngram_join.Linker(df, full.where("counts is null"), 3, 90, "doc_id", "text")


def test_exact_lists_write_no_shingle_of_one_class_alone(spark, monkeypatch):
    """150 shingles of each document are its own: they are counted, but no table holds them."""
    docs = texts(150, 40)
    linker = linked(spark, frame(spark, docs))
    written = []
    stage = ngram_join.stage_table

    def counted(df, name):
        out = stage(df, name)
        cells = F.size("shingles") if "shingles" in out.columns else F.lit(1)
        written.append(out.agg(F.coalesce(F.sum(cells), F.lit(0))).first()[0])
        return out

    monkeypatch.setattr(ngram_join, "stage_table", counted)
    lists = ngram_join._exact_lists(linker, linker.reps.select("cls"))
    monkeypatch.undo()
    sets = [brute.shingles(t, 3) for t in docs]
    often = collections.Counter(x for s in sets for x in s)
    assert {len(s) for s in sets} == {188} and sum(v > 1 for v in often.values()) == 38
    assert max(written) <= 38 * len(docs)
    assert lists.count() == 0  # the prefix of 19 has no common shingle


@pytest.mark.parametrize("repeat", [False, True])
def test_exact_lists_are_the_prefixes_in_rare_first_order(spark, repeat):
    """Also if every row stands twice in the table."""
    docs = texts(6, 40, 30) + texts(6, 60, 5)
    df = frame(spark, docs)
    linker = linked(spark, df.unionByName(df) if repeat else df)
    every = linker.reps.select(F.col("cls").alias("x"), F.col("cls").alias("y"))
    sets = collections.defaultdict(set)
    for r in linker.shingles(every).collect():
        sets[r.cls].add(r.token)
    often = collections.Counter(t for s in sets.values() for t in s)
    want = []
    for cls, s in sets.items():
        keep = len(s) - -(-len(s) * 90 // 100) + 1
        alone = sum(often[t] == 1 for t in s)
        order = sorted(s, key=lambda t: (often[t], t))[:keep]
        want += [(t, cls, len(s), pos, pos - alone, alone) for pos, t in enumerate(order) if often[t] > 1]
    met = collections.Counter(r[0] for r in want)
    got = ngram_join._exact_lists(linker, linker.reps.select("cls")).select("token", "cls", "size", "pos", "shared", "rank")
    assert sorted(map(tuple, got.collect())) == sorted(r for r in want if met[r[0]] > 1) != []


def test_positions_are_one_order(spark):
    rng = np.random.default_rng(2)
    d = np.repeat(np.arange(5), [40, 0, 25, 60, 3])
    g = np.concatenate([np.sort(rng.integers(0, 1 << 62, k)) for k in (40, 0, 25, 60, 3)])
    level = rng.integers(0, 4, len(d)).astype(np.uint8) * (rng.random(len(d)) < 0.5)
    for take in ([5, 1, 20, 61, 3], [40, 1, 3, 10, 1]):
        take = np.array(take)
        pos = ngram_join._positions(d, level, take)
        order = np.lexsort((g, level, d))
        want = np.empty(len(d), np.int64)
        want[order] = np.concatenate([np.arange(k) for k in (40, 0, 25, 60, 3)])
        inside = want < take[d]
        assert ((pos < take[d]) == inside).all() and (pos[inside] == want[inside]).all()


def test_common_shingles_come_last(spark):
    """Before, shingles that fell together with a common one came last as well; each counts by itself."""
    docs = texts(150, 40)
    df = frame(spark, docs)
    table = ngram_join.frequency_table(ngram_join.profile(df, 3, "doc_id", "text"))
    assert (table > 0).sum() <= 38 and table.max() == int(4 * np.log2(len(docs)) - 3)
    assert ngram_join.shared_lists(ngram_join.postings(df, table, 3, 90, "text")).count() == 0


@pytest.mark.parametrize("few", [0, 1 << 17])
def test_sets_by_map_of_ids(spark, monkeypatch, few):
    """Wanted texts are found through the map of ids too, also for null and repeated ids."""
    docs = texts(20, 10)
    ids = [None, 7, 7, -1, *range(10, 46)]
    df = frame(spark, docs, ids)
    linker = linked(spark, df)
    wanted = linker.reps.where("rep is null or rep < 20").select(F.col("cls").alias("x"), F.col("cls").alias("y"))
    monkeypatch.setattr(ngram_join, "FEW", few)
    got = linker.sets(wanted).collect()
    assert len(got) == len({r.cls for r in got}) == 14
    assert all(len(set(r.shingles)) == len(r.shingles) == 28 for r in got)
    flat = {tuple(r) for r in linker.shingles(wanted).collect()}
    assert flat == {(r.cls, t) for r in got for t in r.shingles}
