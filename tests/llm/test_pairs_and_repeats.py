"""Operators 1 and 8 against brute force."""

import random

import pytest

import brute
from panelstats.llm import ngram_join, suffix_dedup
from panelstats.sources.tables import table


def sample(seed, words="one two three four five six seven eight nine ten".split()):
    rnd = random.Random(seed)
    base = [" ".join(rnd.choice(words) + str(rnd.randrange(40)) for _ in range(60)) for _ in range(4)]
    docs = [None, "", " \n\t", "A", "a b", "A B", "short text of five words", base[0], base[0].upper(), base[0]]
    for b in base:
        for k in range(12):  # near copies with some edits, and long shared passages
            w = b.split()
            for _ in range(k % 6):
                w[rnd.randrange(len(w))] = f"new{rnd.randrange(1000)}"
            docs.append(" ".join(w))
    docs += [base[1] + " " + base[2], base[1][:150] + " other words here " + base[3][50:260], "x " * 3000, "ü" * 5000]
    return docs


def frame(spark, docs, ids=None):
    ids = list(range(len(docs))) if ids is None else ids
    return spark.createDataFrame([(i, t, "keep", 1) for i, t in zip(ids, docs, strict=True)],
                                 "doc_id long, text string, cls string, size int").repartition(3)


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (2, 60)])
def test_groups(spark, n, percent):
    docs = sample(n)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.groups(frame(spark, docs), n, percent).collect()}
    want = brute.components(list(enumerate(docs)), n, percent)
    assert [got[i] for i in range(len(docs))] == want


def test_groups_of_repeated_rows_and_null_ids(spark):
    docs = ["a b c d e"] * 3 + [None, "z y x w v u"]
    got = ngram_join.groups(frame(spark, docs, [5, 5, None, 7, None])).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in got) \
        == [(-1, 3, 5), (-1, 4, -1), (5, 3, 5), (5, 3, 5), (7, 0, 7)]


def test_groups_on_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents", "doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.groups(docs).collect()}
    assert [got[k] for k, _ in rows] == brute.components(rows, 3, 90)


def test_one_per_group_keeps_columns(spark):
    docs = sample(1)
    kept = ngram_join.one_per_group(frame(spark, docs))
    want = brute.components(list(enumerate(docs)), 5, 80)
    assert kept.columns == ["doc_id", "text", "cls", "size"]
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, (_, c) in enumerate(want) if c == i]


def test_long_list_is_not_expanded_into_pairs(spark):
    """A group of near copies: the candidates of a round grow with its size, not its square."""
    rnd = random.Random(3)
    base = [f"w{rnd.randrange(500)}" for _ in range(120)]
    docs = []
    for _ in range(150):
        w = list(base)
        w[rnd.randrange(120)] = f"n{rnd.randrange(10**6)}"
        docs.append(" ".join(w))
    seen = []
    close = ngram_join.Linker.close

    def counted(self, candidates):
        seen.append(candidates.distinct().count())
        return close(self, candidates)

    ngram_join.Linker.close = counted
    try:
        got = ngram_join.groups(frame(spark, docs), 3, 80).collect()
    finally:
        ngram_join.Linker.close = close
    assert {r.component_id for r in got} == {0}
    assert sum(seen) < 20 * len(docs)


def test_empty_table(spark):
    none = frame(spark, ["x"]).where("doc_id < 0")
    assert ngram_join.groups(none).collect() == []
    assert suffix_dedup.remove_repeats(none, 50).collect() == []


@pytest.mark.parametrize("length", [400, 50, 120])
def test_repeats(spark, length):
    rnd = random.Random(4)
    base = "".join(rnd.choice("abcdefgh ") for _ in range(3000))
    docs = ["a" * 2000, "a" * 450, "ab" * 700, base, base[100:1500], "x" + base[700:1300] + "y", base[:399],
            base[10:410], "", None, "éü" * 300, base[2000:2600] + base[100:800], *sample(2)]
    got = suffix_dedup.remove_repeats(frame(spark, docs), length).collect()
    got = {r.doc_id: (sum(s["to"] - s["from"] for s in r.spans), len(r.spans), bytes(r.kept)) for r in got}
    assert [got[i] for i in range(len(docs))] == [x[1:] for x in brute.repeats(docs, length)]


def test_repeats_on_documents_and_report(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents", "doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: r[1:] for r in suffix_dedup.report(suffix_dedup.remove_repeats(docs, 400)).collect()}
    want = brute.repeats([t for _, t in rows], 400)
    assert [got[k] for k, _ in rows] == [(a, b, c, brute.sha(d)) for a, b, c, d in want]


def test_repeated_rows_are_occurrences(spark):
    got = suffix_dedup.remove_repeats(frame(spark, ["q" * 10 + "abcdefghijklmnopqrstuvwxyz" * 3] * 2, [4, 4]), 60).collect()
    assert [len(r.kept) for r in got] == [0, 0]


def test_without_repeats_drops_emptied_documents(spark):
    out = suffix_dedup.without_repeats(frame(spark, ["abcdefghij" * 12, "abcdefghij" * 12, "", "other"]), 60)
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(2, ""), (3, "other")]


def test_one_per_group_keeps_one_of_repeated_rows_and_every_text_of_an_id(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(80)) for x in "abcd")
    docs = [(1, a), (2, a), (2, b), (5, c), (5, c), (None, d), (None, d), (None, None), (None, None), (7, a + " more")]
    df = frame(spark, [t for _, t in docs], [k for k, _ in docs])
    kept = sorted(((r.doc_id or -1, r.text or "") for r in ngram_join.one_per_group(df).collect()))
    assert kept == [(-1, ""), (-1, ""), (-1, d), (1, a), (2, b), (5, c)]
    left = suffix_dedup.without_repeats(ngram_join.one_per_group(df), 200).collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in left) == kept
