"""Unlike strings have unlike fingerprints, also those made to collide modulo 2^64."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from panelstats.llm import common, lm, ngram_join, quality, suffix_dedup
from panelstats.llm.common import blocks


def thue_morse(a: str, b: str, size: int = 1024) -> tuple[str, str]:
    word = a
    while len(word) < size:
        word += word.translate(str.maketrans(a + b, b + a))
    return word, word.translate(str.maketrans(a + b, b + a))


PAIRS = [thue_morse(*p) for p in ("ab", "ct", "01")]


def test_equal_bytes_and_only_those():
    rng = np.random.default_rng(3)
    data = bytes(rng.integers(97, 100, 3000, dtype=np.uint8))
    b = next(blocks(pa.array([data.decode()])))
    c = b.prefix()
    for size in (1, 2, 5, 9, 40):
        lo = np.arange(len(data) - size)
        seen = {}
        for i, h in zip(lo.tolist(), b.ranges(c, lo, lo + size).tolist()):
            assert seen.setdefault(data[i:i + size], h) == h
        assert len(set(seen.values())) == len(seen)


def test_texts_longer_than_the_power_tables():
    text = "abcdefg" * 700_000 + "!"
    b = next(blocks(pa.array([text])))
    c = b.prefix()
    lo = np.array([0, 7, 7 * 149_796, 7 * 149_797, 7 * 699_000, 3])
    h = b.ranges(c, lo, lo + 7000)
    assert len(set(h[:5].tolist())) == 1 and h[5] != h[0]
    small = next(blocks(pa.array([text[:7000]])))
    assert small.ranges(small.prefix(), np.array([0]), np.array([7000]))[0] == h[0]


@pytest.mark.parametrize("pair", PAIRS)
def test_thue_morse_words_differ_in_every_operator(spark, pair):
    docs = spark.createDataFrame([(1, pair[0]), (2, pair[1])], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.groups(docs, 3, 90).collect()} == {1: 1, 2: 2}
    kept = {r.doc_id: bytes(r.kept).decode() for r in suffix_dedup.remove_repeats(docs, 1024).collect()}
    assert kept == {1: pair[0], 2: pair[1]}
    lines = spark.createDataFrame([(1, "\n".join(pair))], "doc_id long, text string")
    assert quality.score(lines, None).first().n_dup_lines == 0
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 10][:2]
    texts = spark.createDataFrame(list(zip(ids, pair)), "doc_id long, text string")
    got = lm.score(texts).collect()
    # two training texts, three kinds of token: N = 4, c = 1 for a word and 2 for the end
    want = np.log10(1.1 / (4 + 0.1 * 4)) + np.log10(2.1 / (4 + 0.1 * 4))
    assert [r.base_score for r in got] == pytest.approx([want, want])


def test_power_tables_are_bounded():
    assert common._powers(0)[0].nbytes + common._powers(0)[1].nbytes < 5 << 20
