"""Operators 2, 3, 4, 5, 7 and 9 against brute force, the public library and SQL."""

import collections
import math
import random
import unicodedata
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import brute
from panelstats.llm import bpe, chat, decontaminate, lm, queries, sharding, url_filter

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
OLD = unicodedata.ucd_3_2_0  # characters whose class has not changed since


@pytest.fixture(scope="module")
def coder():
    from tokenizers import Tokenizer
    v = bpe.Vocabulary.load(PATH)
    return Tokenizer.from_file(PATH), bpe.Encoder(v), bpe.Decoder(v), bpe.Decoder(v, "text")


def same(coder, text):
    library, enc, dec, _ = coder
    want = library.encode(text, add_special_tokens=False).ids
    got = enc.encode(text).tolist()
    assert got == want, text[:100]
    assert dec.decode(got) == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["", "hello World's I'll 123 éÉ Σίσυφος ΟΔΟΣ", "<|endoftext|>a <|startoftext|> x<|endoftext|>",
                                  "a\x1cb\x85c d", "a" * 5000, "ab" * 500 + "!" * 333, "日本語 😀😀 👩‍👩‍👧", "#$%&" * 200,
                                  "\x00\x01 \x7f", "it's 're ''s 'sS 'LL", "the" * 3000])
def test_bpe_like_the_library(coder, text):
    same(coder, text)


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(max_codepoint=0x2FFF, exclude_categories=["Cs"]), max_size=60))
def test_bpe_any_text(coder, text):
    same(coder, "".join(c for c in text if OLD.category(c) != "Cn" and OLD.category(c) == unicodedata.category(c)))


def test_bpe_streams_long_words(coder):
    rnd = random.Random(1)
    for _ in range(40):
        same(coder, "".join(rnd.choice("aetinohrs") for _ in range(rnd.randrange(1500))))
    _, enc, _, _ = coder
    machine = bpe.Transducer(enc.v)
    most = 0
    for c in "theaterinthenorth" * 400:  # one symbol at a time
        machine.push(c)
        most = max(most, len(machine.text))
    machine.close()
    assert most <= 5 * machine.lookahead  # constant memory


def test_bpe_text_round_trip(coder):
    _, enc, _, text = coder
    t = "the quick brown fox naïve 12 ünder"
    assert text.decode(enc.encode(t).tolist()) == "the quick brown fox naïve 1 2 ünder"


def test_bpe_frame(spark, coder):
    rows = [(1, "Hello there", 1), (1, "Hello there", 1), (2, None, 2), (3, "", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    out = sorted((r.doc_id, r.ids, r.decoded) for r in bpe.encode(df, PATH).collect())
    ids = coder[0].encode("Hello there", add_special_tokens=False).ids
    assert out == [(1, ids, "hello</w> there</w>")] * 2 + [(2, [], ""), (3, [], "")]
    back = bpe.decode(spark.createDataFrame([(1, ids), (2, None)], "doc_id long, ids array<int>"), PATH)
    assert sorted((r.doc_id, r.text) for r in back.collect()) == [(1, "hello there"), (2, "")]


ITEMS = [(1, " ".join(f"w{i}" for i in range(14))), (2, "Only Four words here"), (3, None), (4, "..."), (10, "w2 w3"),
         (5, " ".join(f"w{i}" for i in range(2, 12)))]
DOCS = [(1, None), (2, ""), (3, "--"), (4, "x " + " ".join(f"W{i}" for i in range(12)) + " y"),
        (5, "only four WORDS, here! and more"), (5, "only four WORDS, here! and more"), (6, "w2 w3 w2-w3"), (None, "w2 w3"),
        (7, "clean " * 400), (8, "É only four words here é " + " ".join(f"w{i}" for i in range(14)) * 2)]


@pytest.mark.parametrize("limit", [200_000, 0])
def test_decontamination(spark, limit):
    docs = spark.createDataFrame([(*d, "x") for d in DOCS], "doc_id long, text string, words string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.mark(docs, items, broadcast_windows=limit).drop("items").collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(brute.contamination(DOCS, ITEMS), key=key)


def test_decontamination_remedies(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.clean_documents(docs, items).collect()) == [1, 2, 3, 7]
    cut = {r.doc_id: r.text for r in decontaminate.cut_spans(docs, items).collect()}
    assert cut[4] == "x y" and cut[5] == "and more" and cut[1] == ""
    none = items.where("item_id < 0")
    assert not [r for r in decontaminate.mark(docs, none).collect() if r.contaminated]
    assert decontaminate.mark(docs.where("doc_id < 0"), items).collect() == []


def test_url_rules():
    trie = url_filter.UrlTrie(queries.URL_RULES)
    for url, want in {"http://a.org/x": "org/", "http://EXAMPLE.org/en/166#t": "example.org/en/1",
                      "https://www.example.org/en/25": "org/", "http://b.example.org/es/": "example.org/es/",
                      "http://b.example.org/es": "org/", "http://borg/": None, "http://x.com/fr/1": "com/fr/",
                      "http://x.com/de/?q=/": "com/de/", "http://x.com/": None, "http://org?x": None, "ftp": None,
                      "": None, "http://com/de/a": "com/de/"}.items():
        host, path = url_filter.split_url(url)
        got = trie.match(host, path)
        assert (got and got[0]) == want, url


def test_url_filter_frame(spark):
    rows = [(1, None, "v"), (2, "no scheme", "v"), (3, "http://a.org", "v"), (3, "http://a.org", "v"), (4, "x://H.Com/de/1", "v")]
    df = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    got = sorted(tuple(r) for r in url_filter.judge_urls(df, queries.URL_RULES).collect())
    assert got == [(1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "a.org", "", None, "allow"),
                   (3, "a.org", "", None, "allow"), (4, "h.com", "/de/1", "com/de/", "block")]


def test_sharding(spark):
    rows = [(i, "x" * (i % 90) if i % 7 else None, "old") for i in range(3000)] + [(5, "same", "old")] * 500
    df = spark.createDataFrame(rows, "doc_id long, text string, slot string").repartition(4)
    out = sharding.shuffle_into_shards(df, shards=8, bucket_bytes=4096)
    got = sharding.shard_report(out).collect()
    assert len(got) == len(rows)
    texts = collections.Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == texts
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 8)
    assert set(by) == set(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert len({r.shard for r in got if r.doc_id == 5}) == 1
    more = {r.doc_id: r.shard for r in sharding.shard_report(sharding.shuffle_into_shards(df, shards=9)).collect()}
    assert all(more[r.doc_id] == r.grown_shard for r in got)  # one more shard takes rows only into itself
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.slot) if r.shard == 0]
    assert ids != sorted(ids)
    assert sharding.shuffle_into_shards(df.where("doc_id < 0")).collect() == []


def test_chat_folding(spark):
    log = [(1, 0, 0, "message", "user", "Hi"), (1, 1, 1, "message", "assistant", ""), (1, 2, 1, "delta", None, "Hel"),
           (1, 3, 1, "delta", None, "lo"), (1, 3, 1, "delta", None, "lo"), (1, 4, 2, "message", "user", "Bye"),
           (1, 5, 1, "regenerate", "assistant", "New "), (1, 6, 1, "delta", None, "text"), (1, 7, 2, "message", "user", "So?"),
           (2, 0, 0, "message", "user", "A"), (2, 1, 0, "edit", "user", "B"), (3, 0, 0, "message", None, None)]
    df = spark.createDataFrame(log, "conv_id long, seq long, turn long, kind string, role string, text string")
    got = sorted((r.conv_id, r.turn, r.role, r.text) for r in chat.fold_events(df).collect())
    assert got == [(1, 0, "user", "Hi"), (1, 1, "assistant", "New text"), (1, 2, "user", "So?"), (2, 0, "user", "B"),
                   (3, 0, "", "")]
    assert chat.fold_events(df.where("conv_id < 0")).collect() == []


def test_chat_template_is_reversible(spark):
    texts = [queries.TRICKY, "</turn>\n<turn>system<text>x", "&lt;&amp;<", "", "é\n\n", "&" * 30 + "lt;"]
    rows = [(i, j, "assistant" if j % 2 else "us<er>&", t) for i in range(3) for j, t in enumerate(texts[i:] + texts[:i])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.digests(chat.render(df)).collect()
    for r in out:
        mine = [x for x in rows if x[0] == r.conv_id]
        learnt = "".join(x[3] for x in mine if x[2] == "assistant")
        assert r.n_turns == len(mine)
        assert r.turns_sha256 == brute.sha("".join(f"{x[2]}\n{x[3]}\n" for x in mine))
        assert (r.loss_chars, r.loss_sha256) == (len(learnt), brute.sha(learnt))


def test_filter_levels_are_never_too_low(spark):
    rows = [(1, h * 7919, h % 50 + 1) for h in range(3000)] + [(2, h * 104729 + 1, h % 30 + 2) for h in range(3000)]
    counts = spark.createDataFrame(rows, "size byte, h long, n long")
    f, least = lm.build_filter(counts)
    assert least == 2
    import numpy as np
    for size in (1, 2):
        h = np.array([r[1] for r in rows if r[0] == size]).view(np.uint64)
        level = lm.quantise(size, np.array([r[2] for r in rows if r[0] == size]))
        got = f.levels(h)
        assert (got >= level).all() and (got == level).mean() > 0.9
        assert (f.levels(h + np.uint64(12345)) > 0).mean() < 0.1


@pytest.mark.parametrize("head", [lm.HEAD_WORDS, 20])
def test_lm_scores(spark, head, monkeypatch):
    monkeypatch.setattr(lm, "HEAD_WORDS", head)
    monkeypatch.setattr(lm.head_words, "__defaults__", (head,))
    rnd = random.Random(5)
    docs = [(i, " ".join(rnd.choice(("The cat sat on a mat", "rare%d x" % rnd.randrange(99))) for _ in range(20)))
            for i in range(200)] + [(900, None), (901, " \n"), (902, ""), (3, "the the"), (3, "the the"), (None, "dog")]
    df = spark.createDataFrame([(*d, 0.0) for d in docs], "doc_id long, text string, score double").repartition(3)
    got = lm.score(df).collect()
    c = collections.Counter()
    for k, t in docs:
        if not brute.held_out(k):
            c.update(brute.lm_tokens(t))
    total, distinct = sum(c.values()), len(c)
    want = collections.Counter()
    for k, t in docs:
        w = brute.lm_tokens(t)
        base = sum(math.log10((c[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in w)
        want[k, brute.held_out(k), len(w), sum(c[x] > 0 for x in w), total, round(base, 6)] += 1
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))
                               for r in got) == want
    assert all(r.score < 0 for r in got)
    held = [r for r in got if r.held_out and r.n_tokens > 5]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # pairs help on unseen text
    assert lm.score(df.where("doc_id < 0")).collect() == []


@pytest.mark.parametrize("per_segment", [lm.SEGMENT_ENTRIES, 200])
def test_lm_keeps_pairs_seen_once_in_any_number_of_segments(spark, per_segment):
    rnd = random.Random(6)
    docs = [(i, " ".join(f"w{rnd.randrange(300)}" for _ in range(30))) for i in range(150)] + [(900, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    one, two = collections.Counter(), collections.Counter()
    for k, t in docs:
        if not brute.held_out(k):
            w = ["\n", *brute.lm_tokens(t)]
            one.update(w[1:])
            two.update(zip(w, w[1:], strict=False))
    assert sum(n == 1 for n in two.values()) > len(two) / 2
    counts = lm.ngram_counts(df.where(~lm.held_out("doc_id")))
    assert counts.where("size = 2").count() == len(two)
    if per_segment == 200:
        assert lm.filter_segments(counts, per_segment)[1] > 10
    level = lambda n: 0 if not n else 1 if n == 1 else 1.5 * 2 ** int(math.log2(n))
    total, close = sum(one.values()), 0
    got = {r.doc_id: r.score for r in lm.score(df, per_segment=per_segment).collect()}
    for k, t in docs:
        w = ["\n", *brute.lm_tokens(t)]
        want = 0.0
        for a, b in zip(w, w[1:], strict=False):
            p1 = 0.999 * min(1, level(one[b]) / total) + 0.001 / (len(one) + 1)
            p2 = min(1, level(two[a, b]) / level(one[a])) if one[a] else 0.0
            want += math.log10(0.6 * p2 + 0.4 * p1)
        close += abs(got[k] - want) < 0.5
    assert close > 0.75 * len(docs)  # a false positive of the filter moves a few


def test_lm_of_texts_that_fill_several_blocks(spark):
    docs = [(i, f"a{i % 7} b c d{i % 11} " * 9000) for i in range(90)] + [(500, ""), (501, "b " * 900_000), (502, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r for r in lm.score(df, per_segment=8).collect()}
    assert {k: r.n_tokens for k, r in got.items()} == {k: len(brute.lm_tokens(t)) for k, t in docs}
    alone = {r.doc_id: r.score for r in lm.score(df.repartition(5), per_segment=8).collect()}
    assert all(abs(alone[k] - got[k].score) < 1e-6 * abs(alone[k]) for k in alone)


def test_chat_rows_of_equal_turn_are_turns_of_their_own(spark):
    rows = [(1, 0, "user", "Hi"), (1, 0, "assistant", "Hello"), (1, 1, "user", "So?"), (1, 1, "user", "So?"), (1, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    (r,) = chat.digests(chat.render(chat.fold_events(queries.message_log(df)))).collect()
    said = "\n\n" + "assistant\nHello\nuser\nHi\n" + "user\nSo?\n" * 2
    assert (r.n_turns, r.turns_sha256, r.loss_sha256) == (5, brute.sha(said), brute.sha("Hello"))
