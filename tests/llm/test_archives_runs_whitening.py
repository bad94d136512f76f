"""Operators 11 to 13 against brute force, byte-exact round trips and numpy."""

import hashlib
import io
import os
import random
import resource
import tempfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from panelstats.llm import queries, warc, whitening
from panelstats.llm.common import blocks
from panelstats.llm.periodic_runs import OrderedPositions, periodic_runs, runs_in_block

SMALL = "/root/testdata/sf0.001"


# Operator 11

def archives(spark, rows, schema="page_id long, url string, html string"):
    path = os.path.join(tempfile.mkdtemp(prefix="run-"), "warc")
    warc.write_archives(spark.createDataFrame(rows, schema).repartition(3), path)
    return path


def test_archives_round_trip_ties_nulls_and_short_payloads(spark):
    long, hot = "x<p>é</p>" * 20, "hot page " * 30
    separator = warc.SEPARATOR.decode()
    rows = [(5, "http://a/1", long), (3, "http://a/2\r\nWARC-Type: forged", long), (3, "http://a/3", long), (None, None, long),
            (7, "http://b", None), (8, "http://b", ""), (9, "http://c", "short"), (2, "http://c", "short"),
            (11, "http://d", separator * 60), (12, "http://d", "\r\n\r\nWARC/1.1\r\n\r\n" * 20),
            (13, "http://e", "é" * 49), (14, "http://e", "é" * 49), (15, "http://f", "é" * 50), (16, "http://f", "é" * 50),
            (None, "u", "y" * 200), (None, "v", "y" * 200)] + [(100 + i, "h", hot) for i in range(300)]
    got = warc.read_archives(spark, archives(spark, rows)).collect()
    assert len(got) == len(rows)
    by_text = {}
    for page, _, text in rows:
        by_text.setdefault(text or "", []).append(page)

    def expected(page, text):
        text = text or ""
        ids = [p for p in by_text[text] if p is not None]
        again = len(text.encode()) >= 100 and ids and page != min(ids)
        return (str(page), len(text.encode()), hashlib.sha256(text.encode()).hexdigest(),
                "revisit" if again else "response", str(min(ids)) if again else "None")

    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) \
        == sorted(expected(p, t) for p, _, t in rows)
    assert sorted(bytes(r.payload).decode() for r in got if r.record_type == "response") \
        == sorted(t or "" for p, _, t in rows if expected(p, t)[3] == "response")
    assert all(r.payload is None for r in got if r.record_type == "revisit")


def test_archive_files_are_plain_zstandard_with_a_leading_dictionary(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    path = os.path.join(tempfile.mkdtemp(prefix="run-"), "warc")
    warc.write_archives(pages.repartition(2), path)
    files = [os.path.join(path, f) for f in os.listdir(path) if f.startswith("part-")]
    records = []
    for name in files:
        data = open(name, "rb").read()
        assert data[:4] == warc.DICTIONARY_MAGIC
        size = int.from_bytes(data[4:8], "little")
        dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8:8 + size]))
        assert dictionary.dict_id()
        reader = zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(io.BytesIO(data[8 + size:]), read_across_frames=True)
        text = reader.read()
        assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
        records += [line for line in text.split(b"\r\n") if line.startswith(b"Page-ID: ")]
    assert sorted(int(r[9:]) for r in records) == sorted(r.page_id for r in pages.collect())


def test_archives_split_anywhere_and_empty_tables(spark):
    path = archives(spark, [(i, "u", f"page {i} " * 40) for i in range(200)])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "777")
    try:
        got = warc.read_archives(spark, path)
        assert sorted(bytes(r.payload) for r in got.collect()) == sorted(f"page {i} ".encode() * 40 for i in range(200))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert warc.read_archives(spark, archives(spark, [])).count() == 0


def test_archives_ignore_other_columns(spark):
    path = archives(spark, [(1, "u", "t" * 100, "a", "b", 3), (2, "u", "t" * 100, "a", "b", 3)],
                    "page_id long, url string, html string, digest string, payload string, size int")
    assert sorted((r.page_id, r.record_type) for r in warc.read_archives(spark, path).collect()) == [("1", "response"), ("2", "revisit")]


def test_frames_never_hold_the_separator():
    rnd = random.Random(3)
    for n in range(200):
        data = b"".join(rnd.choice([warc.SEPARATOR, rnd.randbytes(rnd.randint(1, 9)), b"P*M", b"\0" * 4]) for _ in range(n))
        made = warc.frame(data, None)
        assert warc.SEPARATOR not in made
        assert zstandard.ZstdDecompressor().decompressobj().decompress(made) == data


# Operator 12

def plain_runs(w, least=6, exponent=4):
    n, out = len(w), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least, exponent * q) and \
                    not any(all(w[x] == w[x + p] for x in range(i, i + size - p)) for p in range(1, q)):
                out.append((i, size, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    drop = {i for s, size, q in runs for i in range(s + q, s + size)}
    return " ".join(x for i, x in enumerate(w) if i not in drop)


@pytest.mark.parametrize("least,exponent", [(6, 4), (2, 2), (5, 3), (7, 2)])
def test_runs_equal_brute_force(least, exponent):
    rnd = random.Random(least)
    for _ in range(250):
        docs = []
        for _ in range(rnd.randint(1, 6)):
            w = [rnd.choice(["a", "bb", "cé"][:rnd.choice([1, 2, 3])]) for _ in range(rnd.choice([0, 1, 5, 6, 12, 40, 80]))]
            if rnd.random() < 0.5:
                a, p = rnd.randint(0, 4), rnd.randint(1, 6)
                w = [w[a + (i - a) % p] if i >= a and a + p <= len(w) else x for i, x in enumerate(w)]
            docs.append(w)
        texts = [rnd.choice(["", "\n", "\t "]) + rnd.choice([" ", "\x0b\n"]).join(w) for w in docs]
        got = [r for b in blocks(pa.array(texts), 200) for r in runs_in_block(b, least, exponent)]
        for w, (n, runs, text) in zip(docs, got, strict=True):
            want = plain_runs(w, least, exponent)
            assert (n, [tuple(r) for r in runs.tolist()], text.decode()) == (len(w), want, collapsed(w, want))


def test_ordered_positions_over_many_pieces():
    rnd = random.Random(5)
    numbers = rnd.sample(range(100_000), 9_000)
    s, have = OrderedPositions(numbers[0]), [numbers[0]]
    for p in numbers[1:]:
        s.add(p)
        have.append(p)
    assert list(s) == sorted(have) and s.size == len(have) and len(s.pieces) > 3
    for p in rnd.sample(sorted(set(range(100_000)) - set(have)), 500):
        assert s.around(p) == (max((x for x in have if x < p), default=-1), min((x for x in have if x > p), default=-1))


def test_run_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for r in docs:
        w = (r.text or "").encode().split()
        h = zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[a + (i - a) % p] if i >= a else x for i, x in enumerate(w)]
        w = [x.decode() for x in w]
        runs = plain_runs(w) if len(w) < 700 else None
        if runs is not None:
            best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None,) * 3
            lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
            want[r.doc_id] = (len(runs), *best, 1000 * best[1] // best[2] if runs else None,
                              hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(w, runs).encode()).hexdigest())
    got = {r[0]: tuple(r[1:]) for r in queries.queries()["op12_periodic_runs"](spark, SMALL).collect()}
    assert len(got) == len(docs) and len(want) > 100 and sum(v[0] > 0 for v in want.values()) > 5
    assert {k: got[k] for k in want} == want


def test_runs_nulls_repeats_empty_tables_and_clashing_columns(spark):
    schema = "doc_id long, text string, runs int, collapsed string, key string, n_words int"
    rows = [(1, "a " * 8, 1, "x", "y", 2), (1, "a " * 8, 1, "x", "y", 2), (None, None, None, None, None, None),
            (2, "", 1, "x", "y", 2), (None, "a b " * 4, 1, "x", "y", 2), (3, " \n\t", 1, "x", "y", 2)]
    got = periodic_runs(spark.createDataFrame(rows, schema)).collect()
    assert sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got) == sorted([
        ("1", 8, [(0, 8, 1)], "a"), ("1", 8, [(0, 8, 1)], "a"), ("None", 0, [], ""), ("2", 0, [], ""),
        ("None", 8, [(0, 8, 2)], "a b"), ("3", 0, [], "")])
    assert periodic_runs(spark.createDataFrame([], schema)).count() == 0


def test_runs_of_a_very_long_text_within_bounded_memory():
    """A text of a million repeating words: below 600 bytes a word, most of it Python's."""
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    n = 1_000_000
    text = " ".join(f"w{i % 5000}" for i in range(n))
    (_, runs, kept), = runs_in_block(next(blocks(pa.array([text]))), 6, 4)
    assert runs.tolist() == [[0, n, 5000]] and len(kept.split()) == 5000
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) * 1024 < 600 * n


# Operator 13

def covariance(x):
    return (x - x.mean(0)).T @ (x - x.mean(0)) / len(x)


@pytest.mark.parametrize("dim", [1, 2, 5, 24])
@pytest.mark.parametrize("kind", ["plain", "few", "low rank", "repeats", "equal spectrum"])
def test_spectra_of_merged_parts(dim, kind):
    rng = np.random.default_rng(dim)
    x = rng.integers(-128, 128, (60, dim)).astype(float)
    if kind == "few":
        x = x[:max(1, dim // 2)]
    elif kind == "low rank":
        x = x[:, :1] @ rng.integers(-3, 4, (1, dim)).astype(float)
    elif kind == "repeats":
        x = np.repeat(x[:4], 10, 0)
    elif kind == "equal spectrum":
        x = np.concatenate((np.eye(dim), -np.eye(dim))) * 100
    whole = whitening.Spectrum(dim)
    for part in np.array_split(x, 3):
        s = whitening.Spectrum(dim)
        for v in part:
            s.add(v)
        whole.merge(s)
    want = covariance(x) * len(x)
    assert whole.n == len(x)
    assert np.abs(whole.q @ np.diag(whole.lam) @ whole.q.T - want).max() <= 1e-12 * max(1, np.abs(want).max())
    assert np.abs(whole.q.T @ whole.q - np.eye(dim)).max() < 1e-12


def test_secular_roots_are_eigenvalues():
    rng = np.random.default_rng(1)
    for k in (1, 2, 7, 40):
        for spread in (1.0, 1e-6, 1e6):
            d, z = np.sort(rng.random(k)) * spread, rng.standard_normal(k)
            near, x = whitening.secular_roots(d, z ** 2)
            want = np.linalg.eigvalsh(np.diag(d) + np.outer(z, z))
            assert np.abs(d[near] + x - want).max() <= 1e-13 * max(want.max(), 1)


def check_whitening(rows, got, k=4):
    """``rows``: sound (id, integer vector) pairs."""
    fit = np.unique(np.array([x for _, x in rows]), axis=0)
    n, sums = len(fit), fit.sum(0)
    lam, q = np.linalg.eigh(covariance(fit.astype(float)))
    lam, q = lam[::-1], q[:, ::-1]
    found = min(k, int((lam > 1e-12 * lam.sum()).sum()))
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
    for i, x in rows:
        each = sorted(by[i], key=lambda r: r.component)[:: max(1, len(by[i]) // found)]
        assert len(each) == found
        for c, r in enumerate(each):
            assert r.component == c + 1 and r.n == n and r.deviation == sum((n * int(v) - int(t)) ** 2 for v, t in zip(x, sums, strict=True))
            assert abs(abs(r.whitened) - abs((x - sums / n) @ q[:, c] / np.sqrt(lam[c]))) < 1e-8
            assert abs(r.explained / (lam[c] / lam.sum()) - 1) < 1e-9 and r.identity_error < 1e-9
    for c in range(1, found + 1):
        w = {i: next(r.whitened for r in by[i] if r.component == c) for i, _ in rows}
        sign = {np.sign(w[i] * ((x - sums / n) @ q[:, c - 1])) for i, x in rows if abs(w[i]) > 1e-6}
        assert len(sign) <= 1


def test_whitening_query_equals_numpy(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    sound = [(r.vec_id, np.floor(256 * np.array(r.embedding, float)).astype(int)) for r in rows]
    check_whitening(sound, queries.queries()["op13_whitening"](spark, SMALL).collect())


def test_many_partitions_meet_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(whitening, "TASK_VECTORS", 20)
    x = np.random.default_rng(8).integers(-99, 99, (400, 5))
    fit = spark.createDataFrame([([int(v) for v in r],) for r in x], "x array<long>").repartition(12)
    s = whitening.spectrum_of(fit, 5)
    want = covariance(x.astype(float)) * len(x)
    assert s.n == len(x) and list(s.sums) == x.sum(0).tolist() and np.allclose(s.q @ np.diag(s.lam) @ s.q.T, want, rtol=1e-12)
    turned = np.linalg.qr(np.random.default_rng(9).standard_normal((5, 5)))[0]
    got = whitening.projected(fit, x.mean(0), turned)
    assert np.allclose(got, turned.T @ want @ turned, rtol=1e-10)
    s.q = turned  # a poor basis: the Rayleigh-Ritz passes mend it
    _, lam, basis = whitening.refine(fit, s)
    assert np.allclose(basis @ np.diag(lam) @ basis.T * len(x), want, rtol=1e-12) and list(lam) == sorted(lam, reverse=True)


def test_whitening_drops_unsound_rows_and_keeps_repeats(spark):
    rng = np.random.default_rng(3)
    good = [(i, [float(v) for v in rng.standard_normal(3)]) for i in range(40)]
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [1.0, float("nan"), 2.0]), (104, [float("inf"), 0.0, 1.0]),
           (105, [-float("inf"), 0.0, 1.0]), (106, [1.0, 2.0])]
    twice = [(200 + i, good[0][1]) for i in range(30)] + [(None, good[1][1])]
    schema = "vec_id long, embedding array<double>, x int, n int, component int, whitened double"
    df = spark.createDataFrame([(*r, 1, 1, 1, 1.0) for r in good + bad + twice], schema).repartition(5)
    got = whitening.whiten(df).collect()
    kept = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in good + twice]
    assert len(got) == 3 * len(kept)
    check_whitening(kept, got)


def test_whitening_of_few_rows_and_empty_tables(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [0.5, 0.25])], [(1, [0.5, 0.25]), (2, [0.5, 0.25])]):
        assert whitening.whiten(spark.createDataFrame(rows, schema)).count() == 0
    line = [(i, [i / 8, i / 4, 0.0]) for i in range(9)]
    got = whitening.whiten(spark.createDataFrame(line, schema)).collect()
    assert len(got) == 9 and {r.component for r in got} == {1}
    check_whitening([(i, np.floor(256 * np.array(v)).astype(int)) for i, v in line], got)


def test_deviation_is_exact_or_null(spark):
    rows = [(i, [float(i % 7) * 2.0 ** 30, 1.0]) for i in range(7)] + [(7, [2.0 ** 40, 1.0])]
    got = {r.vec_id: r.deviation for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    x = np.array([[int(256 * v) for v in e] for _, e in rows], object)
    for (i, _), v in zip(rows, x, strict=True):
        exact = sum((len(x) * a - s) ** 2 for a, s in zip(v, x.sum(0), strict=True))
        assert got[i] == (exact if exact < 2 ** 63 else None)
