"""Operators 6 and 10, and the pipeline, against brute force."""

import html
import re

import numpy as np
import pytest

import brute
from panelstats.llm import html_extract, quality
from panelstats.sources.tables import table

SMALL = "/root/testdata/sf0.001"

PAGE = ("<html><head><title>T</title><style>p{x}</style></head><body><header>HEAD</header><nav><a href='/'>M</a></nav>"
        "<div class='cookie-notice'>C</div><article><h1>A &amp; b</h1><p>One <b>t</b>wo<p>three&nbsp;four"
        "<script>var a='</p>'</script><form>F</form><aside>S</aside><ul class=comments><li>no</ul>"
        "<div>five<br>six &lt;x&gt;</div></article><!-- <p>c</p> --><footer>foot</footer>")
TEXT = "A & b One two three four five six <x>"


def test_one_page():
    assert html_extract.extract(PAGE, None) == TEXT
    assert html_extract.extract(PAGE.replace("article", "main"), None) == TEXT
    assert html_extract.extract(PAGE.replace("article", "section"), None).endswith("six <x>")
    assert html_extract.extract(None, None) == html_extract.extract("", None) == ""
    assert html_extract.extract("a <b", None) == "a <b"
    assert html_extract.extract("<nav>only</nav>", None) == ""


def test_template_finds_the_slot_without_an_article_tag(spark):
    def page(i):
        text = " ".join(f"<p>{'word ' * (i % 5 + 20)}{i}</p>" for _ in range(i % 4 + 1))
        return f"<body><div class=menu>Home</div><div id=page{i}><div class=body>{text}</div></div><div class=x>tail</div></body>"

    rows = [(i, f"http://h.org/{i}", page(i)) for i in range(30)] + [(99, None, None), (99, None, None), (98, "http://e.org", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    t = html_extract.templates(html_extract.token_vectors(df.selectExpr("*", "'h.org' as host").where("page_id < 90")))
    assert html_extract.slots(t).first().slot == "/body/div[id=page0]/div[class=body]"
    level = {r.token: (r.level, r.gap) for r in t.collect()}
    assert level["+/body"][0] == 0
    assert level["/body/div[id=page0]/div[class=body]<p>"] == (1, "+/body/div[id=page0]/div[class=body]")
    got = {r.page_id: r.text for r in html_extract.main_text(df).collect()}
    assert got[7] == " ".join(["word " * 22 + "7"] * 4) and got[99] == got[98] == ""
    assert html_extract.main_text(df.where("page_id < 0")).collect() == []


def test_pages(spark):
    pages = table(spark, SMALL, "pages")
    got = {r.page_id: r.text for r in html_extract.main_text(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?p>|</?h1>|<br>", body)]
        assert got[r.page_id] == " ".join(b for b in blocks if b)


def test_statistics(spark):
    texts = [None, "", "a", "a b c a b c", "x\nx\n\nx \n y\n", "#*$ %&| <>", "ü é\n" * 40, "w " * 30000,
             *[r.text for r in table(spark, SMALL, "documents", "text").collect()]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumnRenamed("x", "x")
    got = sorted(tuple(r)[:7] for r in quality.score(docs, None).collect())
    assert got == [(i, *brute.statistics(t)) for i, t in enumerate(texts)]


def data(n=3000, seed=1):
    rnd = np.random.default_rng(seed)
    x = rnd.random((n, 4))
    y = (np.sin(5 * x[:, 0]) - 2 * x[:, 1] + 0.3 * rnd.standard_normal(n) > -0.5).astype(float)
    return x, y


def test_trees_are_accurate_and_monotonic():
    x, y = data()
    trees = quality.fit_trees(x, y, (0, -1, 0, 0))
    other, truth = data(seed=2)
    assert ((trees.probability(other) > 0.5) == truth).mean() > 0.88
    for v in other[:40]:
        line = np.repeat(v[None], 50, 0)
        line[:, 1] = np.linspace(0, 1, 50)
        assert (np.diff(trees.margin(line)) <= 1e-12).all()


def walk(trees, row):
    """One document, node by node."""
    out = trees.bias
    for t in range(len(trees.feature)):
        node = 0
        for _ in range(trees.depth):
            f = trees.feature[t, node]
            node = 2 * node + 1 + int(f >= 0 and row[f] > trees.threshold[t, node])
        out += trees.value[t, node]
    return out


def test_flat_scoring_equals_walking():
    x, y = data(600)
    trees = quality.fit_trees(x, y, (1, -1, 0, 0))
    assert np.allclose(trees.margin(x), [walk(trees, r) for r in x])


def test_quality_on_held_out_labels(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    trees = quality.train(docs, labels.where("doc_id % 2 = 0"))
    got = quality.score(docs, trees).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed").collect()
    right = sum(r.kept == (r.quality > 0) for r in got)
    assert right >= 0.97 * len(got)
    assert sum(r.kept for r in got if r.quality) >= 0.99 * sum(1 for r in got if r.quality)


def test_quality_without_labels(spark):
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    assert quality.train(docs, labels.where("doc_id < 0")) is None
    kept = quality.keep_good(docs, None)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect() if not brute.statistics(r.text)[5]}
    assert quality.keep_good(docs.where("doc_id < 0"), None).collect() == []


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    from tokenizers import Tokenizer

    import public_tokenizers
    docs = table(spark, SMALL, "documents")
    trees = quality.train(docs, table(spark, SMALL, "labels"))
    rows = []
    for r in docs.collect():
        st = quality.column_statistics(__import__("pyarrow").array([r.text]))
        good = walk(trees, quality._matrix(st)[0]) >= 0 if trees is not None else True
        if not brute.statistics(r.text)[5] and good:
            rows.append((r.doc_id, r.text))
    rows = [x for x, (_, c) in zip(rows, brute.components(rows, 5, 80), strict=True) if c == x[0]]
    cut = brute.repeats([t for _, t in rows], pipeline.REPEAT_BYTES)
    rows = [(k, t if not n else kept.decode("utf-8", "ignore"))
            for (k, t), (_, n, _, kept) in zip(rows, cut, strict=True) if not n or kept.decode("utf-8", "ignore").strip(" ")]
    items = [(r.item_id, r.text) for r in table(spark, SMALL, "benchmark").collect()]
    rows = [x for x, hit in zip(rows, brute.contamination(rows, items), strict=True) if not hit[5]]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {k: library.encode(t, add_special_tokens=False).ids for k, t in rows}
    got = pipeline.run(spark, SMALL).collect()
    assert {r.doc_id: r.ids for r in got} == want and len(got) == len(want)


def test_pipeline_of_empty_and_odd_rows(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = table(spark, SMALL, "documents")
    odd = docs.limit(0).unionByName(spark.createDataFrame([(1, None, None, None, None), (None, "", "en", "s", 0)], docs.schema))
    for rows in (docs.limit(0), odd):
        at = rows
        for k, (name, stage) in enumerate(pipeline.STAGES):
            out = stage(spark, at, SMALL)
            if k < len(pipeline.STAGES) - 1:
                assert out.columns == docs.columns, name
            path = str(tmp_path / f"{name}-{k}-{rows is odd}")
            out.write.parquet(path)
            at = spark.read.parquet(path)
        assert at.count() == 0


def test_pages_without_tags_leave_the_template_alone(spark):
    rows = [(i, "http://h.org/x", f"<body><div class=body><p>{'word ' * (20 + i)}</p></div><div class=x>tail</div></body>")
            for i in range(20)]
    rows.append((30, "http://h.org/x", "<body><div class=body><p>short</p></div><div class=x>a long tail of other words</div></body>"))
    rows += [(40, "http://h.org/x", None), (41, "http://h.org/x", ""), (42, "http://h.org/x", "only words")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    vectors = html_extract.token_vectors(df.selectExpr("*", "'h.org' as host"))
    assert html_extract.slots(html_extract.templates(vectors)).first().slot == "/body/div[class=body]"
    got = {r.page_id: r.text for r in html_extract.main_text(df).collect()}
    assert (got[30], got[40], got[41], got[42]) == ("short", "", "", "only words")
