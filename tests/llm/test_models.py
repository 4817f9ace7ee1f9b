import time
import zlib

import numpy as np

from playloom.llm import html_leaves, html_text, html_training, quality


def test_quality_on_held_out_documents(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = {r["doc_id"]: r for r in quality.annotate(docs, labels).collect()}
    marks = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert len(rows) == docs.count()
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    test = [i for i in marks if rows[i]["held_out"]]
    assert np.mean([rows[i]["predicted"] == marks[i] for i in test]) >= 0.9
    kept = quality.keep_good(docs.withColumnRenamed("lang", "quality_score"), labels)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in rows.items() if r["predicted"]}


def test_quality_edge_cases(docs, no_docs, repeated, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.annotate(docs, none).collect()} == {0.5}
    assert quality.annotate(no_docs, none).count() == 0
    some = spark.createDataFrame([(3, 1), (4, 1), (10, 0), (11, 0), (None, 1), (12, None)], "doc_id long, quality int")
    assert quality.annotate(repeated, some).count() == repeated.count()


def test_sum_of_squares_identity():
    rng = np.random.default_rng(0)
    x = rng.random((3, quality.BUCKETS + quality.STATS)).astype(np.float32) * (rng.random((3, quality.BUCKETS + quality.STATS)) < 0.01)
    m = quality.FactorisationMachine(0.5, rng.normal(size=x.shape[1]), rng.normal(size=(x.shape[1], 4)))
    for row, got in zip(x, m.raw(x)):
        on = np.flatnonzero(row)
        pairs = sum(row[i] * row[j] * (m.v[i] @ m.v[j]) for a, i in enumerate(on) for j in on[a + 1 :])
        assert np.isclose(got, 0.5 + row @ m.w + pairs, rtol=1e-4)


PAGE = (
    '<html><head><title>no</title><script>var t="</p>";</script></head><body><nav><ul><li><a href=/a>Home.</a></li></ul></nav>'
    '<div class="cookie-notice">We use cookies</div><article><h1>A &amp; B</h1><p><b>One  two<br>three<p>a < b and fo<b>ur</b>\n five.</p>'
    '<div class="ad">Buy now</div></article><section id="comments"><h3>Comments</h3><div class="comment"><p>Nice text, thanks a lot.</p></div></section>'
    '<form><label>Name</label><button>Send</button></form><aside class="sidebar"><h4>More</h4><p>Other things.</p></aside><footer>&copy; me</footer></body></html>'
)


def test_leaves():
    got = [(b.text, b.path[-1:]) for b in html_leaves.leaves("<div id='x'>a&nbsp;b<p class=\"c d\">fo<i>o</i>\n bar<!-- no --><p>q<li>x<li>y</div>z<")]
    assert got == [("a b", (".x",)), ("foo bar", (".d",)), ("q", ("<p",)), ("x", ("<li",)), ("y", ("<li",)), ("z<", ())]


def test_no_text_is_lost_to_tags_that_look_like_others_or_never_end():
    def texts(source):
        return [b.text for b in html_leaves.leaves(source)]

    assert texts("<article><p>one</p><svg width=1 /><p>two</p></article><p>three</p>") == ["one", "two", "three"]
    assert texts("<title-bar>x</title-bar><p>two</p>") == ["x", "two"]
    assert texts("<title>no end<p>a</p>") == ["no end", "a"]
    assert texts("<svg><text>drawn</text><p>a</p></svg>b") == ["a", "b"]
    assert texts("<svg><text>drawn</text></svg>b<template>t</template>c") == ["b", "c"]
    assert texts("<p>a<iframe src=x>b") == ["a", "b"] and texts("<div a='>'>x</div>") == ["x"]
    assert texts("a<script>if (a</b>c) </script >b") == ["a", "b"] and texts("<noscript>n</noscript>m") == ["m"]
    assert texts("1 < 2 <3 & a<b>c</b>") == ["1 < 2 <3 & ac"] and texts("<p>end<!-- never closed <p>x") == ["end"]
    assert texts("<p>one</p><!-- x --!><p>two</p><!--> <p>three</p><!---><p>four</p><!--!> --><p>five</p>") == ["one", "two", "three", "four", "five"]
    assert texts("<svg><svg><svg>drawn<p>a</p>b") == ["drawn", "a", "b"] and texts("<svg><svg>drawn<p>a</p></svg>b") == ["a", "b"]


def test_megabytes_of_malformed_markup_take_linear_time():
    for piece in ('<div a="', "<div a='x' b=\"", "<div>x", "<b>x<p>", "</div>", "<title>", "<svg>a", "<!--", '<p class="', "<", "<noscript>a", "<i><p>", "<a href=x>y", "<li>x<b>"):
        times = []
        for n in (100_000, 800_000):
            began = time.process_time()
            html_leaves.leaves(piece * (n // len(piece)))
            times.append(time.process_time() - began)
        assert times[1] < 16 * max(times[0], 0.05), piece


def test_one_end_tag_behind_megabytes_takes_linear_time():
    for piece, end in (("<svg>", "</svg>"), ("<svg>a<b>", "</svg >"), ("<noscript>", "</NOSCRIPT>"), ("<title>", "</title>"), ("<!-", "-->"), ("<template><p>", "</template>"), ("<math></svg>", "</math>")):
        times = []
        for n in (1_000_000, 8_000_000):
            began = time.process_time()
            html_leaves.leaves(piece * (n // len(piece)) + end + "x")
            times.append(time.process_time() - began)
        assert times[1] < 16 * max(times[0], 0.05), piece


def test_article_is_found_and_the_rest_is_left():
    model = html_text.trained()
    assert html_text.texts_of(model, [PAGE, "", "<p>"]) == ["A & B One two three a < b and four five.", "", ""]
    made = [html_training.labelled_page(5_000_000 + k) for k in range(120)]
    scores = model.score(html_text.Inputs([b for b, _ in made]))
    marks = np.array([y for _, labels in made for y in labels])
    assert ((scores >= 0.5) == marks).mean() > 0.98


def test_slopes_of_the_labeller():
    """Backpropagation through both directions against differences."""
    made = [html_training.labelled_page(7_000_000 + k) for k in range(3)]
    x, y = html_text.Inputs([b for b, _ in made]), np.array([v for _, labels in made for v in labels], np.float64)
    model = html_text.BlockLabeller.fresh(1)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    slopes = model.slopes(x, y)

    def loss():
        s = model.score(x)
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    for name, at in (("ahead", (1, 3)), ("back", (2, 25)), ("measures", (0, 5)), ("out", (3,)), ("bias", (44,))):
        old = model.p[name][at]
        model.p[name][at] = old + 1e-2
        up = loss()
        model.p[name][at] = old - 1e-2
        down = loss()
        model.p[name][at] = old
        assert np.isclose((up - down) / 2e-2, slopes[name][at], rtol=0.05, atol=2e-5), name


def test_extract_pages(spark):
    rows = [(1, "u", PAGE, "t"), (2, None, None, "t"), (3, "v", "", "t"), (3, "v", "", "t"), (4, "w", "<article>" + "<p>word here.</p>" * 3000 + "</article>", "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r["page_id"], r["url"] or "", r["text"], r["n_chars"]) for r in html_text.extract(pages).collect()))
    assert got[0][2].startswith("A & B") and got[1:4] == [(2, "", "", 0), (3, "v", "", 0), (3, "v", "", 0)]
    assert got[4][2] == " ".join(["word here."] * 3000)
    assert html_text.extract(pages.filter("false")).count() == 0
