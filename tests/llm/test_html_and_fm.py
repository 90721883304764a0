import itertools
import random
import time
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from medialedger.llm import fm_classifier as fm
from medialedger.llm import html_mincut as h
from tests.llm.helpers import documents

PAGE = """<!DOCTYPE html><html><head><title>Title &amp; more</title><style>p{}</style><script>var a="<p>no</p>";</script></head>
<body class="home page"><div id="cookie-notice"><p>We use cookies to make this site work well for all of you, our readers, every day.</p><button>OK</button></div>
<header class="site-header"><a href="/">Home</a> <form action="/s"><input name=q><button>Search</button></form></header>
<nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav>
<main><article class="post"><header><h1>The  great
story</h1></header><p>First &lt;b&gt; paragraph with <b>bold <i>text</i></b>, a <a href="x">link</a>&nbsp;and caf&eacute; &#x41;&#66;.<p>Second one<br>goes on.
<div class="ad-box"><p>Buy now the best thing that money can buy, a great offer for a short time only, really.</p></div>
<ul><li>Point one</li><li>Point two</li></ul><blockquote>Quoted words.</blockquote><pre>x  =  1</pre>
<table><tr><td>Cell a<td>Cell b</table><!-- hidden <p>not</p> --></article>
<section id="comments"><h2>Comments</h2><div class="comment"><p>I read this long story and I liked it very much indeed, thank you for writing it.</p></div></section></main>
<aside class="sidebar"><h3>Related</h3><p>Another story that you may like, about something quite different from this.</p></aside>
<footer><p>&copy; 2024 Someone. All rights reserved.</p></footer><noscript>Enable it</noscript></body></html>"""
WANT = ["The great story", "First <b> paragraph with bold text, a link and café AB.", "Second one goes on.", "Point one", "Point two", "Quoted words.", "x = 1", "Cell a", "Cell b"]


def test_main_text_of_a_page():
    assert h.main_text(PAGE).split("\n\n") == WANT
    assert h.main_text(PAGE[: PAGE.index("Quoted") + 6]).split("\n\n") == WANT[:5] + ["Quoted"]
    for odd in (None, "", "   ", "<", "<p", "<script>x", "<!--", "</p></div>", "<nav><a href=x>y</a></nav>"):
        assert h.main_text(odd) == ""
    assert h.main_text("plain words alone in a page &am") == "plain words alone in a page &am"
    deep = "<div>" * 5000 + "<p>deep words are here</p>" + "</div>" * 5000
    assert h.main_text(deep) == "deep words are here"


def test_article_in_a_flagged_wrapper():
    whole = "\n\n".join(WANT)
    for names in ('class="page has-sidebar"', 'class="no-comments"', 'id="nav-open"', 'class="layout-side"', 'class="wrap" id="overlay"', "class=comments-open"):
        inner = PAGE.replace("<main>", f"<div {names}><main>").replace("</main>", "</main></div>")
        assert h.main_text(inner) == whole
        assert h.main_text(PAGE.replace("<main>", f"<main><div {names}>").replace("</main>", "</div></main>")) == whole
        assert h.main_text(PAGE.replace("<main>", f"<main {names}>")) == whole
        assert h.main_text(inner.replace("<main>", "<div role=main>").replace("</main>", "</div>")) == whole
    assert h.main_text(PAGE.replace("<main>", "<form action=x><main>").replace("</main>", "</main></form>")) == whole
    text = "These are the words of a story that is told at some length, so that it counts as content."
    assert h.main_text(f'<div class="has-sidebar"><div itemprop="articleBody"><p>{text}</p></div></div>') == text
    for box in ("nav", "footer", "aside", 'div class="comments"', 'ol class="comment-list"', 'div class="x related-posts"', "div hidden", "div role=complementary"):
        assert h.main_text(f"<{box}><article><p>{text}</p></article></{box.split()[0]}>") == ""
        assert h.main_text(f'<div class="has-sidebar"><{box}><article><p>{text}</p></article></{box.split()[0]}></div>') == ""
    teaser = f'<div class="promo-box"><article><p>{text}</p></article></div>'
    assert h.main_text(PAGE.replace("<main>", '<div class="has-sidebar"><main>').replace("<blockquote>", teaser + "<blockquote>")) == whole


LONG = "These are the words of a story that is told at some length, with commas, and so on. It counts as content, since it is long and has no links."


def test_names_that_only_hold_a_telling_word_are_outvoted():
    for open_, close in (
        ('<main class="legal">', "</main>"), ('<body><div id="side-story">', "</div>"), ('<article><section class="discussion">', "</section></article>"), ('<section class="share-prices">', "</section>"),
        ('<section id="related-work">', "</section>"), ('<div id="search-method">', "</div>"), ('<div class="legal-analysis">', "</div>"), ('<article><div class="hidden-xs">', "</div></article>"),
    ):
        assert h.main_text(f"{open_}<h2>Some heading</h2><p>{LONG}</p><p>{LONG}</p>{close}").count("content") == 2, open_
    assert h.main_text(f'<article><div class="article-header"><h1>Title</h1></div><p class="hidden-xs">{LONG}</p></article>') == f"Title\n\n{LONG}"
    for box in ("comment-list", "site-footer", "main-nav", "ad-box", "cookie-notice", "social-share", "related posts", "sr-only", "newsletter_form", "notice"):
        assert h.main_text(f'<article><p>{LONG}</p></article><div class="{box}"><p>{LONG}</p></div>') == LONG, box


def test_the_cut_decides_where_names_only_hint():
    """A short block under such a name goes with its neighbours, by the cut and not by its own costs."""
    page = f'<div class="legal-analysis"><p>{LONG}</p><p>{LONG}</p><p>Not so</p><p>{LONG}</p></div><div class="search-tips"><a href=x>One</a></div>'
    found, model = h.blocks(page), h.Model()
    alone = [c >= 0 for c in h.costs_of(found, model)]
    assert alone == [True, True, False, True, False] and h.labels_of(found, model) == [True, True, True, True, False]


def test_cut_is_minimal():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randint(1, 8)
        costs = [round(rng.uniform(-3, 3), 2) for _ in range(n)]
        edges = [(a, b, round(rng.uniform(0, 2), 2)) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.5]

        def energy(kept):
            loss = sum(c if c > 0 and not k else -c if c < 0 and k else 0 for c, k in zip(costs, kept, strict=True))
            return loss + sum(w for a, b, w in edges if kept[a] != kept[b])

        best = min(energy(k) for k in itertools.product([True, False], repeat=n))
        assert abs(energy(h.minimum_cut(costs, edges)) - best) < 0.02


def test_pages_table(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (3, "v", "")], "page_id bigint, url string, html string")
    rows = h.extract(pages.withColumn("text", F.lit(1))).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in rows) == [(0, 0), (1, len("\n\n".join(WANT))), (1, len("\n\n".join(WANT))), (3, 0)]
    assert h.extract(pages.limit(0)).collect() == []


def test_sum_of_squares_identity():
    rng = np.random.default_rng(1)
    m = fm.Machine(0.3, rng.normal(size=6), rng.normal(size=(6, 3)))
    x = rng.normal(size=(4, 6))
    for row, got in zip(x, m.logits(x), strict=True):
        pairs = sum(m.factors[i] @ m.factors[j] * row[i] * row[j] for i in range(6) for j in range(i))
        assert abs(got - (0.3 + m.linear @ row + pairs)) < 1e-9


def test_scores_separate_held_out_texts(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = []
    for i in range(400):
        w = [word() for _ in range(60)]
        texts.append(" ".join(x + "###" for x in w) if i % 4 == 0 else " ".join(w))
    docs = documents(spark, [*texts, None, ""], ids=[*range(401), None]).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(400)] + [(None, 1, 0), (3, None, 1)], "doc_id bigint, quality int, toxic int")
    machine = fm.train(docs, labels, max_rows=300, epochs=20)
    rows = fm.score(docs, machine).collect()
    assert len(rows) == 402 and all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["doc_id"] is not None and r["doc_id"] < 400 and r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r["predicted"] == int(r["doc_id"] % 4 != 0) for r in held) >= 0.95 * len(held)
    nothing = fm.train(docs, labels.limit(0))
    assert all(abs(r["score"] - 0.5) < 1e-6 for r in fm.score(docs, nothing).collect())
    assert fm.score(documents(spark, []), machine).collect() == []


def test_one_text_by_itself_scores_alike():
    column = pa.array(["a b c", "x " * 300, ""])
    whole = fm.features(column)
    assert np.allclose(whole[1:2], fm.features(column.slice(1, 1)))


class Article(HTMLParser):
    """The blocks of text within <article>, by Python's own parser: what the test pages' markup says is their content."""

    INLINE = {"a", "b", "i", "em", "strong", "span", "u", "code"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.skip, self.parts, self.out = 0, 0, [], []

    def end_block(self):
        text = " ".join("".join(self.parts).split())
        if text:
            self.out.append(text)
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.parts.append(" ")
        elif tag not in self.INLINE:
            self.end_block()
        self.depth += tag == "article"
        self.skip += tag in ("script", "style")

    def handle_endtag(self, tag):
        if tag not in self.INLINE:
            self.end_block()
        self.depth -= tag == "article"
        self.skip -= tag in ("script", "style")

    def handle_data(self, data):
        if self.depth and not self.skip:
            self.parts.append(data)


def test_query_equals_another_parser(spark):
    from medialedger.llm import queries

    folder = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{folder}/pages.parquet").collect():
        parser = Article()
        parser.feed(r["html"] or "")
        parser.close()
        parser.end_block()
        want[r["page_id"]] = (r["url"], "\n\n".join(parser.out))
    rows = queries.op4_html_mincut(spark, folder).collect()
    assert len(rows) == len(want) and {r["page_id"]: (r["url"], r["text"]) for r in rows} == want
    assert all(r["n_chars"] == len(r["text"]) for r in rows)


def test_the_cut_corrects_the_classifier(spark):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").collect()]
    rows = [h.sample_rows(p) for p in pages[::2]]
    fitted = h.fit(np.concatenate([x for x, _ in rows]), np.concatenate([y for _, y in rows]))
    models = [h.scaled(fitted, f) for f in h.SCALES]
    tried = sum(h.mistakes(p, models) for p in pages[::2])
    best = models[min(range(len(models)), key=lambda k: (tried[k][2], -k))]
    blocks, alone, cut, mended = sum(h.mistakes(p, [best]) for p in pages[1::2])[0]
    assert mended > 0 and cut <= alone < blocks * 0.15
    # With its markup in sight each page is cut as its markup says.
    for p in pages[1::2]:
        found = h.blocks(p)
        assert all(k == t for k, t in zip(h.labels_of(found, best), map(h.clear_label, found), strict=True) if t >= 0)


def test_long_pages_take_seconds():
    begun = time.time()
    for piece in ('<a "', "<a '", "<div>", "<b><i>", "</x><span>", "<p><h1>", "<tr><td>x", "<!-", "<script", 'class="', "&#9", "<p>a<hr>"):
        h.main_text(piece * (1_000_000 // len(piece)))
    h.main_text("&#" + "9" * 10_000 + "; &#" + "0" * 10_000 + "65; x")
    assert time.time() - begun < 120
    text = "<p>" + "a long story " * 100_000 + "</p>"
    assert len(h.main_text(f"<article>{text}</article>")) == 1_299_999
    assert h.main_text('<article><p>one</p><a href="x>two</article><p>three') == "one\n\ntwo\n\nthree"


def test_training_takes_odd_tables(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (3, "v", "")], "page_id bigint, url string, html string").withColumn("x", F.lit("clash"))
    model = h.train(pages)
    assert h.main_text(PAGE, model).split("\n\n") == WANT
    nothing = h.train(pages.limit(0))
    assert np.allclose(nothing.weights, h.Model().weights)
