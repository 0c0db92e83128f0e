"""HTML extraction: pages laid out otherwise than the labelled ones, the tables' pages against their article elements, and odd pages."""

import html
import re
from html.parser import HTMLParser

import pytest

from confab.llm import html_text as H
from confab.llm import labelled_pages, queries

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def weights(spark):
    return queries.page_weights(spark)


#: Pages as content systems make them, with the text that a reader would call the article.
UNSEEN = [
    (
        """<html><body class="single"><div id="page" class="site"><header id="masthead" class="site-header"><a href="/">My Blog</a><p class="site-description">Notes on sailing</p></header>
        <div class="nav-menu"><ul><li><a href="/a">Home</a></li><li><a href="/b">About us</a></li></ul></div><div id="primary"><main><article id="post-7"><h1 class="entry-title">Rope &amp; sail</h1>
        <div class="entry-content"><p>Hemp was <a href="/hemp">the rope</a> of choice.</p><p>It rots,&nbsp;though.</p><ul><li>Nylon stretches a lot under load</li><li>Steel cuts</li></ul></div></article></main>
        <div id="comments" class="comments-area"><h2>2 thoughts</h2><ol><li><p>Great post, I use hemp every day and love it!</p></li></ol><form><p>Leave a reply</p><textarea>x</textarea></form></div></div>
        <aside class="widget-area"><h3>Recent posts</h3><ul><li><a href="/x">Knots</a></li></ul></aside><footer class="site-footer">&copy; 2024 My Blog. All rights reserved by the owner.</footer></div></body></html>""",
        "Rope & sail Hemp was the rope of choice. It rots, though. Nylon stretches a lot under load Steel cuts",
    ),
    (
        """<body><div class="cookie-consent">We use cookies to make this site better for you and for us. <button>OK</button></div><div class="story"><h1>Flood</h1><p>The river <b>rose</b> two metres<br>over night.
        <div class="ad">Buy boots now, the best boots</div><p>Nobody was hurt.<script>track("<p>x</p>")</script><div class="share">Share this <a href="#">now</a></div><p>Schools stay closed today and tomorrow.</p></div>
        <div class="related"><h2>Read also</h2><p>Ten things that you should know about rivers and floods</p></div><div class="footer"><p>Imprint and terms of use of this site</p></div></body>""",
        "Flood The river rose two metres over night. Nobody was hurt. Schools stay closed today and tomorrow.",
    ),
    ("<p>Just one paragraph, <i>un</i>marked.", "Just one paragraph, unmarked."),
    ("<html><form id=aspnet><div><nav><a href=/>Home</a> <a href=/b>News</a></nav><p>A page that stands in one form, as some servers make them.</p><p>Second.</p></div></form>", "A page that stands in one form, as some servers make them. Second."),
    ("<table><tr><td><h1>Old page</h1><td><p>Tables hold <b>it</b><tr><td>all", "Old page Tables hold it all"),
]


@pytest.mark.parametrize("k", range(len(UNSEEN)))
def test_unseen_layouts(weights, k):
    page, want = UNSEEN[k]
    assert H.main_text(page, weights) == want


def test_labelled_pages_come_out_again(weights):
    for source in labelled_pages.pages():
        page = H.Page(source)
        want = [" ".join("".join(page.items[i][0] for i in b if page.main[i]).split()) for b in page.blocks()]
        assert H.main_text(source, weights) == " ".join(x for x in want if x)


class _Article(HTMLParser):
    """The text of the article element, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.depth, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        if tag in ("p", "h1", "br"):
            self.parts.append(" ")

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        if tag in ("p", "h1"):
            self.parts.append(" ")

    def _put(self, text):
        if self.depth:
            self.parts.append(text)

    def handle_data(self, data):
        self._put(data)

    def handle_entityref(self, name):
        self._put(html.unescape(f"&{name};") if html.unescape(f"&{name};") != f"&{name};" else f"&{name}")

    def handle_charref(self, name):
        self._put(html.unescape(f"&#{name};"))


def test_query(spark):
    out = queries.op11_best_region_text(spark, SMALL)
    assert dict(out.dtypes) == {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"}
    got = {r.page_id: r for r in out.collect()}
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    assert len(got) == len(pages)
    for r in pages:
        p = _Article()
        p.feed(r.html)
        p.close()
        want = " ".join("".join(p.parts).split())
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)


def test_odd_pages(spark, weights):
    long = "<article>" + "<p>One line of text.</p>" * 40_000 + "</article>"
    odd = [
        (1, None, 5), (2, "", 5), (3, "   ", 5), (4, "<script>x</script><style>p{}</style>", 5), (5, "<p>a <", 5), (6, "<p>1 < 2 &amp; 3 &gt; 2", 5), (7, "<p>end<b", 5), (8, "<!-- open <p>x", 5),
        (9, long, 5), (10, "<div>" * 30_000 + "deep text" + "</div>" * 30_000, 5), (11, "<p>twice</p>", 5), (11, "<p>twice</p>", 5), (12, "<nav>menu only</nav>", 5), (13, "<p title=\"a>b\" data-x='<p>'>in &#65;&#x42;&nbsp;&am;</p>", 5), (14, '<p hidden>no</p><div style="display: none">no</div><p>yes</p>', 5),
    ]
    rows = spark.createDataFrame(odd, "page_id int, html string, text int")
    got = H.extract(rows, weights).orderBy("page_id").collect()
    assert [r.text for r in got[:8]] == ["", "", "", "", "a <", "1 < 2 & 3 > 2", "end", ""]
    assert got[8].n_chars == 18 * 40_000 - 1 and got[9].text == "deep text" and [r.text for r in got[10:]] == ["twice", "twice", "", "in AB &am;", "yes"]
    assert H.extract(rows.limit(0), weights).count() == 0


def test_best_region_against_brute_force():
    import random

    rng = random.Random(3)
    for _ in range(300):
        x = [rng.randint(-5, 5) for _ in range(rng.randint(0, 12))]
        first, last = H.best_region(x)
        assert sum(x[first:last]) == max([0, *(sum(x[i:j]) for i in range(len(x)) for j in range(i + 1, len(x) + 1))])


def test_time_grows_with_the_page(weights):
    import time

    def seconds(n):
        began = time.perf_counter()
        H.main_text("<div class=x><b><p>word <a href='x>y'>link</a> &amp; " * n, weights)
        return time.perf_counter() - began

    seconds(100)
    assert seconds(8_000) < 8 * 4 * max(seconds(1_000), 0.02)


def test_a_fit_needs_no_more_than_marks(spark):
    pages = [f"<div class=x{i % 3}>{H.MAIN}<p>{'good words here ' * 5}</p>{H.END_MAIN}<p class=junk>bad words</p></div>" for i in range(6)]
    w = H.fit(spark.createDataFrame([(p,) for p in pages], "html string"))
    assert H.main_text(re.sub("<!--.*?-->", "", pages[0]), w) == ("good words here " * 5).strip()
