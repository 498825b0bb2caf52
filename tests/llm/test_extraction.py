"""Extraction: parsing, boilerplate, consensus of a host, and odd markup."""

import time

import pytest

from kpiforge.llm.extraction import extract, host_paths, main_text, votes

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var x="</p>";</script></head><body class="c{k}">
<header><h2>Site</h2></header><nav><ul><li><a href="/a">Home</a></li><li><a href='/b'>About us</a></li></ul></nav>
<div class="cookie-notice">We use cookies &amp; more</div><div class="ad">Buy {k}</div>
<div class="post-{k} story"><h1>Head &lt;{k}&gt;</h1><p>First <b>bold</b>ness of page {k},
 long enough to matter.</p><p>Second&nbsp;line<br>broken here &eacute;&#33;<aside>side</aside></p>
<ul><li>point one<li>point two</ul><form><p>Subscribe now please</p></form><table><tr><td>cell a<td>cell b</table></div>
<div class="sidebar"><p>Related stories that are long enough to look like text, really quite long.</p></div>
<section id="comments"><p>Reader says: a comment that is far longer than the article itself. {pad}</p></section>
<footer>&copy; 2020</footer></body></html>"""
TEXT = "Head <{k}> First boldness of page {k}, long enough to matter. Second line broken here é! point one point two cell a cell b"


@pytest.fixture
def pages(spark):
    return lambda rows: spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, host string, path string")


def test_page():
    for k in (1, 22):
        page = PAGE.format(k=k, pad="word " * 40)
        assert main_text(page, None) == TEXT.format(k=k)
        assert main_text(page, "html>body.c#>div.post-#.story") == TEXT.format(k=k)
        assert main_text(page, "html>body>div.other") == TEXT.format(k=k)  # a path the page does not have


def test_consensus_of_a_host(pages):
    """One page in which a list of teasers outweighs a short article still yields the article, as its host's others do."""
    long = "<html><body><article><p>" + "real text of the article " * 20 + "</p></article><div class='teasers'><p>teaser</p></div></body></html>"
    short = "<html><body><article><p>Short article.</p></article><div class='teasers'><p>" + "teaser text that goes on " * 20 + "</p></div></body></html>"
    rows = [(i, f"https://user@News.example.org:80/{i}?q=1", long) for i in range(4)] + [(9, "http://news.example.org/x", short), (10, "http://other.example.org/x", short)]
    out = {r["page_id"]: r for r in extract(pages(rows)).collect()}
    assert out[9]["text"] == "Short article." and out[9]["n_chars"] == 14
    assert out[10]["text"].startswith("teaser text")  # alone on its host, its own best container wins
    paths = {r["host"]: r["path"] for r in host_paths(pages(rows)).collect()}
    assert paths == {"news.example.org": "html>body>article", "other.example.org": "html>body>div.teasers"}


def test_votes_add_up(pages):
    rows = [(i, "http://h.example/", PAGE.format(k=i, pad="")) for i in range(6)]
    want = {}
    for _, _, h in rows:
        for p, v in votes(h).items():
            want[p] = want.get(p, 0) + v
    best = max(want, key=lambda p: (want[p], len(p), p))
    assert [(r["path"], r["votes"]) for r in host_paths(pages(rows)).collect()] == [(best, want[best])]


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("just text", "just text"), ("a < b and c > d", "a < b and c > d"), ("<p>one<p>two", "one two"),
    ("<div>open <b>bold<p>next</div>tail", "open bold next"), ("<article>x &am y &amp z &quo</article>", "x &am y & z &quo"),
    ("<article><p>a</p><!-- <p>hidden</p> --><p>b</article>", "a b"), ("<article>t<script>if(a<b){x='</p>'}", "t"),
    ("<nav>menu</nav>", ""), ("<article>a<span>b</span>c<br/>d</article>", "abc d"), ("</p></div>stray", "stray"),
    ("<article>" + "<div>" * 3000 + "deep" + "</article>", "deep"), ("<article>" + "long " * 200000 + "</article>", ("long " * 200000).strip()),
    ("<body><main><p hidden>no</p><p style='display: none'>no</p><p role='alert'>no</p><p>yes</p></main></body>", "yes"),
])
def test_odd_markup(page, text):
    assert main_text(page, None) == text


def test_odd_rows(pages):
    rows = [(1, None, "<article>a</article>"), (1, None, "<article>a</article>"), (None, "no scheme", None), (2, "http://h.example", "")]
    out = sorted((tuple(r) for r in extract(pages(rows)).collect()), key=str)
    assert out == sorted([(1, None, "a", 1), (1, None, "a", 1), (None, "no scheme", "", 0), (2, "http://h.example", "", 0)], key=str)
    assert extract(pages([])).collect() == []


def test_article_of_the_given_pages(spark, sf):
    """The articles of the given pages, cut out by their tags."""
    import html
    import re

    table = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in extract(table).collect()}
    for p in table.collect():
        body = re.search(r"<article>(.*?)</article>", p["html"], re.S)[1]
        blocks = (re.sub(r"\s+", " ", html.unescape(re.sub(r"</?b>", "", b.replace("<br>", " ")))).strip() for b in re.split(r"</?(?:p|h1)>", body))
        assert got[p["page_id"]] == " ".join(b for b in blocks if b)


@pytest.mark.parametrize("unit", ["<a ", "<a \"", "<div>word one ", "<!", "<a \">\"", "<b>t</p>", "</div>x", "<script", "<tr><td>x<p>"])
def test_time_is_linear_in_the_length(unit):
    """A megabyte of open tags, open quotes or nested elements takes no more than its share of a shorter page's time."""
    def seconds(size):
        page = unit * (size // len(unit))
        best = min(_timed(page) for _ in range(2))
        return best

    long, short = seconds(1 << 20), seconds(1 << 17)
    assert long < 10 and long < 40 * short + 0.2  # eight times the length


@pytest.mark.parametrize("unit", ["<tr><td>x<p>", "<tr><td><li>x", "<tr><td>x<dt>"])
def test_rows_nest_in_rows_without_end(unit):
    """Rows, cells and items that are never closed nest by the thousand; what a tag closes is found without a walk over them."""
    long, short = (min(_timed(unit * (size // len(unit))) for _ in range(2)) for size in (1 << 16, 1 << 13))
    assert long < 20 * short + 0.2  # eight times the length


def _timed(page):
    start = time.process_time()
    main_text(page, "html>body>div")
    return time.process_time() - start
