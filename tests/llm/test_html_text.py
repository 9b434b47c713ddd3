"""Cuts against all labellings, and pages with what must stay and what must go."""

import itertools
import random
import re
import time
from html import unescape

import pytest

from tierlens.llm import html_text as h


def cost(labels, odds, ties):
    wrong = sum(abs(o) for o, x in zip(odds, labels) if (o > 0) != x)
    return wrong + sum(w for a, b, w in ties if labels[a] != labels[b])


@pytest.mark.parametrize("seed", range(30))
def test_cut_is_least(seed):
    rng = random.Random(seed)
    n = rng.randrange(1, 10)
    odds = [rng.uniform(-2, 2) for _ in range(n)]
    ties = [(i, j, rng.uniform(0, 2)) for i, j in itertools.combinations(range(n), 2) if rng.random() < 0.5]
    best = min(cost(x, odds, ties) for x in itertools.product([False, True], repeat=n))
    assert cost(h.min_cut(odds, ties), odds, ties) == pytest.approx(best)


LONG = "Some words of an article that goes on for a while and then ends, as they do."
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>if (a < b) x("</p>")</script></head>
<body class="search"><header><h1>Site</h1><p>{LONG}</p></header><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>
<div id="cookie-notice"><p>We use cookies. {LONG}</p></div>
<article><header><h1>Title &amp; more</h1></header><p><b>{LONG}<br><p>Short.<p>{LONG}
  {LONG}</p><div class="ad">Buy this now. {LONG}</div><blockquote>Said &eacute;l &#8364;5</blockquote>
<form><p>Your mail {LONG}</p></form><section class='comments'><h2>Comments</h2><p>First! {LONG}</p></section></article>
<aside><p>{LONG}</p></aside><footer>&copy; Site {LONG}</footer>"""


def test_article_page():
    assert h.main_text(PAGE).split("\n") == ["Title & more", LONG, "Short.", f"{LONG} {LONG}", "Said él €5"]


def test_page_without_article():
    page = f"<body><div class=menu><a href=1>One</a> <a href=2>Two</a></div><div>{LONG} {LONG}</div><p>{LONG}</p><p>So.</p><p>{LONG}</p><ul><li><a href=3>Three four five</a></li></ul>"
    assert h.main_text(page).split("\n") == [f"{LONG} {LONG}", LONG, "So.", LONG]


def test_names():
    page = f"""<div id="siteHeader" class="header"><p>{LONG}</p></div><main><div class="article-header"><h1>Title</h1></div>
    <p>{LONG}</p><div class="commentlist"><p>{LONG}</p></div><div class="col advertbox"><p>{LONG}</p></div>
    <div hidden><p>{LONG}</p></div><p>{LONG}</p></main><div class="sidebarLeft"><p>{LONG}</p></div>"""
    assert h.main_text(page).split("\n") == ["Title", LONG, LONG]


@pytest.mark.parametrize("attrs", [
    'style="overflow:hidden"', 'class="overflow-hidden"', 'class="lg:hidden"', 'aria-hidden="false"', 'title="a hidden place"',
    'data-hidden="1"', 'class="no-sidebar"', 'class="has-sidebar"', 'class="comment-open"', 'class="layout-with-sidebar wide"',
    'style="display:none;display:block"', 'hidden="until-found"',
])
@pytest.mark.parametrize("tag", ["div", "main", "article"])
def test_attributes_that_hide_nothing(attrs, tag):
    wanted = [LONG, f"{LONG} {LONG}"]
    text = f"<p>{LONG}</p><div><p>{LONG} {LONG}</p></div>"
    assert h.main_text(f"<body><{tag} {attrs}>{text}</{tag}></body>").split("\n") == wanted
    assert h.main_text(f"<body><div {attrs}><section><article class=post>{text}</article></section></div>").split("\n") == wanted
    assert h.main_text(f"<main><section {attrs}>{text}</section></main>").split("\n") == wanted


@pytest.mark.parametrize("attrs", [
    "hidden", 'HIDDEN=""', "style='Color: red; Display : NONE !important'", 'style="visibility:hidden"', "aria-hidden=true",
    'class="sidebar"', 'class="wide sidebar-no-border"', "id=comments", "role=navigation",
])
def test_attributes_that_hide(attrs):
    page = f"<main><p>{LONG}</p><div {attrs}><section><p>Away. {LONG}</p></section></div></main>"
    assert h.main_text(page) == LONG


def test_names_around_articles():
    text, reply = f"<p>{LONG}</p><p>{LONG} {LONG}</p>", f"<article class=comment-body><p>First! {LONG}</p></article>"
    wanted = [LONG, f"{LONG} {LONG}"]
    for page in (f"<div class='sidebar-left menu'><article>{text}</article></div>", f"<main class='sidebar search'>{text}</main>",
                 f"<article class='promo'>{text}</article>", f"<div class=related><main><article class='post promo'>{text}</article></main></div>"):
        assert h.main_text(page).split("\n") == wanted
    # Replies are articles too, but not those of the page.
    for page in (f"<main><article>{text}</article><div id=comments>{reply * 3}</div></main>",
                 f"<div class=promo><article><p>Buy. {LONG}</p></article></div><article class=post>{text}{reply}</article>"):
        assert h.main_text(page).split("\n") == wanted


@pytest.mark.parametrize("name", ["svg", "object", "noscript", "iframe", "template", "noembed", "noframes"])
def test_missing_end_tag(name):
    page = f"<article><p>{LONG}</p><div><{name} id=x></div><p>{LONG} {LONG}</p>"
    assert h.main_text(page).split("\n") == [LONG, f"{LONG} {LONG}"]
    assert h.main_text(f"{page}<{name}><p>Gone.</p></{name}></article>").split("\n") == [LONG, f"{LONG} {LONG}"]
    for hard in ("script", "style", "title", "textarea"):
        assert h.main_text(f"{page}<{hard}>{LONG}").split("\n") == [LONG, f"{LONG} {LONG}"]


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "</", "<!--", "<script>never closed", "<a <b <c", "&#;", "<nav>only a menu</nav>"])
def test_broken_pages(page):
    assert isinstance(h.main_text(page), str)
    if page is None or not page.strip() or "nav" in page or "script" in page:
        assert h.main_text(page) == ""


def test_table(spark):
    schema = "page_id bigint, url string, html string, text int"
    rows = [(1, "u", f"<article><p>{LONG}</p></article>", 5), (1, "u", f"<article><p>{LONG}</p></article>", 5), (None, None, None, None)]
    got = h.extract(spark.createDataFrame(rows, schema))
    assert got.columns == ["page_id", "url", "html", "text", "n_chars"]
    assert [tuple(r)[3:] for r in got.collect()] == [(LONG, len(LONG))] * 2 + [("", 0)]
    assert h.extract(spark.createDataFrame([], schema)).collect() == []


def test_query(spark):
    """In the test pages everything inside the one article element is main text."""
    from tierlens.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in QUERIES["op3_html_text"](spark, sf).collect():
        inside = pages[r["page_id"]].split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(unescape(re.sub("<b>|<br>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", inside)]
        assert r["text"] == "\n".join(b for b in blocks if b)
        assert r["n_chars"] == len(r["text"])


ARTICLE = "<article><h1>A title</h1><p>" + "word " * 40 + "</p>{}<p>" + "text " * 40 + "</p></article>"
INSIDE = {
    "<p><a href=x>One whole paragraph that is a link</a></p>": ["One whole paragraph that is a link"],
    "<ul><li><a href=x>Linked item</a></li><li>Plain item</li></ul>": ["Linked item", "Plain item"],
    "<table><tr><td><a href=x>cell</a></td><td>b</td></tr></table>": ["cell", "b"],
    "<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p>": ["so x=1 holds"],
    "<xmp>raw text</xmp>": ["raw text"],
    '<p class="legal">The court said so.</p>': ["The court said so."],
    '<div class="related-work"><p>Related work is this.</p></div>': ["Related work is this."],
    '<div class="comments"><p>Nice post, thank you very much</p></div>': [],
    '<div class="related"><ul><li><a href=1>Other story one</a></li><li><a href=1>Other story two</a></li></ul></div>': [],
    "<nav><a href=1>Home</a></nav>": [],
}


@pytest.mark.parametrize("part", INSIDE)
def test_nothing_of_an_article_is_lost(part):
    assert h.main_text(ARTICLE.format(part)).split("\n")[2:-1] == INSIDE[part]


def test_pages_without_an_article():
    assert h.main_text("One two three four five six seven eight nine.") == "One two three four five six seven eight nine."
    assert h.main_text("<div>Short page text only here.</div>") == "Short page text only here."
    assert h.main_text("<ul>" + "<li><a href=x>Home</a></li>" * 5 + "</ul><div>Short text here.</div>") == "Short text here."
    assert len(h.main_text("<div>a b c</div><p>d e f</p>" * 500).split("\n")) == 1000


def test_a_named_article_by_the_text_beside_it():
    """No number of words at which the rules change: what is beside a named article grows, and its odds only fall."""
    odds = []
    for n in range(0, 60, 3):
        page = h.Blocks(f'<main><p>{"w " * n}</p></main><div class="feedback"><article><p>{"x " * 10}</p></article></div>')
        odds.append(page.odds[-1])
    steps = [a - b for a, b in zip(odds[1:], odds[2:])]
    assert min(steps) >= 0 and max(steps) < 1.5


def test_many_items_take_linear_time():
    began = time.perf_counter()
    page = "<ul>" + "".join(f"<li>item {i}</li>" if i % 3 else f"<li><a>x</a></li><p>some words {i}</p>" for i in range(50_000)) + "</ul>"
    assert len(h.main_text(page)) > 100_000
    assert time.perf_counter() - began < 20
