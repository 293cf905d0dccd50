"""The main text of whole pages: an independent reading of the pages table, further layouts, and pages that are hard to read."""

import html as entities
import re
import time

import pytest

from touchline.llm import html


def words(n):
    return " ".join(f"w{k}" for k in range(n))


def article(page):
    """The article element's blocks by a few substitutions: right for pages as regular as those of the table."""
    inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = (re.sub(r"\s+", " ", entities.unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|h1|br)\b[^>]*>", inside))
    return "\n".join(x for x in parts if x)


def test_pages_table_equals_its_articles(spark, sf):
    rows = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html.extract(rows).collect()}
    want = {r["page_id"]: article(r["html"]) if r["html"] else "" for r in rows.collect()}
    assert got == want


NAV = "<nav><ul><li><a href=/>Home</a><li><a href=/n>News</a><li><a href=/a>About us</a></ul></nav>"
LONG, MORE = words(40), words(25)

PAGES = {
    "title in a named part": (f"{NAV}<article><div class='article-header'><h1>Title</h1></div><p>{LONG}</article>", f"Title\n{LONG}"),
    "summary of a search": (f"<article><h1>Found it</h1><p>{LONG}<div class='search-results-summary'><p>{MORE}</div></article>", f"Found it\n{LONG}\n{MORE}"),
    "no article element": (
        f"{NAV}<h1>A title here</h1><p>{LONG}<h2>Sub</h2><ul><li>one two<li>three</ul><p>{MORE}<p>Short.<p>{words(12)}<p>{words(10)}<div id=footer>Contact</div>",
        f"A title here\n{LONG}\nSub\none two\nthree\n{MORE}\nShort.\n{words(12)}\n{words(10)}",
    ),
    "a linked list is a menu": (f"<article><p>{LONG}<p>{MORE}<ul><li><a href=1>See this</a><li><a href=2>And that one</a><li><a href=3>Or more</a></ul></article>", f"{LONG}\n{MORE}"),
    "a plain list is text": (f"<article><p>{LONG}<ul><li>first<li>second thing</ul><p>{MORE}</article>", f"{LONG}\nfirst\nsecond thing\n{MORE}"),
    "advert, comments and form in the article": (
        f"<article><h1>T</h1><p>{LONG}</p><div class=ad>{words(12)}</div><p>{MORE}</p><form>Name <input><button>Send</button></form><section class=comments><p>{words(30)}</section></article>",
        f"T\n{LONG}\n{MORE}",
    ),
    "an advert without a paragraph end before it": (f"<article><p>{LONG}<div class=ad><p>{words(30)}</div><p>{MORE}</article>", f"{LONG}\n{MORE}"),
    "text that speaks of cookies": (f"<article><h1>Cookie rules</h1><p>{LONG}<p>You can subscribe.<p>The copyright of {MORE}</article>", f"Cookie rules\n{LONG}\nYou can subscribe.\nThe copyright of {MORE}"),
    "beside the article": (f"<div><p>{words(18)}</div>{NAV}<main><p>{LONG}</main><div><h3>More</h3><p>{MORE}</div><footer>&copy; x</footer>", LONG),
    "no main text": (f"{NAV}<footer>&copy; 2024 us<p><a href=x>Privacy</a></footer>", ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_layouts(name):
    page, want = PAGES[name]
    assert html.main_text(page, html.trained()) == want


def test_the_table_is_learned_and_neighbours_decide():
    x, y = html.labelled()
    tree, used = html.trained(), set()

    def walk(t):
        if isinstance(t, tuple):
            used.add(html.COLUMNS[t[0]])
            walk(t[2]), walk(t[3])

    walk(tree)
    assert all((html.decide(tree, row) >= 0.5) == bool(label) for row, label in zip(x, y, strict=True))
    assert {"words", "links"} <= used and used & {"before_words", "before_links"} and used & {"after_words", "after_links"}


@pytest.mark.parametrize("piece", ["<title>", "<textarea>", "<div>", "<b><p><i>", "</x>", "<a '", "<!--", "<li>", "<p>a"])
def test_pages_are_read_in_linear_time(piece):
    took = []
    for n in (20_000, 160_000):
        began = time.perf_counter()
        html.main_text(piece * n, html.trained())
        took.append(time.perf_counter() - began)
    assert took[1] < 24 * took[0] + 0.5


def test_unclosed_and_deep_markup():
    tree = html.trained()
    deep = "<div>" * 9000 + f"<p>{LONG}</p>" + "</div>" * 4000 + f"<p>{MORE}</p>"
    assert html.main_text(deep, tree) == f"{LONG}\n{MORE}"
    began = time.perf_counter()
    html.main_text("<b><p>" + "<i>" * 50_000 + "</b>" * 50_000, tree)
    html.main_text("<div>" * 50_000 + "</x>" * 50_000, tree)
    assert time.perf_counter() - began < 5
