"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut into a flat list of text blocks at block-level tags. A block is
described by its words, the share of them inside links, the same two figures of
the blocks before and after it, where it stands (inside an article or main
element, inside an element such as nav or footer, outside an article on a page
that has one, on a page without one), what the class
names around it hint at (one feature), and whether it is a heading, a list item,
looks like a notice, or is or follows the line over a reader's comment. A decision tree keeps or drops each block. It is grown
once on the labelled blocks of the small pages in ``LAYOUTS``.

Cases: null and empty pages give an empty text. Unclosed tags, stray end tags,
comments, cut-off markup and bad character references never fail: what is not a
tag is text. Repeated rows get a row each. Pages of any length and nesting are
read in one pass. Extra columns stay out.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.runtime import tidy

# Element names (fixed values).
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
SKIPPED = frozenset("script style noscript template title iframe object svg canvas audio video map".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
FURNITURE_TAGS = frozenset("head nav header footer aside form menu button select dialog label fieldset option textarea".split())
MAIN_TAGS = frozenset("article main".split())
INLINE = frozenset("p b i a span em strong".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Words in class names and ids that declare furniture (fixed values): the first list always, the second often.
_ENDS = r"(?:^|[\s_-])(?:{})(?:$|[\s_-])"
STRONG_NAMES = re.compile(
    _ENDS.format(
        r"ad|ads|adv|advert\w*|banner\w*|promo\w*|sponsor\w*|nav\w*|menu\w*|side-?bar\w*|widget\w*|footer|masthead|comments?|disqus\w*|respond|replies|share|sharing|related|recommend\w*|cookies?|consent|gdpr|popup\w*|modal\w*|newsletter\w*|subscri\w*|signup|login|breadcrumbs?|pagination|pager|search[_-]?(?:form|box|bar)|toolbar\w*|copyright|hidden|outbrain|taboola"
    ),
    re.I,
)
WEAK_NAMES = re.compile(_ENDS.format(r"head(?:er)?|foot(?:note)?s?|reply|discussion\w*|social\w*|notice\w*|alert\w*|overlay\w*|tags?|legal|disclaimer|skip|search\w*"), re.I)

# Parts of an id that name a place in a page; an id with any other word, as a heading's slug has, declares nothing (fixed values).
PLACE_NAMES = frozenset(
    "main site page global top bottom left right primary secondary mobile desktop container wrapper wrap section block area list box bar inner outer content body form links items posts articles button panel region row column col mod js".split()
)

# Class names that say how a part is laid out, not what it is (fixed values).
LAYOUT_NAMES = re.compile(r"(?<!\S)(?:has|with|no|sticky)[_-]\S*", re.I)

HEADING = re.compile("h[1-6]")
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_SPACE = re.compile(r"\s+")
_NOTICE = re.compile(r"©|\(c\)|copyright|all rights reserved|cookie|subscribe|sign up|log ?in|advertis|privacy policy|terms of", re.I)
# Lines over a reader's comment.
_REPLY = re.compile(r"^(?:reply|repl(?:y|ied) to|comment|posted|response|submitted) (?:by|from)\b|\b(?:wrote|says|said|commented|replied)(?: (?:on|at)\b.*)?:?$|^(?:\d+ )?(?:comments?|replies|responses)(?: \(\d+\))?:?$|^leave a (?:reply|comment)", re.I)

COLUMNS = ("words", "links", "before_words", "before_links", "after_words", "after_links", "place", "named", "heading", "item", "notice", "reply")

#: place: inside furniture by tag, outside the page's article or main element, on a page without one, inside it.
FURNITURE, OUTSIDE, ANYWHERE, INSIDE = -2, -1, 0, 1

# The labelled table, as pages: a block whose text begins with + is main text, one with - is not; {n} stands for n words.
_MENU = "<nav><ul><li><a>-{1}</a><li><a>-{2}</a><li><a>-{1}</a><li><a>-{3}</a></ul></nav>"
_FOOT = "<footer><p>-&copy; 2024 {6}<p><a>-{2}</a> <a>{1}</a><p>-{14}</footer>"
_BODY = "<h1>+{8}</h1><p>+{60}<p>+{3}<p>+{45}<h2>+{3}</h2><p>+{1}<p>+{80}<p>+{25} <a>{3}</a><p>+{18}<p>+{7}<p>+{12}<p>+{2}"
LAYOUTS = [
    # an article element between menu, advert and footer
    f"{_MENU}<div class=ad>-{{12}}</div><article>{_BODY}</article>{_FOOT}",
    f"{_MENU}<div class=ad>-{{45}}</div><article><h1>+{{10}}</h1><p>+{{30}}<p>+{{1}}<p>+{{2}}<p>+{{1}}</article>{_FOOT}",
    f"<div class=ad>-{{3}}</div><article><p>+{{2}}</article>{_FOOT}",
    f"{_MENU}<article><h1>+{{4}}</h1><p>+{{9}}</article><div class=comments><p>-{{20}}<p>-{{45}}</div>",
    # furniture inside the article: adverts, sharing, comments, a form, a side note; a linked list there is a menu
    f"<article><h1>+{{7}}</h1><p>+{{40}}<div class=ad>-{{14}}</div><p>+{{50}}<div class=share><a>-{{2}}</a></div><p>+{{30}}<section id=comments><h3>-{{2}}</h3><p>-{{35}}<p>-{{8}}</section></article>{_FOOT}",
    f"<article><h1>+{{7}}</h1><p>+{{40}}<aside>-{{30}}</aside><p>+{{22}}<form>-{{5}} <label>-{{2}}</label><button>-{{1}}</button></form><p>+{{16}}</article>",
    "<article><h1>+{6}</h1><p>+{35}<p>+{20}<ul><li><a>-{5}</a><li><a>-{4}</a><li><a>-{6}</a><li><a>-{3}</a></ul></article>",
    "<article><h1>+{6}</h1><ul><li><a>-{2}</a><li><a>-{3}</a><li><a>-{2}</a></ul><p>+{35}<p>+{20}</article>",
    "<article><h1>+{6}</h1><p>+{35}<ul><li>+{5}<li>+{9}<li>+{2}<li>+{14} <a>{4}</a></ul><p>+{25}</article>",
    "<article><h1>+{6}</h1><p>+{35}<p><a>+{9}</a><p>+{25}<p><a>+{2}</a><p>+{60}<h2><a>+{5}</a></h2><p>+{30}</article>",
    "<article><h1>+{6}</h1><p>+{30}<p><a>-{2}</a><p><a>-{3}</a><p><a>-{2}</a></article>",
    f"<article><h1>+{{6}}</h1><p>+{{30}}<p>+{{12}}<p><a>-{{2}}</a></article><nav><a>-{{2}}</a></nav>{_FOOT}",
    # a heading, summary or note in a part whose name is often furniture
    "<article><div class=article-header><h1>+{7}</h1><p>+{20}</div><p>+{40}<p>+{30}</article>",
    "<article><header><h1>+{5}</h1><p>+{9}</header><p>+{40}<div class=search-summary><p>+{25}<p>+{12}</div><p>+{30}<div class=notice>+{40}</div><p>+{9}</article>",
    "<article><h1>+{5}</h1><p>+{40}<div class=notice>-{9} cookies {2}</div><p>+{30}<div class=tags><a>-{1}</a> <a>{1}</a></div><div class=social><a>-{2}</a></div></article>",
    f"<div class=header><p>-{{3}}<p><a>-{{1}}</a></div>{_MENU}<main><div class=head><h1>+{{8}}</h1></div><p>+{{50}}<p>+{{20}}</main>{_FOOT}",
    "<article><h1>+{5} cookies</h1><p>+{40}<p>+{12} subscribe {9}<p>+{3} copyright {2}<p>+{30} privacy policy {30}<p>+{8}</article>",
    # outside the article of a page that has one
    f"<header><a>-{{2}}</a> <p>-{{6}}</header>{_MENU}<p>-{{20}}<article>{_BODY}</article><h3>-{{3}}</h3><p>-{{45}}<p><a>-{{5}}</a> -{{5}}<p>-{{6}}{_FOOT}",
    f"<div><p>-{{9}}<p>-{{30}}</div><main>{_BODY}</main><div><h4>-{{2}}</h4><p>-{{12}}</div>",
    # pages without an article element: words and links of a block and its neighbours decide
    f"<ul><li><a>-{{1}}</a><li><a>-{{1}}</a><li><a>-{{2}}</a></ul><h1>+{{6}}</h1><p>+{{40}}<p>+{{30}}<h2>+{{3}}</h2><p>+{{25}}<ul><li>+{{3}}<li>+{{7}}<li>+{{12}}</ul><p>+{{50}}<p>+{{12}}<p>+{{10}}<p>+{{2}}<div class=footer>-{{2}}</div>",
    f"{_MENU}<div><h1>+{{8}}</h1><p>+{{22}}<p>+{{60}}<p>+{{4}}<p>+{{35}}<p>+{{11}}<p>+{{1}}</div>{_FOOT}",
    f"<div class=top><a>-{{1}}</a> <a>{{2}}</a></div><div>-{{2}}</div><div><a>-{{3}}</a></div><div><h1>+{{9}}</h1><div>+{{45}}</div><div>+{{18}} <a>{{2}}</a></div><div>+{{70}}</div></div><div><a>-{{5}}</a></div><div><a>-{{4}}</a></div><div>-&copy; {{4}}</div>",
    f"<div id=sidebar><h3>-{{2}}</h3><p>-{{25}}<p>-{{9}}</div><h1>+{{5}}</h1><p>+{{33}}<h2>+{{4}}</h2><p>+{{28}}<p>+{{14}}<div class=related><h3>-{{2}}</h3><a>-{{6}}</a><p>-{{18}}</div>",
    f"<table><tr><td><a>-{{2}}</a><td><a>-{{2}}</a></table><p>+{{50}}<p>+{{20}}<p>+{{40}}<table><tr><td><a>-{{1}}</a><td>-{{2}}<td><a>-{{2}}</a></table><p>-{{5}} all rights reserved",
    f"<p>-{{2}}<p><a>-{{2}}</a><p><a>-{{3}}</a><h1>+{{4}}</h1><p>+{{25}}<p>+{{3}}<p>+{{16}}<p>-{{4}} subscribe {{3}}<p><a>-{{3}}</a>",
    f"{_MENU}<h1>+{{6}}</h1><p>+{{34}}<p>+{{25}} copyright {{16}}<p>+{{40}}<ol><li>+{{4}}<li>+{{2}}<li>+{{6}}</ol><p>+{{5}}<h3>+{{2}}</h3><p>+{{28}}<p>+{{9}}<p>-{{2}} cookies {{3}}<ul><li><a>-{{1}}</a><li><a>-{{2}}</a></ul>",
    f"<p><a>-{{2}}</a><p>-{{3}}<ul><li><a>-{{1}}</a><li><a>-{{1}}</a></ul><h2>+{{5}}</h2><p>+{{20}}<p>+{{30}} <a>{{6}}</a><p>+{{16}}<p><a>-{{4}}</a><p>-{{3}}<p><a>-{{2}}</a>",
    # main text to the end of the page
    "<h1>+{7}</h1><p>+{45}<p>+{28}<h2>+{3}</h2><p>+{52}<p>+{17}",
    "<div><p>+{30}<p>+{25}</div>",
    "<div><h1>+{3}</h1><p>+{22}</div>",
    f"{_MENU}<h2>+{{4}}</h2><p>+{{38}}<p>+{{26}}<p>+{{9}}",
    "<div class=head><a>-{2}</a></div><div><p>+{60}</p><p>+{3}</p><p>+{33}</p></div>",
    "<h1>+{5}</h1><p>+{36}<ul><li>+{2}<li>+{6}</ul><p>+{11}<p>+{12}<p>+{14}",
    "<h1>+{4}</h1><p>+{40}<h2>+{1}</h2><ul><li>+{2}<li>+{1}</ul><p>+{25}<h2>+{1}</h2><ol><li>+{1}<li>+{3}</ol><p>+{44}",
    "<p>+{48}<p>+{31}<p>+{2}<p>+{10}<p>+{29}<p>+{70}<p>+{6}<p>+{90}",
    # reader comments that no class name tells, and talk inside an article
    "<h1>+{6}</h1><p>+{40}<p>+{30}<h3>-3 comments</h3><p>-Reply by {1}<p>-{12}<p>-Reply by {2}<p>-{30}<p>-{45}<p>-{3} says:<p>-{9}<footer>-{4}</footer>",
    "<div><h2>+{5}</h2><p>+{25}<p>+{60}<p>+{12}</div><div><p>-Posted by {1}<p>-{22}<p>-{4} wrote<p>-{2}<p>-Comment from {2}<p>-{70}</div>",
    "<h1>+{4}</h1><p>+{33}<p>+{2}<p>+{40}<p>-Leave a reply<p>-{8}<p>-{3}",
    "<article><h1>+{5}</h1><p>+{40}<p>+{2} says:<p>+{15}<p>+{3} wrote<p>+{28}<h2>+Comments</h2><p>+{20}<p>+{3}</article>",
    "<main><p>+{3} said:<p>+{9}<p>+{35}<p>+Reply by {2}<p>+{14}</main>",
    # no main text at all
    f"{_MENU}{_FOOT}",
    f"<ul><li><a>-{{3}}</a><li><a>-{{7}}</a><li><a>-{{5}}</a></ul><div>-{{2}}</div><div><a>-{{8}}</a></div><div>-{{3}}</div><div><a>-{{9}}</a></div>",
    f"<div class=cookies>-{{30}}</div><div class=menu>-{{2}}</div><form>-{{5}}</form>",
]


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """Features of the layouts' blocks, and 1 for main text."""
    x, y = [], []
    for page in LAYOUTS:
        for size in (0.6, 1.0, 1.8):  # shorter and longer texts in the same place
            got = blocks(re.sub(r"\{(\d+)\}", lambda m, size=size: " ".join(["word"] * max(1, round(size * int(m[1])))), page))
            y += [b[0][0] == "+" for b in got]
            x += features(got)
    return np.array(x, float), np.array(y, float)


def grow(x: np.ndarray, y: np.ndarray, least: int = 1, depth: int = 24):
    """A decision tree by Gini impurity: (column, threshold, left, right) or a share of ones."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0) or len(y) < 2 * least:
        return share
    best = None
    for c in range(x.shape[1]):
        values = np.unique(x[:, c])
        for t in (values[1:] + values[:-1]) / 2:
            left = x[:, c] <= t
            n = left.sum()
            if least <= n <= len(y) - least:
                p, q = y[left].mean(), y[~left].mean()
                cost = n * p * (1 - p) + (len(y) - n) * q * (1 - q)
                if best is None or cost < best[0] - 1e-12:
                    best = (cost, c, float(t))
    if best is None:
        return share
    left = x[:, best[1]] <= best[2]
    return best[1], best[2], grow(x[left], y[left], least, depth - 1), grow(x[~left], y[~left], least, depth - 1)


@lru_cache(1)
def trained():
    return grow(*labelled())


def decide(tree, row: tuple) -> float:
    while isinstance(tree, tuple):
        c, t, a, b = tree
        tree = a if row[c] <= t else b
    return tree


class Open:
    """The open elements of a page and what they say about the text inside; each step takes constant time per element opened."""

    def __init__(self):
        self.stack: list[tuple] = []  # name, begins main text, begins furniture, changes of strong and weak
        self.at: dict[str, list[int]] = {}  # places of each name
        self.walls: list[int] = []  # places of block elements, over which inline end tags do not reach
        self.main = self.furniture = self.strong = self.weak = self.links = 0

    def add(self, name: str, main: bool, furniture: bool, strong: int, weak: int) -> None:
        self.at.setdefault(name, []).append(len(self.stack))
        if name in BLOCK_TAGS and name != "p":
            self.walls.append(len(self.stack))
        self.stack.append((name, main, furniture, strong, weak))
        self._count(self.stack[-1], 1)

    def _count(self, item: tuple, sign: int) -> None:
        name, main, furniture, strong, weak = item
        self.main += sign * main
        self.furniture += sign * furniture
        self.strong += sign * strong
        self.weak += sign * weak
        self.links += sign * (name == "a")

    def place(self, name: str) -> int:
        """The innermost open element of this name; -1: none."""
        return (self.at.get(name) or [-1])[-1]

    def shut(self, k: int) -> None:
        while len(self.stack) > k:
            item = self.stack.pop()
            self._count(item, -1)
            self.at[item[0]].pop()
            if self.walls and self.walls[-1] == len(self.stack):
                self.walls.pop()

    def end(self, name: str) -> None:
        k = self.place(name)
        if k >= 0 and not (name in INLINE and self.walls and self.walls[-1] > k):
            self.shut(k)

    def make_room(self, name: str) -> None:
        """Ends what a block's start tag ends: an open paragraph, and for an item the one before it."""
        p, wall = self.place("p"), self.walls[-1] if self.walls else -1
        if p > wall:
            self.shut(p)
        if name == "li" and self.place("li") > max(self.place("ul"), self.place("ol")):
            self.shut(self.place("li"))

    def where(self) -> tuple[int, int]:
        """place, as on a page without a main element, and named: 2 and 1 for the two lists of names."""
        return (FURNITURE if self.furniture else INSIDE if self.main else ANYWHERE), (2 if self.strong else 1 if self.weak else 0)


def blocks(page: str) -> list[tuple]:
    """(text, words, link share, place, named, heading, item) of each non-empty block in page order."""
    out: list[tuple] = []
    open_ = Open()
    seen = False  # an article or main element began
    heading = item = False
    parts: list[tuple[str, bool]] = []
    unclosed: set[str] = set()  # raw elements that have no further end tag

    def flush():
        if parts:
            text = _SPACE.sub(" ", entities.unescape("".join(p for p, _ in parts))).strip()
            if text:
                linked = sum(len(p.split()) for p, a in parts if a)
                words = len(text.split())
                out.append((text, words, min(1.0, linked / words), *open_.where(), heading, item))
            parts.clear()

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            parts.append((page[at:], open_.links > 0))
            break
        if m.start() > at:
            parts.append((page[at : m.start()], open_.links > 0))
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if name in BLOCK_TAGS:
                flush()
                if name[0] == "h" and len(name) == 2:
                    heading = False
                if name == "li":
                    item = False
            open_.end(name)
            continue
        if name in SKIPPED or name in RAW:
            if m[3].endswith("/") and name not in RAW:  # HTML knows no empty script or title, and an unquoted address may end in a slash
                continue
            if name in BLOCK_TAGS:
                flush()
            e = None if name in unclosed else re.compile(rf"</{name}\s*>?", re.I).search(page, at)
            if e is None:
                unclosed.add(name)
            at = e.end() if e else n if name in ("script", "style") else at
            continue
        if name in BLOCK_TAGS:
            flush()
            heading = name[0] == "h" and len(name) == 2 and name[1].isdigit()
            item = name == "li"
            if name == "body":  # ends a head that was left open
                open_.shut(0)
            if name != "br":
                open_.make_room(name)
        if name in VOID:
            continue
        is_main, is_furniture, strong, weak = name in MAIN_TAGS, name in FURNITURE_TAGS, False, False
        for a in _ATTR.finditer(m[3]):
            key, value = a[1].lower(), a[2] or a[3] or a[4] or ""
            if key in ("class", "id"):
                value = LAYOUT_NAMES.sub("", value)
                if key == "id" and (HEADING.fullmatch(name) or any(not known(w) for w in re.split(r"[\s_-]+", value.lower()) if w)):
                    continue
                strong |= STRONG_NAMES.search(value) is not None
                weak |= WEAK_NAMES.search(value) is not None
            elif key == "role":
                is_main |= value in ("main", "article")
                is_furniture |= value in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu")
            elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
                is_furniture = True
        if name == "header" and open_.main and not open_.furniture + open_.strong:
            is_furniture = False  # an article's own heading
        named = name not in ("html", "body", "article", "main")
        change = (int(strong and named), int(weak and named))
        if name in MAIN_TAGS and (name == "main" or not (seen or strong)):
            change = (-open_.strong, -open_.weak)  # a wrapper's class name does not make the page's text furniture; later articles may be comments or teasers
        seen |= name in MAIN_TAGS
        open_.add(name, is_main, is_furniture, *change)
    flush()
    return out


def known(word: str) -> bool:
    """Whether part of an id names furniture or a place."""
    return word in PLACE_NAMES or word.isdigit() or STRONG_NAMES.fullmatch(word) is not None or WEAK_NAMES.fullmatch(word) is not None


def features(got: list[tuple]) -> list[tuple]:
    """A row of COLUMNS for each block."""
    has_main = any(b[3] == INSIDE for b in got)
    none = ("", 0, 0.0)
    out, reply = [], 0
    for i, (text, words, links, place, named, heading, item) in enumerate(got):
        p, q = got[i - 1] if i else none, got[i + 1] if i + 1 < len(got) else none
        place = OUTSIDE if has_main and place == ANYWHERE else place
        if _REPLY.search(text) and words <= 8:
            reply = 1
        elif heading:
            reply = 0
        elif reply:
            reply = 2
        out.append((words, links, p[1], p[2], q[1], q[2], place, named, heading, item, _NOTICE.search(text) is not None, reply))
    return out


def main_text(page: str | None, tree) -> str:
    if not page:
        return ""
    got = blocks(page)
    return "\n".join(b[0] for b, row in zip(got, features(got), strict=True) if decide(tree, row) >= 0.5)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tree = trained()
    for b in batches:
        text = [main_text(x.as_py(), tree) for x in b["html"]]
        yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) for each row of pages."""
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(tidy(_run), f"page_id {kind}, url string, text string, n_chars long")
