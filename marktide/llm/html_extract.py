"""Main text of web pages by maximum-scoring subsequences of a page's words and tags.

A page is one pass over its tags and texts. Each word and each tag is a token with a weight, words positive and tags
negative as a rule; the weights are log-odds of content against boilerplate, counted on labelled pages. A linear scan
finds the contiguous run of tokens with the largest sum: the content region. Menus, headers, footers, forms, asides and
elements whose class, id or role names boilerplate weigh minus infinity, however much they hold, so no region crosses
them; inside an article or a paragraph they weigh nothing and are cut out of the text. What the scan then finds in the
rest of the page joins the text if it holds prose, so a list of links in the middle doesn't end an article.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Markup: comments, declarations, raw-text elements are found apart; a tag that never ends runs to the end of the page.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)(?:>|\Z)", re.S)
_RAW = re.compile(r"script|style|textarea|title|noscript|template|iframe|xmp", re.I)
_HINT = re.compile(r"(?:class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_SKIP = frozenset("nav header footer button select option label dialog menu svg canvas object audio video map head".split())
_MAYBE = frozenset("form fieldset".split())
#: What a head may hold; any other element, and any text, ends it.
_HEAD = frozenset("html head base basefont bgsound link meta title style script noscript template".split())
#: Why an element may be ruled out: it always is; as an advert or a notice; by another name or as an aside, unless it holds the
#: page's headline; as a form, unless the page is laid out in it.
NEVER, ALWAYS, ADVERT, NAMED, FORM = range(5)
#: What the scan may do with a token: take it, take it but cut it out of the text, or never cross it.
TAKE, CUT, WALL = range(3)
#: Words of a class, id or role that name boilerplate: adverts and notices, and other parts of a page.
_ADVERTS = frozenset("ad ads advert adverts advertisement advertisements advertising adsense adslot adunit sponsor sponsored sponsors cookie cookies consent gdpr notice notices".split())
_AWAY = frozenset("promo promotion banner alert alerts popup modal overlay newsletter subscribe subscription signup login share sharing social follow related recommended recommendations more-stories sidebar widget widgets nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager footer header masthead comment comments commentlist respond reply replies disqus discussion search skip toolbar copyright legal disclaimer complementary contentinfo".split())
#: Names with one of these tell what a page has beside its content, or how it looks.
_ABOUT = frozenset("with has no without open closed enabled disabled".split())
#: Words of prose that a further region has at least, and words of a paragraph of which two show that a form is the page.
PROSE_WORDS, PARAGRAPH_WORDS = 8, 10
_WORDS = re.compile(r"\S+")
#: Blocks that hold running text; words right inside other elements are a kind of their own.
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt blockquote pre td th figcaption summary".split())
_TEXT = frozenset(("text", "bare", "link"))
#: Fields that a visitor fills in, elements that lay out a page, and skipped elements that stand between blocks.
_CONTROLS, _LAYOUT, _WALLS = frozenset("input textarea select button".split()), frozenset("h1 main article nav header footer".split()), frozenset("dialog menu head".split())


def _names(attributes: str) -> list[tuple[str, frozenset[str]]]:
    """The names in class, id, role, ..., each with its parts at hyphens and capitals."""
    found = []
    for m in _HINT.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").split():
            found.append((name.lower(), frozenset(x for x in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if x)))
    return found


def _away(tag: str, attributes: str, inside_article: bool) -> int:
    """Why an element may be ruled out. A header of the article itself may hold its headline."""
    if tag in _SKIP and not (tag == "header" and inside_article):
        return ALWAYS
    if tag in ("html", "body"):
        return NEVER
    found = NAMED if tag == "aside" else FORM if tag in _MAYBE else NEVER
    for name, parts in _names(attributes) if attributes else ():
        if parts & _ABOUT:
            continue
        if parts & _ADVERTS:
            return ADVERT
        away = _AWAY - {"header"} if inside_article or tag == "header" or parts & {"article", "entry", "post", "story"} else _AWAY
        if tag == "main" or tag == "article" and not parts & {"comment", "comments", "reply"}:
            continue
        if name == "hidden" or name in away or parts & away and not (parts & {"article", "story"} and not parts & {"comment", "comments", "sidebar", "related"}):
            found = NAMED
    return found


class _Doubt:
    """An element that may be ruled out, in the one around it; wall: it stands between blocks."""

    __slots__ = ("why", "around", "wall", "headline", "layout", "controls", "paragraphs")

    def __init__(self, why: int, around: _Doubt | None, wall: bool):
        self.why, self.around, self.wall = why, around, wall
        self.headline = self.layout = self.controls = False
        self.paragraphs = 0

    def out(self) -> bool:
        if self.why == NAMED:
            return not self.headline
        if self.why == FORM:
            return self.controls and not (self.headline or self.layout or self.paragraphs >= 2)
        return self.why in (ALWAYS, ADVERT)


def _all(doubt: _Doubt | None) -> Iterator[_Doubt]:
    while doubt is not None:
        yield doubt
        doubt = doubt.around


def tokens(page: str) -> list[tuple[str, str, int]]:
    """(kind, text, TAKE, CUT or WALL) in page order. kind: "text", "bare" (in no block of prose), "link", or a tag as "p", "/p"."""
    out: list[tuple[str, str, _Doubt | None]] = []
    # tag; in or below: a doubtful element, an article, a link, prose
    stack: list[tuple[str, _Doubt | None, bool, bool, bool]] = [("", None, False, False, False)]
    opened: Counter[str] = Counter()
    doubtful: list[_Doubt] = []
    at, n = 0, len(page)

    def close(k: int) -> None:
        opened.subtract(x[0] for x in stack[k:])
        del stack[k:]

    def end_head() -> None:
        if opened["head"] > 0:
            close(next(k for k, x in enumerate(stack) if x[0] == "head"))

    while at < n:
        m = _TAG.search(page, at)
        cut = m.start() if m else n
        if cut > at:
            words = len(page[at:cut].split())
            if words and stack[-1][0] == "head":
                end_head()
            _, doubt, _, link, prose = stack[-1]
            if doubt is not None and prose and not link and words >= PARAGRAPH_WORDS:
                for d in _all(doubt):
                    d.paragraphs += 1
            out.append(("link" if link else "text" if prose else "bare", page[at:cut], doubt))
        if not m:
            break
        at = m.end()
        closing, tag, attributes = m[1], m[2], m[3]
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            if opened[tag] > 0:
                close(max(k for k, x in enumerate(stack) if x[0] == tag) if stack[-1][0] != tag else len(stack) - 1)
            out.append((f"/{tag}", "", stack[-1][1]))
            continue
        if tag in _CONTROLS and not (tag == "input" and "hidden" in attributes.lower()):
            for d in _all(stack[-1][1]):
                d.controls = True
        if _RAW.fullmatch(tag) and not attributes.rstrip().endswith("/"):
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag not in _HEAD:
            end_head()
        if tag in _BLOCK:
            # an open paragraph ends where a block begins, and with it what was left open in it
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p" or (tag in ("li", "td", "tr", "dt", "dd") and stack[k][0] == tag):
                    close(k)
                    break
                if stack[k][0] in _BLOCK:
                    break
        _, doubt, article, link, prose = stack[-1]
        if tag in _LAYOUT:
            for d in _all(doubt):
                d.layout, d.headline = True, d.headline or tag in ("h1", "main")
        out.append((tag, "", doubt))
        if tag not in _VOID and not attributes.rstrip().endswith("/"):
            why = _away(tag, attributes, article) if doubt is None or doubt.why != ALWAYS else NEVER
            if why != NEVER:
                doubt = _Doubt(why, doubt, (tag in _BLOCK or tag in _WALLS) and not prose and not article)
                doubtful.append(doubt)
            stack.append((tag, doubt, article or tag in ("article", "main"), link or tag == "a", tag in _PROSE or (prose and tag not in _BLOCK)))
            opened[tag] += 1
    state: dict[int, int] = {}
    for d in doubtful:  # those around come first
        around = state[id(d.around)] if d.around is not None else TAKE
        state[id(d)] = max(around, (WALL if d.wall else CUT) if d.out() else TAKE)
    return [(kind, text, TAKE if d is None else state[id(d)]) for kind, text, d in out]


def learn_weights(pages: list[tuple[str, list[str]]]) -> dict[str, float]:
    """Labelled pages (html, texts of its content blocks) to the weight of each kind of token, as smoothed log-odds."""
    inside, outside = Counter(), Counter()
    for page, blocks in pages:
        wanted, at, started = [" ".join(b.split()) for b in blocks], 0, False
        for kind, text, _ in tokens(page):
            if kind in _TEXT:
                words = html.unescape(text).split()
                if not words:
                    continue
                started = at < len(wanted) and " ".join(words) in wanted[at]
                if started and wanted[at].endswith(" ".join(words)):
                    at += 1
                (inside if started else outside)[kind] += len(words)
            else:
                (inside if started else outside)[kind] += 1
    a, b = sum(inside.values()) + len(inside) + 1, sum(outside.values()) + len(outside) + 1
    raw = {k: math.log((inside[k] + 0.5) / a) - math.log((outside[k] + 0.5) / b) for k in inside | outside}
    # words are for, tags against: a tag common inside costs least
    words = {"text": max(0.2, raw.get("text", 1.0)), "bare": max(0.1, raw.get("bare", 0.1)), "link": min(raw.get("link", -0.5), -0.2)}
    return {k: min(w, -0.05) for k, w in raw.items()} | words | {"": min(-0.1, sum(raw.values()) / max(1, len(raw)))}


#: Labelled pages, written for this purpose: a page and the blocks of its content.
LABELLED: list[tuple[str, list[str]]] = [
    (
        "<html><body><div class=top><a href=/>Start</a> <a href=/n>News</a> <a href=/s>Sport</a></div><div><h1>Rain over the valley</h1><p>The rain began early in the morning and did not stop before night fell over the whole valley.</p><p>People in <a href=/v>the village</a> had waited for it since the end of May, when the last clouds went by.</p></div><div><a href=1>One</a> <a href=2>Two</a> <a href=3>Three</a> Imprint</div></body></html>",
        ["Rain over the valley", "The rain began early in the morning and did not stop before night fell over the whole valley.", "People in the village had waited for it since the end of May, when the last clouds went by."],
    ),
    (
        "<body><ul><li><a href=a>Home</a><li><a href=b>About us</a><li><a href=c>Contact</a></ul><article><h1>Bread without yeast</h1><p>Mix the flour with water and leave it in a warm place for a day.</p><ul><li>Stir it every evening with a wooden spoon.</li><li>Add some more flour on the third day.</li></ul><p>After a week it smells sour, and that is how it should be.</p></article><table><tr><td><a href=x>Log in</a><td><a href=y>Terms</a></table></body>",
        ["Bread without yeast", "Mix the flour with water and leave it in a warm place for a day.", "Stir it every evening with a wooden spoon.", "Add some more flour on the third day.", "After a week it smells sour, and that is how it should be."],
    ),
    (
        "<body><div><a href=1>Archive</a> | <a href=2>Tags</a> | <a href=3>Feed</a></div><main><h2>On keeping bees</h2><blockquote>Bees ask for little and give a lot in return.</blockquote><p>My neighbour told me this when I was a child, and <b>I have never</b> forgotten it.<br>Now I keep four hives behind the barn.</p></main><p><a href=p>Back</a> <a href=q>Next</a></p></body>",
        ["On keeping bees", "Bees ask for little and give a lot in return.", "My neighbour told me this when I was a child, and I have never forgotten it. Now I keep four hives behind the barn."],
    ),
    (
        "<body><div><div>Winter sale on all coats until Friday</div><div><a href=/>Home</a><a href=/m>Map</a></div></div><div><h1>The old mill</h1><p>Nobody knows who built the mill by the river, or when its wheel last turned.</p><p>In the register of the parish it is first named in a list of debts.</p><h2>The last miller</h2><p>He sold flour to three villages and kept a goat on the roof of the shed.</p></div><div>Copyright by the valley press <a href=i>Imprint</a> <a href=p>Privacy</a></div></body>",
        ["The old mill", "Nobody knows who built the mill by the river, or when its wheel last turned.", "In the register of the parish it is first named in a list of debts.", "The last miller", "He sold flour to three villages and kept a goat on the roof of the shed."],
    ),
    (
        "<body><table><tr><td><a href=1>News</a></td><td><a href=2>Weather</a></td></tr></table><div>Dear Anna, the garden has changed a lot since you left us in spring.<br>The plum tree fell in the storm, and we planted a quince in its place.<br>Write soon and tell us how the new house is.</div><div><a href=a>Older letters</a> <a href=b>Newer letters</a></div></body>",
        ["Dear Anna, the garden has changed a lot since you left us in spring. The plum tree fell in the storm, and we planted a quince in its place. Write soon and tell us how the new house is."],
    ),
    (
        "<body><div><span>Today in the city</span> <a href=t>Tickets</a> <a href=o>Offers</a></div><h1>How to mend a chair</h1><p>Take the seat off first and look at the joints from below.</p><ol><li>Scrape the old glue away with a dull knife.</li><li>Press new glue into the holes and wait a night.</li></ol><p>Do not sit on it before the second day.</p><div>Was this page of use to you</div><ul><li><a href=1>How to mend a lamp</a></li><li><a href=2>How to mend a door</a></li></ul></body>",
        ["How to mend a chair", "Take the seat off first and look at the joints from below.", "Scrape the old glue away with a dull knife.", "Press new glue into the holes and wait a night.", "Do not sit on it before the second day."],
    ),
]


@lru_cache(maxsize=1)
def default_weights() -> dict[str, float]:
    return learn_weights(LABELLED)


def best_region(scores: list[float]) -> tuple[int, int]:
    """[start, stop) of the contiguous run with the largest sum, the longest of equals; (0, 0) if no sum is positive."""
    best, span, total, begin = 0.0, (0, 0), 0.0, 0
    for k, s in enumerate(scores):
        if total < 0:
            total, begin = 0.0, k
        total += s
        if total > best or (total == best and span != (0, 0) and begin == span[0]):
            best, span = total, (begin, k + 1)
    return span


def content_regions(found: list[tuple[str, str, int]], scores: list[float]) -> list[tuple[int, int]]:
    """The best region, and the best ones of what is left of the page, as long as they hold prose; in page order."""
    prose = [0]
    for kind, text, state in found:
        prose.append(prose[-1] + (len(_WORDS.findall(text)) if kind == "text" and state == TAKE else 0))
    regions: list[tuple[int, int]] = []

    def rest(begin: int, end: int) -> None:
        """Cuts what is left at the walls, so that a long page isn't scanned again for each of its regions."""
        at = begin
        for k in range(begin, end + 1):
            if k == end or scores[k] == -math.inf:
                if prose[k] - prose[at] >= PROSE_WORDS:
                    todo.append((at, k))
                at = k + 1

    todo = [(0, len(found))]
    while todo:
        a, b = todo.pop()
        start, stop = best_region(scores[a:b])
        start, stop = a + start, a + stop
        if stop == start or regions and prose[stop] - prose[start] < PROSE_WORDS:
            continue
        regions.append((start, stop))
        rest(a, start)
        rest(stop, b)
    return sorted(regions)


def extract(page: str | None, weights: dict[str, float] | None = None) -> str:
    """The main text of one page: blocks joined by a line feed, white space inside a block one space."""
    w, found = weights or default_weights(), tokens(page or "")
    other = w.get("", -0.3)
    scores = [-math.inf if state == WALL else 0.0 if state == CUT else w.get(kind, other) * (len(_WORDS.findall(text)) if kind in _TEXT else 1) for kind, text, state in found]
    blocks, last = [], 0
    for start, stop in content_regions(found, scores):
        # a region is widened to whole blocks
        while start > last and found[start - 1][0].lstrip("/") not in _BLOCK and scores[start - 1] > -math.inf:
            start -= 1
        while stop < len(found) and found[stop][0].lstrip("/") not in _BLOCK and scores[stop] > -math.inf:
            stop += 1
        now = []
        for kind, text, state in found[max(start, last) : stop]:
            if kind in _TEXT:
                if state != CUT:
                    now.append(text)
            elif kind.lstrip("/") in _BLOCK:
                blocks.append("".join(now))
                now = []
            elif kind == "br":
                now.append(" ")
        blocks.append("".join(now))
        last = stop
    joined = (" ".join(html.unescape(b).split()) for b in blocks)
    return "\n".join(b for b in joined if b)


def _extract(weights: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [extract(p.as_py(), weights) for p in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def html_extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", labelled: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """One row per page: page_id, url, text, n_chars. labelled: pages to learn the weights from.

    Null, empty and textless pages give an empty text. Repeated rows are extracted each; an empty table gives an empty
    result; other input columns are ignored. Pages are independent, so nothing is shuffled.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_extract(learn_weights(labelled or LABELLED)), "page_id long, url string, text string, n_chars long")
