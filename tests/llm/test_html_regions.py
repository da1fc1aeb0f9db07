"""Pages with boilerplate of any size, and articles in several regions."""

from __future__ import annotations

from collections import Counter

import pytest

from marktide.llm import html_extract

ARTICLE = [f"Paragraph number {k} of the article tells of the valley and of its people at some length." for k in range(5)]
NOISE = [f"Visitor {k} says that this was a very good read and wants to hear more of it soon." for k in range(12)]
P = "".join(f"<p>{x}</p>" for x in ARTICLE)


def noise(n, tag):
    return "".join(f"<{tag}>{x}</{tag}>" for x in NOISE[:n])


@pytest.mark.parametrize("n", [2, 5, 12])
@pytest.mark.parametrize(
    "form",
    [
        "<ol class='comment-list'>{li}</ol>", "<section class='comments-area'>{p}</section>", "<div id=comments>{p}</div>", "<div class='post-comments'><article class='comment-body'>{p}</article></div>", "<div class='ad-slot'>{p}</div>", "<div id='adSlot1'>{p}</div>",
        "<div class='cookie-notice'>{p}</div>", "<div class='hidden'>{p}</div>", "<aside class=sidebar>{p}</aside>", "<aside>{p}</aside>", "<form><input name=a>{bare}<textarea></textarea></form>", "<nav>{p}</nav>", "<footer>{p}</footer>", "<div role=complementary>{p}</div>",
    ],
)
@pytest.mark.parametrize("place", ["after", "before", "within", "in article"])
def test_boilerplate_goes_whatever_its_size(form, n, place):
    if form.startswith("<form") and n > 2:
        n = 2  # a form that holds running text in words of its own
    part = form.format(p=noise(n, "p"), li=noise(n, "li"), bare=" ".join(NOISE[:n]))
    body = {"after": f"<h1>Of the valley</h1>{P}{part}", "before": f"{part}<h1>Of the valley</h1>{P}", "within": f"<h1>Of the valley</h1><p>{ARTICLE[0]}</p>{part}" + "".join(f"<p>{x}</p>" for x in ARTICLE[1:])}
    page = f"<body><article>{body['within']}</article></body>" if place == "in article" else f"<html><body><div>{body[place]}</div></body></html>"
    assert html_extract.extract(page) == "\n".join(["Of the valley", *ARTICLE])


@pytest.mark.parametrize("links", [1, 15, 200])
def test_both_regions_stay(links):
    menu = "<ul>" + "".join(f"<li><a href=/{k}>Story number {k}</a></li>" for k in range(links)) + "</ul>"
    page = f"<body><div>{P}{menu}<p>A2: the second part goes on after the list of links.</p></div></body>"
    got = html_extract.extract(page)
    assert got.startswith("\n".join(ARTICLE)) and got.endswith("A2: the second part goes on after the list of links.")
    assert links == 1 or "Story number" not in got


@pytest.mark.parametrize(
    "page",
    [
        f"<body><form id=aspnetForm method=post><input type=hidden name=v><div>{P}</div><input type=submit></form></body>", f"<body class='has-sidebar comments-open'><div class='with-ads'>{P}</div></body>",
        f"<body><div class='hidden'><h1>Of the valley</h1>{P}</div></body>", f"<body><main class='promo'>{P}</main></body>", f"<body><article class='post related-topic'>{P}</article></body>", f"<body><div class='popup-page'><main>{P}</main></div></body>",
    ],
)
def test_forms_and_names_around_the_page(page):
    assert html_extract.extract(page).endswith("\n".join(ARTICLE))


def test_search_decides_on_pages_as_they_are(spark, monkeypatch):
    """The test data's pages with their names: without the search most would have more text; it alone loses and adds next to nothing."""
    import re

    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    got = [html_extract.extract(p) for p in pages]
    for p, g in zip(pages, got, strict=True):
        inside = re.search(r"<article>(.*?)</article>", p, re.S)[1]
        want = " ".join(html_extract.html.unescape(re.sub(r"<[^>]*>", " ", inside)).split()).split()
        both = sum((Counter(want) & Counter(g.split())).values())
        assert both >= 0.99 * len(want) and both >= 0.99 * len(g.split())
    monkeypatch.setattr(html_extract, "best_region", lambda scores: (0, len(scores)))
    assert sum(html_extract.extract(p) != g for p, g in zip(pages, got, strict=True)) > 0.9 * len(pages)


def test_many_regions_take_linear_time():
    import time

    block = "<p>Eight words of prose stand in each block.</p><ul>" + "<li><a href=x>more</a></li>" * 10 + "</ul><nav>Menu</nav>"
    took = []
    for n in (200, 1600):
        began = time.time()
        assert html_extract.extract("<body>" + block * n).count("Eight") == n
        took.append(time.time() - began)
    assert took[1] < 24 * took[0] + 1
