"""Main text of pages whose parts are spread, or named like noise."""

from __future__ import annotations

import time

import pytest

from gleaner.llm.htmltext import extract

LINE = "Words of the story go on here."


def said(start: str, n: int) -> str:
    return " ".join([start, *[LINE] * n])


FIRST = f"<article><h1>A</h1><p>{said('One.', 9)}</p><p>{said('Two.', 5)}</p></article>"


@pytest.mark.parametrize(
    "page,text",
    [
        (f"<nav><a href=/>x</a></nav>{FIRST}<article><h2>B</h2><p>{said('Three.', 6)}</p></article><footer>f</footer>", ["A", said("One.", 9), said("Two.", 5), "B", said("Three.", 6)]),
        ("<div>" + "".join(f"<article><p>{said(f'Item {k}.', 5)}</p></article>" for k in range(5)) + "</div>", [said(f"Item {k}.", 5) for k in range(5)]),
        (f"<div>{FIRST}</div><div><ul>{'<li><a href=/a>go</a>' * 30}</ul><article><p>{said('Three.', 6)}</p></article></div>", ["A", said("One.", 9), said("Two.", 5), said("Three.", 6)]),
        (FIRST + "<div>" + "".join(f"<article><h3><a href=/{k}>Read {k}</a></h3></article>" for k in range(4)) + "</div>", ["A", said("One.", 9), said("Two.", 5)]),
    ],
    ids=["two articles", "a feed", "an article among links", "cards of links"],
)
def test_articles_of_a_page(page, text):
    assert extract(f"<body>{page}</body>") == "\n".join(text)


@pytest.mark.parametrize(
    "page,text",
    [
        (f"<article>{{0}}<h2 id='related-work'>Related work</h2><p>{said('Three.', 4)}</p></article>", ["Related work", said("Three.", 4)]),
        (f"<article>{{0}}<h2 id=cookies>Cookies</h2><p>{said('Three.', 4)}</p></article>", ["Cookies", said("Three.", 4)]),
        (f"<article>{{0}}<section id='discussion'><h2>Discussion</h2><p>{said('Three.', 6)}</p></section></article>", ["Discussion", said("Three.", 6)]),
        (f"<article>{{0}}<h2 id='search-results'>Results</h2><p class='no-follow'>{said('Three.', 4)}</p></article>", ["Results", said("Three.", 4)]),
        ("<div class='content has-sidebar'>{0}</div>", []),
        ("<form>{0}</form>", []),
        ("<form method=post><div>{0}</div></form>", []),
        ("<article>{0}<div class='related-posts'><ul>" + "<li><a href=/a>Go there</a>" * 9 + "</ul></div><form><p>mail</p></form><div class='post-comments'><p>Dense talk of others.</p></div></article>", []),
    ],
    ids=["related-work", "cookies", "discussion", "search-results", "has-sidebar", "form", "form of a div", "real noise"],
)
def test_names_of_noise(page, text):
    first = [said("One.", 9), said("Two.", 5)]
    html = "<body><nav><a href=/>x</a></nav>" + page.format("".join(f"<p>{x}</p>" for x in first)) + "<div class=ad>Buy</div></body>"
    assert extract(html) == "\n".join(first + text)


def test_a_form_may_be_the_page():
    assert extract("<form><p>" + LINE + "</p></form>") == LINE


@pytest.mark.parametrize("container", ["div", "section", "td"])
def test_thin_paragraphs_of_a_run_belong_to_it(container):
    """Without an article element, density alone chooses a paragraph; the run it stands in is kept whole."""
    rows = ["<h2>Head</h2>", f"<p>{said('One.', 9)}</p>", "<p>Thin.</p>", f"<p>{said('Two.', 20)} <b>{LINE}</b></p>", "<ul><li>Point</li></ul>"]
    page = f"<table><tr><td><a href=/>x</a></td></tr></table><div><a href=/>Elsewhere</a></div><{container}>{''.join(rows)}</{container}><div><a href=/>More</a></div>"
    assert extract(f"<body>{page}</body>") == "\n".join(["Head", said("One.", 9), "Thin.", f"{said('Two.', 20)} {LINE}", "Point"])


@pytest.mark.parametrize("page", ["<h1><div>" + "<b><h2></h2>" * 8000, "<ul>" + "<li><div>" * 8000, "<p>" + "<b><i>" * 8000 + "</i>" * 8000, "<table>" + "<tr><td><b>" * 8000])
def test_open_elements_take_time_in_proportion(page):
    start = time.perf_counter()
    extract(page)
    assert time.perf_counter() - start < 2
