"""Hand-written pages of layouts that the generator of training pages does not make in this form."""

import pytest

from quirefold.llm import html_extract as H

FOOT = "<footer>&copy; 2024 The Daily Times. All rights reserved.</footer>"
MENU = "<ul><li><a href=/>Home</a><li><a href=/n>News</a><li><a href=/s>Sport</a><li><a href=/c>Contact</a></ul>"
VOTE = ["Council debates new bridge", "The town council met on Monday evening to discuss the new bridge.", "Members argued for two hours.", "A vote is expected in June."]
RIVER = ["River walk", "The river path opens at eight and closes at dusk on every day of the week.", "Dogs are welcome.", "Bring water."]


def paragraphs(lines, tag="p"):
    return "".join(f"<{tag}>{x}</{tag}>" for x in lines)


def page(body, head="<title>x</title>"):
    return f"<html><head>{head}</head><body>{body}</body></html>"


PAGES = {
    "bare": (page(f"<h1>{VOTE[0]}</h1>{paragraphs(VOTE[1:])}"), VOTE),
    "bare with a footer": (page(f"<h1>{VOTE[0]}</h1>{paragraphs(VOTE[1:])}{FOOT}"), VOTE),
    "bare with a menu": (page(f"<nav>{MENU}</nav><h1>{RIVER[0]}</h1>{paragraphs(RIVER[1:])}"), RIVER),
    "bare, h2": (page(f"<h2>{RIVER[0]}</h2>{paragraphs(RIVER[1:])}{FOOT}"), RIVER),
    "layout table": (page(f"<table><tr><td>{MENU}</td><td><h1>{VOTE[0]}</h1>{paragraphs(VOTE[1:])}</td></tr></table>"), VOTE),
    "layout table, footer": (page(f"<table><tr><td>{MENU}</td><td><h1>{RIVER[0]}</h1>{paragraphs(RIVER[1:])}</td></tr></table>{FOOT}"), RIVER),
    "list of links": (page(f"<article><h1>Links of the week</h1><ul><li><a href=/a>A history of the canal</a></li><li><a href=/b>How locks work</a></li></ul></article>{FOOT}"), ["Links of the week", "A history of the canal", "How locks work"]),
    "short paragraphs": (page(f"<article><h1>Notes</h1><p>One.</p><p>Two.</p><p>Three.</p></article>{FOOT}"), ["Notes", "One.", "Two.", "Three."]),
    "caption": (page(f"<article><h1>{RIVER[0]}</h1><figure><img src=a.jpg><figcaption>The path in spring</figcaption></figure>{paragraphs(RIVER[1:])}</article>{FOOT}"), [RIVER[0], "The path in spring", *RIVER[1:]]),
    "code": (page(f"<article><h1>A loop</h1><p>This loop adds the numbers up to ten and prints the sum at the end.</p><pre>for i in range(10): s += i</pre></article>{FOOT}"), ["A loop", "This loop adds the numbers up to ten and prints the sum at the end.", "for i in range(10): s += i"]),
    "references within text": (page("<article><h1>Signs</h1><p>A<b>&amp;</b>amp; B &lt;tag&gt; and a long enough sentence to be read as text.</p></article>"), ["Signs", "A&amp; B <tag> and a long enough sentence to be read as text."]),
    "long svg path": (page(f"<article><h1>{VOTE[0]}</h1><svg d={'a' * 5000}/><text>no</text></svg>{paragraphs(VOTE[1:])}</article>"), VOTE),
    "svg closed by itself": (page(f"<article><h1>{VOTE[0]}</h1><svg d='{'a' * 5000}'/>{paragraphs(VOTE[1:])}</article>"), VOTE),
    "main": (page(f"<header><a href=/>Times</a></header><main><h1>{VOTE[0]}</h1>{paragraphs(VOTE[1:])}</main>{FOOT}"), VOTE),
    "div by id": (page(f"<div id=nav>{MENU}</div><div id=content><h1>{RIVER[0]}</h1>{paragraphs(RIVER[1:])}</div><div id=footer><p>Imprint</p></div>"), RIVER),
    "section": (page(f"<nav>{MENU}</nav><section><h1>{RIVER[0]}</h1>{paragraphs(RIVER[1:])}</section>{FOOT}"), RIVER),
    "sidebar before": (page(f"<aside><h3>Related</h3>{MENU}</aside><article><h1>{VOTE[0]}</h1>{paragraphs(VOTE[1:])}</article>{FOOT}"), VOTE),
    "sidebar behind": (page(f"<article><h1>{VOTE[0]}</h1>{paragraphs(VOTE[1:])}</article><div class=sidebar>{MENU}</div>{FOOT}"), VOTE),
    "comments": (page(f"<article><h1>{VOTE[0]}</h1>{paragraphs(VOTE[1:])}</article><section class=comments><h2>Comments</h2><div class=comment><p>I never liked the old bridge anyway.</p></div></section>{FOOT}"), VOTE),
    "cookie notice": (page(f"<div class=cookie-notice><p>We use cookies to improve your experience on this site.</p><button>OK</button></div><article><h1>{RIVER[0]}</h1>{paragraphs(RIVER[1:])}</article>{FOOT}"), RIVER),
    "newsletter form": (page(f"<article><h1>{RIVER[0]}</h1>{paragraphs(RIVER[1:])}</article><form class=newsletter><p>Sign up for our weekly letter.</p><input><button>Join</button></form>{FOOT}"), RIVER),
    "advert in the text": (page(f"<article><h1>{VOTE[0]}</h1><p>{VOTE[1]}</p><div class=advert>Buy the best shoes today</div>{paragraphs(VOTE[2:])}</article>{FOOT}"), VOTE),
    "quote": (page(f"<article><h1>{VOTE[0]}</h1><p>{VOTE[1]}</p><blockquote><p>We need this bridge now.</p></blockquote><p>{VOTE[3]}</p></article>{FOOT}"), [VOTE[0], VOTE[1], "We need this bridge now.", VOTE[3]]),
    "unclosed paragraphs": (page(f"<article><h1>{VOTE[0]}</h1><p>{VOTE[1]}<p>{VOTE[2]}<p>{VOTE[3]}</article>{FOOT}"), VOTE),
    "data table": (page(f"<article><h1>Times</h1><p>The ferry leaves from the old pier at the times that are given here.</p><table><tr><td>Monday</td><td>Nine</td></tr></table></article>{FOOT}"), ["Times", "The ferry leaves from the old pier at the times that are given here.", "Monday", "Nine"]),
    "numbered list": (page(f"<article><h1>Bread</h1><p>A simple loaf needs four things and a warm place to rise for a night.</p><ol><li>Mix the flour.</li><li>Wait.</li></ol></article>{FOOT}"), ["Bread", "A simple loaf needs four things and a warm place to rise for a night.", "Mix the flour.", "Wait."]),
    "script and style": (page(f"<script>var a = '<p>no</p>';</script><style>p {{}}</style><article><h1>{RIVER[0]}</h1>{paragraphs(RIVER[1:])}</article>{FOOT}"), RIVER),
    "nested wrappers": (page(f"<div class=wrapper><div class=container><nav>{MENU}</nav><div class=content><h1>{VOTE[0]}</h1>{paragraphs(VOTE[1:])}</div></div></div>{FOOT}"), VOTE),
    "subheadings": (page(f"<article><h1>{RIVER[0]}</h1><h2>Times</h2><p>{RIVER[1]}</p><h2>Rules</h2>{paragraphs(RIVER[2:])}</article>{FOOT}"), [RIVER[0], "Times", RIVER[1], "Rules", *RIVER[2:]]),
    "share bar": (page(f"<article><h1>{VOTE[0]}</h1>{paragraphs(VOTE[1:])}<div class=share><ul><li><a href=/t>Tweet</a><li><a href=/m>Mail</a></ul></div></article>{FOOT}"), VOTE),
    "article header": (page(f"<article><header><h1>{VOTE[0]}</h1></header>{paragraphs(VOTE[1:])}</article>{FOOT}"), VOTE),
    "breadcrumb": (page(f"<div class=breadcrumb>{MENU}</div><main><h1>{RIVER[0]}</h1>{paragraphs(RIVER[1:])}</main>{FOOT}"), RIVER),
    "empty": (page(""), []),
}


@pytest.fixture(scope="module")
def trees():
    return H.fit_trees()


#: Known to fail: the title is lost where nothing but its tag tells it from a widget's.
LOST = {"bare, h2"}


@pytest.mark.parametrize("name", [pytest.param(n, marks=pytest.mark.xfail(strict=True)) if n in LOST else n for n in PAGES])
def test_pages_by_hand(trees, name):
    html, lines = PAGES[name]
    assert next(iter(H.extract_pages([html], trees))) == "\n".join(lines)


@pytest.mark.parametrize(("attributes", "closes"), [("d=a/", False), ("d='a'/", True), ("d=a /", True), ("/", True), ("d", False), ("", False), ('x="/" y=/', False), ("d= a/", False), ("d=" + "a" * 9000 + "/", False), ("hidden/", True), ("a='" + "b=c/ " * 3000 + "'/", True)])
def test_tags_that_close_themselves(attributes, closes):
    assert H._closes_itself(attributes) is closes
