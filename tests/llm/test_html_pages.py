"""Main text of pages written and labelled by hand, and of deep ones."""

import random
import re
import time

import pytest

from lexspan.llm import html_text

#: (page, main text). None of them comes from the generator that makes the training pages.
BY_HAND = [
    (
        """<html lang="en"><head><meta charset="utf-8"><title>Bridge reopens</title><script>track()</script></head>
<body><header id="masthead"><a href="/">The Daily Courier</a><nav><ul><li><a href="/n">News</a></li><li><a href="/s">Sport</a></li></ul></nav></header>
<main><article><h1>Old bridge reopens after two years</h1><p>The stone bridge over the river opened to walkers on Monday.
It had been closed since the flood.</p><figure><img src="b.jpg"></figure><p>Repairs cost 3 million &euro;, the council said. &ldquo;We are relieved,&rdquo; the mayor added.</p>
<div class="ad-box advert">Cheap flights from 19.99!</div><p>Cars may cross again <em>next spring</em>.</p></article></main>
<section id="comments"><h2>Comments</h2><p>About time! I walked the long way for two years.</p></section>
<footer><p>Copyright 2024 The Daily Courier. All rights reserved.</p></footer></body></html>""",
        "Old bridge reopens after two years The stone bridge over the river opened to walkers on Monday. It had been closed since the flood. Repairs cost 3 million €, the council said. “We are relieved,” the mayor added. Cars may cross again next spring.",
    ),
    (
        """<!doctype html><body><div class="cookie-consent"><p>This site uses cookies to improve your visit.</p><button>Accept</button></div>
<nav class="breadcrumb"><a href="/">Home</a> &gt; <a href="/r">Recipes</a></nav>
<div class="content"><h2>Potato soup</h2><p>Peel the potatoes and cut them into small cubes. Fry an onion in butter until it is soft.</p>
<ul><li>500 g of potatoes, peeled.<li>One large onion, chopped.<li>A litre of stock.</ul>
<p>Add the stock, boil for twenty minutes and serve with bread.</p></div>
<aside class="sidebar"><h3>Popular</h3><ul><li><a href="/1">Apple pie</a></li><li><a href="/2">Lentils</a></li></ul></aside>
<form action="/subscribe" class="newsletter"><label>Your mail</label><input name="m"><button>Subscribe</button></form></body>""",
        "Potato soup Peel the potatoes and cut them into small cubes. Fry an onion in butter until it is soft. 500 g of potatoes, peeled. One large onion, chopped. A litre of stock. Add the stock, boil for twenty minutes and serve with bread.",
    ),
    (
        """<html><body><div id="nav" class="menu"><a href="/a">Start</a><a href="/b">Kontakt</a></div>
<article><h1>Der Wald im Winter</h1><p>Im Winter ist der Wald still. Die meisten V&ouml;gel sind fort&shy;gezogen.</p>
<blockquote>Schnee d&auml;mpft jeden Schritt.</blockquote><p>Nur der Specht ist noch zu h&#246;ren.</article>
<div class="related"><p>Das k&ouml;nnte Sie auch interessieren: Der See im Sommer.</p></div><footer>Impressum</footer></body></html>""",
        "Der Wald im Winter Im Winter ist der Wald still. Die meisten Vögel sind fort\xadgezogen. Schnee dämpft jeden Schritt. Nur der Specht ist noch zu hören.",
    ),
]


@pytest.fixture(scope="module")
def model():
    return html_text.fit()


@pytest.mark.parametrize("k", range(len(BY_HAND)))
def test_pages_labelled_by_hand(model, k):
    page, want = BY_HAND[k]
    assert model.text(page) == want


N = 100_000


@pytest.mark.parametrize("page", ["<div>" * N + "some text here." + "</div>" * N, "<div>" * N + "</x>" * N, "<b>" * N + "<div></div>" * N, "<div>" * N + "<li></li>" * N, "<b><div>" + "<i>" * N + "</b>" * N])
def test_deep_pages_take_linear_time(model, page):
    start = time.perf_counter()
    text = model.text(page)
    assert time.perf_counter() - start < 60 and text in ("", "some text here.")


def test_a_very_long_page_is_read_whole(model):
    body = "".join(f"<p>Paragraph number {i} tells a little more of the story, and ends here.</p>" for i in range(20_000))
    text = model.text(f"<html><body><nav><a href='/'>Home</a></nav><article>{body}</article></body></html>")
    assert text.startswith("Paragraph number 0 ") and text.count("Paragraph number") == 20_000


ARTICLE = "<article><h1>Rivers</h1><p>The river rose in the night, and by morning the lower fields stood under water.</p><p>Nobody was hurt, said the mayor.</p></article>"
TEXT = "Rivers The river rose in the night, and by morning the lower fields stood under water. Nobody was hurt, said the mayor."

#: Legal or common pages whose head, title or silent elements lack tags.
UNCLOSED = [
    f"<html><head><title>T</title><body>{ARTICLE}",
    f"<html><head><title>T</title>{ARTICLE}",
    f"<title>T</title>{ARTICLE}",
    f"<head><meta charset=utf-8><link rel=x><style>p {{}}</style>{ARTICLE}</head>",
    f"<html><head><title>T<body>{ARTICLE}</body></html>",
    f"<html><head><title>T</head><body>{ARTICLE}</body></html>",
    f"<title>T {ARTICLE}",
    f"<html><head><noscript><link rel=s><body>{ARTICLE}",
    f"<html><head><noscript><img src=x></noscript><title>T</title><body>{ARTICLE}",
    f"<html><head><noscript><img src=x></head><body>{ARTICLE}",
    f"<body><div><noscript>Turn scripts on</div>{ARTICLE}</body>",
    f"<body><noscript><p>Turn scripts on</p>{ARTICLE}</body>",
    f"<body><svg><g><title>icon</svg>{ARTICLE}</body>",
    f"<body><select><option>a<option>b</select>{ARTICLE}</body>",
    f"<body><svg/><template/>{ARTICLE}</body>",
    f"<html><head><title>a <b>bold</b> title</title><base href=x>{ARTICLE}",
]


@pytest.mark.parametrize("k", range(len(UNCLOSED)))
def test_optional_and_missing_tags(model, k):
    assert model.text(UNCLOSED[k]) == TEXT


def test_text_ends_a_head_without_an_end(model):
    assert model.text("<head><title>T</title>Plain words.") == "Plain words."


def test_silent_elements_that_are_closed_stay_silent(model):
    page = f"<body><noscript><section><h1>no</h1></section></noscript><template><article><p>No text of a template is shown here.</p></article></template>{ARTICLE}"
    assert model.text(page) == TEXT


OPTIONAL = re.compile(r"</?(?:html|head|body)>|</(?:p|li|td|tr)>")


def test_optional_tags_dropped_at_random(model):
    """An end tag of p is left out only where a block or the parent's end follows, as the standard has it."""
    rng = random.Random(11)
    for page in html_text.labelled_pages(1000, seed=77):
        want = model.text(page)

        def drop(m):
            follows = page[m.end() : m.end() + 30]
            ended = m[0] != "</p>" or re.match(r"</(?!a>|b>|i>|em>|span>)|<(?:p|div|ul|ol|h[1-6]|table|section|article|aside|header|footer|nav|form|blockquote|pre)\b", follows)
            return "" if ended and rng.random() < 0.5 else m[0]

        assert model.text(OPTIONAL.sub(drop, page)) == want


def test_deep_silence_takes_linear_time(model):
    start = time.perf_counter()
    assert model.text("<svg>" + "<g>" * N + "</x>" * N + "</svg>" + ARTICLE) == TEXT
    assert model.text("<svg></b>" * N + "</svg>" * N + ARTICLE) == TEXT
    assert time.perf_counter() - start < 60
