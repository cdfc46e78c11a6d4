"""Main text: held-out pages, a plain page, odd markup and odd rows."""

import collections
import time

import numpy as np
import pytest

from quarryline.llm import html_gbt


@pytest.fixture(scope="module")
def forest():
    return html_gbt.trained()


def test_held_out_pages(forest):
    rng = np.random.default_rng(4242)
    nodes, exact, n = [], 0, 150
    for _ in range(n):
        blocks = html_gbt.blocks_of(html_gbt.parse(html_gbt.generated_page(rng)))
        x, parent = html_gbt.features(blocks)
        size = np.expm1(x[:, len(html_gbt.KINDS) + 2 * html_gbt.N_GROUPS])
        keep = html_gbt.decide(forest.log_odds(x), parent, size)
        truth = np.array([b.truth == "1" or i == 0 for i, b in enumerate(blocks)])
        nodes += (keep == truth).tolist()
        exact += html_gbt.kept_text(blocks, keep) == html_gbt.kept_text(blocks, truth)
        assert all(keep[parent[i]] for i in range(1, len(blocks)) if keep[i])
    assert np.mean(nodes) > 0.99 and exact / n > 0.9


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><!-- <p>no</p> --><div class="cookie-notice">We use cookies.</div>
<article><h1>A title &amp; more</h1><p>First   paragraph
with <b>bold</b>ness &eacute;&#8364;.<p>Second one<br>after break.</p><ul><li>item one<li>item two</ul>
<form><input><button>Go</button>Sign up</form></article><section class="comments"><div class="comment"><p>I liked this a lot, thank you.</p></div></section>
<footer>&copy; 2020 someone</footer></body></html>"""
TEXT = "A title & more First paragraph with boldness é€. Second one after break. item one item two"


def test_page(forest):
    assert html_gbt.main_texts([PAGE], forest) == [TEXT]


def test_decision_is_consistent():
    parent, size = np.array([-1, 0, 1, 1, 0]), np.array([10.0, 8, 4, 4, 2])
    assert html_gbt.decide(np.array([1.0, -3, 2, 2, -1]), parent, size).tolist() == [True, False, False, False, False]
    assert html_gbt.decide(np.array([1.0, -1, 2, 2, 1]), parent, size).tolist() == [True, True, True, True, True]


def test_rows(spark, forest):
    long = "<p>" + "many words here " * 60000 + "</p>"
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "x"), (3, "v", "", "x"), (None, "w", f"<article>{long}</article>", "x"), (5, "y", "<p>plain <text & < > \"</p></div></b><a href='>'>q</a>", "x")]
    got = html_gbt.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"), forest).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == 6 and by[1].text == TEXT and by[1].n_chars == len(TEXT)
    assert by[2].text == "" and by[3].text == "" and by[2].url is None
    assert by[None].text == ("many words here " * 60000).strip()
    assert html_gbt.extract(spark.createDataFrame([], "page_id long, url string, html string"), forest).count() == 0


#: Pages written by hand in other layouts than the generator's, and their main texts.
BY_HAND = [
    ("""<html><body><form id="aspnetForm"><div id="wrap"><div id="topnav"><a href="/">Start</a> <a href="/x">Products</a> <a href="/y">Contact</a></div>
<div id="main"><h2>Opening hours</h2><p>The library opens at nine on weekdays and closes at six, except during the summer months when it closes at four.</p><p>On Saturdays it opens at ten.</p></div>
<div id="bottom">Copyright the town library</div></div></form></body></html>""", "Opening hours The library opens at nine on weekdays and closes at six, except during the summer months when it closes at four. On Saturdays it opens at ten."),
    ("""<body><header class="site-header"><nav><a href="/">Home</a><a href="/blog">Blog</a></nav></header><main><article><header><h1>Mending a kettle</h1></header>
<p>The <label>Blue Note</label> kettle has two screws under the handle, and both must come out before the lid does.</p><p>Boil it twice before you drink from it.</p></article>
<aside class="sidebar"><h3>Popular</h3><ul><li><a href="/1">One</a></li><li><a href="/2">Two</a></li></ul></aside></main><footer><p>All rights reserved</p></footer></body>""", "Mending a kettle The Blue Note kettle has two screws under the handle, and both must come out before the lid does. Boil it twice before you drink from it."),
    ("""<table class="layout"><tr><td class="menu"><a href=1>A</a><br><a href=2>B</a><br><a href=3>C</a></td><td class="content"><h1>Rain</h1>It rained for eleven days that spring and the lower fields stood under water until the end of May.
<p>Nobody could remember a year like it, and the mill had to be closed.</p></td></tr></table>""", "Rain It rained for eleven days that spring and the lower fields stood under water until the end of May. Nobody could remember a year like it, and the mill had to be closed."),
    ("""<body><div class="cookie-consent">We use cookies to make this site better. <button>Accept</button></div><section class="post"><h1>Bread</h1><p>Mix the flour with water and salt, and leave it alone for a night before you do anything else with it.</p>
<blockquote>Time does most of the work.</blockquote><ol><li>Fold it four times.</li><li>Bake it hot.</li></ol></section><section id="comments"><h2>Comments</h2><div class="comment"><p>Mine did not rise at all, what did I do wrong?</p></div></section></body>""", "Bread Mix the flour with water and salt, and leave it alone for a night before you do anything else with it. Time does most of the work. Fold it four times. Bake it hot."),
    ("""<p class="x>Hello</p><p>the world is "quoted" in this longer line of plain text that has no page around it</p>""", None),
]


def test_pages_that_the_generator_did_not_make(forest):
    got = html_gbt.main_texts([p for p, _ in BY_HAND], forest)
    scores = []
    for (_, want), text in zip(BY_HAND, got):
        assert "<" not in text and "class=" not in text
        if want is not None:
            a, b = collections.Counter(want.split()), collections.Counter(text.split())
            scores.append(2 * sum((a & b).values()) / max(1, sum(a.values()) + sum(b.values())))
    assert np.mean(scores) > 0.9, scores
    assert "plain text that has no page around it" in got[-1]


@pytest.mark.parametrize("page", ["<" + "a" * 500_000, "<p>x" * 60_000, '<a b="x>' * 60_000, "<b>" * 50_000 + "<p>y" * 20_000, "<div>" * 30_000 + "</x>" * 60_000, "<" * 500_000, "<!--" * 100_000, "<li>q" * 40_000, "<a " + " " * 300_000])
def test_hostile_pages_take_time_in_proportion(forest, page):
    begin = time.process_time()
    html_gbt.main_texts([page], forest)
    assert time.process_time() - begin < 20


def test_an_open_head_does_not_swallow_the_page(forest):
    text = "A long enough paragraph about nothing much, so that it is the main text of this page by any measure."
    assert html_gbt.main_texts([f"<html><head><title>T</title><meta charset=x><body><article><h1>On</h1><p>{text}</p></article>"], forest) == [f"On {text}"]
