"""Pages whose articles stand in elements that look hidden, unfinished or raw but are not."""

from __future__ import annotations

import pytest

from huegrid.llm.html_blocks import DEPTH, Block, Element, leaf_blocks
from huegrid.llm.html_crf import block_features, main_text, trained

SHOWN = ['style="overflow:hidden"', 'class="overflow-hidden"', 'data-title="The hidden valley"', 'aria-hidden="false"', "data-hidden", 'title="display: none"', 'style="display:none;display:block"', 'style="--display:none"', 'hidden="until-found"']
HIDDEN = ["hidden", 'class="a" hidden=""', "HIDDEN=hidden", 'style="color:red; Display : NONE"', "style='display:none !important; display:block'", "style=display:none", 'aria-hidden="true"', "aria-hidden=TRUE"]
ARTICLE = "<article><h1>The valley</h1><p>A long walk through the valley begins at the old mill and follows the river.</p></article>"


@pytest.mark.parametrize("attributes", SHOWN)
def test_shown(attributes):
    page = f"<html><body><div {attributes}>{ARTICLE}</div></body></html>"
    assert not any(b.hidden for b in leaf_blocks(page))
    assert "follows the river" in main_text(page, trained())


@pytest.mark.parametrize("attributes", HIDDEN)
def test_hidden(attributes):
    page = f"<html><body><div {attributes}>{ARTICLE}</div></body></html>"
    assert all(b.hidden for b in leaf_blocks(page)) and main_text(page, trained()) == ""


@pytest.mark.parametrize("tag", ["svg", "math", "object", "canvas", "textarea", "template", "title"])
def test_an_unclosed_tag_drops_no_text_after_it(tag):
    assert [b.text for b in leaf_blocks(f"<body><p>one</p><{tag}><p>two</p><p>three</p>")] == ["one", "two", "three"]


@pytest.mark.parametrize("tag", ["script", "style", "xmp"])
def test_an_unclosed_raw_text_runs_to_the_end(tag):
    assert [b.text for b in leaf_blocks(f"<body><p>one</p><{tag}><p>two</p>")] == ["one"]


def test_formulas_and_fallbacks_are_text():
    page = "<p>so <math><mrow><mi>e</mi><mo>=</mo><msup><mi>c</mi><mn>2</mn></msup></mrow></math> holds</p><object data=x><p>a film</p></object><canvas>a chart</canvas><svg><path/></svg><p>end</p>"
    assert [b.text for b in leaf_blocks(page)] == ["so e=c2 holds", "a film", "a chart", "end"]


def test_digits_count_over_the_whole_block():
    digits = lambda text: "digits" in block_features([Block(text, Element("p"), 0)])[0]
    assert digits("a" * 200 + "1" * 300) and not digits("1" * 200 + "a" * 2000)


def test_noscript_is_no_text():
    page = f"<body><noscript><p>Please enable JavaScript to read this page in full.</p></noscript>{ARTICLE}</body>"
    assert "JavaScript" not in main_text(page, trained()) and "follows the river" in main_text(page, trained())


@pytest.mark.parametrize("unit", ["<a ", "<div><p>x", "<div>x", '<a ">"', "</script <", "<b>x", "<div class=q%d>x", "<!-- ", "<x y='", "&#", "<p><b>y"])
def test_broken_pages_take_time_in_proportion(unit):
    import time

    took = []
    for n in (3000, 24_000):
        page = "".join(unit % k for k in range(n)) if "%d" in unit else unit * n
        t = time.process_time()
        main_text(page, trained())
        took.append(time.process_time() - t)
    assert took[1] < 30 * took[0] + 0.5


def test_deep_and_broken_markup_keeps_its_text():
    deep = leaf_blocks("<div>" * 3 * DEPTH + "low" + "</div>" * 3 * DEPTH + "<p>after</p>")
    assert [b.text for b in deep] == ["low", "after"] and deep[1].owner.parent.tag == ""
    assert [b.text for b in leaf_blocks("<p>a < b, 3 <4 and c > d</p><p>e")] == ["a < b, 3 <4 and c > d", "e"]
    assert [b.text for b in leaf_blocks('<p>one</p><p title="open>two</p><p>three</p>')] == ["one", "two", "three"]


def test_a_page_written_by_hand():
    """Markup of another kind than the generated pages that the field was fitted on."""
    page = """<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>Bridges</title><style>.x{}</style></head><body class="home page-template">
      <header id="masthead"><a href="/">The Daily River</a><nav aria-label="primary"><ul><li><a href="/news">News</a></li><li><a href="/sport">Sport</a></li></ul></nav></header>
      <div id="cookie-notice" class="notice"><p>We use cookies to improve this site.</p><button>Accept</button></div>
      <main><article><h1>Old bridge opens again</h1><p>The bridge over the river was closed for nine years. On Sunday it opened again, and the whole town walked across it.</p>
      <p>Its stones were numbered, taken down and put back one by one &mdash; 4,212 in all.</p><aside class="newsletter"><p>Subscribe to our newsletter</p><form><input name="mail"><button>Go</button></form></aside>
      <p>The mayor said that the next bridge would take less time.</p></article></main>
      <section id="comments"><h2>2 comments</h2><p>Great news, thank you for this!</p><p>Finally open.</p></section>
      <footer><p>&copy; 2024 The Daily River. All rights reserved.</p></footer><script>track()</script></body></html>"""
    want = ["Old bridge opens again", "The bridge over the river was closed for nine years. On Sunday it opened again, and the whole town walked across it.", "Its stones were numbered, taken down and put back one by one — 4,212 in all.", "The mayor said that the next bridge would take less time."]
    assert main_text(page, trained()).split("\n\n") == want


def test_a_news_page_written_by_hand():
    page = """<html><body><div class="top-bar"><span>Tuesday</span><a href="/login">Log in</a></div><div class="advertisement"><p>Buy one, get one free at the shoe store this week only.</p></div>
      <div class="story-body"><h1>Council votes for new tram line</h1><p>The city council voted on Monday to build a second tram line from the harbour to the university.</p>
      <div class="ad-slot"><p>Advertisement: the best coffee in town.</p></div><p>Work is to begin next spring and will take four years, officials said.</p><blockquote>It will change how people move through this city.</blockquote></div>
      <div class="related-stories"><h3>Read more</h3><ul><li><a href=1>Tram fares to rise</a></li></ul></div><div class="newsletter-signup"><p>Get the news in your inbox every morning.</p><form><input><button>Sign up</button></form></div></body></html>"""
    want = ["Council votes for new tram line", "The city council voted on Monday to build a second tram line from the harbour to the university.", "Work is to begin next spring and will take four years, officials said.", "It will change how people move through this city."]
    assert main_text(page, trained()).split("\n\n") == want
