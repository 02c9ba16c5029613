"""No part of a page is lost to an element that is left open."""

import random
import time

from scanledger.llm.html_text import main_text, text_spans


def test_an_unwanted_element_without_end_tag_ends_with_its_kind_or_parent():
    assert main_text('<article><p class="ad">Buy<p>Text</p><p>More</p></article>') == "Text\nMore"
    assert main_text('<article><p class="ad">Buy</article><article><p>Next</p></article>') == "Next"
    assert main_text('<article><p class="notice">Old<div>Text</div></article>') == "Text"
    assert main_text('<article><ul><li class="share">Tell<ul><li>all</ul><li>Item</ul><p>Text</article>') == "Item\nText"
    assert main_text('<body><ul><li class="share">Tell</ul><p>A text that is not short, but not long either.</p></body>') == "A text that is not short, but not long either."
    assert main_text('<article><div><span class="ad">Buy</div><p>Text</p></article>') == "Text"
    assert main_text('<article><table><tr><td class="ad">Buy<td>Cell<tr><td>Next</table></article>') == "Cell\nNext"
    assert main_text('<article><dl><dt class="ad">Buy<dd>Text</dl></article>') == "Text"
    # What is properly closed, and stray end tags.
    assert main_text('<article><div class="ad"><p>a<p>b</div><p>Text</article>') == "Text"
    assert main_text("<body><div><article><p>One</p></div><p>Two</p></article></div><p>out</p></body>") == "One\nTwo"
    assert main_text('<article><p>One</p><article class="comment"><p>x</p><article>y</article>z</article><p>Two</p></article>') == "One\nTwo"


def test_raw_elements_that_close_themselves_are_empty():
    assert main_text('<article><svg/><p>One</p><svg width="1" /><p>Two</p><math/>Three</article>') == "One\nTwo\nThree"
    assert main_text("<article><svg><text>x</text></svg><p>One</p><iframe src=http://x/>old</iframe><p>Two</p></article>") == "One\nTwo"


def test_short_parts_of_pages_without_an_article_stay():
    long = "".join(f"<p>{'word ' * 40}{i}</p>" for i in range(3))
    box = '<div class="newsletter"><p>Sign up</p><p>now</p><p>please</p><p>do</p></div>'
    links = "<ul>" + "".join(f"<li><a href=x{i}>Link number {i}</a></li>" for i in range(5)) + "</ul>"
    page = f"<body>{links}<h1>Short title</h1><p>A short lead.</p>{box}{long}{box}<h2>End</h2><p>A short closing section of its own.</p>{links}<p>Bye.</p></body>"
    got = main_text(page).split("\n")
    assert got[:2] == ["Short title", "A short lead."] and got[-3:] == ["End", "A short closing section of its own.", "Bye."] and len(got) == 8


def test_unwanted_elements_around_an_article_count_once_they_are_closed():
    assert main_text("<main><p>A first paragraph.</p><aside><article><p>Teaser</p></article><p>more</p></aside><p>A second one.</p></main>") == "A first paragraph.\nA second one."
    assert main_text('<article><p>T</p></article><section id="comments"><article><p>reader says hi</p></article></section>') == "T"
    assert main_text('<article><p>T</p></article><div class="related"><article><p>x</p></article></div>') == "T"
    assert main_text("<nav><ul><li>x<article><p>Text</p></article>") == "Text"


def test_words_of_classes_count_only_where_the_whole_name_says_so():
    assert main_text('<article><p class="side-by-side">One</p><div class="ad-free-reading">Two</div><p>E = <math><mi>m</mi></math></p></article>') == "One\nTwo\nE = m"
    assert main_text('<article><p>One</p><p class="ad-box">no</p><div class="cookieNotice">no</div><div id="sidebar_2">no</div><p class="x share-buttons">no</p></article>') == "One"
    assert main_text('<p title="is hidden">yes</p><p hidden>no</p>') == "yes"


def test_unwanted_parts_of_a_line_leave_the_rest_of_it_whole():
    assert main_text('<article><p>a <span class="share">x</span> b <button>Send</button> c</p></article>') == "a b c"


def test_links_stay_in_running_text_and_go_in_lists():
    page = "<article><p>One</p><p><a href=x>Linked</a></p><p>Two</p><ul><li><a href=1>1</a><li><a href=2>2</a><li><a href=3>3</a></ul><p>Three</p></article>"
    assert main_text(page) == "One\nLinked\nTwo\nThree"
    assert main_text(page.replace("article", "div")) == "One\nLinked\nTwo\nThree"
    assert main_text("<article><p>One <a href=x>with a link</a> in it.</p></article>") == "One with a link in it."


def test_spans_by_brute_force():
    rng = random.Random(6)
    for _ in range(300):
        weights = [rng.choice([0, 0, 0, 5, 40]) for _ in range(rng.randint(0, 14))]
        for window in (1, 2, 3, 4):
            kept = set()
            heavy = [i for i, w in enumerate(weights) if w]
            for i in range(len(weights)):
                a, b = max((h for h in heavy if h <= i), default=None), min((h for h in heavy if h >= i), default=None)
                if a is not None and b is not None and not any(sum(weights[j : j + window]) == 0 for j in range(a + 1, b - window + 1)):
                    kept.add(i)
            spans = text_spans(weights, window)
            assert {i for a, z in spans for i in range(a, z)} == kept and all(a < z for a, z in spans)


def test_odd_and_very_long_pages_take_linear_time():
    assert main_text("a < b and c > d") == "a < b and c > d" and main_text('<p>x</p><a "') == "x"
    for piece in ('<a "', '<a b="', "<div>", "<p>x", "<", "<!--", "<script>", "<svg/", "<li><div>"):
        began = time.time()
        main_text(piece * (1_000_000 // len(piece)))
        assert time.time() - began < 20, piece
