"""What of a page belongs to the article, and pages of deep or broken markup."""

import time

import pytest

from sparkloom.llm import html_extract

ARTICLE = """<body><div class="site-nav">Menu here</div><article><header class="entry-header"><h1>Title</h1></header><p class="share-price">The share price rose.</p>
<h2 id="notice">Notice of a thing</h2><p>Plain words.</p><div class="related-work">Work that is related.</div><p><math><mi>x</mi></math> is a number</p>
<details><summary>More</summary>Hidden away</details><p><label>Kept</label></p><div class="ad-slot-3">Buy</div><div class="cookie-notice">We use cookies</div>
<nav>Next</nav><form><label>Mail</label></form><ul class="share-links"><li>Tweet</li></ul><section id="comments"><p>First!</p></section><aside>Side</aside></article></body>"""


def text_of(html):
    page = html_extract.Page(html)
    return page.text({page.paths[page.best()]})


def test_names_alone_take_nothing_out_of_the_article():
    assert text_of(ARTICLE).split("\n") == ["Title", "The share price rose.", "Notice of a thing", "Plain words.", "Work that is related.", "x is a number", "More", "Hidden away", "Kept"]


@pytest.mark.parametrize("html", ["<div>x" * 150_000, "<a " * 300_000, "<span>" * 80_000 + "</b>" * 80_000, '<a "' * 200_000 + ">x", "<h2>a" * 150_000, "<li><h2>b" * 100_000, "<!--" * 200_000, "<p '<a \"" * 100_000 + ">y"], ids=["deep", "open", "stray", "quotes", "headings", "items", "comments", "mixed"])
def test_a_megabyte_of_bad_markup_takes_seconds(html):
    start = time.process_time()
    page = html_extract.Page(html)
    page.text({page.paths[page.best()]} if page.best() >= 0 else set())
    assert time.process_time() - start < 8


def test_containers_of_equal_paths_are_equal():
    a, b = html_extract.Page("<div class=x1><div id=y>a</div></div>"), html_extract.Page("<div class=x2><div id=y>b</div><div id=z>c</div></div>")
    assert a.paths[2] == b.paths[2] != b.paths[3] and len(set(b.paths)) == 4
