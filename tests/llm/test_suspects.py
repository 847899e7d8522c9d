"""Elements with suspect names: what they hold decides whether they are of the article."""

import pytest

from sparkloom.llm import html_extract

PROSE = "The tree keeps its nodes in order. A walk over it visits every key once."
OUT = [
    '<div class="comment-body"><p>First of all, I liked this text a lot.</p></div>',
    '<div class="comment-content">I liked this text a lot.</div>',
    '<div class="user-comments"><p>Good text, I read it twice.</p><p>Not so good, I read it once.</p></div>',
    '<ul><li class="comment-entry">Good text, I read it twice.</li></ul>',
    '<div id="disqus_thread"><p>Good text, I read it twice.</p></div>',
    '<div class="reply"><p>I agree with all of this.</p></div><div class="reply"><p>I do not agree with this.</p></div>',
    '<div class="newsletter-form">Get our letter once a week. <input type="email"><button>Send</button></div>',
    '<div class="newsletter-form">Get our letter once a week.</div>',
    '<div class="cookie-text">We use cookies to make this site better. You can say no at any time.</div>',
    '<div class="advertisement-label">Advertisement</div>',
    '<div class="ad"><p>Buy two of these and get one for nothing today.</p></div>',
    '<div class="related-posts"><p>Another tree that keeps its keys in order.</p></div>',
    '<div class="related"><a href="/x">Another tree that keeps its keys in order.</a></div>',
    '<header class="site-header"><p>The daily tree, a paper of trees.</p></header>',
    '<div class="search">Search <input name="q"></div>',
    '<ul class="share-links"><li><a href="/t">Tweet</a></li></ul>',
    '<div class="site-notice">We are away until Monday.</div>',
    '<div class="alert-box">Sale ends soon</div>',
    '<div class="pagination"><a href="/2">2</a> <a href="/3">3</a></div>',
]
IN = [
    f'<section class="search"><h2>Trees</h2><p>{PROSE}</p></section>',
    f'<div class="share"><p>{PROSE}</p></div>',
    f'<div class="reply"><p>{PROSE}</p></div>',
    f'<p class="notice">{PROSE}</p>',
    f'<div class="related-work"><p>{PROSE}</p></div>',
    f'<div class="post comments-open has-sidebar"><p>{PROSE}</p></div>',
    f'<header class="entry-header"><h1>Trees</h1><p>{PROSE}</p></header>',
    f'<section class="cookies-history"><p>{PROSE * 12}</p></section>',
    f'<div class="advert-research"><p>{PROSE * 12}</p></div>',
    "<xmp>Keep <b> &amp; this as it stands.</xmp>",
]


def text_of(html):
    page = html_extract.Page(html)
    return page.text({page.paths[page.best()]})


def article(inner):
    return f"<body><article><h1>Title</h1><p>{PROSE}</p>{inner}<p>The last words of it.</p></article></body>"


@pytest.mark.parametrize("inner", OUT)
def test_left_out(inner):
    assert text_of(article(inner)).split("\n") == ["Title", PROSE, "The last words of it."]


@pytest.mark.parametrize("inner", IN)
def test_kept(inner):
    got = text_of(article(inner))
    if "<xmp>" in inner:
        assert got.split("\n")[2] == "Keep <b> &amp; this as it stands."
    else:
        assert got.startswith(f"Title\n{PROSE}\n") and got.endswith("The last words of it.") and got.count(PROSE) == inner.count(PROSE) + 1


def test_nested_suspects_take_linear_time():
    html = '<div class="share">' * 60_000 + PROSE + '<div class="ad">Buy</div>' * 30_000
    assert text_of(html) == PROSE


def test_pages_of_three_templates_against_their_articles(spark):
    """Votes and re-extraction: on each host most pages have the article in one place, some have more text elsewhere."""
    rows, want = [], {}
    for i in range(90):
        body = f"<h1>Text {i}</h1><p>{PROSE}</p><p>Number {i} ends here.</p>"
        text = f"Text {i}\n{PROSE}\nNumber {i} ends here."
        other = f"<div class='teaser'><p>{PROSE * (9 if i < 6 else 0)}</p></div>"
        page = [
            f"<body><nav>Home</nav><div class='wrap'><div class='story-{i}'>{body}</div>{other}</div><footer>Foot</footer></body>",
            f"<body><table><tr><td class='left'>Menu</td><td class='text'>{body}<div class='comments'><p>I liked it very much.</p></div></td></tr></table>{other}</body>",
            f"<body><main id='m{i}'><article>{body}<form>Mail <input></form></article>{other}</main></body>",
        ][i % 3]
        rows.append((i, f"https://host{i % 3}.org/{i}", page))
        want[i] = text
    got = {r["page_id"]: r["text"] for r in html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want
