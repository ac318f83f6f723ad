import html
import re
import time
import tracemalloc

import numpy as np
import pytest

from tidemark.llm import html_text as h

LONG = "Words of an article that goes on for a while, with commas, and more of them still. " * 4

CASES = {
    "plain article": (f"<html><body><nav><a>Menu</a></nav><article><h1>T</h1><p>{LONG}</p><p>s</p></article><footer>F</footer></body></html>", f"T\n\n{LONG.strip()}\n\ns"),
    "unclosed p and b": ("<article><p><b>one<br>two<p>three</article><p>out", "one two\n\nthree"),
    "references and white space": ("<article><p>a&nbsp;&amp;\n\t b &#233;&eacute;</p></article>", "a & b éé"),
    "inline tags add nothing": ("<article><p>a<b>b</b><i> c</i></p></article>", "ab c"),
    "scripts and styles": ("<article><p>a<script>var x='<p>';</script>b</p><style>p{}</style><p>c</p></article>", "ab\n\nc"),
    "comments, ads and forms inside": (
        "<article><header><h1>H</h1></header><p>x</p><div class='ad-slot'>buy</div><form><p>mail</p></form><aside>s</aside><div id='comments'><p>first!</p></div><section class='reader-comments'>me</section></article>",
        "H\n\nx",
    ),
    "no article, main": (f"<header>Site</header><main><h2>T</h2><p>{LONG}</p><p>k</p></main><div class='sidebar'><p>{LONG}</p></div>", f"T\n\n{LONG.strip()}\n\nk"),
    "no marks at all": (
        f"<body><div class='top'><a>1</a> <a>2</a> <a>3</a></div><div class='text'><h1>T</h1><p>{LONG}</p><p>short</p><p>{LONG}</p></div><div><a>x</a> <a>y</a></div></body>",
        f"T\n\n{LONG.strip()}\n\nshort\n\n{LONG.strip()}",
    ),
    "title before the text": (f"<body><div id='top'>x</div><h1>T</h1><div class='text'><p>{LONG}</p><p>{LONG}</p></div></body>", f"T\n\n{LONG.strip()}\n\n{LONG.strip()}"),
    "cookie notice": (f"<div role='dialog'>We use cookies</div><div class='cookie-notice'>ok?</div><article><p>{LONG}</p></article>", LONG.strip()),
    "wrappers aren't boilerplate": ("<div class='page has-sidebar'><article class='post'><p>x</p></article></div>", "x"),
    "list and table": ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "a\n\nb\n\nc\n\nd"),
    "bad markup": ("<article><p>a < b </zzz> <![x <p>c</article>", None),
    "empty": ("", ""),
    "only tags": ("<html><body><article></article></body></html>", ""),
    "text alone": ("just text", "just text"),
}


@pytest.mark.parametrize("name", CASES)
def test_pages(name):
    page, want = CASES[name]
    got = h.main_text(page)
    assert want is None or got == want


def test_smoothing_against_plain_sums():
    x = np.array([0.0, 5, 1, 9, 0, 0, 2])
    k = [np.exp(-(d * d) / 2) for d in (-2, -1, 0, 1, 2)]
    plain = [sum(k[d + 2] * x[i + d] for d in range(-2, 3) if 0 <= i + d < 7) / sum(k[d + 2] for d in range(-2, 3) if 0 <= i + d < 7) for i in range(7)]
    assert np.allclose(h.smoothed(x), plain)
    assert np.allclose(h.smoothed(np.array([3.0])), [3.0])


def brute(page):
    body = page[page.index("<article>") + 9 : page.index("</article>")]
    blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", body)]
    return "\n\n".join(b for b in blocks if b)


def test_query(spark, sf_dir):
    want = {r.page_id: (r.url, brute(r.html)) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = h.op5_html_text(spark, sf_dir).collect()
    assert {r.page_id: (r.url, r.text) for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_rows(spark):
    big = "<article><p>" + "word " * 100_000 + "</p></article>"
    rows = [(1, None, None, "t"), (None, "u", "", "t"), (2, "u", big, "t"), (2, "u", big, "t"), (3, "u", "<p>" * 20_000 + "deep", None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = {(r.id, r.url): r.text for r in h.extract(df).collect()}
    assert got == {(1, None): "", (None, "u"): "", (2, "u"): ("word " * 100_000).strip(), (3, "u"): "deep"}
    assert h.extract(df).count() == 5 and h.extract(df.limit(0)).count() == 0


PARAGRAPHS = f"<p>{LONG}</p>" * 3
BODY = "\n\n".join([LONG.strip()] * 3)


@pytest.mark.parametrize("card", ["<article><h3>Card</h3><p>See this too</p></article>", "<main><article><h3>Card</h3></article></main>", "<div itemprop='articleBody'>Card</div>"])
def test_a_marked_card_beside_the_body(card):
    for page in (f"<body><div>{PARAGRAPHS}</div>{card}</body>", f"<body>{card}<div>{PARAGRAPHS}</div></body>"):
        assert BODY in h.main_text(page)


def test_links_alone_outside_an_article_weigh_nothing():
    links = "".join(f"<p><a href='/{i}'>{LONG}</a></p>" for i in range(9))
    assert h.main_text(f"<body><article><h1>T</h1>{PARAGRAPHS}</article><div>{links}</div></body>") == f"T\n\n{BODY}"


def test_clustered_text_in_several_elements():
    last = "A last section with some words of its own, which are enough to be seen as text."
    menu = "<div><a>x</a> <a>y</a></div>"
    page = f"<body>{menu}<div>{PARAGRAPHS}{PARAGRAPHS}</div><div><p>{last}</p><p>End</p></div>{menu}</body>"
    assert h.main_text(page) == f"{BODY}\n\n{BODY}\n\n{last}\n\nEnd"
    page = f"<body><div><p>{LONG}</p></div><h1>T</h1><div>{PARAGRAPHS * 4}</div>{menu}</body>"
    assert h.main_text(page) == "\n\n".join([LONG.strip(), "T", *[BODY] * 4])


SECTIONS = ["section class='related-work'", "section id='discussion'", "div class='copyright-law'", "section id='responses'", "div class='notice-period'", "section class='related'", "div class='shareHolders social-history'"]


@pytest.mark.parametrize("mark", SECTIONS)
def test_sections_of_an_article_with_a_word_of_boilerplate_stay(mark):
    section = f"<{mark}><h2>Heading</h2><p>{LONG}</p><p>{LONG}</p></{mark.split()[0]}>"
    for page in (f"<article><h1>T</h1>{PARAGRAPHS}{section}</article>", f"<article><h1>T</h1>{section}{PARAGRAPHS}</article>"):
        got = h.main_text(page)
        assert got.count(LONG.strip()) == 5 and "Heading" in got


@pytest.mark.parametrize("mark", SECTIONS)
def test_the_same_marks_on_links_forms_comments_and_short_lines_go(mark):
    end = mark.split()[0]
    for held in (
        "<ul>" + "".join(f"<li><a href='/{i}'>Read this other article with a long title</a></li>" for i in range(5)) + "</ul>",
        f"<p>{LONG}</p><form><textarea>say</textarea></form>",
        f"<div class='comment-body'><p>{LONG}</p></div>",
        "<p>© A. All rights reserved</p><p><a>Post</a> <a>Mail</a></p>",
    ):
        assert h.main_text(f"<article><h1>T</h1>{PARAGRAPHS}<{mark}>{held}</{end}></article>") == f"T\n\n{BODY}"


def test_outside_an_article_and_alone_the_words_still_tell():
    for mark in ("notice", "copyright", "share", "social", "comments", "ads"):
        assert h.main_text(f"<article><h1>T</h1>{PARAGRAPHS}<div class='{mark}'><p>{LONG}</p></div></article>") == f"T\n\n{BODY}"
    for mark in SECTIONS[:4]:
        assert h.main_text(f"<body><{mark}><p>{LONG}</p></{mark.split()[0]}><article><h1>T</h1>{PARAGRAPHS}</article></body>") == f"T\n\n{BODY}"


LINK = "<p><a href='/x'>One link</a></p>"


def menus():
    """An unmarked page: a link between paragraphs belongs to them, unmarked menus around them don't."""
    far, head, tail = LINK * 6, "<p>By A</p><p>May 1</p>", "<p>Said</p><p>Done</p>"
    return f"<body><div>{far}{head}<p>{LONG}</p>{LINK}<p>{LONG}</p>{tail}{far}</div></body>", "\n\n".join(["By A", "May 1", LONG.strip(), "One link", LONG.strip(), "Said", "Done"])


def test_ratios_decide_on_unmarked_pages(monkeypatch):
    page, want = menus()
    assert h.main_text(page) == want
    with monkeypatch.context() as m:
        m.setattr(h, "smoothed", lambda ratios: ratios)
        assert h.main_text(page) != want
    with monkeypatch.context() as m:
        m.setattr(h, "smoothed", np.zeros_like)
        assert h.main_text(page) != want
    with monkeypatch.context() as m:
        m.setattr(h, "THRESHOLD", 1e9)
        assert h.main_text(page) != want


def test_ratios_decide_between_articles_and_the_rest(monkeypatch):
    page = f"<body><article><h3>Card</h3><p>Teaser</p></article><div>{PARAGRAPHS}<p>{LONG * 2}</p></div><article><p>Another card</p></article></body>"
    want = BODY + "\n\n" + (LONG * 2).strip()
    assert want in h.main_text(page) and "Card" not in h.main_text(page)
    monkeypatch.setattr(h, "MARKED", 0)
    assert want not in h.main_text(page)


@pytest.mark.parametrize("page", ["<span><div>x</div>" * 60_000, "<b>" * 150_000 + "</i>" * 150_000, "<div>x" * 170_000, "<p>" * 300_000 + "x", "<li><b>" * 140_000 + "x", "<a>" * 330_000 + "x"])
def test_a_megabyte_of_odd_markup(page):
    """Linear in time and memory, however deep the elements nest."""
    assert 0.9e6 < len(page) < 1.3e6
    start = time.process_time()
    h.main_text(page)
    assert time.process_time() - start < 20
    tracemalloc.start()
    h.main_text(page[: len(page) // 10])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 30 << 20


BARE = ["<head><title>Cut off in the ti", "<title>T</title><body><nav><ul><li><a href='/'>Home</a>", "<nav>Menu</nav><div class='ad'>Buy</div><footer>F</footer>", f"<div hidden><p>{LONG}</p></div>"]


def test_pages_of_boilerplate_alone_have_no_text(spark):
    assert [h.main_text(page) for page in BARE] == [""] * len(BARE)
    rows = [(i, "u", page) for i, page in enumerate([*BARE, None, f"{BARE[2]}<p>x</p>"])]
    got = h.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1)).collect()
    assert sorted((r.id, r.text, r.n_chars) for r in got) == [*((i, "", 0) for i in range(len(BARE) + 1)), (len(BARE) + 1, "x", 1)]


def test_references_of_thousands_of_digits():
    """Python's int() refuses more than 4,300."""
    for digits, want in (("9" * 5000, "�"), ("0" * 5000 + "65", "A"), ("0" * 5000, "�")):
        assert h.main_text(f"<p title='&#{digits};'>a &#{digits}; b</p>") == f"a {want} b"
