"""Main text of web pages from streaming parser events and text-to-tag ratios.

The standard library's parser streams a page's events.  Block-level tags end a line; a line knows its text, how many
tags came with it, the element that holds it, and whether one of the open elements is boilerplate by its tag, role, or a word of its
class or id.  Inside an article some of these words only raise a doubt (a section "discussion" or "related-work"): such a section is
boilerplate if its smoothed ratios don't cluster, its own ratio is under half that of the page's clustered lines, most of its text is links, or it holds
forms or marks of reader comments.  Regions are the elements that directly hold lines.  The lines' text-to-tag ratios are smoothed with a
Gaussian, lines above THRESHOLD standard deviations cluster
into content, and the clusters choose the regions: ``article`` elements if MARKED times the clustered text outside them is no more than
that inside, else ``main`` elements by the same test, else the smallest element that holds nine tenths of the clustered text and,
beside it, all other clustered lines with the outermost elements around them whose text is mostly clustered.
Lines of links alone don't count in this unless all clustered lines are such.  Every line of a chosen region that isn't
boilerplate is kept, short ones too; outside marked regions a line of links alone (a menu's) is kept only if it clusters.

Elements know their parent and open elements are found by tag, so time and memory are linear in the page, however deep it nests.

Cases: null and empty pages, and those of boilerplate alone (a page cut off in its head or menu), give an empty text; text outside any block counts as a block; unclosed elements end with
their parent or the next block; unknown end tags are ignored; white space is what ``str.split`` takes for it; very long and very deep pages
are parsed whole; repeated rows give repeated results; null ids and URLs stay null; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import read
from tidemark.sources.html import feed

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
#: A start tag of these ends an open element of the same kind (and what it holds) within the nearest of the bounds.
CLOSES = {"p": ("p", ""), "li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
DROPPED = set("script style noscript template head title nav footer aside form button select textarea input iframe object svg canvas menu dialog audio video map".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
BOILERPLATE = set(
    "ad ads adv advert adverts advertisement advertisements advertising adsense banner banners sponsor sponsored sponsors promo promos promotion promoted sidebar sidebars rail widget widgets "
    "menu menus nav navbar navigation breadcrumb breadcrumbs masthead topbar footer foot colophon cookie cookies consent gdpr notice notices alert alerts disclaimer popup modal overlay paywall newsletter subscribe "
    "subscription signup login share sharing social related recommended recommendations teaser teasers comment comments commentlist disqus reply replies respond responses discussion pagination pager copyright hidden".split()
)
#: Words that an article's own sections use too.  Inside an article they only raise a doubt, these alone or with others...
TOPICS = set("related recommended recommendations discussion responses respond replies".split())
#: ... and these beside other words (copyright-law, notice-period); alone they tell boilerplate.
COMPOUND = TOPICS | set("notice notices alert alerts disclaimer share sharing social copyright subscription promotion promotions reply rail overlay banner banners sponsor sponsors foot".split())
#: What a doubtful section of readers' words holds.
ANSWERS = set("comment comments commentlist disqus reply avatar commenter".split())
THRESHOLD = 0.5
#: A character of clustered text outside ``article`` or ``main`` elements weighs as many inside them.
MARKED = 3
PAGE_HEADER = {"header", "head"}
WRAPS = set("wrap wrapper container layout page body no has with".split())


class Open(NamedTuple):
    """An open element: what is told of it, and of all that hold it."""

    tag: str
    number: int
    gone: bool
    article: bool
    title: bool
    link: bool
    doubt: int  # the outermost element that may be boilerplate, 0 for none


class Lines(HTMLParser):
    """Collects (text, tags, holder, boilerplate) lines; ``holder`` is the number of the innermost open element, 0 for none."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[Open] = []
        self.places: dict[str, list[int]] = {}  # where in ``open`` the elements of a tag are
        self.blocks: list[int] = []  # and those of block level
        self.parts: list[str] = []
        self.tags = 0
        self.parent = [0]  # of each element
        self.lines: list[tuple[str, int, int, bool]] = []
        self.titles: set[int] = set()  # lines in an h1
        self.links: set[int] = set()  # lines of links alone
        self.unlinked = False  # the line has text outside links
        self.articles: set[int] = set()
        self.mains: set[int] = set()
        self.doubts: list[int] = []  # of each line, the doubtful element that it is in
        self.answers: set[int] = set()  # doubtful elements with forms or marks of comments

    def parse_html_declaration(self, i):
        """Marked sections of any name are bogus comments, where the parser would raise on names it doesn't know."""
        return self.parse_bogus_comment(i) if self.rawdata.startswith("<![", i) else super().parse_html_declaration(i)

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            if self.open and self.open[-1].title:
                self.titles.add(len(self.lines))
            if not self.unlinked:
                self.links.add(len(self.lines))
            self.doubts.append(self.open[-1].doubt if self.open else 0)
            self.lines.append((text, self.tags, self.open[-1].number if self.open else 0, bool(self.open) and self.open[-1].gone))
            self.tags = 0
        self.parts.clear()
        self.unlinked = False

    def close_from(self, place: int) -> None:
        """End the open elements from a place on."""
        while len(self.open) > place:
            self.places[self.open.pop().tag].pop()
        while self.blocks and self.blocks[-1] >= place:
            self.blocks.pop()

    def last(self, tags) -> int:
        """The place of the innermost open element with one of the tags, -1 for none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def dropped(self, tag: str, attrs: list) -> bool | None:
        """Is an element boilerplate?  None: in doubt."""
        if tag in ("html", "body", "main"):
            return False
        if tag in DROPPED:
            return True
        inside = bool(self.open) and self.open[-1].article
        if tag == "header":
            return not inside
        given = {k: v or "" for k, v in attrs}
        if "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", "").lower():
            return True
        if given.get("role", "").lower() in ROLES:
            return True
        words = set(re.split("[^a-z]+", re.sub("([a-z])([A-Z])", r"\1 \2", f"{given.get('class', '')} {given.get('id', '')}").lower()))
        if words & WRAPS:
            return False
        told = words & BOILERPLATE
        if inside and told and told <= (COMPOUND if words - told - {""} else TOPICS):
            return None
        return bool(told or not inside and words & PAGE_HEADER)

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in VOID:
            if tag == "hr":
                self.flush()
            elif tag in ("br", "wbr", "img", "input"):
                self.parts.append(" " if tag != "wbr" else "")
            return
        if tag in BLOCK:
            self.flush()
            self.implied(tag)
        top = self.open[-1] if self.open else Open("", 0, False, False, False, False, 0)
        number = len(self.parent)
        self.parent.append(top.number)
        found = top.gone or self.dropped(tag, attrs)
        gone, doubt = bool(found), top.doubt or (number if found is None else 0)
        if top.doubt and (tag in ("form", "textarea", "button") or set(re.split("[^a-z]+", " ".join(v or "" for k, v in attrs if k in ("class", "id")).lower())) & ANSWERS):
            self.answers.add(top.doubt)
        if not gone and (tag == "article" or dict(attrs).get("itemprop") == "articleBody"):
            self.articles.add(number)
        if not gone and (tag == "main" or dict(attrs).get("role") == "main"):
            self.mains.add(number)
        self.places.setdefault(tag, []).append(len(self.open))
        if tag in BLOCK:
            self.blocks.append(len(self.open))
        self.open.append(Open(tag, number, gone, top.article or number in self.articles, top.title or tag == "h1", top.link or tag == "a", doubt))

    def implied(self, tag: str) -> None:
        if tag in ("body", "main", "article") and self.places.get("head"):
            self.close_from(self.places["head"][0])
        names, bounds = CLOSES.get(tag, ("p", "") if tag not in ("html", "head", "body", "title", "option") else ("", ""))
        place = self.last(names.split())
        if place >= 0 and place >= (self.last(bounds.split()) if bounds else self.blocks[-1]):
            self.close_from(place)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCK:
            self.flush()
        place = self.last((tag,))
        # An inline element doesn't end beyond the block it is in.
        if place >= 0 and (tag in BLOCK or not self.blocks or place > self.blocks[-1]):
            self.close_from(place)

    def handle_data(self, data):
        # Boilerplate inside a line (a script, a button) leaves the line without it.
        if not (self.open and self.open[-1].gone) or self.open[-1].tag in BLOCK:
            self.parts.append(data)
            self.unlinked = self.unlinked or not (self.open and self.open[-1].link) and not data.isspace()


def smoothed(ratios: np.ndarray, sigma: float = 1.0, radius: int = 2) -> np.ndarray:
    kernel = np.exp(-(np.arange(-radius, radius + 1) ** 2) / (2 * sigma**2))
    weight = np.convolve(np.ones(len(ratios)), kernel)[radius : radius + len(ratios)]
    return np.convolve(ratios, kernel)[radius : radius + len(ratios)] / weight


def held_by(parent: list[int], chosen: set[int]) -> list[bool]:
    """Whether each element is one of the chosen or in one; parents have smaller numbers than what they hold."""
    out = [False] * len(parent)
    for n in range(1, len(parent)):
        out[n] = n in chosen or out[parent[n]]
    return out


def sums(parent: list[int], lines) -> list[int]:
    """The length of the lines that each element holds, itself or in others; 0 holds all."""
    out = [0] * len(parent)
    for text, _, holder, _ in lines:
        out[holder] += len(text)
    for n in range(len(parent) - 1, 0, -1):
        out[parent[n]] += out[n]
    return out


def settled(page: Lines) -> list[tuple[str, int, int, bool]]:
    """The lines, those in doubtful sections told to be boilerplate or not."""
    if not any(page.doubts):
        return page.lines
    ratios = np.array([0.0 if gone else len(text) / max(1, tags) for text, tags, _, gone in page.lines])
    smooth = smoothed(ratios)
    high = smooth >= min(THRESHOLD * ratios.std(), smooth.max())
    sure = [i for i, d in enumerate(page.doubts) if not d and high[i] and not page.lines[i][3]]
    dense = lambda lines: sum(len(page.lines[i][0]) for i in lines) / max(1, sum(page.lines[i][1] for i in lines))
    held: dict[int, list[int]] = {}
    for i, d in enumerate(page.doubts):
        if d and not page.lines[i][3]:
            held.setdefault(d, []).append(i)
    out = set(page.answers)
    for d, lines in held.items():
        size = lambda some: sum(len(page.lines[i][0]) for i in some)
        clustered, linked = size([i for i in lines if high[i]]), size([i for i in lines if i in page.links])
        if 2 * clustered < size(lines) or 2 * linked > size(lines) or 2 * dense(lines) < dense(sure):
            out.add(d)
    return [(text, tags, holder, gone or d in out) for (text, tags, holder, gone), d in zip(page.lines, page.doubts)]


def content_blocks(html: str) -> list[str]:
    """The main text's blocks in page order."""
    page = Lines()
    feed(page, html)
    page.flush()
    lines, parent = settled(page), page.parent
    if all(gone for *_, gone in lines):
        return []
    ratios = np.array([0.0 if gone else len(text) / max(1, tags) for text, tags, _, gone in lines])
    smooth = smoothed(ratios)
    least = min(THRESHOLD * ratios.std(), smooth.max())
    content = [bool(high) and not line[3] for high, line in zip(smooth >= least, lines, strict=True)]
    said = [good and i not in page.links for i, good in enumerate(content)]
    said = said if any(said) else content
    clustered = [line for line, good in zip(lines, said, strict=True) if good]
    whole = sum(len(line[0]) for line in clustered)
    for chosen in (page.articles, page.mains):
        within = held_by(parent, chosen)
        kept = [text for text, _, holder, gone in lines if not gone and within[holder]]
        inside = sum(len(text) for text, _, holder, _ in clustered if within[holder])
        if kept and MARKED * (whole - inside) <= inside:
            return kept
    menu = [i in page.links and not good for i, good in enumerate(content)]
    weights = sums(parent, clustered)
    # Elements are numbered in page order, so of nested ones the inner has the higher number.
    best = max((n for n, w in enumerate(weights) if w >= 0.9 * whole), default=0)
    if not best:
        return [line[0] for i, line in enumerate(lines) if not line[3] and not menu[i]]
    within = held_by(parent, {best})
    # A title may stand before the element that holds the rest.
    first = next(i for i, line in enumerate(lines) if not line[3] and within[line[2]])
    # Clustered text outside it comes with its own regions: the outermost elements beside it whose text is mostly clustered.
    beside = {i for i, good in enumerate(said) if good and not within[lines[i][2]]}
    if beside:
        lengths, above, n = sums(parent, [line for line in lines if not line[3]]), set(), best
        while n:
            n = parent[n]
            above.add(n)
        mostly = {n for n in range(1, len(parent)) if n not in above and 2 * weights[n] > lengths[n]}
        holds = held_by(parent, mostly)
        within = [a or b for a, b in zip(within, holds, strict=True)]
    return [line[0] for i, line in enumerate(lines) if not line[3] and not menu[i] and (within[line[2]] or i in beside or i < first and i in page.titles)]


def main_text(html: str | None) -> str:
    return "\n\n".join(content_blocks(html)) if html else ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for every row of ``pages``."""
    given = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("body"))

    def run(batches):
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["id", "url", "text", "n_chars"])

    return given.mapInArrow(run, f"id {pages.schema[id_col].dataType.simpleString()}, url string, text string, n_chars bigint")


def op5_html_text(spark, sf_dir):
    return extract(read(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")
