"""Main text of web pages by tag-path ratios.

A page is read once into blocks: the text between two block boundaries, with its path of
tags from the root. Per path, text length and punctuation per block are aggregated, with
the share of the text that is in links; along the page both ratios are smoothed by a
Gaussian kernel and fused into one score. Of each path's blocks the mean score is held
against a threshold taken from the page's own scores, on every page.

Article and main elements are one factor of that score, weighted by the square of the share of the page's
score that lies in the element itself (``BOOST``): the text of an article that holds most of
a page gains much and the text around it loses as much, while a teaser or a comment that is
an article of its own changes little. Blocks in an element that is marked as a menu, footer,
advert, form, comments and the like never count.

Blocks come in page order, joined by a blank line; white space within a block is one space,
and character references are decoded. Null, empty and textless pages give an empty text.
Unclosed and stray tags are allowed; an unclosed comment or script runs to the end of the
page. Repeated rows give a row each. Extra columns are ignored. The whole html is read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Element names by their role in HTML.
DROPPED = frozenset("head script style noscript template nav footer aside form iframe object svg math canvas button select option datalist textarea audio video dialog menu title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Words of class and id values that mark what isn't the article.
MARKED = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsors sponsored promo promos promotion menu menus nav navbar navigation breadcrumb breadcrumbs sidebar sidebars widget widgets footer masthead topbar cookie cookies consent gdpr notice notices alert alerts popup modal overlay toast newsletter subscribe subscription signup login signin share sharing social related recommended recommendations recommendation comment comments commentlist disqus reply replies respond pagination pager toolbar search searchbox form copyright legal disclaimer skip paywall survey tracking".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
CLOSED_BY_BLOCK = frozenset(BLOCKS - frozenset("li dd dt td th tr tbody thead tfoot html body caption legend summary".split()))
SIBLINGS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
SIBLINGS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in SIBLINGS.items()}

NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
SPECIAL = re.compile("[\"'>]")
#: Attributes without quotes that hide a tag's end: the usual case, in one step.
SIMPLE = re.compile(r"""[^"'<>]*(?:"[^"<>]*"[^"'<>]*|'[^'<>]*'[^"'<>]*)*+>""")
ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|([^\s"'=<>/]+)""")
PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？、]")
#: An article that holds all of a page's score multiplies its blocks' scores by one more than this, and divides those of others.
BOOST = 7.0
#: Added to the smoothed punctuation, so that text without any has a score.
FLOOR = 0.05
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def _marked(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether an element says that it isn't part of the article."""
    if tag in DROPPED:
        return True
    if tag == "header" and not in_article:
        return True
    if not attributes or tag in ("html", "body", "main", "article"):
        return False
    for name, a, b, c, bare in ATTRIBUTE.findall(attributes):
        name, value = (name or bare).lower(), (a or b or c).lower()
        if name in ("class", "id"):
            words = set(re.split(r"[^a-z0-9]+", value))
            if words & MARKED or ("header" in words and not in_article and not words & {"article", "entry", "post", "content"}):
                return True
        elif name == "role" and value.strip() in ROLES:
            return True
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and HIDDEN.search(value)):
            return True
    return False


class Block(NamedTuple):
    path: int  # number of its path of tags
    text: str
    linked: int  # characters in links
    article: int  # the innermost article's number, or 0
    marked: bool
    above: int  # number of the path without the last tag
    tag: str  # the last tag


class _Open(NamedTuple):
    """An element that is open."""

    tag: str
    path: int
    article: int
    marked: bool
    block: int  # place of the innermost block element in the stack, itself included; or -1
    links: int  # a elements that are open, itself included
    fence: int  # place of the innermost table, td or th; or -1


class _Tokens:
    """Tags, and the text between, of a page from left to right; linear in its length."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.ends: dict[int, int] = {}  # where a tag ends, seen from a quote or > outside of quotes
        self.gap = (0, -1)  # a place, and the next quote or > after it

    def tag_end(self, at: int) -> int:
        """Place of the > that ends a tag, with quotes heeded; without, where they never close; or -1."""
        page = self.page
        if at > self.last:
            return -1
        seen, p, end = [], at, -1
        while True:
            if not self.gap[0] <= p <= self.gap[1]:
                m = SPECIAL.search(page, p)
                self.gap = (p, m.start() if m else len(page))
            s = self.gap[1]
            if s == len(page):
                break
            if s in self.ends:
                end = self.ends[s]
                break
            seen.append(s)
            if page[s] == ">":
                end = s
                break
            shut = page.find(page[s], s + 1)
            if shut < 0:
                break
            p = shut + 1
        for s in seen:
            self.ends[s] = end
        return end if end >= 0 else page.find(">", at)

    def __iter__(self) -> Iterator[tuple[str, str, str]]:
        """(text, "", ""), or ("", a tag's name with / for an end tag, attributes)."""
        page, at, size = self.page, 0, len(self.page)
        while at < size:
            lt = page.find("<", at)
            if lt != at:
                yield page[at : lt if lt >= 0 else size], "", ""
                if lt < 0:
                    return
                at = lt
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                at = end + 3 if end >= 0 else size
                continue
            if at + 1 < size and page[at + 1] in "!?" and at < self.last:
                at = page.find(">", at) + 1
                continue
            m = NAME.match(page, at + 1)
            if m is not None:
                simple = SIMPLE.match(page, m.end()) if len(self.ends) < 64 else None  # a page that is often odd goes the long way
                end = simple.end() - 1 if simple else self.tag_end(m.end())
                if end >= 0:
                    tag, at = m[2].lower(), end + 1
                    yield "", m[1] + tag, page[m.end() : end]
                    if not m[1] and tag in RAW:
                        at = self.after_raw(tag, at)
                    continue
            elif page.startswith("</", at) and at < self.last:  # a stray end
                at = page.find(">", at) + 1
                continue
            yield "<", "", ""
            at += 1

    def after_raw(self, tag: str, at: int) -> int:
        """The place after an element whose content isn't read."""
        shut = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(self.page, at)
        end = self.page.find(">", shut.end()) if shut else -1
        return end + 1 if end >= 0 else len(self.page)


def blocks(page: str) -> list[Block]:
    """The texts between block boundaries, in page order."""
    out: list[Block] = []
    stack: list[_Open] = []
    places: dict[str, list[int]] = {}  # of each tag's open elements in the stack
    paths: dict[tuple[int, str], int] = {}
    above: list[tuple[int, str]] = [(0, "")]  # of each path: the path above, and the last tag
    articles = linked = 0
    parts: list[str] = []
    place: tuple[int, int, bool] = (0, 0, False)

    def flush():
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(place[0], text, linked, place[1], place[2], *above[place[0]]))
        parts, linked = [], 0

    def close(i: int):
        if stack[-1].block >= i:
            flush()
        for e in stack[i:]:
            places[e.tag].pop()
        del stack[i:]

    def latest(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=-1)

    for piece, tag, attributes in _Tokens(page):
        top = stack[-1] if stack else _Open("", 0, 0, False, -1, 0, -1)
        if not tag:
            if not parts:
                if piece.isspace():
                    continue
                block = stack[top.block] if top.block >= 0 else _Open("", 0, 0, False, -1, 0, -1)
                place = (block.path, top.article, block.marked)
            if top.marked and not place[2]:
                continue  # a marked element within a line
            text = html.unescape(piece) if "&" in piece else piece
            parts.append(text)
            if top.links:
                linked += len(text.strip())
            continue
        if tag[0] == "/":
            i = latest((tag[1:],))
            if i >= 0 and (tag[1:] in BLOCKS or top.fence <= i):
                close(i)
            continue
        if tag in ("br", "wbr", "hr"):
            flush() if tag == "hr" else parts and parts.append(" " if tag == "br" else "")
            continue
        if tag in VOID:
            continue
        if tag in SIBLINGS:
            same, fence = SIBLINGS[tag]
            i = latest(same)
            if i > latest(fence):
                close(i)
        if tag in CLOSED_BY_BLOCK and stack and stack[-1].block >= 0 and stack[stack[-1].block].tag == "p":
            close(stack[-1].block)
        if tag in BLOCKS:
            flush()
        if tag in RAW or (attributes.rstrip().endswith("/") and tag not in BLOCKS):
            continue
        top = stack[-1] if stack else _Open("", 0, 0, False, -1, 0, -1)
        article = top.article
        if tag in ("article", "main") or (not article and "articleBody" in attributes):
            articles += 1
            article = articles
        path = paths.setdefault((top.path, tag), len(above))
        if path == len(above):
            above.append((top.path, tag))
        n = len(stack)
        places.setdefault(tag, []).append(n)
        stack.append(
            _Open(tag, path, article, top.marked or _marked(tag, attributes, top.article > 0), n if tag in BLOCKS else top.block, top.links + (tag == "a"), n if tag in ("td", "th", "table") else top.fence)
        )
    flush()
    return out


def smooth(x: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    reach = np.arange(-3, 4)
    kernel = np.exp(-(reach**2) / (2 * sigma**2))
    weight = np.convolve(np.ones(len(x)), kernel, "full")[3 : 3 + len(x)]
    return np.convolve(x, kernel, "full")[3 : 3 + len(x)] / weight


def select(found: list[Block], share: float = 0.5) -> list[bool]:
    """Which blocks are content, by the fused ratios of their tag paths."""
    paths: dict[int, list[int]] = {}
    for i, b in enumerate(found):
        if not b.marked:
            paths.setdefault(b.path, []).append(i)
    open_ = [i for at in paths.values() for i in at]
    if not open_:
        return [False] * len(found)
    chars = [len(b.text) for b in found]
    stops = [len(PUNCTUATION.findall(b.text)) for b in found]
    length, stop, links = np.zeros(len(found)), np.zeros(len(found)), np.zeros(len(found))
    for at in paths.values():
        total = sum(chars[i] for i in at)
        length[at] = total / len(at)
        stop[at] = sum(stops[i] for i in at) / len(at)
        links[at] = min(1.0, sum(found[i].linked for i in at) / total)
    fused = smooth(np.log1p(length)) * np.sqrt(FLOOR + smooth(np.log1p(stop))) * (1 - links)
    bar = share * float(np.average(fused[open_], weights=[chars[i] for i in open_]))
    # The article factor: each article by its own squared share of the score.
    mass: dict[int, float] = {}
    for i in open_:
        mass[found[i].article] = mass.get(found[i].article, 0.0) + float(fused[i])
    total = sum(mass.values()) or 1.0
    gain = {a: 1 + BOOST * (m / total) ** 2 if a else 1.0 for a, m in mass.items()}
    best = max(gain, key=gain.get)
    groups: dict[tuple[int, int], list[int]] = {}
    for i in open_:
        groups.setdefault((found[i].path, found[i].article), []).append(i)
    out = [False] * len(found)
    for (_, a), at in groups.items():
        good = float(fused[at].mean()) * gain[a] / (1.0 if a == best else gain[best]) >= bar
        for i in at:
            out[i] = good
    # A heading goes with the text below it in the same element.
    for i in range(len(found) - 2, -1, -1):
        if found[i].tag in HEADINGS and not found[i].marked and not out[i]:
            out[i] = out[i + 1] and found[i + 1].above == found[i].above
    return out


def extract(page: str | None) -> str:
    if not page:
        return ""
    found = blocks(page)
    return "\n\n".join(b.text for b, good in zip(found, select(found)) if good) if found else ""


def extract_pages(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, text, n_chars (code points)."""

    def f(batches):
        for b in batches:
            text = [extract(x) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(f, "page_id long, url string, text string, n_chars long")
