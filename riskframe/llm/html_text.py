"""HTML extraction (1): line-block distribution over marked-up lines.

A page becomes lines: each block element's text is one line, and each opening
or closing of a container is an empty one, as it would be in the stripped
source. What stands in elements that never hold article text (menus, page
headers and footers, sidebars, notices, adverts, forms, comments, scripts,
styles; known by element, role or the words of class and id) counts as markup,
and so does everything outside ``article`` or ``main`` where a page has them. In
an article every word of a class must speak of such an element, as one of a
compound ("share-price") may belong to the text's own subject.

The distribution is the sum of text lengths, link text left out, over a sliding
window of ``window`` lines. It surges where a window first exceeds ``surge``
characters and dives where a window is empty; the text between a surge and the
next dive is kept, in all stretches; one that is small beside the largest goes if
most of its text is links. A page without a surge (a short article) keeps all of
its ``article`` or ``main``, or else its largest stretch, if that is article text
rather than links.

Defined results: null html gives an empty text; unclosed elements, comments and
scripts run to where their parent or the page ends; repeated rows count each on
its own; an empty table gives an empty result; nothing is cut off long pages.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
SURGE = 86
SMALL = 0.25

TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^"'>]|"[^"<]*"|'[^'<]*')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|\b(hidden)\b""")
# content that is not markup: ends only at its own end tag
RAW = frozenset("script style noscript template textarea iframe svg math canvas object audio video title xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
                   "span strike strong sub sup time tt u var wbr nobr input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS_NEVER_TEXT = frozenset("head nav footer aside form menu button select dialog datalist fieldset".split())
ROLES_NEVER_TEXT = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
WORDS_NEVER_TEXT = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion promotions banner banners cookie cookies "
    "consent gdpr notice notices alert alerts popup modal overlay comment comments commentlist respond reply replies disqus discussion "
    "sidebar aside rail widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs toolbar footer footnav masthead topbar "
    "share sharing social related recommended recommendations newsletter subscribe subscription signup login search pagination pager "
    "skip legal copyright disclaimer".split())
HEADER_WORDS = frozenset("header head topnav".split())
# words that speak of no content of their own: a compound of these and the above is what the above say
PLAIN_WORDS = frozenset(
    "wrapper wrap container box block section area region inner outer content body list item items group panel row col column grid card cards "
    "module component element holder slot unit bar button buttons icon icons link links text title form field input label count header head "
    "top bottom left right main primary secondary site page global post posts article articles story stories user users reader readers "
    "media inline mobile desktop sticky fixed floating mid google native more the of for to".split())
# a token with one of these tells what the page has, not what the element is
STATE_WORDS = frozenset("has no not with without layout".split())
HEAD_ELEMENTS = frozenset("base link meta title style script noscript template head".split())
NEVER_HIDDEN = frozenset("html body main".split())
# words that make an article element something else than the page's article
NOT_THE_ARTICLE = frozenset("comment comments reply replies ad ads advert advertisement sponsored promo related recommended teaser".split())
CLOSES_SAME = frozenset("p li dt dd tr td th option".split())
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Line(NamedTuple):
    text: str
    weight: int  # characters outside links; 0 for markup and what counts as markup
    inside: bool  # in article or main


def _speaks_of(tag: str, attributes: dict[str, str], in_article: bool) -> bool:
    never = NOT_THE_ARTICLE if tag == "article" else WORDS_NEVER_TEXT
    for name in ("class", "id"):
        for token in attributes.get(name, "").split():
            words = {w.lower() for w in WORD.findall(token)}
            if words & STATE_WORDS:
                continue
            header = not in_article and tag != "article" and bool(words & HEADER_WORDS)
            if not (words & never or header):
                continue
            # in an article "share-price" is about prices: every word must speak of something that is not the article
            if not in_article or all(w in never or w in PLAIN_WORDS or w.isdigit() for w in words):
                return True
    style = attributes.get("style", "").replace(" ", "").lower()
    return ("hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in style
            or attributes.get("role", "").lower() in ROLES_NEVER_TEXT)


def lines(page: str, by_words: bool = True) -> list[Line]:
    """The page's lines; text that counts as markup has none."""
    out: list[Line] = []
    stack: list[tuple[str, bool, bool]] = []  # (element, hidden, inside article or main)
    open_count: dict[str, int] = {}
    parts: list[str] = []
    plain = 0
    links = 0

    def end_line(markup: bool) -> None:
        nonlocal plain
        text = " ".join("".join(parts).split())
        if text:
            hidden, inside = stack[-1][1:] if stack else (False, False)
            if not hidden:
                out.append(Line(text, min(plain, len(text)), inside))
        parts.clear()
        plain = 0
        if markup:
            out.append(Line("", 0, False))

    def push(tag: str, hidden: bool, inside: bool) -> None:
        stack.append((tag, hidden, inside))
        open_count[tag] = open_count.get(tag, 0) + 1

    def pop() -> None:
        open_count[stack.pop()[0]] -= 1

    def say(raw: str) -> None:
        nonlocal plain
        if raw:
            text = html.unescape(raw)
            parts.append(text)
            if not links:
                plain += len(" ".join(text.split()))

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at:m.start()])
        at = m.end()
        closing, tag, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag in RAW:
            if not closing and not rest.rstrip().endswith("/"):
                stop = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = stop.end() if stop else end
            continue
        if tag == "a":
            links = 0 if closing else 1
        if tag in INLINE:
            continue
        if tag in VOID:
            end_line(False)
            continue
        flow = tag in ("p", "li", "dt", "dd", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "td", "th", "blockquote", "pre")
        if closing:
            end_line(not flow)
            if open_count.get(tag):
                while stack[-1][0] != tag:
                    pop()
                pop()
            if not flow:
                links = 0
            continue
        end_line(not flow)
        if open_count.get("head") and tag not in HEAD_ELEMENTS:  # its end tag may be left out
            while stack[-1][0] != "head":
                pop()
            pop()
        if stack and (stack[-1][0] == "p" or (tag in CLOSES_SAME and stack[-1][0] == tag)):
            pop()
        hidden, inside = stack[-1][1:] if stack else (False, False)
        if not hidden:
            if tag in ("article", "main"):
                inside = True
            attributes = {(a[0] or a[2]).lower(): a[1].strip("\"'") for a in ATTRIBUTE.findall(rest)} if rest else {}
            inside = inside or attributes.get("role", "").lower() == "main"
            hidden = tag in CONTAINERS_NEVER_TEXT or (tag == "header" and not inside)
            if not hidden and by_words and attributes and tag not in NEVER_HIDDEN:
                hidden = _speaks_of(tag, attributes, inside)
        push(tag, hidden, inside)
    end_line(True)
    return out


def stretches(weights: list[int], window: int, surge: int) -> list[tuple[int, int, bool]]:
    """(first line, end, surged) of what lies between empty windows."""
    n = len(weights)
    sums, total = [], 0
    for i in range(n - 1, -1, -1):  # window that starts at line i
        total += weights[i] - (weights[i + window] if i + window < n else 0)
        sums.append(total)
    sums.reverse()
    found, i = [], 0
    while i < n:
        if not sums[i]:
            i += 1
            continue
        j, up = i, False
        while j < n and sums[j]:
            up = up or sums[j] > surge
            j += 1
        first = i
        while not weights[first]:
            first += 1
        found.append((first, j, up))
        i = j
    return found


def extract(page: str | None, window: int = WINDOW, surge: int = SURGE, small: float = SMALL) -> str:
    """The main text of a page."""
    if not page:
        return ""
    for by_words in (True, False):  # a class on a wrapper may speak of what it wraps
        all_lines = lines(page, by_words)
        if any(x.inside and x.text for x in all_lines):
            all_lines = [x if x.inside else Line("", 0, False) for x in all_lines]
            kept = [x.text for x in all_lines if x.text] if not any(x.weight for x in all_lines) else None
            if kept is not None:
                return " ".join(kept)
        found = stretches([x.weight for x in all_lines], window, surge)
        if not found:
            continue
        size = lambda s: sum(x.weight for x in all_lines[s[0]:s[1]])
        largest = max(map(size, found))
        surged = [s for s in found if s[2]]
        if surged:
            chosen = [s for s in surged if size(s) >= small * largest or 2 * size(s) >= sum(len(x.text) for x in all_lines[s[0]:s[1]])]
        elif all_lines[found[0][0]].inside:
            chosen = found  # a short article: all of it is its own
        else:
            chosen = [max(found, key=size)]
        texts = [x.text for first, end, _ in chosen for x in all_lines[first:end] if x.text]
        if texts:
            return " ".join(texts)
    return ""


def _extract(window: int, surge: int, small: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(h.as_py(), window, surge, small) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])
    return run


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", window: int = WINDOW,
              surge: int = SURGE, small: float = SMALL) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    src = pages.select(F.col(f"`{id_col}`").cast("bigint").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))
    return src.mapInArrow(_extract(window, surge, small), "page_id bigint, url string, text string, n_chars bigint")
