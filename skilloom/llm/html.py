r"""Main text of web pages by tag-path ratios.

Every piece of text on a page has a tag path from the root to its leaf (block
tags with their classes; inline tags only format).  Per path the operator sums
text length and punctuation over the number of its text blocks; blocks take
the ratios of their path, the sequence of blocks is smoothed with a Gaussian
window, both ratios are fused into one score, and a threshold on the score
selects the content blocks.  The element that holds most selected text is the
content element: its blocks (short paragraphs and headings too) and blocks
elsewhere with a selected path of the same shape form the text.

Containers that announce themselves as something else (navigation, page
headers and footers, asides, forms, adverts, notices, reader comments) do not
take part.  If nothing is left then, class names are not believed and the page
is read again without them.

Defined cases: null or empty html gives an empty text; plain text without
markup is its own content; unclosed comments, scripts and tags end with the
page; repeated pages give repeated rows; extra input columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import per_text, table, whole_text

# Element names of HTML by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe noframes noembed xmp svg math canvas object audio video textarea select title".split())
BLOCKS = frozenset("""html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption
 blockquote pre figure figcaption address details summary center header footer nav aside form fieldset head menu dialog hgroup search
 button""".split())
NOT_CONTENT = frozenset("head nav footer aside form fieldset menu dialog search button".split())
#: An opening tag of the key closes an open one of these, up to the nearest of the stops.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
          "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "thead", "tbody")}
STOPS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",),
         "tbody": ("table",), "tfoot": ("table",)}
#: Words in class, id or role that name something other than the article.
OTHER = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu sidebar
 footer cookie cookies consent gdpr notice notices banner alert comment comments disqus reply replies respond share sharing social
 related recommended newsletter subscribe signup login search breadcrumb breadcrumbs pagination pager widget popup modal overlay toolbar
 masthead complementary contentinfo""".split())
#: Words that turn the next one into a statement about the page ("has-sidebar").
ABOUT = frozenset("has with no without is show hide".split())

TOKEN = re.compile(r"""<!--(?:.*?-->|.*\Z)|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z][^>]*(?:>|\Z)
|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>
|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)""", re.S | re.X)
ATTR = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden|style|itemprop)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
PUNCTUATION = re.compile(r"[.,;:!?…、。，¿¡\"'()]")
WINDOW = np.exp(-0.5 * np.arange(-2, 3) ** 2)


@dataclass(slots=True)
class Element:
    name: str
    path: str
    up: Element | None
    other: bool
    article: bool
    weight: float = 0.0


@dataclass(slots=True)
class Block:
    element: Element
    parts: list[str] = field(default_factory=list)
    linked: int = 0


def _names_other(attrs: str) -> tuple[bool, bool, str, bool]:
    """(names something else, is hidden, class name for the path, says that it is the article)"""
    other = hidden = article = False
    shape = ""
    for m in ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden":
            hidden = True
        elif key == "aria-hidden":
            hidden |= value.strip().lower() == "true"
        elif key == "style":
            hidden |= re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) is not None
        elif key == "itemprop":
            article |= value.strip().lower() == "articlebody"
        else:
            if key == "role" and value.strip().lower() == "main":
                article = True
            if key == "class" and value.split():
                shape = "." + value.split()[0]
            for one in value.split():
                words = [w.lower() for w in WORDS.findall(one)]
                other |= any(w in OTHER and not (i and words[i - 1] in ABOUT) for i, w in enumerate(words))
    return other, hidden, shape, article


def blocks_of(html: str, believe: bool = True) -> list[Block]:
    """The text blocks of a page in page order, without those of containers that are not content."""
    root = Element("", "", None, False, False)
    at, links, pos, out = root, 0, 0, []
    block = Block(root)

    def text(part: str) -> None:
        if part and not at.other:
            block.parts.append(part)
            if links:
                block.linked += len(part.strip())

    def cut() -> None:
        nonlocal block
        if block.parts:
            out.append(block)
        block = Block(at)

    for m in iter(lambda: TOKEN.search(html, pos), None):
        text(html[pos:m.start()])
        pos = m.end()
        name = m["name"] or m["name2"]
        if not name:
            continue
        name, end, attrs = name.lower(), m["end"] or m["end2"], m["attrs"] or m["attrs2"] or ""
        if name in RAW:
            if not end and not attrs.endswith("/"):
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(html, pos)
                pos = close.end() if close else len(html)
                if name in ("textarea", "select", "object", "video", "audio"):
                    text(" ")
        elif name == "br" or name == "hr":
            text(" ")
        elif name in VOID:
            continue
        elif name not in BLOCKS:
            links = max(0, links + (-1 if end else 1)) if name == "a" else links
        elif end:
            hit = at
            while hit.up and hit.name != name:
                hit = hit.up
            if hit.up:
                at = hit.up
                links = 0
                cut()
        else:
            links = 0
            if name != "button":
                hit, stops, closes = at, STOPS.get(name, ()), CLOSES.get(name, ("p",))
                if name not in CLOSES and hit.name == "p":
                    at = hit.up
                while name in CLOSES and hit.up and hit.name not in stops:
                    if hit.name in closes:
                        at = hit.up
                    hit = hit.up
            other, hidden, shape, article = _names_other(attrs) if attrs else (False, False, "", False)
            inside = at.article
            article |= inside or name in ("article", "main")
            dropped = (at.other or hidden or name in NOT_CONTENT or (name == "header" and not inside)
                       or (believe and other and name not in ("html", "body", "main") and not (name == "article" and "comment" not in attrs.lower())))
            at = Element(name, f"{at.path}/{name}{shape}", at, dropped, article and name not in ("html", "body"))
            cut()
    text(html[pos:])
    cut()
    return out


def _selected(blocks: list[tuple[Block, str]]) -> np.ndarray:
    """Which blocks the fused, smoothed path ratios select."""
    paths: dict[str, int] = {}
    own = np.array([paths.setdefault(b.element.path, len(paths)) for b, _ in blocks])
    length = np.array([max(0, len(t) - b.linked) for b, t in blocks], float)
    marks = np.array([len(PUNCTUATION.findall(t)) for _, t in blocks], float)
    count = np.bincount(own)
    ratios = [(np.bincount(own, weights=x) / count)[own] for x in (length, marks)]
    middle = slice(len(WINDOW) // 2, len(WINDOW) // 2 + len(own))
    edge = np.convolve(np.ones(len(own)), WINDOW)[middle]
    smooth = [np.convolve(x, WINDOW)[middle] / edge for x in ratios]
    fused = smooth[0] * (1 + smooth[1])
    return (fused >= min(fused.mean(), 0.5 * fused.max())) & (length > 0)


def main_text(html: str | None) -> str:
    """The article of a page: blocks joined by a line feed, empty if there is none."""
    if not html:
        return ""
    for believe in (True, False):
        blocks = [(b, t) for b in blocks_of(html, believe) if (t := " ".join(unescape("".join(b.parts)).split()))]
        if blocks:
            break
    else:
        return ""
    chosen = _selected(blocks)
    if not chosen.any():
        chosen[:] = True
    best: Element | None = None
    for (b, t), yes in zip(blocks, chosen, strict=True):
        at, share = b.element, float(len(t)) if yes else 0.0
        while at and share:
            at.weight += share
            if best is None or at.weight > best.weight:
                best = at
            at, share = at.up, share if at.name == "p" else 0.7 * share
    while best.up and best.up.article:
        best = best.up
    shapes = {b.element.path for (b, _), yes in zip(blocks, chosen, strict=True) if yes and _within(b.element, best)}
    out = []
    for (b, t), yes in zip(blocks, chosen, strict=True):
        if _within(b.element, best) or (yes and b.element.path in shapes):
            if b.element.article or not (b.element.name == "li" and b.linked >= 0.9 * len(t) and not yes):
                out.append(t)
    return "\n".join(out)


def _within(at: Element | None, top: Element) -> bool:
    while at is not None and at is not top:
        at = at.up
    return at is not None


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of (page_id, url, html); one pass, nothing is shuffled."""

    def columns(pages: list[str]) -> dict:
        texts = [main_text(h) for h in pages]
        return {"text": texts, "n_chars": [len(t) for t in texts]}

    return per_text(pages, ["page_id", "url"], whole_text("html"), lambda: columns, {"text": "string", "n_chars": "long"})


def op1_html_path_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


QUERIES = {"op1_html_path_ratios": op1_html_path_ratios}
ORACLES: dict[str, str] = {}
