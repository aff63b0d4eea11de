"""Main text of web pages by the distribution of line blocks.

Markup is stripped into lines, one for each block element. A line weighs its text outside links, or
nothing inside elements whose kind or name marks them as page furniture. Weights are summed over a
sliding window of lines; text surges where the sum rises over a threshold and dives where it falls to
nothing. Lines between are kept. Lines of text in an article element get a bonus to their sums; lines of links alone
have none, inside an article or outside, and stay only where text around them surges. Text outside the article is
measured by the same threshold, and every text that surges is kept.

Containers whose names are made of words for comments, notices and adverts weigh nothing either, but only if the
sums say that the page has another text: a review in a box of that name is its text.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: Lines of a window; weight of the sum at which text surges; longest stretch without weight inside a text.
WINDOW, SURGE, GAP = 3, 40, 2
#: Added to the sums of lines with text of their own in an article or main element; as much as the threshold, so that short ones stay.
BONUS = SURGE

_OPEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)", re.S)
#: What may stand between the name of a tag and its end; possessive, so that nothing is read twice.
_ATTRIBUTES = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+")
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
_SPACE = re.compile(r"\s+")
_PART = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")

# Elements whose content is never text of a page: skipped up to their end tag.
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "canvas", "audio", "video", "xmp", "noframes"}
_FURNITURE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "option", "datalist", "fieldset", "label", "input", "head"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "meter", "nobr", "output",
    "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "label",
}
_TEXT_ROOT = {"article", "main"}
#: Elements whose names are looked at; those of headings, paragraphs, list items and inline elements say nothing about a page's parts.
_CONTAINERS = {"div", "section", "ul", "ol", "dl", "table", "tbody", "td", "center"}
#: Whole classes, ids and labels of furniture.
_NAMES = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "breadcrumb", "breadcrumbs", "comments", "consent", "cookie", "cookies", "disqus", "disqus-thread", "footer", "gdpr",
    "masthead", "menubar", "modal", "nav", "navbar", "navigation", "newsletter", "pagination", "pager", "popup", "promo", "replies", "respond", "share", "sharing", "sidebar", "social", "sponsor",
    "sponsored", "subscribe", "toolbar", "topbar", "skip-link", "skip-links", "skip-to-content", "search-form", "search-box", "search-bar", "social-media", "cookie-law", "cookie-policy", "page-footer",
} | {f"{x}-{y}" for x in ("site", "main", "global", "top", "primary", "secondary", "left", "right") for y in ("nav", "navbar", "navigation", "menu", "sidebar", "footer")} | {
    f"{x}-{y}"
    for x in ("ad", "ads", "advert", "advertisement", "breadcrumb", "breadcrumbs", "comment", "comments", "cookie", "footer", "nav", "newsletter", "share", "sharing", "sidebar", "social", "sponsor")
    for y in ("area", "banner", "bar", "block", "box", "button", "buttons", "consent", "form", "icons", "links", "list", "menu", "notice", "slot", "signup", "unit", "widget")
} | {f"related-{x}" for x in ("articles", "content", "items", "links", "news", "posts", "stories")}
#: Names that furniture has outside an article, while inside one they can be parts of the text.
_OUTER_NAMES = {"banner", "comment", "header", "menu", "notice", "notices", "notification", "promotion", "related", "search", "site-header", "main-header", "skip", "widget"}
#: Words for what readers and others add to a page, and words that names of such containers have beside them.
_ADDED = {
    "ad", "ads", "advert", "advertisement", "adverts", "comment", "commenter", "comments", "discussion", "feedback", "newsletter", "notice", "notices", "notification", "notifications", "promo",
    "promotion", "replies", "reply", "response", "responses", "review", "reviews", "sponsor", "sponsored", "subscribe",
}
_BESIDE = {
    "all", "area", "article", "blog", "block", "body", "bottom", "box", "card", "container", "content", "customer", "customers", "entry", "feed", "form", "global", "group", "guest", "inline", "inner", "item",
    "items", "legal", "list", "main", "member", "news", "outer", "page", "panel", "post", "reader", "readers", "section", "site", "slot", "story", "system", "text", "thread", "threads", "top", "unit", "user",
    "users", "visitor", "visitors", "widget", "wrap", "wrapper",
}
_ROLES = {"alertdialog", "banner", "complementary", "contentinfo", "dialog", "menu", "menubar", "navigation", "search", "toolbar"}
#: Elements that end an open element of the first set when they start.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


@dataclass
class Line:
    text: str
    link_chars: int
    furniture: bool
    rooted: bool
    heading: bool
    added: bool = False


def _names_addition(name: str) -> bool:
    """Whether a name consists of words for additions and words that stand beside them: reader-comments, not comments-on-law."""
    words = {w.lower() for w in _PART.split(name) if w and not w.isdigit()}
    return not words.isdisjoint(_ADDED) and words <= _ADDED | _BESIDE


def _adds(tag: str, attributes: str) -> bool:
    """Whether a container's class, id or label names an addition to the text."""
    if tag not in _CONTAINERS or not attributes:
        return False
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = _PART.sub("-", "".join(values))
        if name.lower() == "class" and any(map(_names_addition, "".join(values).split())) or name.lower() in ("id", "aria-label") and _names_addition(value):
            return True
    return False


def _marked(tag: str, attributes: str, inside: bool) -> bool:
    """Whether the names or the role of an element make it furniture, or its attributes hide it."""
    for name, *values in _ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), "".join(values)
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _NO_DISPLAY.search(value):
            return True
        if tag not in _CONTAINERS:
            continue
        if name == "role" and not _ROLES.isdisjoint(value.lower().split()):
            return True
        # Ids inside an article, and those of sections, are often made from the words of a heading.
        if name == "class" or name in ("id", "aria-label") and not inside and tag != "section":
            whole = {_PART.sub("-", x).strip("-").lower() for x in (value.split() if name == "class" else [value])}
            if not whole.isdisjoint(_NAMES) or not inside and not whole.isdisjoint(_OUTER_NAMES):
                return True
    return False


def lines_of(page: str) -> list[Line]:
    """Blocks of text in page order; empty ones are left out."""
    out: list[Line] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # (tag, furniture, root, addition)
    opened: Counter[str] = Counter()
    text: list[str] = []
    link = [0]
    furniture = roots = links = headings = added = 0

    def flush() -> None:
        if text:
            line = _SPACE.sub(" ", html.unescape("".join(text))).strip()
            if line:
                out.append(Line(line, link[0], furniture > 0, roots > 0, headings > 0, added > 0))
            text.clear()
        link[0] = 0

    def pop() -> None:
        nonlocal furniture, roots, links, headings, added
        tag, bad, root, addition = stack.pop()
        opened[tag] -= 1
        added -= addition
        furniture -= bad
        roots -= root
        links -= tag == "a"
        headings -= tag in ("h1", "h2", "h3", "h4", "h5", "h6")

    def take(part: str) -> None:
        if part:
            text.append(part)
            if links:
                link[0] += len(part)

    at, end = 0, len(page)
    while at < end:
        found = _OPEN.search(page, at)
        if found is None:
            take(page[at:])
            break
        take(page[at : found.start()])
        at = found.end()
        closing, tag = found.group(1), found.group(2)
        if tag is None:
            if found.group().startswith("<![CDATA["):
                take(html.escape(found.group()[9:].removesuffix("]]>")))
            continue
        stop = _ATTRIBUTES.match(page, at).end()
        if stop < end and page[stop] != ">":  # a quote without its other half: the tag ends as if there were no quotes
            stop = page.find(">", at)
            stop = end if stop < 0 else stop
        attributes, at = page[at:stop], stop + 1
        tag = tag.lower()
        if tag in _RAW and not closing:
            if not attributes.endswith("/") or tag in ("script", "style", "title", "textarea"):
                stop = re.compile(rf"</{tag}\s*[^>]*(?:>|$)", re.I).search(page, at)
                at = stop.end() if stop else end
            if tag not in _INLINE:
                flush()
            continue
        if tag not in _INLINE:
            flush()
        if closing:
            if opened[tag]:
                # Inline elements do not end the blocks around them.
                if tag in _INLINE:
                    while stack[-1][0] != tag and stack[-1][0] in _INLINE:
                        pop()
                    if stack[-1][0] == tag:
                        pop()
                else:
                    while stack[-1][0] != tag:
                        pop()
                    pop()
            continue
        if tag in _VOID:
            continue
        if tag not in _INLINE:
            # Open inline elements end with the paragraph they began in.
            while stack and (stack[-1][0] == "p" or stack[-1][0] in _INLINE):
                if stack[-1][0] == "a" and tag not in ("p", "article", "main"):
                    break
                pop()
            ends = _CLOSES.get(tag, ())
            while stack and stack[-1][0] in ends:
                pop()
        if tag in _TEXT_ROOT and furniture and not roots:
            # An unclosed notice or advert does not hold the article.
            while furniture:
                pop()
        inside = roots > 0
        bad = tag in _FURNITURE and not (tag in ("header", "label") and inside) or tag not in (*_TEXT_ROOT, "body", "html") and _marked(tag, attributes, inside)
        addition = _adds(tag, attributes)
        stack.append((tag, bad, tag in _TEXT_ROOT and not bad, addition))
        opened[tag] += 1
        added += addition
        furniture += bad
        roots += stack[-1][2]
        links += tag == "a"
        headings += tag in ("h1", "h2", "h3", "h4", "h5", "h6")
    flush()
    return out


def keep(lines: list[Line], window: int = WINDOW, surge: int = SURGE, gap: int = GAP, bonus: int = BONUS) -> list[bool]:
    """Which lines lie between a surge and a dive of the window sums."""
    out = [False] * len(lines)
    own = np.array([0 if x.furniture else max(len(x.text) - x.link_chars, 0) for x in lines], np.int64)
    ones = np.ones(window, np.int64)
    # Additions are none where nothing else on the page but headings weighs enough.
    added = np.array([x.added for x in lines], bool)
    apart = [int(np.convolve(np.where(some, own, 0), ones).max()) if some.any() else 0 for some in (added, ~added & ~np.array([x.heading for x in lines], bool))]
    bad = np.array([x.furniture for x in lines], bool)
    if apart[1] and apart[1] >= min(2 * surge, apart[0] // 2):
        bad |= added
    weight = np.where(bad, 0, own)
    # Text inside and outside articles surges for itself; furniture inside an article does not part its text.
    stretches = [list(g) for _, g in groupby((i for i, x in enumerate(lines) if not (bad[i] and x.rooted)), key=lambda i: lines[i].rooted)]
    sums = [np.convolve(weight[s], ones, "full")[window // 2 : window // 2 + len(s)] for s in stretches]
    # Short pages have no line of the usual length: half of their best window counts.
    level = min(surge, max(1, max((int(x.max()) for x in sums), default=0) // 2))
    for places, total in zip(stretches, sums, strict=True):
        total = total + bonus * np.array([lines[k].rooted and weight[k] > 0 for k in places])
        # Lines that can begin or end a text: not those that are mostly links; in an article, those whose sums reach the level.
        solid = [bool(total[n] >= level) if lines[k].rooted else bool(weight[k]) and (weight[k] * 2 >= len(lines[k].text) or weight[k] >= surge) for n, k in enumerate(places)]
        i = 0
        while i < len(places):
            if not solid[i] or total[i] < level:
                i += 1
                continue
            start = stop = i
            empty = 0
            j = i + 1
            while j < len(places) and empty <= gap:
                if solid[j]:
                    stop, empty = j, 0
                else:
                    empty += 1
                j += 1
            # Headings and short lines just before the surge belong to it.
            while start and solid[start - 1]:
                start -= 1
            for k in places[start : stop + 1]:
                out[k] = not bad[k]
            # So do headings just before an article.
            k = places[start] - 1
            while not start and k >= 0 and lines[k].heading and not bad[k]:
                out[k] = True
                k -= 1
            i = stop + 1
    return out


def main_text(page: str) -> str:
    lines = lines_of(page)
    return "\n".join(x.text for x, kept in zip(lines, keep(lines), strict=True) if kept)


def extract_pages(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """Add the main text of each page; other columns stay.

    Blocks come in page order, joined by a line break; white space within one is a single blank;
    character references are decoded. A null or empty page, or one without an article or longer
    text, gives an empty text. Broken markup is read as far as it goes, pages of any length in time that grows with
    their length. Pages that repeat give the
    same text; an empty table stays empty; a column of the new name is replaced.
    """

    @F.arrow_udf("string")
    def extract(page: pa.Array) -> pa.Array:
        return pa.array([main_text(x.as_py() or "") for x in page], pa.string())

    return pages.withColumn(out_col, extract(text_or_empty(pages, html_col)))
