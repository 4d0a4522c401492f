"""Main text of web pages by line-block distribution.

A page's markup is stripped into lines, one for each block element. Lines of menus, adverts, forms and
the like, and characters of links, count nothing. Sums of text lengths over windows of ``WIDTH`` lines
surge where the main text begins and dive to nothing where it ends; the lines between a surge and its
dive are kept. Where a page has article or main elements, only lines inside them have a length, and any
text is a surge; otherwise a surge needs ``SURGE`` characters, and regions far smaller than the largest
are left out. An advert or form between lines of one element does not part them: they are one region.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

WIDTH = 3
#: Characters of a window that make a surge where no element marks the article, less on short pages.
SURGE = 80
#: Least share of the largest region's text that another region has.
LEAST_SHARE = 0.2

MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "xmp", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
DROPPED = {
    "head", "nav", "header", "footer", "aside", "form", "button", "select", "dialog", "menu", "object", "audio",
    "video", "canvas", "map", "fieldset", "label", "datalist", "applet",
}
SCOPE = {"article", "main"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div",
    "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head",
    "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "select",
    "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: Elements whose end need not be written and that hold no other blocks of interest; they are not nested.
LOOSE = {"p", "li", "dt", "dd", "td", "th", "tr", "option", "b", "i", "u", "em", "strong", "span", "font", "small", "a"}
#: Words of a class, id or role that name what is not the article.
NOT_ARTICLE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors promo promotion "
    "banner nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar complementary footer masthead contentinfo "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup "
    "login share sharing social related recommended recommendations pagination pager comment comments commentlist "
    "disqus respond replies widget widgets toolbar search".split()
)
#: First words of a class that say what a page or its text has or lacks, not what the element is.
ABOUT_OTHERS = {"no", "not", "has", "have", "with", "without", "hide", "show", "after", "before"}
WHOLE_NAMES = {"header", "site-header", "page-header", "top-bar", "topbar", "skip-link"}


def not_article(attributes: str) -> bool:
    """Whether an element's class, id, role or visibility says that it isn't part of the article."""
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return True
        elif name in ("class", "id", "role"):
            for word in value.split():
                parts = re.split(r"[^a-z0-9]+", word)
                if word in WHOLE_NAMES or parts[0] not in ABOUT_OTHERS and not NOT_ARTICLE.isdisjoint(parts):
                    return True
    return False


class Lines:
    """Lines of a page: text, its length outside links, whether it stands in an article, and the element that holds it."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, int, bool, int]] = []
        self.parts: list[str] = []
        self.free = 0
        #: Dropped elements that hold an article or main element, by their number in the page.
        self.around: set[int] = set()

    def add(self, text: str, linked: bool) -> None:
        self.parts.append(text)
        if not linked:
            self.free += len(text.strip())

    def end(self, scoped: bool, holder: int) -> None:
        text = " ".join(html.unescape("".join(self.parts)).split()) if self.parts else ""
        if text:
            self.rows.append((text, self.free, scoped, holder))
        self.parts, self.free = [], 0

    def gap(self, scoped: bool, holder: int) -> None:
        """Room for what was left out, so that windows over it are empty."""
        self.end(scoped, holder)
        if self.rows and self.rows[-1][0]:
            self.rows.extend([("", 0, False, holder)] * WIDTH)


def page_lines(page: str, spared: frozenset[int] = frozenset()) -> Lines:
    """The lines of a page; elements whose number is in ``spared`` are not dropped for their names."""
    lines = Lines()
    opened: list[tuple[str, bool, int]] = []
    depth: dict[str, int] = {}
    dropping = scope = at = links = number = 0

    def holder() -> int:
        return opened[-1][2] if opened else 0

    def close(name: str) -> None:
        nonlocal dropping, scope
        while True:
            last, drops, _ = opened.pop()
            depth[last] -= 1
            scope -= last in SCOPE
            if drops:
                dropping -= 1
                if not dropping:
                    lines.gap(bool(scope), holder())
            if last == name:
                return

    while True:
        m = MARKUP.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text and not dropping:
            lines.add(text, links > 0)
        if not m:
            break
        at = m.end()
        slash, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if slash:
            if name == "a":
                links = 0
            if name in BLOCKS and not dropping:
                lines.end(bool(scope), holder())
            if depth.get(name):
                close(name)
            continue
        if name in RAW:
            if not attributes.rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if name == "a":
            links = 1
        if name in BLOCKS:
            links = 0
            if not dropping:
                lines.end(bool(scope), holder())
        elif name in ("br", "img", "wbr") and not dropping and name == "br":
            lines.add(" ", True)
        if name in VOID or attributes.endswith("/") and name not in BLOCKS:
            continue
        number += 1
        named = name not in SCOPE and name not in ("body", "html") and number not in spared and not_article(attributes)
        drops = name in DROPPED or named
        if name in LOOSE and not drops:
            continue
        if drops and not dropping:
            lines.gap(bool(scope), holder())
        if dropping and name in SCOPE:
            lines.around.update(own for last, dropped, own in opened if dropped and last not in DROPPED)
        dropping += drops
        scope += name in SCOPE
        opened.append((name, bool(drops), number))
        depth[name] = depth.get(name, 0) + 1
    lines.end(bool(scope), holder())
    return lines


def regions(lengths: list[int], least: int) -> list[tuple[int, int]]:
    """Stretches of lines from each surge of the window sums to the next dive, end exclusive.

    A surge is a window of ``least`` characters; the stretch begins after the last empty window before
    it. A dive is the first empty window after it.
    """
    found: list[tuple[int, int]] = []
    start, surged = 0, False
    window = sum(lengths[:WIDTH])
    for i in range(len(lengths)):
        if window == 0:
            if surged:
                found.append((start, i))
            start, surged = i + 1, False
        elif window >= least:
            surged = True
        window += (lengths[i + WIDTH] if i + WIDTH < len(lengths) else 0) - lengths[i]
    if surged:
        found.append((start, len(lengths)))
    return found


def joined_regions(rows: list[tuple[str, int, bool, int]], lengths: list[int], least: int) -> list[tuple[int, int]]:
    """Regions that surge, with all stretches that only a dropped element of the same holder parts from them."""
    surging = regions(lengths, least)
    groups: list[list[int]] = []
    for a, b in regions(lengths, 1):
        filled = [i for i in range(a, b) if lengths[i]]
        first, last = filled[0], filled[-1]
        before = groups[-1][1] if groups else 0
        gap = {rows[i][3] for i in range(before + 1, first) if not rows[i][0]}
        if groups and rows[before][3] == rows[first][3] and rows[first][3] in gap:
            groups[-1][1] = last
        else:
            groups.append([first, last])
    return [(a, b + 1) for a, b in groups if any(x < b + 1 and a < y for x, y in surging)]


def main_text(page: str | None) -> str:
    """The article of a page, its blocks joined by line ends; empty if there is none.

    An element that is named like clutter but holds the page's only article is not dropped.
    """
    lines = page_lines(page or "")
    rows = lines.rows
    if lines.around and not any(scoped for _, _, scoped, _ in rows):
        rows = page_lines(page or "", frozenset(lines.around)).rows
    if any(scoped for _, _, scoped, _ in rows):
        lengths = [len(text) if scoped else 0 for text, _, scoped, _ in rows]
        kept = regions(lengths, 1)
        return "\n".join(rows[i][0] for a, b in kept for i in range(a, b) if lengths[i])
    lengths = [free for _, free, _, _ in rows]
    sums = [sum(lengths[i : i + WIDTH]) for i in range(len(lengths))]
    kept = joined_regions(rows, lengths, max(1, min(SURGE, max(sums, default=0) // 2)))
    most = max((sum(lengths[a:b]) for a, b in kept), default=0)
    kept = [(a, b) for a, b in kept if sum(lengths[a:b]) >= LEAST_SHARE * most]
    return "\n".join(rows[i][0] for a, b in kept for i in range(a, b) if rows[i][0])


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for each row of ``pages``.

    Null and empty pages, and pages without an article, have an empty text. Comments, scripts and
    elements that are never closed reach to the end of what holds them. Repeated rows and null ids stay
    as they are; an empty table gives no rows. Columns other than the three named are not read.
    """

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(page) for page in batch["html"]]
            out = batch[["page_id", "url"]].copy()
            out["text"], out["n_chars"] = texts, [len(t) for t in texts]
            yield out

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInPandas(
        made, f"page_id {kind}, url string, text string, n_chars long"
    )
