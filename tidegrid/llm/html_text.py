"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped in one pass over the tags. Each block element begins a new line; what is never part of an article
(scripts, styles, forms, menus, headers, footers, sidebars, and elements whose class, id or role names an advert, a notice
or comments) is left out. Names that only say what an element has or lacks (``has-sidebar``) do not count, nor do
those of an article or main element. If the page marks one of these, all lines in it are the text.

Otherwise lines that mostly consist of links count as empty; lines without text, which come from tags and what was left out,
are no lines at all. The length of text in ``WINDOW`` consecutive lines rises at the beginning of the main text and
falls at its end. A surge point is a line whose window holds ``surge`` characters or more with text before it being absent;
a dive point is a line after which a whole window is empty. All lines between a surge and the next dive are kept, short
ones included. A page whose text nowhere surges keeps the densest stretch instead, so that a short article is still found.

Character references are decoded once, white space inside a block becomes one space, blocks are joined by an empty
line. Null and empty pages, and pages without text, give an empty text. Pages are independent rows: repeated ones each get
their result, extra columns are ignored. Time and memory are linear in the length of a page.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines in a window, and the characters that make it dense.
WINDOW, SURGE = 3, 80

#: Element names of HTML by what they do to a text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math noembed noframes xmp".split())
OUTSIDE = frozenset("head nav header footer aside form button select option dialog menu object audio video canvas".split())
ARTICLE = frozenset("article main".split())
#: Elements whose end tag may be left out, and the begin tags that end them.
ENDS_PARAGRAPH = BLOCKS - frozenset("td th tr tbody thead tfoot body html caption dd dt li".split()) | {"li", "dd", "dt", "table"}
UNWANTED = re.compile(
    r"(?i)(?:^|[\s_-])(?:ads?|adverts?|advertis\w*|banners?|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alerts?|popups?|modal|overlay|newsletter|subscribe|"
    r"comments?|disqus|replies|respond|sidebars?|menus?|nav|navbar|navigation|breadcrumbs?|footer|header|masthead|related|recommended|share|sharing|social|"
    r"toolbar|pagination|pager|widgets?|complementary|contentinfo|search|login|signup)(?:$|[\s_-])"
)
#: Names that say what an element has or lacks, not what it is.
MODIFIER = re.compile(r"(?i)(?:^|(?<=\s))(?:has|have|no|not|with|without)[_-]\S*")

_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z))", re.DOTALL)
_NAMED = re.compile(r"""(?i)(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_HIDDEN = re.compile(r"""(?i)(?:^|\s)(?:hidden(?=\s|$|=)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""")


@dataclass
class Line:
    """Text pieces of one block; ``linked`` counts the characters inside links."""

    parts: list[str]
    linked: int
    inside: bool

    def text(self) -> str:
        return " ".join(entities.unescape("".join(self.parts)).split())


def _unwanted(name: str, attributes: str) -> bool:
    if not attributes or "=" not in attributes or name in ARTICLE:
        return bool(attributes) and bool(_HIDDEN.search(attributes))
    if any(UNWANTED.search(MODIFIER.sub(" ", value)) for found in _NAMED.findall(attributes) for value in found if value):
        return True
    return bool(_HIDDEN.search(attributes))


def to_lines(html: str) -> tuple[list[Line], bool]:
    """The page's lines without markup, and whether it marks an article."""
    lines = [Line([], 0, False)]
    stack: list[str] = []
    open_now: Counter[str] = Counter()
    dropped_at = links = articles = 0  # depth of the outermost dropped element; open links and articles
    marked, at = False, 0

    def take(text: str) -> None:
        if not dropped_at and text:
            lines[-1].parts.append(text)
            if links:
                lines[-1].linked += len(text)

    def cut() -> None:
        if lines[-1].parts or lines[-1].inside != (articles > 0):
            lines.append(Line([], 0, articles > 0))

    def close(depth: int) -> None:
        nonlocal dropped_at, links, articles
        while len(stack) > depth:
            name = stack.pop()
            open_now[name] -= 1
            links -= name == "a"
            articles -= name in ARTICLE
            if dropped_at and len(stack) < dropped_at:
                dropped_at = 0
                lines.append(Line([], 0, articles > 0))

    for m in iter(lambda: _TAG.search(html, at), None):
        take(html[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if open_now[name]:
                close(len(stack) - 1 - stack[::-1].index(name))
            if name in BLOCKS:
                cut()
            continue
        if name in ENDS_PARAGRAPH and open_now["p"]:
            close(len(stack) - 1 - stack[::-1].index("p"))
        if name in ("li", "dt", "dd", "option", "tr", "td", "th") and stack and stack[-1] == name:
            close(len(stack) - 1)
        if name in BLOCKS:
            cut()
        if name == "br":
            take(" ")
        if name in VOID or m[3].endswith("/"):
            continue
        if name in RAW:
            end = re.compile(rf"(?i)</{re.escape(name)}\b[^>]*>?").search(html, at)
            at = end.end() if end else len(html)
            continue
        stack.append(name)
        open_now[name] += 1
        links += name == "a"
        if name in ARTICLE and not dropped_at:
            marked = True
        articles += name in ARTICLE
        if name in ARTICLE:
            cut()
        if not dropped_at and name not in ("html", "body") and (name in OUTSIDE and not (name == "header" and articles) or _unwanted(name, m[3])):
            cut()
            dropped_at = len(stack)
    take(html[at:])
    return lines, marked


def main_text(html: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The lines between surge and dive points."""
    if not html:
        return ""
    lines, marked = to_lines(html)
    read = [(line.text(), line.linked) for line in lines if (line.inside or not marked) and line.parts]
    if marked:
        return "\n\n".join(text for text, _ in read if text)
    texts = ["" if 2 * linked > len(text) else text for text, linked in read if text]
    lengths = [len(t) for t in texts]
    kept: list[str] = []
    densest: tuple[int, list[str]] = (0, [])
    start = 0
    while start < len(lengths):
        if not lengths[start]:
            start += 1
            continue
        end, gap, dense, total = start, 0, False, 0
        while end < len(lengths) and gap < window:  # a whole empty window is the dive
            gap = 0 if lengths[end] else gap + 1
            total += lengths[end]
            dense = dense or sum(lengths[end : end + window]) >= surge
            end += 1
        stretch = [t for t in texts[start:end] if t]
        if dense:
            kept += stretch
        elif total > densest[0]:
            densest = (total, stretch)
        start = end
    return "\n\n".join(kept or densest[1])


def text_column(html: Column, window: int = WINDOW, surge: int = SURGE) -> Column:
    """The main text of each page."""

    @F.arrow_udf("string")
    def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([main_text(page.as_py(), window, surge) for page in batch], pa.string())

    return extract(html)


def extract_pages(pages: DataFrame, window: int = WINDOW, surge: int = SURGE) -> DataFrame:
    """One row per page: id, url, text and its length in code points."""
    text = text_column(F.col("html"), window, surge)
    return pages.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
