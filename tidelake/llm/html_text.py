"""Main text of web pages by tag-path ratios.

A page is cut into blocks, each with the path of its block elements from the root to the leaf.
For every path the text length and the sentence marks of its blocks are summed and divided by
the number of blocks (length ratio, mark ratio). Along the page the ratios of the blocks are
smoothed over neighbours, weighted by how much of the path they share; the two are fused by
their product, and paths whose fused value reaches ``THRESHOLD`` standard deviations of the
page are content. The content region is the article or main element around all content blocks,
on a page without one their lowest common element, and its blocks are the main text, short ones
too.

Menus, headers, footers, side bars, notices, adverts, forms, scripts, styles and reader
comments are known by their element, role, or words of class and id; they never count and are
left out of the region. A name that joins such a word with one that is not common in names of
these parts (``no-sidebar``, ``entry-header``, ``related-work``) leaves the part out only if no
path in it is content. A name of layout round most of the text is a wrapper; neither it nor a
joined name leaves out the headline.

Output: character references decoded, white space inside a block made one blank, blocks in page
order joined by a line feed; nothing else is dropped. Defined cases: a NULL or empty page, and
one without text outside those parts, gives the empty text; pages may be cut off anywhere, and
their open elements end there (a tag that is cut off is no text); pages of any length are read
whole, in time linear in their length; repeated rows give repeated results; an empty table gives an
empty one; other columns pass through, but one that is named like the result gives way to it.
"""

from __future__ import annotations

import math
import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.llm.common import text_of

THRESHOLD = 0.5
REACH = 2

# A tag ends before the next one begins, quotes aside, so no place is read for many tags.
TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)"
    r"|<(?P<raw>script|style|noscript|template|svg|math|iframe|textarea|title)\b"
    r"(?:\"[^\"]*+\"|'[^']*+'|[^'\"<>])*+>"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<rest>(?:\"[^\"]*+\"|'[^']*+'|[^'\"<>])*+)>"
    r"|<[!?][^<>]*+>"
    r"|</?[a-zA-Z!?](?:\"[^\"]*+\"|'[^']*+'|[^'\"<>])*+(?:[\"'][^>]*+)?$",
    re.S | re.I,
)
BLOCKS = frozenset(
    "html head body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead"
    " tbody tfoot tr td th caption blockquote pre figure figcaption address details summary"
    " header footer nav aside form fieldset dialog menu center hgroup search".split()
)
# These end the block without being on the path.
BREAKS = frozenset(("br", "hr"))
VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
# What an opening tag ends by itself, up to the nearest container.
CLOSES = {
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "tr": ("tr", "td", "th"),
    "td": ("td", "th"),
    "th": ("td", "th"),
}
LOOSE = frozenset("p h1 h2 h3 h4 h5 h6".split())
SKIPPED = frozenset(
    "head nav header footer aside form button select option label input fieldset dialog menu"
    " search script style noscript template".split()
)
ROLES = frozenset(
    "navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog"
    " toolbar tablist status".split()
)
HINT = re.compile(
    r"(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|footer"
    r"|masthead|header|sidebar\w*|side|aside|widget\w*|comments?|commentlist|disqus|replies|reply"
    r"|respond|cookies?|consent|notices?|alert|popup|modal|overlay|newsletter|subscribe\w*|signup"
    r"|social|share|sharing|related|recommend\w*|pagination|pager|toolbar|login|copyright)",
    re.I,
)
# Words that names of those parts hold beside the hint.
BESIDE = re.compile(
    r"(?:site|page|top|bottom|main|global|primary|secondary|left|right|sticky|fixed|mobile|list"
    r"|items?|box|bar|wrap|wrapper|container|section|area|region|zone|slot|block|inner|outer"
    r"|links?|posts?|articles?|stories|news|form|buttons?|icons?|panel|group|row|column|col"
    r"|unit|thread|user|reader|js|the|and|by|\d*)",
    re.I,
)
# Hints that pages also use for the parts around their content.
LAYOUT = re.compile(r"(?:banner|header|masthead|sidebar\w*|side|aside|widget\w*|overlay|modal|toolbar|nav\w*|menu\w*)", re.I)
WRAPPED = 0.5
ATTRIBUTE = re.compile(
    r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?"
)
MARKS = re.compile(r"[.,;:!?…。、，！？；：]")
KEPT_INSIDE = frozenset(("article", "main"))


def _attributes(rest: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(rest)}


# What the name of an element says of it.
FINE, WEAK, WRAPPER, STRONG = range(4)


def _hint(names: str) -> int:
    """The strongest hint of the names of class and id."""
    found = FINE
    for name in names.split():
        parts = re.split("[_-]+", name)
        hints = [p for p in parts if HINT.fullmatch(p)]
        if not hints:
            continue
        if not all(HINT.fullmatch(p) or BESIDE.fullmatch(p) for p in parts):
            found = max(found, WEAK)
        else:
            found = max(found, WRAPPER if all(map(LAYOUT.fullmatch, hints)) else STRONG)
    return found


def _is_boilerplate(name: str, rest: str, inside: bool) -> int:
    """Whether an element is one of the parts that never count: FINE and STRONG are settled.

    A header or footer inside an article may hold its headline and is judged by its blocks.
    """
    if name in SKIPPED:
        return FINE if name == "header" and inside else STRONG
    if not rest.strip() or name in ("html", "body"):
        return FINE
    found = _attributes(rest)
    if "hidden" in found or found.get("aria-hidden") == "true":
        return STRONG
    if found.get("role", "").lower() in ROLES:
        return STRONG
    if name in KEPT_INSIDE:
        return FINE
    return _hint(f"{found.get('class', '')} {found.get('id', '')}")


class Block:
    __slots__ = ("path", "elements", "text", "marks", "hints")

    def __init__(
        self, path: tuple[str, ...], elements: tuple[int, ...], text: str, hints: tuple[int, ...] = ()
    ):
        self.path, self.elements, self.text, self.hints = path, elements, text, hints
        self.marks = len(MARKS.findall(text))


def blocks_of(html: str) -> list[Block]:
    """The text blocks outside boilerplate, in page order."""
    return _settled(_all_blocks(html))


def _settled(blocks: list[Block]) -> list[Block]:
    """The blocks that no weak hint and no wrapper's name leaves out."""
    for kind in (WRAPPER, WEAK):
        # Outer elements first: what they hold is judged once they stay.
        for depth in range(max((len(b.hints) for b in blocks), default=0)):
            inside: dict[int, list[Block]] = {}
            for b in blocks:
                if len(b.hints) > depth and b.hints[depth] == kind:
                    inside.setdefault(b.elements[depth], []).append(b)
            if not inside:
                continue
            if kind == WEAK:
                paths = content_paths(blocks)
            else:
                least = WRAPPED * sum(len(b.text) for b in blocks)
            out = set()
            for element, held in inside.items():
                if kind == WEAK:
                    stays = any(b.path in paths for b in held)
                else:
                    stays = sum(len(b.text) for b in held) >= least
                if not stays and not any("h1" in b.path for b in held):
                    out.add(element)
            blocks = [b for b in blocks if not (len(b.elements) > depth and b.elements[depth] in out)]
    return blocks


def _all_blocks(html: str) -> list[Block]:
    """The text blocks outside what is settled as boilerplate, in page order."""
    stack: list[tuple[str, int, int]] = []  # element, its number, its hint
    out: list[Block] = []
    pieces: list[str] = []
    number = 0

    def end_block() -> None:
        text = " ".join(unescape("".join(pieces)).split())
        pieces.clear()
        if text and not (stack and stack[-1][2] == STRONG):
            hints = tuple(s[2] for s in stack) if any(s[2] for s in stack) else ()
            out.append(Block(tuple(s[0] for s in stack), tuple(s[1] for s in stack), text, hints))

    at, size = 0, len(html)
    while at < size:
        m = TOKEN.search(html, at)
        if m is None:
            pieces.append(html[at:])
            break
        if m.start() > at:
            pieces.append(html[at : m.start()])
        at = m.end()
        if m["raw"]:
            close = re.compile(rf"</{m['raw']}\b[^>]*>", re.I).search(html, at)
            at = close.end() if close else size
            continue
        if not m["name"]:
            continue
        name = m["name"].lower()
        if name in BREAKS:
            end_block()
            continue
        if name not in BLOCKS and name not in SKIPPED:
            continue
        if name in VOID:
            continue
        end_block()
        if m["close"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            continue
        # A new block ends an open paragraph or heading; items and cells end their like.
        while stack and stack[-1][0] in LOOSE:
            stack.pop()
        ends = CLOSES.get(name, ())
        if ends:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ends:
                    del stack[k:]
                elif stack[k][0] in ("ul", "ol", "dl", "table"):
                    break
        number += 1
        inside = any(s[0] in KEPT_INSIDE for s in stack)
        never = stack and stack[-1][2] == STRONG
        stack.append((name, number, STRONG if never else _is_boilerplate(name, m["rest"], inside)))
    end_block()
    return out


def _shared(a: tuple, b: tuple) -> float:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n / max(len(a), len(b), 1)


def content_paths(blocks: list[Block]) -> set[tuple[str, ...]]:
    """Paths whose smoothed and fused ratio reaches the threshold."""
    sums: dict[tuple[str, ...], list[float]] = {}
    for b in blocks:
        s = sums.setdefault(b.path, [0.0, 0.0, 0.0])
        s[0] += len(b.text)
        s[1] += b.marks
        s[2] += 1
    length = [sums[b.path][0] / sums[b.path][2] for b in blocks]
    marks = [sums[b.path][1] / sums[b.path][2] for b in blocks]
    fused = []
    for i, b in enumerate(blocks):
        weight = total_length = total_marks = 0.0
        for j in range(max(0, i - REACH), min(len(blocks), i + REACH + 1)):
            w = math.exp(-((i - j) ** 2) / 2) * _shared(b.path, blocks[j].path)
            w = w if j != i else 1.0
            weight += w
            total_length += w * length[j]
            total_marks += w * marks[j]
        fused.append(total_length / weight * (1 + total_marks / weight))
    mean = sum(fused) / len(fused)
    least = THRESHOLD * math.sqrt(sum((f - mean) ** 2 for f in fused) / len(fused))
    best: dict[tuple[str, ...], float] = {}
    for b, f in zip(blocks, fused):
        best[b.path] = max(best.get(b.path, 0.0), f)
    return {path for path, f in best.items() if f >= least}


def main_text(html: str) -> str:
    """The main text of one page."""
    blocks = blocks_of(html)
    if not blocks:
        return ""
    articles = [b for b in blocks if KEPT_INSIDE.intersection(b.path)]
    pool = articles or blocks
    paths = content_paths(pool)
    chosen = [b for b in pool if b.path in paths]
    if not chosen:
        return "\n".join(b.text for b in pool)
    # The lowest element around all content blocks.
    k = min(len(b.elements) for b in chosen)
    while k and any(b.elements[:k] != chosen[0].elements[:k] for b in chosen):
        k -= 1
    path = chosen[0].path[:k]
    if articles:
        while path and path[-1] not in KEPT_INSIDE:
            path = path[:-1]
    else:
        # A lone paragraph is not the region: the element around it is.
        while path and path[-1] in LOOSE:
            path = path[:-1]
    region = chosen[0].elements[: len(path)]
    return "\n".join(b.text for b in pool if b.elements[: len(region)] == region)


@F.arrow_udf(T.StringType())
def extract(pages: pa.Array) -> pa.Array:
    return pa.array([main_text(p) for p in pages.to_pylist()], type=pa.string())


def extract_pages(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """All columns of ``pages`` and the main text of its whole html."""
    return pages.withColumn(out, extract(text_of(pages, html)))
