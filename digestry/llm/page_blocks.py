"""Leaf blocks of an HTML page in page order, with the path of open elements above each."""

from __future__ import annotations

import html
import re
from typing import NamedTuple

# Elements that start a block; all others run inside a line.  Fixed values of HTML.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav noscript ol option p pre search section select summary table tbody td tfoot "
    "th thead tr ul".split()
)
#: Raw text up to the end tag, or to the end of the page; none of it is text of the page.
RAW = frozenset("iframe script style textarea title".split())
#: Nothing inside these is text of the page; like blocks, they end at their own end tag or at a parent's.
HIDDEN = frozenset("audio canvas object svg template video".split())
#: Those that, without an end tag of their own, end also where a parent's is left out; object only with its cell or row.
LEFT_OPEN = {t: re.compile(rf"<(/?){t}\b", re.I) for t in ("audio", "canvas", "object", "video")}
#: Start tags that may stand in a head; any other, and any text, ends it.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: Start tags that end an svg, unless inside one of ``SVG_HTML``.
ENDS_SVG = BLOCKS | frozenset("b big br code em embed head hr i img listing meta nobr ruby s small span strong strike sub sup tt u var".split())
SVG_HTML = frozenset("desc foreignobject title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What a start tag closes, if it is the innermost open block of the kind.
CLOSES = {
    **{t: {"p"} for t in BLOCKS},
    "li": {"p", "li"},
    "dt": {"p", "dt", "dd"},
    "dd": {"p", "dt", "dd"},
    "tr": {"p", "td", "th", "tr"},
    "td": {"p", "td", "th"},
    "th": {"p", "td", "th"},
    "option": {"option"},
}

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
NAMED = re.compile(r"""\b(class|id|role|aria-hidden|hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


#: What a block's path tells of the elements around it: the outermost and the innermost ones, and of each the first words of its class,
#: id and role.  It is a feature of the labeller, bounded so that deep pages take linear time and memory; texts are never cut.
OUTER, INNER, NAMES = 8, 24, 24


class Block(NamedTuple):
    path: tuple[str, ...]  # tokens of the open elements, innermost last
    text: str


def descriptor(tag: str, attributes: str) -> tuple[str, ...]:
    """The tag, and the words of its class, id and role."""
    out = [tag]
    if attributes:
        for name, *values in NAMED.findall(attributes):
            value, name = "".join(values), name.lower()
            if name in ("class", "id", "role"):
                out += ["." + p.lower() for p in PART.findall(value)]
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
                out.append(".hidden")
    return tuple(out[: 1 + NAMES])


def blocks(page: str | None) -> list[Block]:
    """Blocks with text: references decoded, white space turned into single spaces, trimmed."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...], bool]] = []  # open blocks and hidden elements: tag, descriptor, without an end tag
    parts: list[str] = []
    linked = total = 0  # characters inside links, and all, of the block
    in_link = False
    hidden = head = -1  # height of the stack below the outermost hidden element, and at the start of the open head
    heights: dict[str, list[int]] = {}  # height of the stack below each of its elements
    inline: dict[str, list[int]] = {}  # height of the stack at each start tag of other elements

    def text(raw: str) -> None:
        nonlocal linked, total, head
        if raw and hidden < 0:
            parts.append(raw)
            n = len(raw.strip())
            total += n
            linked += n * in_link
            if n:
                head = -1

    def space() -> None:
        if hidden < 0:
            parts.append(" ")

    def flush() -> None:
        nonlocal linked, total
        if parts:
            joined = " ".join(html.unescape("".join(parts)).split())
            if joined:
                height = len(stack) if hidden < 0 else hidden
                around = stack[:height] if height <= OUTER + INNER else stack[:OUTER] + stack[height - INNER : height]
                path = [t for _, d, _ in around for t in d]
                out.append(Block((*path, "a") if 2 * linked > total else tuple(path), joined))
            parts.clear()
        linked = total = 0

    def leave(height: int) -> None:
        """Close all above ``height``; a hidden element closed alone doesn't end the block around it."""
        nonlocal hidden
        if height != hidden and (hidden < 0 or height < hidden):
            flush()
        for gone, _, _ in stack[height:]:
            heights[gone].pop()
        del stack[height:]
        if height <= hidden:
            hidden = -1

    page = page or ""
    at = 0
    while True:
        m = MARKUP.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if head >= 0 and (tag in ("head", "body") if closing or hidden >= 0 else tag not in IN_HEAD):
            if len(stack) > head:
                leave(head)
            head = -1
        while stack and stack[-1][0] == "svg" and (tag in ("p", "br") if closing else tag in ENDS_SVG):
            leave(len(stack) - 1)
        in_svg = bool(stack) and stack[-1][0] == "svg"
        if closing:
            if tag in BLOCKS or tag in HIDDEN or tag in SVG_HTML:
                if heights.get(tag):
                    leave(heights[tag][-1])
                elif tag in BLOCKS and hidden < 0:
                    flush()
                continue
            below = inline.get(tag)
            while below:
                height = below.pop()
                if height <= len(stack):
                    if height == hidden:
                        leave(height)
                    break
            if tag == "a" and hidden < 0:
                in_link = False
        elif tag in HIDDEN and not in_svg or in_svg and (tag in SVG_HTML or tag == "svg"):
            space()
            if not attributes.endswith("/"):
                following = LEFT_OPEN[tag].search(page, at) if tag in LEFT_OPEN else None
                if hidden < 0:
                    hidden = len(stack)
                heights.setdefault(tag, []).append(len(stack))
                stack.append((tag, (), tag in LEFT_OPEN and not (following and following[1])))
        elif in_svg:
            continue
        elif tag in RAW:
            space()
            if not attributes.endswith("/"):
                end = _ENDS[tag].search(page, at)
                at = end.end() if end else len(page)
        elif tag == "br":
            space()
        elif tag == "head":
            if hidden < 0:
                head = len(stack)
        elif tag in BLOCKS:
            if hidden < 0:
                flush()
            while stack:
                k = len(stack) - 1
                while k >= 0 and stack[k][2] and (stack[k][0] != "object" or tag in ("td", "th", "tr")):
                    k -= 1
                if k < 0 or stack[k][0] not in CLOSES[tag]:
                    break
                leave(k)
            if tag not in VOID:
                heights.setdefault(tag, []).append(len(stack))
                stack.append((tag, descriptor(tag, attributes), False))
        elif tag not in VOID:
            inline.setdefault(tag, []).append(len(stack))
            if tag == "a" and hidden < 0:
                in_link = True
    flush()
    return out


_ENDS = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in RAW}
