"""Blocks of HTML pages by CSS selectors (A8), as a map over pages.

A page is cut into tags and text once, from left to right.  Each open element keeps one integer whose bits say which
selector steps it matches, and the union of its ancestors' and earlier siblings' bits, so an element is matched
against all combinators in a few operations, and time and memory are linear in the page.  The text of an element
is a range of the page's text pieces.  Pages are independent: nothing is shuffled.

Selectors are lists (``a, b``) of compounds (tag, ``*``, ``#id``, ``.class``, ``[attr]``, ``[attr=value]`` and
``~= |= ^= $= *=``) joined by descendant, ``>``, ``+`` and ``~``.  Anything else is not supported.

Missing end tags: an element ends with the end tag of its name, with that of an element around it, or with the page;
``p``, ``li``, ``dt``, ``dd``, ``tr``, ``td``, ``th`` and ``option`` also end where a next one starts.  Text of scripts,
styles and comments counts for no element.
"""

from __future__ import annotations

import functools
import html
import re
from bisect import bisect_left

_NAME = r"[A-Za-z][\w-]*"
_ATTRIBUTE = r"\[\s*[A-Za-z_][\w:-]*\s*(?:[~|^$*]?=\s*(?:\"[^\"]*\"|'[^']*'|[\w-]+)\s*)?\]"
_COMPOUND = rf"(?:(?:{_NAME}|\*)(?:[.#][\w-]+|{_ATTRIBUTE})*|(?:[.#][\w-]+|{_ATTRIBUTE})+)"
_COMPLEX = rf"{_COMPOUND}(?:(?:\s*[>+~]\s*|\s+){_COMPOUND})*"
#: Regular expression of a supported selector, for Python and Java.
SELECTOR = rf"^\s*{_COMPLEX}(?:\s*,\s*{_COMPLEX})*\s*$"

_PART = re.compile(rf"(?P<comma>\s*,\s*)|(?P<join>\s*[>+~]\s*|\s+)|(?P<tag>{_NAME}|\*)|\.(?P<cls>[\w-]+)|#(?P<id>[\w-]+)|(?P<attr>{_ATTRIBUTE})")
_CONDITION = re.compile(r"\[\s*([\w:-]+)\s*(?:([~|^$*]?=)\s*(?:\"([^\"]*)\"|'([^']*)'|([\w-]+))\s*)?\]")
_TEST = {
    None: lambda have, want: True,
    "=": lambda have, want: have == want,
    "~=": lambda have, want: want in have.split(),
    "|=": lambda have, want: have == want or have.startswith(want + "-"),
    "^=": lambda have, want: want != "" and have.startswith(want),
    "$=": lambda have, want: want != "" and have.endswith(want),
    "*=": lambda have, want: want != "" and want in have,
}

# Elements of the HTML standard without content, with raw text, and those whose end tag may be left out.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"))
UNSEEN = frozenset(("script", "style"))
ENDED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


class Step:
    """One compound and how it hangs on the step before."""

    def __init__(self, join: str):
        self.join, self.tag, self.ids, self.classes, self.attributes = join, None, [], [], []

    def fits(self, tag: str, attributes: dict, classes) -> bool:
        if self.tag not in (None, "*", tag) or any(i != attributes.get("id") for i in self.ids) or any(c not in classes for c in self.classes):
            return False
        return all(name in attributes and _TEST[op](attributes[name], value) for name, op, value in self.attributes)


@functools.lru_cache(maxsize=4096)
def parse_selector(selector: str) -> tuple | None:
    """Alternatives, each a list of steps; None if the selector isn't supported."""
    if not re.match(SELECTOR, selector):
        return None
    alternatives = [[Step("")]]
    for part in _PART.finditer(selector.strip()):
        step = alternatives[-1][-1]
        if part["comma"]:
            alternatives.append([Step("")])
        elif part["join"]:
            alternatives[-1].append(Step(part["join"].strip() or " "))
        elif part["tag"]:
            step.tag = part["tag"].lower()
        elif part["cls"]:
            step.classes.append(part["cls"])
        elif part["id"]:
            step.ids.append(part["id"])
        else:
            name, op, *values = _CONDITION.match(part["attr"]).groups()
            step.attributes.append((name.lower(), op, next((v for v in values if v is not None), "")))
    return tuple(map(tuple, alternatives))


class Matcher:
    """The steps of several selectors, numbered as bits."""

    def __init__(self, selectors: list[str | None]):
        self.steps, self.final = [], []
        for selector in selectors:
            last = 0
            for alternative in parse_selector(selector) if selector is not None else ():
                for step in alternative:
                    self.steps.append((1 << len(self.steps), step))
                last |= self.steps[-1][0]
            self.final.append(last)

    def bits(self, tag: str, attributes: dict, above: int, parent: int, earlier: int, previous: int) -> int:
        classes = attributes.get("class", "").split()
        base = {" ": above, ">": parent, "~": earlier, "+": previous}
        out = 0
        for bit, step in self.steps:
            if (not step.join or base[step.join] & (bit >> 1)) and step.fits(tag, attributes, classes):
                out |= bit
        return out


@functools.lru_cache(maxsize=4096)
def _matcher(*selectors: str | None) -> Matcher:
    return Matcher(list(selectors))


_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
_ATTR = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*([\"']?))?")
_BARE = re.compile(r"[^\s>]*")


def _attributes(page: str, at: int, quoteless: set) -> tuple[dict, int]:
    """Attributes of the start tag whose name ends at ``at``, and where the tag ends."""
    found: dict[str, str] = {}
    while m := _ATTR.match(page, at):
        name, quote, at = m[1].lower(), m[2], m.end()
        value = ""
        if quote:
            end = -1 if quote in quoteless else page.find(quote, at)
            if end < 0:
                quoteless.add(quote)  # there is none to the end of the page
            else:
                value, at = page[at:end], end + 1
        elif quote is not None:
            value = _BARE.match(page, at)[0]
            at += len(value)
        found.setdefault(name, html.unescape(value))
    end = page.find(">", at)
    return found, len(page) if end < 0 else end + 1


def events(page: str):
    """('start', name, attributes), ('end', name, None) and ('text', text, raw element or '')."""
    at, quoteless = 0, set()
    while at < len(page):
        less = page.find("<", at)
        less = len(page) if less < 0 else less
        if less > at:
            yield "text", html.unescape(page[at:less]), ""
        at = less
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = len(page) if end < 0 else end + 3
        elif page.startswith(("<!", "<?"), at):
            end = page.find(">", at)
            at = len(page) if end < 0 else end + 1
        elif tag := _TAG.match(page, at):
            name = tag[2].lower()
            if tag[1]:
                end = page.find(">", tag.end())
                at = len(page) if end < 0 else end + 1
                yield "end", name, None
                continue
            attributes, at = _attributes(page, tag.end(), quoteless)
            yield "start", name, attributes
            if name in RAW:
                close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
                end = close.start() if close else len(page)
                yield "text", page[at:end] if name in UNSEEN else html.unescape(page[at:end]), name
                at = end
        elif at < len(page):
            yield "text", "<", ""
            at += 1


class _Open:
    """An element that hasn't ended: its bits, those above it, and those of its children so far."""

    __slots__ = ("name", "bits", "above", "children", "last", "items")

    def __init__(self, name, bits, above, items):
        self.name, self.bits, self.above, self.items = name, bits, above, items
        self.children = self.last = 0


def select_blocks(page: str, block: str, fields: list[str | None]):
    """For each block in page order, per field: (text of all matches in it, attributes of the first or None)."""
    matcher = _matcher(block, *fields)
    pieces: list[str] = []
    found: list[list] = [[] for _ in matcher.final]  # [order, first piece, end piece, end order, attributes]
    stack, heights, order = [_Open("", 0, 0, [])], {}, 0

    def close(down_to: int) -> None:
        while len(stack) > down_to:
            gone = stack.pop()
            heights[gone.name].pop()
            for item in gone.items:
                item[2], item[3] = len(pieces), order

    for kind, name, attributes in events(page):
        if kind == "text":
            if attributes not in UNSEEN:
                pieces.append(name)
            continue
        if kind == "end":
            if heights.get(name):
                close(heights[name][-1])
            continue
        if name in ENDS_P and heights.get("p"):
            close(heights["p"][-1])
        for other in ENDED_BY.get(name, ()):
            if heights.get(other) and all(not heights.get(s) or heights[s][-1] < heights[other][-1] for s in SCOPE[name]):
                close(heights[other][-1])
        order += 1
        parent = stack[-1]
        above = parent.above | parent.bits
        bits = matcher.bits(name, attributes, above, parent.bits, parent.children, parent.last)
        parent.children |= bits
        parent.last = bits
        items = []
        for which, final in enumerate(matcher.final):
            if bits & final:
                item = [order, len(pieces), len(pieces), order, attributes]
                found[which].append(item)
                items.append(item)
        if name not in VOID:
            heights.setdefault(name, []).append(len(stack))
            stack.append(_Open(name, bits, above, items))
    close(1)
    orders = [[item[0] for item in items] for items in found]
    for start, _, _, end, _ in found[0]:
        out = []
        for which in range(1, len(found)):
            inside = found[which][bisect_left(orders[which], start + 1) : bisect_left(orders[which], end + 1)]
            out.append(("".join(["".join(pieces[a:b]) for _, a, b, _, _ in inside]), inside[0][4] if inside else None))
        yield out


FIELDS = ("title", "url", "content")
SCHEMA = "source string, page bigint, item_pos int, source_url string, title string, href string, content string"
# Blocks of several pages leave together, once they are this many or have this many characters.
BATCH_ROWS, BATCH_CHARS = 4096, 1 << 20


def blocks_of_pages(batches):
    """Arrow map from (source, page, source_url, selector, title, url, content, payload) to ``SCHEMA``, one row per block."""
    import pyarrow as pa

    names = [c.split()[0] for c in SCHEMA.split(", ")]
    types = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string()]
    rows, chars = [], 0

    def out():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    for batch in batches:
        for at in range(batch.num_rows):
            source, page, url, block, *fields, payload = [c[at].as_py() for c in batch.columns]
            for n, ((title, _), (_, first), (content, _)) in enumerate(select_blocks(payload, block, fields)):
                href = (first or {}).get("href")
                rows.append((source, page, n, url, title, href, content))
                chars += sum(len(x) for x in (source, url, title, href, content) if x is not None)
                if len(rows) >= BATCH_ROWS or chars >= BATCH_CHARS:
                    yield out()
                    rows, chars = [], 0
    if rows:
        yield out()
