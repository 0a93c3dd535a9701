"""Leaf blocks of an HTML page: runs of text between block-level tags, with the elements around them.

A small tolerant reader: raw-text elements and comments are skipped, missing end tags are implied,
end tags without a start are passed over, a page may break off anywhere. Character references are
decoded, white space inside a block becomes one space, blocks without text don't count. The time is linear
in the page, however deep its elements are nested: a block names its innermost element, which knows its parent.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe noembed noframes xmp svg select datalist".split())
INLINE = frozenset(
    "math mi mn mo mrow ms msqrt mroot mfrac msub msup msubsup munder mover munderover mtext mtable mtr mtd mspace mstyle mpadded semantics annotation "
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
#: A start tag that ends an open element of the second kind, unless one of the third stands between.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("table", "tr")),
    "th": (("td", "th"), ("table", "tr")),
    "tbody": (("tr", "thead", "tbody"), ("table",)),
    "option": (("option",), ("select",)),
    "body": (("head",), ()),
}

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)""")
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*+)"?|'([^']*+)'?|([^\s"'>]+))""")
_SPACE = re.compile(r"\s+")
_TITLE = re.compile(r"<title[^>]*+>([^<]*+)", re.IGNORECASE)


class Element:
    """An open element; ``parent`` is the next one around it that is block-level or has names."""

    __slots__ = ("tag", "names", "parent", "notes")

    def __init__(self, tag: str, names: tuple[str, ...], parent: Element | None):
        self.tag, self.names, self.parent = tag, names, parent
        #: For readers to keep what they found of the element.
        self.notes = None

    def around(self) -> Iterator[Element]:
        """The element and those around it, from the inside."""
        at: Element | None = self
        while at is not None:
            yield at
            at = at.parent


class Block(NamedTuple):
    """``within`` is the innermost element, None outside all; ``linked`` the number of characters inside links."""

    text: str
    within: Element | None
    linked: int


def title_of(html: str | None) -> str:
    """The text of the first title element."""
    found = _TITLE.search(html or "")
    return _SPACE.sub(" ", unescape(found[1])).strip() if found else ""


def _names(attributes: str) -> tuple[str, ...]:
    """Words of class, id, role and such, lower-cased, parted at anything but letters."""
    if "=" not in attributes:
        return ()
    out: list[str] = []
    for name, *values in _ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id", "role", "itemprop", "aria-label"):
            out += re.findall(r"[a-z]+", unescape("".join(values)).lower())
    return tuple(out)


def blocks(html: str | None) -> list[Block]:
    """The leaf blocks in page order."""
    html = html or ""
    out: list[Block] = []
    stack: list[str] = []
    #: For each open tag the innermost element that counts, and for each kind of tag the places where it is open.
    within: list[Element | None] = [None]
    places: dict[str, list[int]] = defaultdict(list)
    run: list[str] = []
    linked = 0
    at, end = 0, len(html)

    def flush() -> None:
        nonlocal linked
        if run:
            text = _SPACE.sub(" ", unescape("".join(run))).strip()
            if text:
                out.append(Block(text, within[-1], min(linked, len(text))))
            run.clear()
        linked = 0

    def close(upto: int) -> None:
        if any(x not in INLINE for x in stack[upto:]):
            flush()
        while len(stack) > upto:
            places[stack.pop()].pop()
            within.pop()

    def last(*tags: str) -> int:
        return max((places[t][-1] for t in tags if places[t]), default=-1)

    while at < end:
        to = html.find("<", at)
        if to < 0:
            to = end
        if to > at:
            run.append(html[at:to])
            if places["a"]:
                linked += to - at
            at = to
            continue
        if html.startswith("<!--", at):
            to = html.find("-->", at + 4)
            at = end if to < 0 else to + 3
            continue
        if html.startswith(("<!", "<?"), at):
            to = html.find(">", at)
            at = end if to < 0 else to + 1
            continue
        found = _TAG.match(html, at) or _LOOSE_TAG.match(html, at)
        if not found:
            run.append("<")
            at += 1
            continue
        at = found.end()
        tag = found[2].lower()
        if found[1]:
            k = last(tag)
            if k >= 0:
                close(k)
            elif tag not in INLINE:
                flush()
            continue
        if tag in VOID:
            if tag in INLINE:
                run.append(" ")
            else:
                flush()
            continue
        if tag in RAW:
            if not found[3].endswith("/"):
                ending = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE).search(html, at)
                at = ending.end() if ending else end
            continue
        if tag not in INLINE:
            flush()
        if tag in CLOSES_P:
            k = last("p", "td", "th", "button", "table")
            if k >= 0 and stack[k] == "p":
                close(k)
        if tag in IMPLIED:
            ends, stops = IMPLIED[tag]
            above = last(*stops)
            open_ends = [places[t][k] for t in ends if (k := bisect_right(places[t], above)) < len(places[t])]
            if open_ends:
                close(min(open_ends))
        names = _names(found[3])
        places[tag].append(len(stack))
        stack.append(tag)
        within.append(within[-1] if tag in INLINE and not names else Element(tag, names, within[-1]))
    flush()
    return out
