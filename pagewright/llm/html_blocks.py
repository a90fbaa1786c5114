"""A page as text blocks with their place in the element tree."""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^<>"']++|"[^"]*"|'[^']*')*+|[^>]*)>""",
    re.S,
)
_NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

# Element names.
RAW = frozenset("script style title textarea template noscript iframe svg math object video audio canvas".split())
BLOCK = frozenset(
    "html head body p div section article main header footer nav aside ul ol li dl dt dd menu table thead tbody tfoot tr td th "
    "caption h1 h2 h3 h4 h5 h6 hgroup blockquote pre figure figcaption form fieldset legend address details summary hr "
    "dialog center select option optgroup button search".split()
)
VOID = frozenset(["hr"])
#: An opening tag of the key ends an open element of the value, unless one of the limits lies between.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("table", "tr")),
    "th": (("td", "th"), ("table", "tr")),
    "option": (("option",), ("select",)),
}


@dataclass
class Element:
    tag: str
    #: The words of each name in its class, id and role.
    names: tuple[frozenset[str], ...]
    parent: int
    depth: int


@dataclass
class Block:
    text: str
    element: int
    link_chars: int


def blocks_of(html: str) -> tuple[list[Block], list[Element]]:
    """Text blocks in page order. Inline tags join their text to the block around them; ``br`` is white
    space; comments, scripts, styles and other raw elements give nothing; unclosed and stray tags are
    tolerated."""
    elements = [Element("", (), 0, 0)]
    stack = [0]
    blocks: list[Block] = []
    parts: list[str] = []
    linked = 0
    in_link = False

    def flush() -> None:
        nonlocal linked, in_link
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                blocks.append(Block(text, stack[-1], min(linked, len(text))))
            parts.clear()
        linked, in_link = 0, False

    def close(tags, limits=()) -> None:
        """Leave the innermost open element of one of the names, if no limit lies inside it."""
        for k in range(len(stack) - 1, 0, -1):
            tag = elements[stack[k]].tag
            if tag in tags:
                del stack[k:]
                return
            if tag in limits:
                return

    def say(text: str) -> None:
        nonlocal linked
        parts.append(text)
        if in_link:
            linked += len(text.strip())

    at, end = 0, len(html)
    while at < end:
        found = _TOKEN.search(html, at)
        if not found:
            say(html[at:])
            break
        if found.start() > at:
            say(html[at : found.start()])
        at = found.end()
        name = found["name"]
        if name is None:
            continue
        tag, closing = name.lower(), bool(found["close"])
        if tag in RAW:
            if not closing and not found["attributes"].endswith("/"):
                after = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                at = after.end() if after else end
        elif tag in BLOCK:
            flush()
            if closing:
                close((tag,))
                continue
            if elements[stack[-1]].tag == "p":
                stack.pop()
            if tag in ENDS:
                close(*ENDS[tag])
            if tag not in VOID:
                given = (next(g for g in m.groups() if g is not None) for m in _NAMED.finditer(found["attributes"]))
                names = tuple(frozenset(w.lower() for w in _WORD.findall(name)) for value in given for name in value.split())
                elements.append(Element(tag, names, stack[-1], elements[stack[-1]].depth + 1))
                stack.append(len(elements) - 1)
        elif tag == "a":
            in_link = not closing
        elif tag in ("br", "img", "wbr", "input") and tag != "wbr":
            parts.append(" ")
    flush()
    return blocks, elements
