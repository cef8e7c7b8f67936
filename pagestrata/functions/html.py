"""A tolerant reader of page markup: which text stands in which block element, and in which boxes these lie."""

from __future__ import annotations

import html as _html
import re
from typing import NamedTuple

BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th figcaption div".split())
BOXES = frozenset("html body main article section header footer nav aside dialog ul ol dl table tbody thead tfoot tr figure form fieldset details template svg".split()) | BLOCKS
#: Start tags that end an open element of the named kinds, as HTML has it.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_P_ENDERS = BOXES - {"tr", "td", "th", "tbody", "thead", "tfoot", "li", "svg", "template", "html", "body"} | {"hr"}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|title|textarea)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([A-Za-z][A-Za-z0-9-]*)((?:[^<>\"']++|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*>", re.S | re.I)


class Block(NamedTuple):
    no: int
    tag: str
    text: str
    linked: int
    path: tuple[int, ...]


class Box(NamedTuple):
    tag: str
    parent: int
    attrs: str
    at: int


def blocks(source: str | None) -> tuple[list[Block], list[Box]]:
    """The block elements of a page that hold text of their own, numbered by start tags in source order, and all
    boxes. Comments, scripts and styles are skipped; inline tags are seen through; unclosed elements end where HTML
    ends them. A block's path names its boxes from the outside in, itself last."""
    boxes: list[Box] = []
    stack: list[int] = []
    text: dict[int, list[str]] = {}
    number: dict[int, int] = {}
    linked: dict[int, int] = {}
    paths: dict[int, tuple[int, ...]] = {}
    n, at, in_link = 0, 0, False

    def put(chunk: str) -> None:
        if not stack:
            return
        top = stack[-1]
        if top in paths:
            text[top].append(chunk)
        elif top in number and not chunk.isspace():
            paths[top] = tuple(stack)
            text[top] = [chunk]
        else:
            return
        if in_link:
            linked[top] = linked.get(top, 0) + len(chunk)

    source = source or ""
    for m in _TOKEN.finditer(source):
        begin = m.start()
        if begin > at:
            put(source[at:begin])
        at = m.end()
        name = m.group(3)
        if not name:
            continue
        name = name.lower()
        if name == "a":
            in_link = not m.group(2)
            continue
        if name == "br":
            put("\n")
            continue
        if name not in BOXES:
            if name in ("img", "hr"):
                put(" ")
            continue
        if m.group(2):
            for k in range(len(stack) - 1, -1, -1):
                if boxes[stack[k]].tag == name:
                    del stack[k:]
                    break
                if boxes[stack[k]].tag in ("table", "td") and name not in ("table", "tr", "body", "html"):
                    break
            in_link = False
            continue
        if name in _P_ENDERS and stack and boxes[stack[-1]].tag == "p":
            stack.pop()
        if name in _CLOSES:
            kinds, bound = _CLOSES[name]
            for k in range(len(stack) - 1, -1, -1):
                tag = boxes[stack[k]].tag
                if tag in kinds:
                    del stack[k:]
                    if name != "tr":
                        break
                elif tag in bound:
                    break
        elif name in _HEADINGS and stack and boxes[stack[-1]].tag in _HEADINGS:
            stack.pop()
        in_link = False
        boxes.append(Box(name, stack[-1] if stack else -1, m.group(4), begin))
        stack.append(len(boxes) - 1)
        if name in BLOCKS:
            n += 1
            number[len(boxes) - 1] = n
    if at < len(source):
        put(source[at:])
    out = []
    for k, parts in text.items():
        got = "".join(parts)
        if "&" in got:
            got = _html.unescape(got)
        if not got.isspace():
            out.append(Block(number[k], boxes[k].tag, got, linked.get(k, 0), paths[k]))
    out.sort(key=lambda b: b.no)
    return out, boxes


_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


def attributes(source: str | None) -> dict[str, str]:
    """A start tag's attributes by name in lower case; of repeated ones the first."""
    out: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(source or ""):
        out.setdefault(name.lower(), _html.unescape(next((v for v in values if v), "")).strip())
    return out


def start_tags(source: str) -> list[tuple[str, dict[str, str]]]:
    """The start tags of a piece of markup with their attributes, in source order, not inside comments or scripts."""
    return [(m.group(3).lower(), attributes(m.group(4))) for m in _TOKEN.finditer(source) if m.group(3) and not m.group(2)]


def squeezed(text: str) -> str:
    return " ".join(text.split())
