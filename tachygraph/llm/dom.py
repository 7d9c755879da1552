"""A page's block structure: elements that hold blocks, and the runs of text between their borders."""

from __future__ import annotations

import re
from html import unescape

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*+\"|'[^']*+'|[^>\"'])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_HINT = re.compile(r"[A-Z]?[a-z]+")
_SPACE = re.compile(r"\s+")

#: Elements without an end tag, whose text is no text, and that stand within a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object select datalist canvas audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var nobr blink".split())
#: An element of the first sort ends an open one of the second.
_CLOSERS = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
_ENDS_P = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol pre section table ul".split())
#: What a reader fills in or presses.
CONTROLS = frozenset("input select textarea button".split())
_SCOPE = frozenset("table td th ul ol dl body html article section div main aside nav form".split())


class Node:
    """An element (``text`` is None) or a run of text. ``parent`` is its index, -1 for the root; ``controls`` counts an element's own inputs."""

    __slots__ = ("attrs", "controls", "linked", "parent", "tag", "text")

    def __init__(self, tag: str, attrs: str, parent: int, text: str | None = None, linked: int = 0):
        self.tag, self.attrs, self.parent, self.text, self.linked, self.controls = tag, attrs, parent, text, linked, 0


def parse(html: str) -> list[Node]:
    """The nodes of a page in page order, each after its parent. Unclosed and misplaced tags are tolerated."""
    nodes = [Node("html", "", -1)]
    stack = [0]
    run: list[str] = []
    linked = 0
    in_link = False
    at = 0

    def flush() -> None:
        nonlocal linked, in_link
        if run:
            text = _SPACE.sub(" ", unescape("".join(run))).strip()
            if text:
                nodes.append(Node("#text", "", stack[-1], text, linked))
            run.clear()
        linked = 0

    def close(until: int) -> None:
        del stack[until:]

    last = html.rfind(">")
    while True:
        m = _TOKEN.search(html, at) if at <= last else None
        piece = html[at : m.start()] if m else html[at:].split("<!--", 1)[0]
        if piece:
            run.append(piece)
            if in_link:
                linked += len(piece)
        if m is None:
            break
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag = tag.lower()
        ending = bool(m[1] or m[4])
        if tag in INLINE:
            if tag == "a":
                in_link = not ending
            continue
        if tag in ("br", "wbr", "img"):
            if tag == "br":
                run.append(" ")
            continue
        if not ending and tag in CONTROLS:
            nodes[stack[-1]].controls += 1
        if not ending and tag in RAW:
            if m[0][-2:] != "/>" or tag in ("script", "style", "title", "textarea"):
                end = re.compile(f"</{re.escape(tag)}\\s*>", re.I).search(html, at)
                at = end.end() if end else len(html)
            if tag not in ("select", "textarea", "datalist"):
                run.append(" ")
            continue
        if tag in RAW:
            continue
        flush()
        if tag in VOID:
            continue
        if ending:
            for k in range(len(stack) - 1, 0, -1):
                if nodes[stack[k]].tag == tag:
                    close(k)
                    break
                if tag in ("p", "li", "dt", "dd") and nodes[stack[k]].tag in _SCOPE:
                    break
            in_link = False
            continue
        ended = _CLOSERS.get(tag) or ({"p"} if tag in _ENDS_P else ())
        while len(stack) > 1 and nodes[stack[-1]].tag in ended:
            close(len(stack) - 1)
        in_link = False
        if tag == "html":
            continue
        nodes.append(Node(tag, m[3] or m[6] or "", stack[-1]))
        stack.append(len(nodes) - 1)
    flush()
    return nodes


def hints(attrs: str) -> tuple[set[str], bool]:
    """The lower-case words of class, id, role and the like, and whether the element is hidden."""
    words: set[str] = set()
    hidden = False
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role", "itemprop", "aria-label", "data-role"):
            words.update(w.lower() for w in _HINT.findall(value))
            words.update(re.split(r"[^a-z0-9]+", value.lower()))
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            hidden = True
    words.discard("")
    return words, hidden
