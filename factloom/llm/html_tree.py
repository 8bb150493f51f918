"""A small HTML tree for main-text extraction: block elements and their text runs.

Inline elements do not make nodes; they only leave marks (link text, number of
tags) on the run they stand in.  Every stretch of inline content between block
boundaries becomes a leaf; formulas are inline, without their annotations.  Unclosed and misnested tags, missing end tags and
cut-off pages are handled as browsers do, as far as text is concerned.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr output picture progress q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr".split())
#: Formulas are read as inline content.
INLINE |= frozenset("math menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split())
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp noembed noframes iframe template noscript svg annotation annotation-xml".split())
#: Elements whose text is never page text.
SILENT = frozenset("head script style title textarea noembed noframes iframe template noscript svg select option datalist object audio video canvas map".split())
#: Start tag -> open elements that it ends, up to the nearest of the stops.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, set()),
}
#: Between a tag's name and its end: blanks and slashes, a value after an equals
#: sign (quoted, or up to the next blank), or a name, in which quotes mean nothing.
ATTRIBUTES = r"(?:[\s/]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+)?|[^\s/>=]++)*+"
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<(/?)([A-Za-z][^\s/>]*+)({ATTRIBUTES})(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORDS = re.compile(r"[a-z]+")
HIDDEN = re.compile(r"\shidden(?=[\s=>/]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    depth: int
    tokens: tuple[str, ...] = ()
    hidden: bool = False
    text: str = ""
    link_chars: int = 0
    tags: int = 0
    children: list[int] = field(default_factory=list)


def parse(source: str | None, noscript: bool = False) -> list[Node]:
    """Nodes in document order; the first is the root, text leaves have the tag '#'.

    With ``noscript`` the content of that element is page text, as it is to a
    reader without scripts.
    """
    raw, mute = (RAW - {"noscript"}, SILENT - {"noscript"}) if noscript else (RAW, SILENT)
    nodes = [Node("#root", -1, 0)]
    if not source:
        return nodes
    stack = [0]  # block elements only
    places: dict[str, list[int]] = {}  # of a tag's open elements on the stack
    run: list[str] = []
    links = marks = open_links = silent = 0
    formula = False
    at = 0

    def flush():
        nonlocal links, marks
        if run:
            text = " ".join("".join(run).split())
            run.clear()
            if text:
                top = nodes[stack[-1]]
                top.children.append(len(nodes))
                nodes.append(Node("#", stack[-1], top.depth + 1, text=text, link_chars=min(links, len(text)), tags=marks))
        links = marks = 0

    def close(k: int):
        """Take the k-th and all later open elements off the stack."""
        nonlocal silent
        flush()
        for n in stack[k:]:
            silent -= nodes[n].tag in mute
            places[nodes[n].tag].pop()
        del stack[k:]

    def last(tags) -> int:
        """The topmost place of an open element of any of the tags; 0 if none is."""
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    length = len(source)
    while at < length:
        m = TOKEN.search(source, at)
        stop = m.start() if m else length
        if stop > at and not silent:
            text = source[at:stop]
            if "&" in text:
                text = html.unescape(text)
            run.append(text)
            if open_links:
                links += len(text)
        if not m:
            break
        at = m.end()
        name = m[2]
        if name is None:
            # elsewhere a marked section is a comment up to the next bracket, as any declaration
            if formula and m[0].startswith("<![CDATA["):
                end = source.find("]]>", m.start() + 9)
                if not silent:
                    run.append(source[m.start() + 9 : end if end >= 0 else length])
                at = end + 3 if end >= 0 else length
            continue
        name = name.lower()
        if m[1]:
            if name == "a":
                open_links = max(0, open_links - 1)
            elif name in INLINE:
                formula &= name != "math"
            elif k := last((name,)):
                close(k)
            elif name == "p":
                flush()
            continue
        if name in raw:
            # its content is not markup
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(source, at)
            start, at = at, end.end() if end else length
            if name == "svg" or name.startswith("annotation"):
                continue
            if name == "xmp" and not silent:
                flush()
                run.append(source[start : end.start() if end else length])
            flush() if name not in ("script", "style", "template", "noscript") else None
            continue
        if name in INLINE:
            marks += 1
            if name == "a":
                open_links = 1
            elif name == "math":
                formula = not m[3].endswith("/")
            elif name == "br":
                run.append(" ")
            continue
        # a block element
        flush()
        open_links = 0
        if name not in ("td", "th") and (k := last(("p",))):
            close(k)
        if name in ENDS:
            ended, stops = ENDS[name]
            if (k := last(ended)) > last(stops):
                close(k)
        attributes = m[3]
        tokens: tuple[str, ...] = ()
        if attributes and "=" in attributes:
            tokens = tuple(w for a in ATTRIBUTE.finditer(attributes) for w in WORDS.findall((a[2] or a[3] or a[4] or "").lower()))
        top = nodes[stack[-1]]
        top.tags += 1
        top.children.append(len(nodes))
        nodes.append(Node(name, stack[-1], top.depth + 1, tokens, bool(attributes and HIDDEN.search(attributes))))
        if name not in VOID and not attributes.endswith("/") or name in ("div", "p", "section", "article"):
            places.setdefault(name, []).append(len(stack))
            stack.append(len(nodes) - 1)
            silent += name in mute
    flush()
    return nodes
