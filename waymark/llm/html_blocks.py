"""Text blocks of an HTML page with their tag paths, from whatever markup there is, in time linear in its length."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from dataclasses import dataclass, field
from html import unescape

#: A tag without odd quotes; no part of it reaches beyond the next "<".
_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>"'=]++|=\s*+"[^"<]*+"|=\s*+'[^'<]*+'|=(?!\s*["']))*+)>""")
_NAME_ONLY = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)")
_STEP = re.compile(r""">|=\s*(["'])""")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|aria-label|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

#: Elements whose content up to the end tag is no text of the page: scripts, styles, graphics, form controls, what stands in for scripts and frames.
RAW = frozenset("script style template svg title iframe noscript textarea select datalist".split())
#: Those of them that reach to the end of the page where the end tag is missing.
_TO_END = frozenset("script style template svg".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre "
    "section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What an opening tag ends, up to the nearest element that holds it.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}


@dataclass
class Node:
    """A block element: the one around it, and the tokens of its tag, classes, ids and role."""

    parent: Node | None
    tokens: tuple[str, ...]


@dataclass
class Block:
    text: str
    node: Node | None  # the innermost block element
    linked: int  # characters inside links

    @property
    def path(self) -> tuple[str, ...]:
        """Tokens of all block elements above, outermost first."""
        parts, node = [], self.node
        while node is not None:
            parts.append(node.tokens)
            node = node.parent
        return tuple(t for p in reversed(parts) for t in p)


@dataclass
class _Frame:
    """An open block element and the inline elements open directly in it."""

    tag: str
    node: Node | None
    inline: list[str] = field(default_factory=list)
    count: dict[str, int] = field(default_factory=lambda: defaultdict(int))


def _tokens(tag: str, attributes: str) -> tuple[str, ...]:
    if not attributes or attributes.isspace():
        return (tag,)
    out = [tag]
    for m in _ATTRIBUTE.finditer(attributes):
        value = m[2] or m[3] or m[4] or ""
        out += [w.lower() for w in _NAME.findall(value)] if m[1].lower() != "hidden" else ["hidden"]
    return tuple(out)


class _Scanner:
    """Finds one piece of markup after another; what has no end further on is remembered, so no part is searched twice."""

    def __init__(self, html: str):
        self.html, self.absent = html, set()

    def find(self, what: str, at: int) -> int:
        if what in self.absent:
            return -1
        k = self.html.find(what, at)
        if k < 0:
            self.absent.add(what)
        return k

    def tag(self, at: int) -> tuple[bool, str, str, int] | None:
        """(whether it ends, name, attributes, place behind it) of the tag at `at`; None for text. An open tag reaches to the end."""
        m = _TAG.match(self.html, at)
        if m:
            return bool(m[1]), m[2].lower(), m[3], m.end()
        m = _NAME_ONLY.match(self.html, at)
        if not m:
            return None
        k = m.end()
        while step := _STEP.search(self.html, k):
            if not step[1]:
                return bool(m[1]), m[2].lower(), self.html[m.end() : step.start()], step.end()
            close = self.find(step[1], step.end())
            k = step.end() if close < 0 else close + 1
        return bool(m[1]), m[2].lower(), self.html[m.end() :], len(self.html)

    def skip(self, at: int) -> int | None:
        """Place behind the comment, declaration or CDATA section at `at`; None if there is none."""
        for start, end in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<!", ">"), ("<?", ">")):
            if self.html.startswith(start, at):
                k = self.find(end, at + len(start))
                return len(self.html) if k < 0 else k + len(end)
        return None

    def raw_end(self, tag: str, at: int) -> int | None:
        """Place behind the end tag; None if there is none further on."""
        if tag in self.absent:
            return None
        end = re.compile(rf"</{tag}\b", re.I).search(self.html, at)
        if not end:
            self.absent.add(tag)
            return None
        close = self.find(">", end.end())
        return len(self.html) if close < 0 else close + 1


def blocks(html: str) -> list[Block]:
    """Blocks in page order; character references are decoded and white space is one blank. Blocks without text are left out.

    The content of RAW elements is no text; that of all others is, buttons, formulas and what media fall back on included.
    """
    out: list[Block] = []
    frames = [_Frame("", None)]
    places: dict[str, list[int]] = defaultdict(list)  # of the open block elements of each tag, ascending
    parts: list[str] = []
    links: list[str] = []
    linked = 0
    scan = _Scanner(html)

    def flush() -> None:
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                inside = len(" ".join(unescape(" ".join(links)).split())) if links else 0
                out.append(Block(text, frames[-1].node, inside))
            parts.clear(), links.clear()

    def close(k: int) -> None:
        nonlocal linked
        while len(frames) > max(k, 1):
            f = frames.pop()
            places[f.tag].pop()
            linked -= f.count["a"] if f.inline else 0

    def say(piece: str) -> None:
        if piece:
            parts.append(piece)
            if linked:
                links.append(piece)

    at, n = 0, len(html)
    while at < n:
        low = html.find("<", at)
        if low < 0:
            say(html[at:])
            break
        say(html[at:low])
        at = low
        if (found := scan.tag(at)) is None:
            behind = scan.skip(at)
            if behind is None:
                say("<")
            at = at + 1 if behind is None else behind
            continue
        ends, tag, attributes, at = found
        if ends:
            if tag in BLOCKS:
                flush()
                if places[tag]:
                    close(places[tag][-1])
            elif frames[-1].count[tag]:  # an inline end tag does not reach out of its block
                f = frames[-1]
                while True:
                    last = f.inline.pop()
                    f.count[last] -= 1
                    linked -= last == "a"
                    if last == tag:
                        break
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in RAW:
            behind = scan.raw_end(tag, at)
            if behind is not None:
                at = behind
            elif tag in _TO_END:
                break
            continue
        if tag in BLOCKS:
            flush()
            if tag in _ENDS:
                over, within = _ENDS[tag]
                holder = max((places[t][-1] for t in within if places[t]), default=0)
                own = [p[k] for t in over if (k := bisect_right(p := places[t], holder)) < len(p)]
                if own:
                    close(min(own))
            if frames[-1].tag == "p":
                close(len(frames) - 1)
        if tag in VOID or attributes.endswith("/") and tag not in BLOCKS:
            continue
        if tag in BLOCKS:
            places[tag].append(len(frames))
            frames.append(_Frame(tag, Node(frames[-1].node, _tokens(tag, attributes))))
        else:
            frames[-1].inline.append(tag)
            frames[-1].count[tag] += 1
            linked += tag == "a"
    flush()
    return out
