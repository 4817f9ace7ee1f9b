"""From HTML source to the sequence of leaf blocks of a page, for use inside tasks.

Defined results: an unknown or unclosed tag loses no text; a script or style
without an end tag and a comment without an end hold the rest of the page; a tag
that the source ends in is dropped, as browsers do.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable
from dataclasses import dataclass

#: A tag's name; ``<`` before anything else is text.
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: One attribute, as browsers read it: quotes count after an equals sign only. Possessive, so that no input is read twice.
_ATTRIBUTE = re.compile(r"[\s/]*+(=?[^\s/>=]++)?+(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+")
_MARKS = frozenset(("class", "id", "role"))
_PARTS = re.compile(r"[a-z]+")
#: Their content is no markup and no text of the page; it ends at the end tag alone.
RAW = frozenset("script style iframe noembed noframes title".split())
#: Their content is markup but no text of the page.
HIDDEN = frozenset("noscript template svg math".split())
#: What ends a drawing or formula that was left open.
BREAKOUT = frozenset(
    "article aside blockquote body center dd div dl dt figure footer form h1 h2 h3 h4 h5 h6 head header hr li main nav ol p pre section table ul".split()
)
#: Ancestors that a block's path names, at most: features of the labeller, text is never cut by it.
PATH = 64
#: Tags that run inside a line of text; all others begin and end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Tags without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What a new block ends if it stands open: a paragraph, a list item and so on.
CLOSES = {"p": "p", "li": "li", "dt": "dd", "dd": "dd", "option": "option", "tr": "tr", "td": "td", "th": "td"}


@dataclass
class Leaf:
    path: tuple[str, ...]
    text: str
    linked: int


class _Reader:
    """One pass over a page's source; what was looked for once is found again without a search, so the time is linear."""

    def __init__(self, source: str):
        self.source = source
        #: What was looked for: from where on, and where it is (-1 for nowhere).
        self.known: dict[str, tuple[int, int]] = {}

    def _next(self, what: str, begin: int, search: Callable[[int], int]) -> int:
        since, at = self.known.get(what, (len(self.source) + 1, -1))
        if since <= begin and (at < 0 or begin <= at):
            return at
        at = search(begin)
        self.known[what] = begin, at
        return at

    def find(self, what: str, begin: int) -> int:
        """Position of ``what`` from ``begin`` on, -1 if there is none."""
        return self._next(what, begin, lambda k: self.source.find(what, k))

    def end_tag(self, tag: str, begin: int) -> int:
        """Where the end tag of ``tag`` begins, -1 if there is none."""
        ends = re.compile(rf"</{tag}(?=[\s/>])", re.I)
        return self._next(f"</{tag}", begin, lambda k: m.start() if (m := ends.search(self.source, k)) else -1)

    def comment_end(self, begin: int) -> int:
        """Behind the comment that begins here, -1 if it never ends. ``<!-->`` and ``<!--->`` are whole comments."""
        ends = [(at, at + len(mark)) for mark, at in (("-->", self.find("-->", begin + 2)), ("--!>", self.find("--!>", begin + 4))) if at >= 0]
        return min(ends)[1] if ends else -1

    def attributes(self, at: int) -> tuple[int, bool, list[str]]:
        """From behind a tag's name: the position behind the tag (-1 if it never ends), whether it closes itself, and the
        values of class, id and role."""
        source, marks = self.source, []
        while True:
            m = _ATTRIBUTE.match(source, at)
            if m[1] and m[1].lower() in _MARKS:
                marks.append(m[2] or m[3] or m[4] or "")
            end = m.end()
            if end >= len(source):
                return -1, False, marks
            if source[end] == ">":
                return end + 1, source[end - 1] == "/" and m[4] is None, marks
            at = max(end, at + 1) if end > at else at + 1


def _names(tag: str, marks: list[str]) -> tuple[str, ...]:
    """What a tag adds to the path: its name, and the words of its class, id and role."""
    return (f"<{tag}", *[f".{part}" for value in marks for part in _PARTS.findall(html.unescape(value).lower())[:PATH]])


def leaves(source: str) -> list[Leaf]:
    """Blocks of visible text in page order, white space joined, with the path of open tags above each."""
    reader, out = _Reader(source), []
    # tag, names, place of the nearest open block at or below this entry
    stack: list[tuple[str, tuple[str, ...], int]] = []
    opened: dict[str, int] = {}
    pieces: list[str] = []
    linked = hidden = 0

    def text_of(piece: str) -> None:
        nonlocal linked
        if piece and not hidden:
            pieces.append(piece)
            if opened.get("a"):
                linked += len(piece)

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                path, at = [], stack[-1][2] if stack else -1
                while at >= 0 and len(path) < PATH:
                    path.append(stack[at][1])
                    at = stack[at - 1][2] if at else -1
                out.append(Leaf(tuple(dict.fromkeys(name for names in reversed(path) for name in names)), text, min(linked, len(text))))
            pieces.clear()
        linked = 0

    def push(tag: str, marks: list[str]) -> None:
        nonlocal hidden
        nearest = len(stack) if tag not in INLINE else stack[-1][2] if stack else -1
        stack.append((tag, _names(tag, marks) if tag not in INLINE else (), nearest))
        opened[tag] = opened.get(tag, 0) + 1
        hidden += tag in HIDDEN

    def pop_to(depth: int) -> None:
        nonlocal hidden
        while len(stack) > depth:
            tag = stack.pop()[0]
            opened[tag] -= 1
            hidden -= tag in HIDDEN

    def close(tag: str) -> None:
        """An end tag ends the nearest open one of its name; an inline one only if it is near."""
        if not opened.get(tag):
            return
        for depth in range(len(stack) - 1, max(-1, len(stack) - 5) if tag in INLINE else -1, -1):
            if stack[depth][0] == tag:
                pop_to(depth)
                return

    at = 0
    while at < len(source):
        begin = source.find("<", at)
        if begin < 0:
            text_of(source[at:])
            break
        text_of(source[at:begin])
        if source.startswith("<!--", begin):
            end = reader.comment_end(begin)
            at = len(source) if end < 0 else end
            continue
        ends = source.startswith("</", begin)
        name = _NAME.match(source, begin + 1 + ends)
        if name is None:
            if ends or source.startswith(("<!", "<?"), begin):
                end = reader.find(">", begin + 2)
                at = len(source) if end < 0 else end + 1
            else:
                text_of("<")
                at = begin + 1
            continue
        tag = name[0].lower()
        at, itself, marks = reader.attributes(name.end())
        if at < 0:  # the source ends within a tag
            break
        if tag not in INLINE:
            flush()
        if ends:
            close(tag)
            continue
        if tag in RAW:
            end = reader.end_tag(tag, at)
            if end >= 0:
                at = end
            elif tag in ("script", "style"):
                break
            continue
        if tag in BREAKOUT:
            for drawing in ("svg", "math"):
                while opened.get(drawing):
                    close(drawing)
        if tag in VOID or (itself and tag not in INLINE):
            continue
        if tag in HIDDEN and reader.end_tag(tag, at) < 0:
            continue  # never ended: what follows is text of the page
        if tag in CLOSES and stack and stack[-1][2] >= 0 and CLOSES.get(stack[stack[-1][2]][0]) == CLOSES[tag]:
            pop_to(stack[-1][2])
        push(tag, marks)
    flush()
    return out
