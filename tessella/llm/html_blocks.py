"""HTML as a sequence of leaf blocks: text between block boundaries, with the path of open elements and its linked share."""

from __future__ import annotations

import html
import re
from typing import NamedTuple

#: Elements that do not end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements without content, and elements whose content is no text of the page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template textarea title noframes noscript iframe svg math object".split())
#: What a start tag closes, where it is open: siblings that end without an end tag.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that such a closing does not look beyond.
BOUNDS = frozenset("ul ol dl table body article section div main".split())

#: Open elements, from the innermost out, that a block's path names.
LEVELS = 64

NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD = re.compile(r"[a-z]+")


class Block(NamedTuple):
    path: tuple[str, ...]
    text: str
    linked: float


class Tags:
    """The tags of a page in one pass, with no way back: what has been looked for in vain is not looked for again."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.quotes = {q: page.rfind(q) for q in "\"'"}

    def end(self, at: int) -> int:
        """The place of the > that ends a tag: the first outside quotes, or where these don't match, the first; or -1."""
        page, place = self.page, at
        while place <= self.last:
            m = STOP.search(page, place)
            if m is None:
                break
            if m[0] == ">":
                return m.start()
            if m.start() >= self.quotes[m[0]]:  # opens nothing
                place = m.end()
            else:
                place = page.find(m[0], m.end()) + 1
        self.quotes = dict.fromkeys(self.quotes, -1)  # quotes that run on to the end are none
        return page.find(">", at)

    def next(self, at: int) -> tuple[int, int, str, str]:
        """(start, end, name, attributes) of the next tag from a place on; / before the name ends an element, and comments and
        declarations have none. Without another tag, start and end lie at the page's end."""
        page = self.page
        while True:
            start = page.find("<", at)
            if start < 0:
                break
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, len(page) if end < 0 else end + 3, "", ""
            if start > self.last:
                at = page.find("<!--", start)  # the only kind that needs no >
                if at < 0:
                    break
                continue
            if page.startswith(("<!", "<?"), start):
                return start, page.find(">", start) + 1, "", ""
            m = NAME.match(page, start)
            end = self.end(m.end()) if m else -1
            if m and end >= 0:
                return start, end + 1, page[start + 1 : m.end()].lower(), page[m.end() : end]
            at = start + 1
        return len(page), len(page), "", ""


STOP = re.compile(r"[>\"']")


class Open:
    """The open elements; where each kind of them is open is known without looking through them."""

    def __init__(self):
        self.stack: list[str] = []
        self.names: list[str] = []
        self.places: dict[str, list[int]] = {}

    def top(self, tags) -> int:
        """The innermost place at which one of these elements is open, or -1."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=-1)

    def push(self, tag: str, name: str) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append(tag), self.names.append(name)

    def cut(self, place: int) -> None:
        while len(self.stack) > place:
            self.places[self.stack.pop()].pop()
            self.names.pop()


def blocks(page: str | None) -> list[Block]:
    """Non-empty leaf blocks in page order; unclosed, stray and repeated tags are tolerated, nothing is cut off. The time grows
    with the page's length, whatever its tags."""
    page = page or ""
    out: list[Block] = []
    opened, tags = Open(), Tags(page)
    held: list[str] = []
    links, depth, at = 0, 0, 0

    def flush() -> None:
        nonlocal links
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                out.append(Block(tuple(opened.names[-LEVELS:]), text, min(1.0, links / len(text))))
            held.clear()
        links = 0

    while at < len(page):
        start, end, tag, rest = tags.next(at)
        if start > at:
            held.append(page[at:start])
            if depth:
                links += start - at
        at = end
        if not tag:
            continue
        closing, tag = tag[0] == "/", tag.lstrip("/")
        if tag in INLINE:
            if tag == "a":
                depth = max(0, depth - 1) if closing else 1
            elif tag == "br":
                held.append(" ")
            continue
        if closing:
            flush()
            if (place := opened.top((tag,))) >= 0:
                opened.cut(place)
            continue
        if tag in RAW:
            found = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = found.end() if found else len(page)
            continue
        flush()
        if opened.stack and opened.stack[-1] == "p":
            opened.cut(len(opened.stack) - 1)
        if (place := opened.top(CLOSES.get(tag, ()))) > opened.top(BOUNDS):
            opened.cut(place)
        if tag not in VOID and not rest.endswith("/"):
            found = [w for n in NAMES.finditer(rest) for w in WORD.findall((n[1] or n[2] or n[3] or "").lower())] if rest else []
            opened.push(tag, " ".join([tag, *found]))
    flush()
    return out
