"""What a reader sees of HTML and XML, with the source bytes behind it."""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from dataclasses import dataclass, field
from html.parser import HTMLParser
from xml.parsers import expat

from ..errors import Refused

#: Elements by their part in a page, and headings by level.
SUPPRESSED = frozenset({"head", "noscript", "script", "style", "template"})
UNSEEN = SUPPRESSED - {"head"}
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"})
HTML_HEADINGS = {f"h{i}": i for i in range(1, 7)}
XML_HEADINGS = {"SUBJECT": 1, "HD:HED": 2, "HD:HD1": 3, "HD:HD2": 4, "HD:HD3": 5, "HD": 3}
DEEPEST = 6


@dataclass
class Element:
    """An element's own texts ``(text, start, end)`` and children, in document order."""

    tag: str
    key: str = ""
    parts: list = field(default_factory=list)

    def owns_text(self) -> bool:
        return any(isinstance(p, tuple) and p[0].strip() for p in self.parts)

    def texts(self):
        for p in self.parts:
            if isinstance(p, tuple):
                yield p
            else:
                yield from p.texts()

    def outermost_owners(self):
        """Text-owning elements none of whose ancestors owns text."""
        todo = [self]
        while todo:
            e = todo.pop()
            if e.owns_text():
                yield e
            else:
                todo += [p for p in reversed(e.parts) if isinstance(p, Element)]


class _Html(HTMLParser):
    def __init__(self, text: str):
        super().__init__(convert_charrefs=False)
        self.lines = [0]
        for m in re.finditer("\n", text):
            self.lines.append(m.end())
        self.root = Element("#document")
        self.open = [self.root]
        self.hidden = self.elements = self.visible = 0
        self.unseen: list[str] = []
        self.pieces: list[tuple[str, int, int]] = []

    def _at(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_starttag(self, tag, attrs):
        self.elements += 1
        if tag in UNSEEN:
            self.unseen.append(tag)
        if tag in VOID:
            return
        if tag in SUPPRESSED:
            self.hidden += 1
            return
        e = Element(tag)
        if not self.hidden:
            self.open[-1].parts.append(e)
        self.open.append(e)

    def handle_endtag(self, tag):
        if tag in self.unseen:
            while self.unseen.pop() != tag:
                pass
        if tag in VOID:
            return
        if tag in SUPPRESSED:
            self.hidden = max(0, self.hidden - 1)
            return
        depth = max((i for i, e in enumerate(self.open) if i and e.tag == tag), default=0)
        if depth:
            del self.open[depth:]

    def _piece(self, text: str, length: int) -> None:
        at = self._at()
        if not self.unseen:
            self.visible += len(text)
        if not self.hidden:
            self.open[-1].parts.append((text, at, at + length))

    def handle_data(self, data):
        self._piece(data, len(data))

    def handle_entityref(self, name):
        self._piece(html.unescape(f"&{name};"), len(name) + 2)

    def handle_charref(self, name):
        self._piece(html.unescape(f"&#{name};"), len(name) + 3)


def read_html(text: str) -> tuple[Element, int, int]:
    """(tree, elements, characters outside script, style, template and noscript)."""
    p = _Html(text)
    p.feed(text)
    p.close()
    return p.root, p.elements, p.visible


def read_xml(data: bytes) -> tuple[Element, int]:
    """(tree, elements); refuses what does not parse."""
    parser = expat.ParserCreate()
    parser.buffer_text = False
    root = Element("#document")
    open_, count = [root], 0

    def start(tag, attributes):
        nonlocal count
        count += 1
        source = attributes.get("SOURCE")
        e = Element(tag, f"{tag}:{source}" if source else tag)
        open_[-1].parts.append(e)
        open_.append(e)

    def text(piece):
        at = parser.CurrentByteIndex
        open_[-1].parts.append((piece, at, at + len(piece.encode())))

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, lambda _: open_.pop(), text
    try:
        parser.Parse(data, True)
    except expat.ExpatError as error:
        raise Refused(f"XML cannot be parsed: {error}") from error
    return root, count


@dataclass
class Visible:
    """Visible text as UTF-8, its blocks ``(kind, level, start, end)`` and its runs
    ``(start, end, source start, source end)``, all in bytes."""

    text: str
    blocks: list[tuple[str, int | None, int, int]]
    runs: list[tuple[int, int, int, int]]

    def source_range(self, start: int, end: int) -> tuple[int, int] | None:
        """Least source range behind an interval of the text.  A run copied byte for byte
        is cut to the interval; any other counts whole."""
        found = []
        for a, b, x, y in self.runs:
            lo, hi = max(a, start), min(b, end)
            if lo < hi:
                found.append((x + lo - a, x + hi - a) if b - a == y - x else (x, y))
        return (min(f[0] for f in found), max(f[1] for f in found)) if found else None


def _squeezed(pieces):
    """Texts with white space collapsed across pieces; a joining space is (" ", None, None)."""
    out, gap = [], False
    for text, start, end in pieces:
        flat = re.sub(r"\s+", " ", text)
        core = flat.strip(" ")
        if core:
            if out and (gap or flat[0] == " "):
                out.append((" ", None, None))
            out.append((core, start, end))
            gap = flat[-1] == " "
        elif out and flat:
            gap = True
    return out


def lay_out(root: Element, headings: dict[str, int], *, squeeze: bool) -> Visible:
    """Blocks of outermost text owners, a blank line between; headings get their marks."""
    parts: list[str] = []
    size, blocks, runs = 0, [], []

    def put(text: str, start=None, end=None) -> None:
        nonlocal size
        n = len(text.encode())
        if start is not None:
            runs.append((size, size + n, start, end))
        parts.append(text)
        size += n

    for e in root.outermost_owners():
        level = headings.get(e.key, headings.get(e.tag))
        pieces = list(e.texts())
        pieces = _squeezed(pieces) if squeeze or level is not None else pieces
        if blocks:
            put("\n\n")
        begin = size
        if level is not None:
            put("#" * min(level, DEEPEST) + " ")
        for p in pieces:
            put(*p)
        blocks.append(("paragraph" if level is None else "heading", level, begin, size))
    return Visible("".join(parts), blocks, runs)


def _bytes_of(text: str) -> list[int]:
    out, at = [0], 0
    for c in text:
        at += len(c.encode())
        out.append(at)
    return out


def visible_html(text: str) -> Visible:
    seen = lay_out(read_html(text)[0], HTML_HEADINGS, squeeze=False)
    if not text.isascii():
        at = _bytes_of(text)
        seen.runs = [(a, b, at[x], at[y]) for a, b, x, y in seen.runs]
    return seen


def visible_xml(data: bytes) -> Visible:
    return lay_out(read_xml(data)[0], XML_HEADINGS, squeeze=True)


def block_at(seen: Visible, place: int) -> int:
    """Index of the block that a byte of the visible text lies in."""
    return bisect_right([b[2] for b in seen.blocks], place) - 1
