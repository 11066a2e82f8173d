"""FictionBook files: a repair by edits at places of the file's own text, and the text of its sections."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from xml.parsers import expat

_NO_TEXT = re.compile(r"<!--.*?-->|<\?.*?\?>", re.S)
_TAG = re.compile(rb"<(?:[^>\"']|\"[^\"]*\"|'[^']*')*>")
_ENCODING = re.compile(r"""(<\?xml\b[^>]*?)\s+encoding\s*=\s*["'][^"']*["']""")


@dataclass
class Element:
    """Where an element is: its tags' places, and its children. Of an empty tag, both tags are the same."""

    tag: str
    start: int
    opened: int = 0
    closing: int = 0
    end: int = 0
    children: list[Element] = field(default_factory=list)

    @property
    def name(self) -> str:
        return self.tag.rpartition(":")[2]

    @property
    def prefix(self) -> str:
        return self.tag[: len(self.tag) - len(self.name)]


def decoded(data: bytes) -> str:
    """A file's text by its byte order mark or declared encoding (UTF-8 if there is none that is known); the declaration then names none."""
    for mark, encoding in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return _ENCODING.sub(r"\1", data.decode(encoding, "replace"), count=1)
    named = re.match(rb"""\s*<\?xml\b[^>]*?encoding\s*=\s*["']([\w.-]+)["']""", data)
    try:
        text = data.decode(named[1].decode() if named else "utf-8", "replace")
    except LookupError:
        text = data.decode("utf-8", "replace")
    return _ENCODING.sub(r"\1", text, count=1)


def parsed(data: bytes) -> Element:
    """The file's elements under one that stands for the whole. Raises ``expat.ExpatError`` if it is not well-formed."""
    parser = expat.ParserCreate("utf-8")
    top = Element("", 0, 0, len(data), len(data))
    stack = [top]

    def start(tag: str, _: dict) -> None:
        at = parser.CurrentByteIndex
        own = Element(tag, at, _TAG.match(data, at).end())
        stack[-1].children.append(own)
        stack.append(own)

    def end(_: str) -> None:
        own, at = stack.pop(), parser.CurrentByteIndex
        empty = data.endswith(b"/>", own.start, own.opened)
        own.closing = own.opened if empty else at
        own.end = own.opened if empty else data.index(b">", at) + 1

    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.Parse(data, True)
    return top


def _every(node: Element, name: str) -> list[Element]:
    """The elements of a name under a node, in order."""
    found, waiting = [], [node]
    while waiting:
        own = waiting.pop()
        if own.name == name:
            found.append(own)
        waiting += own.children[::-1]
    return found


def _loose(data: bytes, node: Element) -> list[tuple[int, int]]:
    """The text right under a node, as places without the space around."""
    edges = [node.opened, *(x for c in node.children for x in (c.start, c.end)), node.closing]
    found = []
    for a, b in zip(edges[::2], edges[1::2]):
        raw = data[a:b]
        if html.unescape(_NO_TEXT.sub("", raw.decode())).strip():
            found.append((a + len(raw) - len(raw.lstrip()), a + len(raw.rstrip())))
    return found


def repaired(text: str) -> tuple[str, int]:
    """A FictionBook whose loose text is in paragraphs and whose bodies hold sections only (but for a title, epigraph or image before the first): what
    stands outside goes into the section before it, or opens one. With the number of characters of the bodies, -1 if it is not well-formed. All else, namespaces
    too, stays as it was, letter by letter; a second run changes nothing."""
    data = text.encode("utf-8", "surrogatepass")
    try:
        top = parsed(data)
    except expat.ExpatError:
        return text, -1
    edits: list[tuple[int, int, int, bytes]] = []  # place, order at one place, bytes that go, what comes

    def put(at: int, rank: int, what: str, gone: int = 0) -> None:
        edits.append((at, rank, gone, what.encode()))

    for body in _every(top, "body"):
        p = f"{body.prefix}p"
        for node in [*_every(body, "section"), body]:
            for a, b in _loose(data, node):
                put(a, 2, f"<{p}>")
                put(b, 0, f"</{p}>")
        items = sorted([(c.start, c.end, c) for c in body.children] + [(a, b, None) for a, b in _loose(data, body)], key=lambda x: x[0])
        open_since, last_end, section = False, 0, f"{body.prefix}section"
        for a, b, own in items:
            if own is not None and own.name == "section":
                if open_since:
                    put(last_end, 1, f"</{section}>")
                open_since, previous = False, own
                last_end = b
                continue
            front = own is not None and own.name in ("title", "epigraph", "image")
            if not open_since and (last_end or not front):
                if last_end:  # the section before takes what follows: its end moves behind it
                    if previous.closing == previous.end:
                        put(previous.end - 2, 0, ">", 2)
                    else:
                        put(previous.closing, 0, "", previous.end - previous.closing)
                else:
                    put(a, 1, f"<{section}>")
                open_since = True
            last_end = b if open_since else last_end
        if open_since:
            put(last_end, 1, f"</{section}>")
    out, at = [], 0
    for place, _, gone, what in sorted(edits, key=lambda e: e[:2]):
        out += [data[at:place], what]
        at = place + gone
    done = b"".join([*out, data[at:]]).decode("utf-8", "surrogatepass")
    return done, sum(len(t) for b in _texts(done, "body") for t in b)


def _texts(text: str, name: str) -> list[list[str]]:
    """The character data of each outermost element of a name, but the space between blocks (right under bodies and sections)."""
    parser, open_tags, found = expat.ParserCreate("utf-8"), [], []

    def start(tag: str, _: dict) -> None:
        own = tag.rpartition(":")[2]
        if open_tags or own == name:
            if not open_tags:
                found.append([])
            open_tags.append(own)

    def end(_: str) -> None:
        if open_tags:
            open_tags.pop()

    def take(data: str) -> None:
        if open_tags and open_tags[-1] not in ("body", "section"):
            found[-1].append(data)

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, take
    parser.Parse(text.encode("utf-8", "surrogatepass"), True)
    return found


def sections(text: str) -> list[str]:
    """The text of a FictionBook's bodies, a part for each stretch between borders of sections, in reading order; so an inner section is a part, and what
    follows it another. Blocks are divided by line ends. Raises ``ValueError`` if the file is not well-formed."""
    done, chars = repaired(text)
    if chars < 0:
        raise ValueError("not well-formed")
    parser, inside, parts = expat.ParserCreate("utf-8"), 0, [""]
    blocks = ("p", "v", "subtitle", "text-author", "title", "stanza", "cite", "poem", "epigraph", "empty-line", "td", "th", "tr")

    def border(tag: str) -> None:
        name = tag.rpartition(":")[2]
        if name in ("section", "body"):
            parts.append("")
        elif name in blocks and parts[-1] and not parts[-1].endswith("\n"):
            parts[-1] += "\n"

    def start(tag: str, _: dict) -> None:
        nonlocal inside
        inside += tag.rpartition(":")[2] == "body" or inside > 0
        border(tag)

    def end(tag: str) -> None:
        nonlocal inside
        border(tag)
        inside -= inside > 0

    def take(data: str) -> None:
        if inside:
            parts[-1] += data

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, take
    parser.buffer_text = True
    parser.Parse(done.encode("utf-8", "surrogatepass"), True)
    return [p.strip() for p in parts if p.strip()]
