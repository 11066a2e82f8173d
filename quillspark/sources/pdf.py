"""Spans of PDF files: runs of text with their font, size and place. A row for each span; a file that cannot be read is one row with its problem.

Read are files whose objects and pages are plain or deflated, object streams too; fonts with one byte a character (code page 1252) or with a table to Unicode. What other filters hold, and encrypted
files, are problems. Widths are not read: a span's right edge is an estimate of half its size a character.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, page int, block int, line int, span int, text string, font string, size double, bold boolean, italic boolean, x0 double, y0 double, x1 double, y1 double, width double, height double, problem string"
_TYPES = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_REF = re.compile(rb"(\d+)\s+\d+\s+R")
_TOKEN = re.compile(rb"\s+|%[^\r\n]*|(?P<hex><[0-9A-Fa-f\s]*>)|(?P<open>\()|(?P<name>/[^\s()<>\[\]{}/%]*)|(?P<number>[+-]?(?:\d+\.?\d*|\.\d+))|(?P<mark>\[|\]|<<|>>|\{|\})|(?P<word>[^\s()<>\[\]{}/%]+)")
_PLAIN, _OCTAL = re.compile(rb"[^\\()]+"), re.compile(rb"[0-7]{1,3}")
_BOLD, _ITALIC = re.compile("(?i)bold|black|heavy"), re.compile("(?i)italic|oblique")
#: Spans that a task hands on at once.
_BATCH = 20_000
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Span(NamedTuple):
    text: str
    font: str
    size: float
    x: float
    y: float


class Document:
    """The objects of a file by number, and its pages."""

    def __init__(self, data: bytes):
        if not data.startswith(b"%PDF"):
            raise ValueError("no PDF")
        if b"/Encrypt" in data:
            raise ValueError("encrypted")
        self.objects = {int(m[1]): m[2] for m in _OBJECT.finditer(data)}
        for body in list(self.objects.values()):
            if re.search(rb"/Type\s*/ObjStm\b", body):
                held = self.stream(body)
                first, n = (int(re.search(rb"/%s\s+(\d+)" % k, body)[1]) for k in (b"First", b"N"))
                head = list(map(int, held[:first].split()))[: 2 * n]
                ends = [*head[3::2], len(held) - first]
                self.objects |= {k: held[first + a : first + b] for k, a, b in zip(head[::2], head[1::2], ends)}

    def stream(self, body: bytes) -> bytes:
        start = re.search(rb"\bstream\r?\n", body)
        if not start:
            return b""
        head, raw = body[: start.start()], body[start.end() :]
        length = re.search(rb"/Length\s+(\d+)(?!\s+\d+\s+R)", head)
        raw = raw[: int(length[1])] if length else raw[: raw.rfind(b"endstream")]
        kinds = re.findall(rb"/(\w+Decode)\b", head)
        if not kinds:
            return raw
        if kinds != [b"FlateDecode"] or re.search(rb"/Predictor\s+(?!1\b)\d", head):
            raise ValueError(f"filter {kinds[-1].decode()}")
        return zlib.decompressobj().decompress(raw)

    def get(self, body: bytes, key: str) -> bytes:
        """What a dictionary has under a key: an object that it refers to, or what stands there."""
        found = re.search(rb"/%s\b\s*(?:(\d+)\s+\d+\s+R|(\[[^\]]*\]|<<.*|/?[^\s/<>\[\]]+))" % key.encode(), body, re.S)
        if not found:
            return b""
        return self.objects.get(int(found[1]), b"") if found[1] else found[2]

    def pages(self) -> Iterator[tuple[bytes, bytes, bytes]]:
        """(page, resources, box) in order; what a page lacks comes from above it."""
        root = next((b for b in self.objects.values() if re.search(rb"/Type\s*/Catalog\b", b)), b"")
        waiting = [(self.get(root, "Pages"), b"", b"")]
        while waiting:
            node, resources, box = waiting.pop()
            resources, box = self.get(node, "Resources") or resources, self.get(node, "MediaBox") or box
            kids = self.get(node, "Kids")
            if kids:
                waiting += [(self.objects.get(int(k), b""), resources, box) for k in _REF.findall(kids)[::-1]]
            elif node:
                yield node, resources, box

    def fonts(self, resources: bytes) -> dict[bytes, tuple[str, dict[int, str] | None, int]]:
        """By name: the base font, its table to Unicode, and the bytes of a code."""
        found = {}
        for name, number in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", self.get(resources, "Font").partition(b">>")[0]):
            body = self.objects.get(int(number), b"")
            base = self.get(body, "BaseFont").lstrip(b"/").decode("latin-1")
            table = self.get(body, "ToUnicode")
            wide = b"/Type0" in body.replace(b" ", b"")
            found[name] = (re.sub(r"^[A-Z]{6}\+", "", base), _unicode_table(self.stream(table)) if table else None, 2 if wide else 1)
        return found

    def contents(self, page: bytes) -> bytes:
        own = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", page)
        return b"\n".join(self.stream(self.objects.get(int(k), b"")) for k in _REF.findall(own[1])) if own else b""


def _unicode_table(body: bytes) -> dict[int, str]:
    said = lambda x: bytes.fromhex(x.decode()).decode("utf-16-be", "replace")
    table = {}
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", body, re.S):
        table |= {int(a, 16): said(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block)}
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", body, re.S):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            start = said(c)
            table |= {int(a, 16) + k: start[:-1] + chr(ord(start[-1]) + k) for k in range(int(b, 16) - int(a, 16) + 1)}
    return table


def _tokens(body: bytes) -> Iterator[tuple[str, bytes]]:
    at = 0
    while at < len(body):
        m = _TOKEN.match(body, at)
        if not m:
            at += 1
            continue
        at = m.end()
        if m.lastgroup == "open":
            out, depth = bytearray(), 1
            while at < len(body) and depth:
                plain = _PLAIN.match(body, at)
                if plain:
                    out += plain[0]
                    at = plain.end()
                    continue
                c = body[at : at + 1]
                at += 1
                if c == b"\\":
                    octal = _OCTAL.match(body, at)
                    if octal:
                        out.append(int(octal[0], 8) & 255)
                        at = octal.end()
                    else:
                        c = body[at : at + 1]
                        out += b"" if c in (b"\r", b"\n") else _ESCAPES.get(c, c)
                        at += 1
                    continue
                depth += (c == b"(") - (c == b")")
                if depth:
                    out += c
            yield "text", bytes(out)
        elif m.lastgroup == "hex":
            digits = re.sub(rb"\s", b"", m[0][1:-1]).decode()
            yield "text", bytes.fromhex(digits + "0" * (len(digits) % 2))
        elif m.lastgroup:
            yield m.lastgroup, m[0]


def page_spans(body: bytes, fonts: dict) -> list[Span]:
    """The texts that a page's contents show, in their order, with the place of their baseline."""
    found: list[Span] = []
    stack: list = []
    font, size, leading = ("", None, 1), 0.0, 0.0
    line = at = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)

    def show(raw: bytes) -> None:
        nonlocal at
        name, table, step = font
        text = raw.decode("cp1252", "replace") if table is None else "".join(table.get(int.from_bytes(raw[k : k + step], "big"), "") for k in range(0, len(raw), step))
        scale = (at[1] ** 2 + at[3] ** 2) ** 0.5 or 1.0
        if text:
            found.append(Span(text, name, size * scale, at[4], at[5]))
            at = (*at[:4], at[4] + at[0] * size * len(text) / 2, at[5] + at[1] * size * len(text) / 2)

    def move(x: float, y: float) -> None:
        nonlocal line, at
        line = at = (*line[:4], line[4] + x * line[0] + y * line[2], line[5] + x * line[1] + y * line[3])

    for kind, token in _tokens(body):
        if kind in ("text", "name"):
            stack.append((kind, token))
        elif kind == "number":
            stack.append((kind, float(token)))
        elif kind == "word":
            numbers = [v for k, v in stack if k == "number"]
            texts = [v for k, v in stack if k == "text"]
            if token == b"BT":
                line = at = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
            elif token == b"Tf" and numbers:
                size = numbers[-1]
                font = next((fonts.get(v[1:], (v[1:].decode("latin-1"), None, 1)) for k, v in stack if k == "name"), font)
            elif token == b"TL" and numbers:
                leading = numbers[-1]
            elif token in (b"Td", b"TD") and len(numbers) >= 2:
                leading = -numbers[-1] if token == b"TD" else leading
                move(numbers[-2], numbers[-1])
            elif token == b"Tm" and len(numbers) >= 6:
                line = at = tuple(numbers[-6:])
            elif token in (b"T*", b"'", b'"'):
                move(0, -leading)
            if token in (b"Tj", b"'", b'"') and texts:
                show(texts[-1])
            elif token == b"TJ":
                # A wide step back between parts is a space.
                parts = []
                for k, v in stack:
                    parts += [v] if k == "text" else [b" "] if k == "number" and v < -200 and parts and font[2] == 1 else []
                show(b"".join(parts))
            stack = []
    return found


def spans(data: bytes) -> list[tuple]:
    """(page, block, line, span, text, font, size, bold, italic, x0, y0, x1, y1, width, height) of a file; places from the page's upper left corner. Spans of one baseline are a line;
    lines of one size that follow each other closely are a block."""
    doc, rows, fonts = Document(data), [], {}
    for number, (page, resources, box) in enumerate(doc.pages(), 1):
        edges = [float(x) for x in re.findall(rb"-?[\d.]+", box)[:4]] or [0.0, 0.0, 612.0, 792.0]
        width, height = edges[2] - edges[0], edges[3] - edges[1]
        block = line = span = 0
        last: Span | None = None
        if resources not in fonts:
            fonts[resources] = doc.fonts(resources)
        for s in page_spans(doc.contents(page), fonts[resources]):
            if last is None:
                pass
            elif abs(s.y - last.y) < 0.2 * s.size:
                span += 1
            else:
                gap = last.y - s.y
                line, span = line + 1, 0
                block += not (0 < gap <= 1.4 * max(s.size, last.size) and abs(s.size - last.size) < 0.6)
            last = s
            top = edges[3] - s.y - s.size
            bold, italic = bool(_BOLD.search(s.font)), bool(_ITALIC.search(s.font))
            rows.append((number, block, line, span, s.text, s.font, s.size, bold, italic, s.x - edges[0], top, s.x - edges[0] + s.size * len(s.text) / 2, top + s.size, width, height))
    return rows


def file_spans(files: DataFrame) -> DataFrame:
    """The spans of ``files`` (path, content), as ``SCHEMA`` has them."""

    kind = pa.schema([(c, _TYPES[t]) for c, t in (f.split() for f in SCHEMA.split(", "))])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(values, t) for values, t in zip(zip(*rows), kind.types)], schema=kind)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content")):
                try:
                    rows += [(path, *r, None) for r in spans(bytes(data.as_py()))]
                except Exception as problem:  # noqa: BLE001  any broken file is a row, not the end of the job
                    rows.append((path, *[None] * 15, f"{type(problem).__name__}: {problem}"))
                if len(rows) >= _BATCH:
                    yield table(rows)
                    rows = []
            if rows:
                yield table(rows)

    return files.select("path", "content").mapInArrow(read, SCHEMA)


def read_spans(spark: SparkSession, path: str) -> DataFrame:
    """The spans of all PDF files under ``path``."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[pP][dD][fF]").load(path)
    return file_spans(found)


def written(pages: list[list[tuple[str, float, str]]], size: tuple[float, float] = (612, 792), leading: float = 1.2) -> bytes:
    """A PDF of pages of lines (text, size, font: a standard one). A line stands ``leading`` sizes below the one before; an empty one leaves a gap."""
    names = list(dict.fromkeys(f for p in pages for _, _, f in p)) or ["Helvetica"]
    bodies = ["<< /Type /Catalog /Pages 2 0 R >>".encode(), b""]
    bodies += [f"<< /Type /Font /Subtype /Type1 /BaseFont /{n} /Encoding /WinAnsiEncoding >>".encode() for n in names]
    fonts = " ".join(f"/F{k} {k + 3} 0 R" for k in range(len(names)))
    kids = []
    for page in pages:
        y, out = size[1] - 40.0, [b"BT"]
        for text, own, font in page:
            y -= own * leading
            raw = re.sub(rb"([\\()])", rb"\\\1", text.encode("cp1252", "replace")).replace(b"\r", b"\\r").replace(b"\n", b"\\n")
            out.append(b"/F%d %g Tf 1 0 0 1 40 %g Tm (%s) Tj" % (names.index(font), own, y, raw))
        body = zlib.compress(b"\n".join([*out, b"ET"]))
        bodies.append(b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(body), body))
        kids.append(len(bodies) + 1)
        bodies.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {size[0]:g} {size[1]:g}] /Resources << /Font << {fonts} >> >> /Contents {len(bodies)} 0 R >>".encode())
    bodies[1] = f"<< /Type /Pages /Kids [{' '.join(f'{k} 0 R' for k in kids)}] /Count {len(kids)} >>".encode()
    data, places = bytearray(b"%PDF-1.4\n"), []
    for k, body in enumerate(bodies, 1):
        places.append(len(data))
        data += b"%d 0 obj\n%s\nendobj\n" % (k, body)
    start = len(data)
    data += b"xref\n0 %d\n0000000000 65535 f \n" % (len(bodies) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(data + b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(bodies) + 1, start))
