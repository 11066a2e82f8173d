"""EPUB archives: chapters in the order that the package's spine declares, else by name."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from xml.etree import ElementTree


def pack(chapters: list[str]) -> bytes:
    """A small archive of chapters, whose spine runs against the names' order."""
    out = io.BytesIO()
    names = [f"c{len(chapters) - k:04d}.xhtml" for k in range(len(chapters))]
    with zipfile.ZipFile(out, "w") as z:
        items = "".join(f'<item id="i{k}" href="{n}" media-type="application/xhtml+xml"/>' for k, n in enumerate(names))
        spine = "".join(f'<itemref idref="i{k}"/>' for k in range(len(names)))
        z.writestr("OPS/book.opf", f"<package><manifest>{items}</manifest><spine>{spine}</spine></package>")
        for name, text in zip(names, chapters):
            z.writestr(f"OPS/{name}", f"<p>{re.sub('[<>&]', ' ', text)}</p>")
    return out.getvalue()


def chapters(data: bytes) -> list[tuple[str, str]]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = dict.fromkeys(z.namelist())
        ordered: list[str] = []
        package = next((n for n in names if n.endswith(".opf")), None)
        if package:
            root = ElementTree.fromstring(z.read(package))
            local = lambda e: e.tag.rpartition("}")[2]
            hrefs = {e.get("id"): e.get("href") for e in root.iter() if local(e) == "item"}
            base = posixpath.dirname(package)
            ordered = [posixpath.join(base, hrefs[e.get("idref")]) for e in root.iter() if local(e) == "itemref" and e.get("idref") in hrefs]
        ordered = [n for n in ordered if n in names] or sorted(n for n in names if n.lower().endswith((".xhtml", ".html", ".htm")))
        return [(n, z.read(n).decode("utf-8", "replace")) for n in ordered]
