"""Books from files of any folder that Spark reads: a row for each part of a book, in reading order."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.sources import epub, fictionbook

SCHEMA = "path string, format string, place long, name string, text string, problem string"
_SILENT = re.compile(r"(?is)<(script|style)\b.*?</\1>")
_JOINED = re.compile(r"(?i)</?(?:a|span|font)\b[^>]*>")
_TAG = re.compile(r"<[^>]+>")


def page_text(page: str) -> str:
    """Text of a page: links and spans leave no space, other tags do."""
    return html.unescape(_TAG.sub(" ", _JOINED.sub("", _SILENT.sub(" ", page))))


def parts(data: bytes, kind: str) -> list[tuple[str, str]]:
    """(name, text) of a file's parts."""
    if kind == "epub":
        return [(name, page_text(body)) for name, body in epub.chapters(data)]
    if kind == "fb2":
        return [("", part) for part in fictionbook.sections(fictionbook.decoded(data))]
    text = data.decode("utf-8", "replace")
    if kind in ("html", "htm", "xhtml"):
        return [("", page_text(text))]
    return [("", text)]


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """The parts of all books under ``path`` (epub, html, fb2, txt, md). A file that cannot be read, or of a kind that is not read here, is one
    row with its problem."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for where, data in zip(pdf["path"], pdf["content"]):
                kind = where.rpartition(".")[2].lower()
                try:
                    if kind not in ("epub", "html", "htm", "xhtml", "fb2", "txt", "md"):
                        raise ValueError(f"books of kind {kind} are not read")
                    rows += [(where, kind, k, name, text, None) for k, (name, text) in enumerate(parts(bytes(data), kind))]
                except Exception as problem:  # noqa: BLE001  any broken file is a row, not the end of the job
                    rows.append((where, kind, 0, None, None, f"{type(problem).__name__}: {problem}"))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path"), "content").mapInPandas(read, SCHEMA)
