"""Notes of books: pairs of anchors that point at each other, from a pass over the markup of each file."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ANCHORS = "place long, id string, target string, shown string, opens boolean"
#: A call or a definition shows as many characters at most.
SHOWN = 8
_BLOCKS = ("p", "div", "li", "aside")
#: Files of a batch whose texts and anchors are Python objects at a time.
_AT_ONCE = 32


class AnchorReader(HTMLParser):
    """Anchors of a page in order: place, id, what they point at, their visible text, and whether they open a block (no text stands before them in it)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.at_start = False
        self.inside: list | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "a":
            given = dict(attrs)
            link = given.get("href") or ""
            self.inside = [len(self.rows), given.get("id"), link.partition("#")[2] if "#" in link else None, "", self.at_start]
            self.rows.append(self.inside)
            self.at_start = False
        elif tag in _BLOCKS:
            self.at_start = True

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self.inside = None
        elif tag in _BLOCKS:
            self.at_start = False

    def handle_data(self, data: str) -> None:
        if self.inside is not None:
            self.inside[3] += data
        elif data.strip():
            self.at_start = False


def anchors(files: DataFrame, key: list[str], html: str = "html") -> DataFrame:
    """The anchors of files (key, html), as ``AnchorReader`` has them. Null pages have none."""
    kinds = dict(files.dtypes)
    fields = [f.split() for f in ANCHORS.split(", ")]
    types = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (batch.slice(at, _AT_ONCE) for batch in batches for at in range(0, batch.num_rows, _AT_ONCE)):
            of, rows = [], []
            for row, body in enumerate(part.column("_html").to_pylist()):
                reader = AnchorReader()
                reader.feed(body or "")
                reader.close()
                of += [row] * len(reader.rows)
                rows += [(k, i, t, " ".join(s.split()), o) for k, i, t, s, o in reader.rows]
            take = pa.array(of, pa.int64())
            values = [pa.array([r[n] for r in rows], types[kind]) for n, (_, kind) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([*(part.column(k).take(take) for k in key), *values], [*key, *(name for name, _ in fields)])

    return files.select(*key, F.col(html).alias("_html")).mapInArrow(read, ", ".join([*(f"`{k}` {kinds[k]}" for k in key), ANCHORS]))


def note_pairs(found: DataFrame, book: str, file: str) -> DataFrame:
    """(book, number, call_file, call, definition_file, definition) from anchors: two of ``SHOWN`` visible characters at most that point at each other, one of which opens a block:
    that is the definition. Calls are numbered in order of file and place; of anchors with one id in a book, the last one counts."""
    small = F.col("target").isNotNull() & (F.length("shown") <= SHOWN)
    last = F.max_by(F.struct(file, "place", "target"), F.when(small, F.struct(file, "place"))).alias("_own")
    one = found.where(F.col("id").isNotNull()).groupBy(book, "id").agg(last, F.bool_or("opens").alias("opens")).where("_own IS NOT NULL")
    # Two anchors that point at each other are the rows of one pair of ids; grouping, unlike a join, keeps a null book's together.
    row = F.struct(F.col(f"_own.{file}").alias(file), F.col("_own.place").alias("place"), "id")
    ends = F.least("id", "_own.target").alias("_low"), F.greatest("id", "_own.target").alias("_high")
    both = one.groupBy(book, *ends).agg(F.max(F.when(~F.col("opens"), row)).alias("_call"), F.max(F.when(F.col("opens"), row)).alias("_definition"))
    pairs = both.where("_call IS NOT NULL AND _definition IS NOT NULL").select(book, F.col(f"_call.{file}").alias(file), "_call.place", "_call.id", F.col(f"_definition.{file}").alias("_file"), F.col("_definition.id").alias("target"))
    number = F.row_number().over(Window.partitionBy(book).orderBy(file, "place"))
    return pairs.select(book, number.cast("long").alias("number"), F.col(file).alias("call_file"), F.col("id").alias("call"), F.col("_file").alias("definition_file"), F.col("target").alias("definition"))

# What a class of headings is called.
HEADING_NAME = r"(?i)(^|[-_ ])(sub-?)?(head(er|ing)?|title|titulo|chapter|capitulo|heading)([-_ ]|\d|$)"


def style_headings(paragraphs: DataFrame, styles: DataFrame, deepest: DataFrame, book: str = "book") -> DataFrame:
    """(book, class, level, n) of paragraph classes that are headings: at most 90 characters in the median and 220 in all, a fifth of a book's paragraphs, and bold or named
    so. ``paragraphs``: (book, place, class, length); ``styles``: (book, class, bold, size: null counts as 1); ``deepest``: (book, level) of the markup's own headings. Levels
    go down from there by size, classes of one size in order of their first use, to the sixth."""
    use = paragraphs.groupBy(book, "class").agg(F.percentile("length", 0.5).alias("_median"), F.max("length").alias("_most"), F.count(F.lit(1)).alias("n"), F.min("place").alias("_first"))
    total = use.groupBy(book).agg(F.sum("n").alias("_total"))
    styled = use.join(total, book).join(styles, [book, "class"], "left").join(deepest.select(book, F.col("level").alias("_deepest")), book, "left")
    named = F.coalesce("bold", F.lit(False)) | F.col("class").rlike(HEADING_NAME)
    fits = styled.where((F.col("_median") <= 90) & (F.col("_most") <= 220) & (F.col("n") / F.col("_total") <= 0.2) & named)
    rank = F.row_number().over(Window.partitionBy(book).orderBy(F.desc(F.coalesce("size", F.lit(1.0))), "_first"))
    return fits.select(book, "class", F.least(F.lit(6), F.coalesce("_deepest", F.lit(0)) + rank).cast("long").alias("level"), "n")
