"""Comparing a source's blocks with another edition.

A book's blocks and its copy come together in one row. The blocks' places depend on each other, so a task finds them for a book at a time, and what changed in each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import align

CHANGES = "array<struct<kind:string,ours:string,theirs:string,before:string>>"
COMPARED = f"place long, id string, outcome string, changes {CHANGES}, total long, words long, before string, excerpt string"
#: Changes that a row shows; ``total`` counts all.
SHOWN = 12
#: Share of words that a modernised text keeps at least, but for their spelling.
SAME = 0.93
#: Books whose texts are Python objects at a time.
_AT_ONCE = 16


def _changes(ours: list[str], theirs: list[str]) -> tuple[str, list[dict], int]:
    """A located block's outcome, the changes that are shown, and how many there are."""
    found = align.differences(ours, theirs)
    return "different" if found else "equal", [dict(zip(("kind", "ours", "theirs", "before"), c)) for c in found[:SHOWN]], len(found)


def _compared(ids: list[str], texts: list[str | None], copy: list[str]) -> list[tuple]:
    """The rows of a book, as ``COMPARED`` has them."""
    placed = align.place_blocks([align.words(align.strip_markdown(t or "")) for t in texts], copy)
    rows = []
    for k, (i, p, t) in enumerate(zip(ids, placed, texts)):
        outcome, changes, total = _changes(p.ours, p.theirs) if p.outcome == "located" else (p.outcome, None, 0)
        rows.append((k, i, outcome, changes, total, len(p.theirs), None, " ".join((t or "").split())[:240] if outcome == "absent" else None))
    return rows + [(len(ids), x.after, "only in copy", None, 0, x.words, x.before, x.excerpt) for x in align.leftovers(ids, placed, copy)]


def compare_editions(blocks: DataFrame, copies: DataFrame, key: str = "book") -> DataFrame:
    """blocks (key, id, ord, text) in copies (key, text). A row for each block: outcome (equal, different, absent, not compared), its first changes and how many there
    are; and one for each run that only the copy has (id: the block before it, ``before``: the one after, ``words``: its length). ``place`` is the row's place in the book, ``excerpt``
    the text of what is missing on either side. Books without blocks or copies have no rows. Blocks and copies are dealt together, and a book is read once."""
    kinds = dict(blocks.dtypes)
    block = F.struct(F.col("ord"), F.col("id"), F.col("text"))
    none = f"struct<ord:{kinds['ord']},id:{kinds['id']},text:string>"
    ours = blocks.select(key, block.alias("_block"), F.lit(None).cast("string").alias("_copy"))
    theirs = copies.select(key, F.lit(None).cast(none).alias("_block"), F.col("text").alias("_copy"))
    books = ours.unionByName(theirs).groupBy(key).agg(F.array_sort(F.collect_list("_block")).alias("_blocks"), F.collect_list("_copy").alias("_copies"))
    books = books.where((F.size("_blocks") > 0) & (F.size("_copies") > 0))
    column = lambda name: F.transform("_blocks", lambda x: x[name]).alias(f"_{name}s")
    books = books.select(key, column("id"), column("text"), F.array_join("_copies", "\n\n").alias("_copy"))
    names = [c.split()[0] for c in COMPARED.split(", ")]
    types = {"long": pa.int64(), "string": pa.string(), CHANGES: pa.list_(pa.struct([(c, pa.string()) for c in ("kind", "ours", "theirs", "before")]))}
    kind_of = [types[c.split(" ", 1)[1]] for c in COMPARED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _AT_ONCE):
                part = batch.slice(at, _AT_ONCE)
                of, rows = [], []
                for k, (ids, texts, copy) in enumerate(zip(*(part.column(c).to_pylist() for c in ("_ids", "_texts", "_copy")))):
                    found = _compared(ids, texts, align.words(copy))
                    of += [k] * len(found)
                    rows += found
                values = [pa.array([r[n] for r in rows], kind) for n, kind in enumerate(kind_of)]
                yield pa.RecordBatch.from_arrays([part.column(key).take(pa.array(of, pa.int64())), *values], [key, *names])

    return books.mapInArrow(run, f"`{key}` {kinds[key]}, {COMPARED}")


def summary(compared: DataFrame, key: str = "book") -> DataFrame:
    """Blocks by outcome, blocks compared, and what only the copy has."""
    names = ("equal", "different", "absent", "not compared", "only in copy")
    counts = [F.count_if(F.col("outcome") == n).alias(n.replace(" ", "_")) for n in names]
    own = F.col("outcome") != "only in copy"
    return compared.groupBy(key).agg(*counts, F.count_if(own).alias("blocks"), F.count_if(own & (F.col("outcome") != "not compared")).alias("compared"))


def same_words(source: Column, out: Column) -> Column:
    """The share of words whose skeletons agree in order: 1 of a source without words."""

    @F.pandas_udf("double")
    def skeleton_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        bones = lambda t: [align.skeleton(w) for w in align.words(t or "")]
        return pd.Series([align.ratio(bones(x), bones(y)) if x else 1.0 for x, y in zip(a, b)])

    return skeleton_ratio(source, out)


def beyond_spelling(source: Column, out: Column) -> Column:
    """Whether a modernised text changed more than spelling: under 0.93 of the words' skeletons agree."""
    return same_words(source, out) < SAME
