"""Whether texts are in books: a book meets all its parts in one row, and its runs are hashed: cost follows the letters of both, not their product."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Letters of a chunk; longer parts are looked for by their chunks.
WINDOW = 30
_FACTOR = 0x9E3779B97F4A7C15
_BACK = pow(_FACTOR, -1, 1 << 64)
#: Letters of a batch's texts that are looked at together (one text at least), so that a task holds the places of these alone.
_LETTERS = 1 << 20
#: Letters of a book times its parts up to which the parts are looked for one by one.
DIRECT = 1 << 22


def _parts(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """A batch in parts of whole rows by the bytes of ``text``."""
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).cumsum()
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + _LETTERS, "right")))
        yield batch.slice(at, to - at)
        at = to


class Runs:
    """Hashes of any runs of a text, from running sums of its letters' codes times powers of a factor."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.size = len(codes)
        up, self.back = (np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(self.size, f, np.uint64)])) for f in (_FACTOR, _BACK))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes + np.uint64(1)) * up[:-1])])

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.back[start]


def _cuts(text: str) -> list[str]:
    """Chunks of ``WINDOW`` letters (what is shorter at the end is not looked at); a shorter text is one chunk."""
    return [text[k : k + WINDOW] for k in range(0, max(len(text) - WINDOW, 0) + 1, WINDOW)]


def _met(runs: Runs, length: int, sought: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of a text whose runs of ``length`` have one of the hashes ``sought``, in order of the hash, and where in ``sought`` each has its first."""
    if runs.size < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(sought, kind="stable")
    own = sought[order]
    h = runs.of(np.arange(runs.size - length + 1), length)
    at = np.minimum(np.searchsorted(own, h), len(own) - 1)
    places = np.flatnonzero(own[at] == h)
    by = np.argsort(at[places], kind="stable")
    return places[by], order[at[places[by]]]


def places(body: str, parts: list[str], first: bool = False) -> Iterator[tuple[int, int]]:
    """(number of the part, place) of all places, or at least one of each part that is there, of different and not empty parts in a text. Parts shorter than ``WINDOW`` meet the text's
    runs of their length; of longer ones the chunk that the text has least often does, and the whole is compared there."""
    if len(body) * len(parts) <= DIRECT:
        for k, part in enumerate(parts):
            at = body.find(part)
            while at >= 0:
                yield k, at
                at = -1 if first else body.find(part, at + 1)
        return
    runs, joined = Runs(body), Runs("".join(parts))
    size = np.array([len(p) for p in parts])
    start = np.cumsum(size) - size
    whole = joined.of(start, size)
    for length in np.unique(size[size < WINDOW]).tolist():
        own = np.flatnonzero(size == length)
        at, which = _met(runs, length, whole[own])
        if first:
            which, one = np.unique(which, return_index=True)
            at = at[one]
        yield from ((k, i) for k, i in zip(own[which].tolist(), at.tolist()) if body.startswith(parts[k], i))
    long = np.flatnonzero(size >= WINDOW)
    if not len(long):
        return
    chunks = size[long] // WINDOW
    of = np.repeat(np.arange(len(long)), chunks)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    sought, same = np.unique(joined.of(start[long][of] + nth * WINDOW, WINDOW), return_inverse=True)
    at, which = _met(runs, WINDOW, sought)
    bounds = np.searchsorted(which, np.arange(len(sought) + 1))
    count = np.diff(bounds)[same]
    rarest = np.lexsort((nth, count, of))[np.cumsum(chunks) - chunks]
    for k, c in zip(long.tolist(), rarest.tolist()):
        begin = at[bounds[same[c]] : bounds[same[c] + 1]] - nth[c] * WINDOW
        begin = begin[(begin >= 0) & (begin + size[k] <= runs.size)]
        for i in begin[runs.of(begin, size[k]) == whole[k]].tolist():
            if body.startswith(parts[k], i):
                yield k, i
                if first:
                    break


def _asked(parts: DataFrame, books: DataFrame, book: str, part: str, text: str, how: str) -> DataFrame:
    """(book, _text, _parts): books with all their parts, so that both are shuffled once and what is found is not."""
    own = parts.groupBy(book).agg(F.collect_list(F.struct(F.col(part).alias("part"), F.col(text).alias("text"))).alias("_parts"))
    return own.join(books.select(book, F.col(text).alias("_text")), book, how).select(book, "_text", "_parts")


def _each(batches: Iterator[pa.RecordBatch], book: str) -> Iterator[tuple[pa.Array, str, pa.Array, list[str]]]:
    """Of each book: its key, its text, its parts' keys and texts."""
    for batch in (part for whole in batches for part in _parts(whole, "_text")):
        for row, body in enumerate(batch.column("_text").to_pylist()):
            own = batch.column("_parts").slice(row, 1).flatten()
            yield batch.column(book).slice(row, 1), body or "", pc.struct_field(own, "part"), pc.struct_field(own, "text").to_pylist()


def found_places(parts: DataFrame, books: DataFrame, book: str = "book", part: str = "part", text: str = "text") -> DataFrame:
    """(book, part, place) of all places (from 0) at which a book (book, text) holds a part (book, part, text).

    A book's parts are gathered to its row, as its text is one. Parts of equal text in a book are looked for once. Null and empty parts are nowhere."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(own: pa.Array, keys: pa.Array, rows: list[tuple[int, int]]) -> pa.RecordBatch:
            of = own.take(pa.array([0] * len(rows), pa.int64()))
            return pa.RecordBatch.from_arrays([of, keys.take(pa.array([k for k, _ in rows], pa.int64())), pa.array([i for _, i in rows], pa.int64())], [book, part, "place"])

        for own, body, keys, texts in _each(batches, book):
            named: dict[str, list[int]] = {}
            for k, t in enumerate(texts):
                named.setdefault(t, []).append(k)
            rows, wanted = [], list(named.values())
            for k, place in places(body, list(named)):
                rows += [(x, place) for x in wanted[k]]
                if len(rows) >= 100_000:
                    yield out(own, keys, rows)
                    rows = []
            if rows:
                yield out(own, keys, rows)

    asked = _asked(parts.where((F.length(text) > 0) & F.col(book).isNotNull()), books.where(F.length(text) > 0), book, part, text, "inner")
    return asked.mapInArrow(find, f"`{book}` {dict(asked.dtypes)[book]}, `{part}` {dict(parts.dtypes)[part]}, place long")


def completeness(parts: DataFrame, books: DataFrame, book: str = "book", part: str = "part", text: str = "text", missing: int = 2) -> DataFrame:
    """(book, part, whole, in_pages) for parts (already letters alone) of over three letters: whether the book's letters (a row a book; none: no letters) hold the part as a whole, and all but
    ``missing`` of its chunks of ``WINDOW`` letters (what is shorter at the end is not looked at; a shorter part is one chunk)."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, body, keys, texts in _each(batches, book):
            distinct = list(dict.fromkeys(texts))
            held = {distinct[k] for k, _ in places(body, distinct, first=True)}
            # A part that is there as a whole lacks no chunk.
            cuts = {t: _cuts(t) for t in distinct if t not in held}
            sought = list(dict.fromkeys(c for own_cuts in cuts.values() for c in own_cuts))
            there = {sought[k] for k, _ in places(body, sought, first=True)}
            most = {t: sum(c not in there for c in own_cuts) <= missing for t, own_cuts in cuts.items()}
            columns = [own.take(pa.array([0] * len(texts), pa.int64())), keys, pa.array([t in held for t in texts], pa.bool_()), pa.array([most.get(t, True) for t in texts], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, [book, part, "whole", "in_pages"])

    asked = _asked(parts.where(F.length(text) > 3), books, book, part, text, "left")
    return asked.mapInArrow(check, f"`{book}` {dict(asked.dtypes)[book]}, `{part}` {dict(parts.dtypes)[part]}, whole boolean, in_pages boolean")


def relocated(marks: DataFrame, lines: DataFrame, book: str = "book") -> DataFrame:
    """Marks (book, mark, ord, snippet) with ``moved``: their own line (book, ord, line) if that holds the snippet still, else the first that does, else null. An empty
    snippet is in every line, so it stays, or moves to the first line if its own is gone; a null one is nowhere."""
    # Lines are searched as one text, in which a snippet without a line's end stays within a line.
    asked = marks.where((F.length("snippet") > 0) & ~F.contains("snippet", F.lit("\n"))).select(book, "mark", F.col("ord").alias("_was"), F.col("snippet").alias("_text"))
    body = lines.select(book, "ord", F.concat(F.coalesce("line", F.lit("")), F.lit("\n")).alias("_line"))
    before = F.coalesce(F.sum(F.length("_line")).over(Window.partitionBy(book).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = body.withColumn("_from", before.cast("long"))
    texts = placed.groupBy(book).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "_line"))), lambda s: s["_line"]), "").alias("_text"))
    found = found_places(asked, texts, book, "mark", "_text")
    spans = placed.select(book, "ord", "_from", (F.col("_from") + F.length("_line")).alias("_to"))
    # Which line a place is in: places and line starts in one order, the last start wins; no pairs are made.
    starts = spans.select(book, F.col("_from").alias("_at"), F.lit(0).alias("_kind"), "ord", F.lit(None).cast(dict(marks.dtypes)["mark"]).alias("mark"))
    hits = found.select(book, F.col("place").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(dict(lines.dtypes)["ord"]).alias("ord"), "mark")
    order = Window.partitionBy(book).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    within = starts.unionByName(hits).withColumn("_line_ord", F.last("ord", True).over(order)).where("_kind = 1").select(book, "mark", F.col("_line_ord").alias("_in"))
    own = within.join(asked.select(book, "mark", "_was"), [book, "mark"])
    best = own.groupBy(book, "mark").agg(F.min(F.struct((F.col("_in") != F.col("_was")).alias("far"), F.col("_in").alias("ord")))["ord"].alias("moved"))
    empty = marks.where("snippet = ''").select(book, "mark", F.col("ord").alias("_was"))
    first = lines.groupBy(book).agg(F.min("ord").alias("_first"))
    there = lines.select(book, F.col("ord").alias("_was"), F.lit(True).alias("_there")).distinct()
    still = empty.join(there, [book, "_was"], "left").join(first, book, "left").select(book, "mark", F.when(F.col("_there"), F.col("_was")).otherwise(F.col("_first")).alias("moved"))
    return marks.join(best.unionByName(still), [book, "mark"], "left")


def anchored(anchors: DataFrame, lines: DataFrame, book: str = "book", head: int = 8) -> DataFrame:
    """Anchors (book, anchor, start) with ``ord`` of the first line (book, ord, line) that starts with ``start``, null if none does. Anchors and lines meet by as many of
    their first ``head`` characters as the anchor has; lines are keyed by the lengths that a book's anchors have."""
    asked = anchors.where(F.col("start").isNotNull()).select(book, "anchor", "start", F.least(F.length("start"), F.lit(head)).alias("_k")).withColumn("_key", F.expr("left(start, _k)"))
    lengths = asked.groupBy(book).agg(F.collect_set("_k").alias("_ks"))
    keyed = lines.join(lengths, book).select(book, "ord", "line", F.explode("_ks").alias("_k")).withColumn("_key", F.expr("left(line, _k)"))
    distinct = asked.select(book, "_k", "_key", "start").distinct()
    firsts = keyed.join(distinct, [book, "_k", "_key"]).where(F.startswith("line", F.col("start"))).groupBy(book, "start").agg(F.min("ord").alias("ord"))
    return anchors.join(firsts, [book, "start"], "left")
