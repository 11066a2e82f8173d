"""Structure from the spans of pages: the body's type, titles by their type, texts of pages, a book's font and page size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.structure import SENTENCE_END


def body_size(spans: DataFrame, book: str = "path") -> DataFrame:
    """(book, body): the rounded size that most characters have; of equal ones the smaller."""
    sized = spans.where("text IS NOT NULL").groupBy(book, F.round("size").alias("_size")).agg(F.sum(F.length(F.trim("text"))).alias("_chars"))
    return sized.groupBy(book).agg(F.max_by("_size", F.struct("_chars", -F.col("_size"))).alias("body"))


def with_body(spans: DataFrame, book: str = "path") -> DataFrame:
    """``spans`` that have a text, with their book's ``body``. Spans are read once and dealt by their book; so what goes by book and page after it is not dealt again."""
    size = F.round("size")
    sized = spans.where("text IS NOT NULL").repartition(book).withColumn("_chars", F.sum(F.length(F.trim("text"))).over(Window.partitionBy(book, size)))
    return sized.withColumn("body", F.max_by(size, F.struct("_chars", -size)).over(Window.partitionBy(book))).drop("_chars")


def blocks(spans: DataFrame, book: str = "path") -> DataFrame:
    """(book, page, block, text, size: of the longest span, bold: all of it is, y0, y1, and body if the spans have it): lines are divided by line ends. Blank blocks go."""
    own = ["body"] if "body" in spans.columns else []
    solid = F.trim("text") != ""
    span = F.struct("line", "span", "text")
    line = lambda rows, k: F.array_join(F.transform(F.filter(rows, lambda s: s["line"] == k), lambda s: s["text"]), "")
    held = spans.where("text IS NOT NULL").groupBy(book, "page", "block").agg(
        F.array_sort(F.collect_list(span)).alias("_all"),
        F.max_by("size", F.when(solid, F.struct(F.length("text"), -F.col("line"), -F.col("span")))).alias("size"),
        F.coalesce(F.bool_and(F.when(solid, F.col("bold"))), F.lit(False)).alias("bold"),
        F.min("y0").alias("y0"),
        F.max("y1").alias("y1"),
        *(F.first(c).alias(c) for c in own),
    )
    lines = F.transform(F.array_distinct(F.transform("_all", lambda s: s["line"])), lambda k: line(F.col("_all"), k))
    return held.select(book, "page", "block", F.trim(F.array_join(lines, "\n")).alias("text"), "size", "bold", "y0", "y1", *own).where("text <> ''")


def titled(rows: DataFrame, body: DataFrame | None = None, book: str = "path") -> DataFrame:
    """``rows`` (as ``blocks`` has them, with their body or beside it) with ``title``: under 200 characters, and of a size of 1.18 bodies or more, or under 120 and bold throughout. Titles that follow each other in one size,
    the next right below one without final punctuation, are one: its texts with a space between, the first one's place."""
    known = rows if body is None else rows.join(body, book)
    large = (F.length("text") < 200) & ((F.col("size") >= 1.18 * F.col("body")) | ((F.length("text") < 120) & F.col("bold")))
    own = Window.partitionBy(book, "page").orderBy("block")
    before = lambda c: F.lag(c).over(own)
    gap = F.col("y0") - before("y1")
    below = (gap >= -0.3 * F.col("size")) & (gap < 0.9 * F.col("size"))
    marked = known.withColumn("title", large)
    goes_on = F.col("title") & before("title") & (F.abs(F.col("size") - before("size")) < 0.6) & below & ~before("text").rlike(SENTENCE_END)
    islands = marked.withColumn("_opens", (~F.coalesce(goes_on, F.lit(False))).cast("long"))
    islands = islands.withColumn("_island", F.sum("_opens").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda s: s["text"]), " ")
    return islands.groupBy(book, "page", "_island").agg(F.min("block").alias("block"), text.alias("text"), F.bool_and("title").alias("title"), F.min_by("size", "block").alias("size")).drop("_island")


def page_texts(rows: DataFrame, book: str = "path") -> DataFrame:
    """(book, page, text, titles) of pages: blocks by blank lines, titles in order."""
    ordered = F.array_sort(F.collect_list(F.struct("block", "text", "title")))
    held = rows.groupBy(book, "page").agg(ordered.alias("_all"))
    titles = F.transform(F.filter("_all", lambda b: b["title"]), lambda b: b["text"])
    return held.select(book, "page", F.array_join(F.transform("_all", lambda b: b["text"]), "\n\n").alias("text"), titles.alias("titles"))


def dominant_font(spans: DataFrame, book: str = "path") -> DataFrame:
    """(book, font, chars): the font with most characters over a book's middle pages (from its quarter on, thirty at most); of equal ones the first by name."""
    # One pass over the spans: what follows are sums by page and font.
    used = spans.where(F.col(book).isNotNull()).groupBy(book, "page", "font").agg(F.sum(F.length("text")).alias("chars"))
    used = used.withColumn("_pages", F.max("page").over(Window.partitionBy(book)))
    start = F.floor(F.col("_pages") / 4)
    stop = F.greatest(start + 1, F.least(F.col("_pages"), start + 30))
    fonts = used.where((F.col("page") > start) & (F.col("page") <= stop)).groupBy(book, "font").agg(F.sum("chars").alias("chars"))
    return fonts.groupBy(book).agg(F.min_by("font", F.struct(-F.col("chars"), F.col("font"))).alias("font"), F.max("chars").cast("long").alias("chars"))
