"""Block structure from lines: running heads, paragraphs, continuations, section paths. All are windows within a document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.search import fold

LIST_MARK = r"^(\d{1,3}[.)]|[a-z]\)|[IVXLC]{1,6}\.\s*[—-]?)\s+\S"
SENTENCE_END = r"[.!?:;…\"”»)\]]\s*$"


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, ord, line of each line of ``text``; other columns of a document are carried."""
    rest = [c for c in docs.columns if c != "text"]
    return docs.select(*rest, F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("ord", "line"))


def running_heads(pages: DataFrame, book: str = "book", page: str = "page", share: float = 0.2, first: int = 2, last: int = 1) -> DataFrame:
    """(book, key) of short lines at page ends that recur on a share of the book's pages; key: letters only."""
    own = Window.partitionBy(book, page)
    solid = pages.where(F.trim("line") != "")
    placed = solid.withColumns({"_up": F.row_number().over(own.orderBy("ord")), "_down": F.row_number().over(own.orderBy(F.desc("ord")))})
    ends = placed.where(((F.col("_up") <= first) | (F.col("_down") <= last)) & (F.length(F.trim("line")) < 60))
    keyed = ends.select(book, page, F.regexp_replace(fold(F.col("line")), "[^a-z]+", "").alias("key")).where("key != ''").distinct()
    total = solid.groupBy(book).agg(F.count_distinct(page).alias("_pages"))
    counted = keyed.groupBy(book, "key").agg(F.count(F.lit(1)).alias("pages")).join(total, book)
    return counted.where(F.col("pages") >= F.greatest(F.lit(2.0), share * F.col("_pages"))).drop("_pages")


def paragraphs(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lines to paragraphs: blank lines end them, list marks open them."""
    w = Window.partitionBy(key).orderBy("ord")
    opens = F.trim("line").rlike(LIST_MARK) | (F.coalesce(F.lag(F.trim("line")).over(w), F.lit("")) == "")
    islands = rows.withColumn("_opens", opens).where(F.trim("line") != "").withColumn("paragraph", F.sum(F.col("_opens").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda s: F.trim(s.line))
    return islands.groupBy(key, "paragraph").agg(F.array_join(text, " ").alias("text"), F.min("ord").alias("ord"))


def continuations(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Merges paragraphs that go on: the one before lacks final punctuation, and the page turns or the next starts in lower case."""
    w = Window.partitionBy(key).orderBy("ord")
    before = F.lag("text").over(w)
    turns = F.col("page") == F.lag("page").over(w) + 1
    same = (F.col("page") == F.lag("page").over(w)) & F.col("text").rlike(r"^\p{Ll}")
    goes_on = (F.col("kind") == "paragraph") & (F.lag("kind").over(w) == "paragraph") & ~before.rlike(SENTENCE_END) & (turns | same)
    islands = blocks.withColumn("_opens", (~F.coalesce(goes_on, F.lit(False))).cast("long"))
    islands = islands.withColumn("block", F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda s: s.text)
    return islands.groupBy(key, "block").agg(F.array_join(text, " ").alias("text"), F.min("kind").alias("kind"), F.array_sort(F.collect_set("page")).alias("pages"))


def section_path(blocks: DataFrame, key: str = "doc_id", level: str = "level", title: str = "text") -> DataFrame:
    """Adds the last titles of level 1 and 2; a level-1 title ends the level-2 one before it."""
    w = Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    first = blocks.withColumn("_at", F.max(F.when(F.col(level) == 1, F.col("ord"))).over(w)).withColumn("h1", F.last(F.when(F.col(level) == 1, F.col(title)), True).over(w))
    inner = Window.partitionBy(key, "_at").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return first.withColumn("h2", F.last(F.when(F.col(level) == 2, F.col(title)), True).over(inner)).drop("_at")
