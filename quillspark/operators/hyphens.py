"""Lines to paragraphs with their line-end hyphens decided by the book's own words: candidates, a join with the vocabulary, and decisions back by place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.prose import CLITICS

#: How often both halves of a compound stand alone in the book.
LEAST = 2


def vocabulary(lines: DataFrame, book: str = "book", line: str = "line") -> DataFrame:
    """(book, word, n): lower-case words of letters, counted by book. The counting is combined before it is dealt."""
    words = F.regexp_extract_all(F.lower(F.coalesce(line, F.lit(""))), F.lit(r"(?U)[^\W\d_]+"), F.lit(0))
    return lines.select(book, F.explode(words).alias("word")).groupBy(book, "word").agg(F.count(F.lit(1)).alias("n"))


def joined_lines(lines: DataFrame, words: DataFrame, key: list[str], book: str = "book") -> DataFrame:
    """(key, book, text) of paragraphs ``lines`` (key, book, ord, line): blank lines go, a space joins lines. After a hyphen and before a small letter lines join without one; the
    hyphen itself stays before clitics and in compounds, whose halves are words of the book (``words``: book, word, n) while the whole is not, and goes otherwise."""
    own = Window.partitionBy(*key).orderBy("ord")
    solid = lines.withColumn("line", F.regexp_replace("line", r"(?U)^\s+|\s+$", "")).where("line <> ''")
    following = solid.withColumn("_next", F.lead("line").over(own))
    broken = F.endswith("line", F.lit("-")) & F.coalesce(F.col("_next").rlike(r"^\p{Ll}"), F.lit(False))
    head, tail = F.lower(F.regexp_extract("line", r"(?U)(\w+)-$", 1)), F.lower(F.regexp_extract("_next", r"(?U)^\w+", 0))
    placed = following.withColumns({"_broken": broken, "_head": F.when(broken, head), "_tail": F.when(broken, tail)})
    # Only distinct pairs of halves meet the vocabulary, three of its words each.
    pairs = placed.where("_broken AND _head <> '' AND _tail <> ''").select(book, "_head", "_tail").distinct()
    asked = pairs.select("*", F.explode(F.array(F.struct(F.lit(0).alias("part"), F.col("_head").alias("word")), F.struct(F.lit(1).alias("part"), F.col("_tail").alias("word")), F.struct(F.lit(2).alias("part"), F.concat("_head", "_tail").alias("word")))).alias("_w"))
    asked = asked.select(book, "_head", "_tail", "_w.part", "_w.word").join(words, [book, "word"], "left")
    count = lambda part: F.coalesce(F.max(F.when(F.col("part") == part, F.col("n"))), F.lit(0))
    decided = asked.groupBy(book, "_head", "_tail").agg(((count(0) >= LEAST) & (count(1) >= LEAST) & (count(2) == 0)).alias("_compound"))
    known = placed.join(decided, [book, "_head", "_tail"], "left")
    stays = F.col("_tail").isin(*CLITICS) | F.coalesce("_compound", F.lit(False))
    shown = F.when(F.col("_broken") & ~F.coalesce(stays, F.lit(False)), F.expr("left(line, length(line) - 1)")).otherwise(F.col("line"))
    piece = F.concat(shown, F.when(F.col("_broken") | F.col("_next").isNull(), F.lit("")).otherwise(F.lit(" ")))
    held = known.withColumn("_piece", piece).groupBy(*dict.fromkeys([*key, book])).agg(F.array_sort(F.collect_list(F.struct("ord", "_piece"))).alias("_all"))
    return held.select(*dict.fromkeys([*key, book]), F.array_join(F.transform("_all", lambda s: s["_piece"]), "").alias("text"))
