"""Sequential folds as expressions: pages of blocks, and pieces of sentences. No Python worker sees a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A sentence with the space after it: its end, closing quotes, and a start that follows. The last one reaches the text's end.
SENTENCE = r"""(?sU).+?(?:(?<=[.!?…])["”’»)\]*]*\s+(?=["“‘«(\[*]*[A-ZÀ-Ý0-9])|\z)"""


def live_pages(blocks: DataFrame, key: str = "doc_id", room: int = 1800, most: int = 14, long: int = 200) -> DataFrame:
    """``blocks`` (key, ord, kind, text) with their page (from 1): a block opens a page if the page would hold over ``room`` characters or ``most`` blocks, or if
    it is a heading and prose (over ``long`` characters) stands on the page.

    A heading right after prose opens a page whatever stands before them. So books are cut there, and the fold runs over a stretch between two such
    headings; pages are then numbered by a running sum over a book's stretches. Null texts count as empty; columns pass, but for a page that the blocks have already."""
    blocks = blocks.drop("page")
    own = Window.partitionBy(key).orderBy("ord")
    size = F.length(F.coalesce("text", F.lit(""))).cast("long")
    prose = (F.col("kind") != "heading") & (size > long)
    cut = (F.col("kind") == "heading") & F.coalesce(F.lag(prose).over(own), F.lit(False))
    stretches = blocks.withColumn("_cut", cut.cast("long")).withColumn("_stretch", F.sum("_cut").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    row = F.struct(F.col("ord").alias("_ord"), size.alias("_size"), (F.col("kind") == "heading").alias("_heading"), F.struct(*(F.col(f"`{c}`") for c in blocks.columns)).alias("_row"))
    held = stretches.groupBy(F.col(key).alias("_key"), "_stretch").agg(F.array_sort(F.collect_list(row), lambda a, b: F.when(a["_ord"] < b["_ord"], -1).when(a["_ord"] > b["_ord"], 1).otherwise(0)).alias("_rows"))

    def step(at: Column, b: Column) -> Column:
        opens = (at["size"] > 0) & ((at["size"] + b["_size"] > room) | (at["n"] >= most) | (b["_heading"] & at["prose"]))
        page = at["page"] + opens.cast("long")
        return F.struct(
            page.alias("page"),
            (F.when(opens, 0).otherwise(at["size"]) + b["_size"]).alias("size"),
            (F.when(opens, 0).otherwise(at["n"]) + 1).cast("long").alias("n"),
            ((~opens & at["prose"]) | (~b["_heading"] & (b["_size"] > long))).alias("prose"),
            F.array_append(at["pages"], page).alias("pages"),
        )

    start = F.struct(F.lit(1).cast("long").alias("page"), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("n"), F.lit(False).alias("prose"), F.array().cast("array<bigint>").alias("pages"))
    paged = held.withColumn("_pages", F.aggregate("_rows", start, step, lambda at: at["pages"]))
    before = F.coalesce(F.sum(F.element_at("_pages", -1)).over(Window.partitionBy("_key").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = paged.withColumn("_before", before).select("_before", F.explode(F.arrays_zip("_rows", "_pages")).alias("_x"))
    return each.select("_x._rows._row.*", (F.col("_before") + F.col("_x._pages")).alias("page"))


def pieces(text: Column, limit: int) -> Column:
    """The pieces of a text, each of at most ``limit`` characters and of whole sentences where these are short enough; a longer one is cut after its last
    space within the limit, or at the limit. What is left of it goes on with the next sentences. Null in, null out; blank pieces go."""
    cut = rf"(?s)(?=.{{{limit + 1}}})(?:.{{0,{limit - 1}}} |.{{{limit}}})|.+"
    parts = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)), lambda s: _hardened(F.regexp_extract_all(s, F.lit(cut), F.lit(0)))))

    def step(at: Column, part: Column) -> Column:
        full = part["hard"] | (F.length(at["open"]) + F.length(part["text"]) > limit)
        closed = F.when(full, F.array_append(at["done"], at["open"])).otherwise(at["done"])
        return F.struct(
            F.when(part["hard"], F.array_append(closed, part["text"])).otherwise(closed).alias("done"),
            F.when(part["hard"], F.lit("")).when(full, part["text"]).otherwise(F.concat(at["open"], part["text"])).alias("open"),
        )

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    packed = F.aggregate(parts, start, step, lambda at: F.array_append(at["done"], at["open"]))
    strip = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    return F.filter(F.transform(packed, strip), lambda x: x != "")


def _hardened(parts: Column) -> Column:
    """Parts of one sentence: all but the last were cut by the limit, and stand alone."""
    return F.transform(parts, lambda x, i: F.struct(x.alias("text"), (i < F.size(parts) - 1).alias("hard")))
