"""Numbered paragraphs of another copy, found as a chain of rising numbers, and their comparison with one's own."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import align

#: A number at a line's start, its point and white space (which may be the line's end).
MARK = r"(?U)^\s*([1-9]\d{0,8})\.(?:\s|$)"


def number_marks(copies: DataFrame, key: str, most: DataFrame) -> DataFrame:
    """Where a copy's paragraphs begin: (key, n, start: the place after the mark).

    ``copies``: (key, text); ``most``: (key, n_max). Numbers are looked for from 1 on, each on a line after the mark found before; one that is not there
    is passed over. So the chain takes, of all marks in order of (n, place), each whose number is above the chain's last and whose line begins
    behind it: a fold over a copy's marks alone, which are few beside its text."""
    lines = copies.select(key, F.posexplode(F.split("text", r"\n", -1)).alias("_line", "_text"), F.length("text").alias("_len"))
    # Lines are ordered by their lengths and marks alone: no text is dealt or sorted for it.
    whole = F.regexp_extract("_text", MARK, 0)
    mark = F.length(whole) + F.when(F.endswith(whole, F.lit(".")), 1).otherwise(0)
    sizes = lines.select(key, "_line", "_len", (F.length("_text") + 1).alias("_size"), F.when(F.col("_text").rlike(MARK), F.struct(F.regexp_extract("_text", MARK, 1).cast("long").alias("n"), mark.alias("mark"))).alias("_own"))
    before = Window.partitionBy(key).orderBy("_line").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.withColumn("_at", F.coalesce(F.sum("_size").over(before), F.lit(0)).cast("long")).where("_own IS NOT NULL")
    marks = placed.select(key, "_own.n", F.col("_at").alias("at"), (F.col("_at") + F.col("_own.mark")).cast("long").alias("start"), "_len")
    marks = marks.where("start <= _len").join(most, key).where("n <= n_max")
    held = marks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("n", "at", "start"))).alias("_all"))

    def step(done, x):
        last = F.try_element_at(done, F.lit(-1))
        return F.when(last.isNull() | ((x["n"] > last["n"]) & (x["at"] > last["start"])), F.array_append(done, x)).otherwise(done)

    chain = F.aggregate("_all", F.array().cast("array<struct<n:bigint,at:bigint,start:bigint>>"), step)
    return held.select(key, F.explode(chain).alias("m")).select(key, "m.n", "m.start")


def numbered_paragraphs(copies: DataFrame, key: str, most: DataFrame) -> DataFrame:
    """(key, n, text) of a copy's numbered paragraphs. Each ends four characters and its number's digits before the place after the next mark, which
    leaves out a blank line between them; the last reaches to the end."""
    marks = number_marks(copies, key, most)
    own = Window.partitionBy(key).orderBy("n")
    ends = marks.withColumn("_end", F.lead("start").over(own) - F.length(F.lead("n").over(own).cast("string")) - 4)
    held = ends.groupBy(key).agg(F.collect_list(F.struct("n", "start", "_end")).alias("_spans"))
    cut = copies.join(held, key).select(key, "text", F.explode("_spans").alias("s"))
    size = F.greatest(F.coalesce(F.col("s._end"), F.length("text").cast("long")) - F.col("s.start"), F.lit(0))
    return cut.select(key, F.col("s.n").alias("n"), F.substring(F.col("text"), (F.col("s.start") + 1).cast("int"), size.cast("int")).alias("text"))


def collate(own: DataFrame, copies: DataFrame, key: str) -> DataFrame:
    """``own`` numbered paragraphs (key, n, text) against a copy's: outcome (equal, different, absent), ratio of the words (3 places), the first
    12 differing runs and their number, and whether one of them is more than an addition of the copy."""
    most = own.groupBy(key).agg(F.max("n").alias("n_max"))
    theirs = numbered_paragraphs(copies, key, most).withColumnRenamed("text", "_theirs")
    kind = "outcome string, ratio double, total long, changed boolean, changes array<struct<kind:string,ours:string,theirs:string>>"

    @F.pandas_udf(kind)
    def compared(ours: pd.Series, other: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([align.collated(a, b) for a, b in zip(ours, other)], columns=[c.split()[0] for c in kind.split(", ")])

    joined = own.join(theirs, [key, "n"], "left").withColumn("_x", compared("text", "_theirs"))
    return joined.select(key, "n", "_x.*")
