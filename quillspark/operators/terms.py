"""Names and terms that a corpus repeats, as expressions over each text and a count by term."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import lexicons

# A run of up to four capitalised words with at most two small ones between them; what stands before a sentence's first word; endings of contractions.
TERM = r"(?U)[A-ZÀ-Ý][\w’'-]*(?:(?:\s+(?:of|the|and|de|da|do|dos|das|von|van|der|des|du|la|le)){0,2}\s+[A-ZÀ-Ý][\w’'-]*){0,3}"
START = r"""(?U)(?:^|[.!?:;…—–]["”’»)\]]*\s+|\n\s*)[\s"“‘«(\[]*$"""
CONTRACTION = r"[’'](?:m|t|re|ve|ll|d)$"
#: Characters of an example on either side.
AROUND = 70


def plain(text: Column) -> Column:
    """A text without its markup, links first."""
    unlinked = F.regexp_replace(text, r"!?\[([^\]]*)\]\((?:[^()\s]|\([^()\s]*\))+\)", "$1")
    return F.regexp_replace(unlinked, r"<[^>]+>|\[\^[^\]]+\]|[*_#]", " ")


def found_terms(texts: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """A row for each term of each text: (key, place, term, inside: whether it is within a sentence, example). Leading everyday and small words are no part of
    a term, nor is a possessive ending; everyday words, numbers, contractions and what has under three letters are no terms."""
    body = texts.where(F.col(text).isNotNull()).select(*key, plain(F.col(text)).alias("_text"))
    pair = F.arrays_zip(F.split("_text", TERM, -1).alias("gap"), F.regexp_extract_all("_text", F.lit(TERM), F.lit(0)).alias("term"))

    def step(done: Column, x: Column) -> Column:
        start = F.coalesce(F.try_element_at(done, F.lit(-1))["end"], F.lit(0)) + F.length(x["gap"])
        row = F.struct((start + F.length(x["term"])).alias("end"), x["gap"].alias("gap"), x["term"].alias("term"))
        return F.when(x["term"].isNull(), done).otherwise(F.array_append(done, row))

    runs = F.aggregate(pair, F.array().cast("array<struct<end:int,gap:string,term:string>>"), step)
    each = body.select(*key, "_text", F.posexplode(runs).alias("place", "_m"))
    everyday = "|".join(lexicons.EVERYDAY)
    core = F.regexp_replace("_m.term", rf"(?U)^(?:(?:(?:{everyday})|\p{{Ll}}\S*)\s+)+(?=\S)", "")
    lead = F.expr("left(_m.term, length(_m.term) - length(_core))")
    # Before a term of a text stands what is before its first one, or a word and the gap after it.
    before = F.concat(F.when(F.col("place") > 0, F.lit("x")).otherwise(F.lit("")), "_m.gap", lead)
    term = F.regexp_replace(F.regexp_replace("_core", "[’']s$", ""), "^[’'-]+|[’'-]+$", "")
    start = F.col("_m.end") - F.length("_core")
    example = F.expr(f"substring(_text, greatest(0, _start - {AROUND}) + 1, _m.end + {AROUND} - greatest(0, _start - {AROUND}))")
    named = each.withColumn("_core", core).withColumns({"_start": start, "term": term, "inside": ~before.rlike(START)})
    named = named.where((F.length("term") >= 3) & ~F.col("term").isin(*lexicons.EVERYDAY) & ~F.col("term").rlike(r"(?U)^\d+$") & ~F.col("term").rlike(CONTRACTION))
    return named.select(*key, "place", "term", "inside", F.trim(F.regexp_replace(example, r"(?U)\s+", " ")).alias("example"))


def mined(texts: DataFrame, key: list[str], known: DataFrame, text: str = "text", least: int = 3, most: int = 80) -> DataFrame:
    """(term, n, example) of terms found ``least`` times and once within a sentence, but those of ``known`` (term; case aside): the ``most`` most frequent. The example is around
    the first place within a sentence, in order of ``key``."""
    rows = found_terms(texts, key, text)
    first = F.min(F.when(F.col("inside"), F.struct(*key, "place", "example")))
    counted = rows.groupBy("term").agg(F.count(F.lit(1)).alias("n"), first.alias("_first")).where((F.col("n") >= least) & F.col("_first").isNotNull())
    ignored = known.select(F.lower(F.trim("term")).alias("_lower")).distinct()
    fresh = counted.withColumn("_lower", F.lower("term")).join(ignored, "_lower", "left_anti")
    return fresh.select("term", "n", F.col("_first.example").alias("example")).orderBy(F.desc("n"), "term").limit(most)
