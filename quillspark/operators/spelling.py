"""Modernising the spelling of words, as DataFrame operations over distinct words: rules are expressions, dictionaries are joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.align import REFORMS
from quillspark.functions.folding import accent_table
from quillspark.operators.tables import kept

# Regular changes of spelling, in the order in which they apply, as (pattern, replacement).
RULES = (
    ("ph", "f"),
    ("rh", "r"),
    ("th", "t"),
    ("y", "i"),
    ("(?<=[aeiou])ll(?=[aeiou])", "l"),
    ("mm", "m"),
    ("nn", "n"),
    ("tt", "t"),
    ("pp", "p"),
    ("ff", "f"),
    ("cc(?=[aou])", "c"),
    ("gg", "g"),
    ("dd", "d"),
    ("bb", "b"),
    ("mpt", "nt"),
    ("^sc(?=[ie])", "c"),
    ("^d'", "d"),
    ("^n'", "n"),
    ("aes$", "ais"),
    ("ae$", "ai"),
    ("óe$", "ói"),
    ("^quasi$", "quase"),
    ("^póde$", "pode"),
    ("encia(s?)$", "ência$1"),
    ("ancia(s?)$", "ância$1"),
    ("avel$", "ável"),
    ("ivel$", "ível"),
    ("uvel$", "úvel"),
    ("ario(s?)$", "ário$1"),
    ("orio(s?)$", "ório$1"),
    ("icio(s?)$", "ício$1"),
)

# Changes that also fit words of today. One (or two in a row) counts only if it leads to just one word of the dictionary.
REPAIRS = (
    ("(?<=[aeiou])ct(?=[aeiou])", "t"),
    ("(?<![qg])ue$", "ui"),
    ("cç", "ç"),
    ("pç", "ç"),
    ("(?<=[aeiouóéí])pt", "t"),
    ("(?<=[aeiou])h(?=[aeiou])", ""),
    ("^h(?=[aeiou])", ""),
    ("(?<=[aeiou])hi", "í"),
    ("(?<=[aeiou])hu", "ú"),
    ("ãi(s?)$", "ãe$1"),
    ("éia", "eia"),
    ("éa(s?)$", "eia$1"),
    ("ói(?=[acd])", "oi"),
    ("ezes$", "eses"),
    ("ez$", "ês"),
    ("eza(s?)$", "esa$1"),
    ("az$", "ás"),
    ("oz$", "ôs"),
    ("(?<=[aeiouáéíóú])z(?=[aeiou])", "s"),
    ("(?<=[aeiou])s(?=[aeiou])", "z"),
    ("^e(?=[gdq])", "i"),
    ("ch(?=[aourlnmt])", "c"),
    ("ch(?=[ei])", "qu"),
    ("x(?=[tpcg])", "s"),
    ("gn(?=[aeiou])", "n"),
    ("mn", "n"),
    ("gm", "m"),
    ("ü", "u"),
    ("^k(?=[ei])", "qu"),
    ("ou", "oi"),
)
# Accents that a repair takes off, as (letters, letters without).
REPAIR_ACCENTS = (("âêô", "aeo"), ("èò", "eo"))

# A word, and what makes it look like old spelling.
WORD = "[A-Za-zÀ-ÿ]+(?:[-'][A-Za-zÀ-ÿ]+)*"
ANTIQUE = "(?i)ph|th|mm|nn|tt|pp|ff|[aeiou]ll[aeiou]|y|mpt|aes$|[^qg]ue$|^d'"


def leftovers(text: Column) -> Column:
    """The words of a text that still look like old spelling, sorted; proper names (capitalised words) are left out."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: ~w.rlike("^[A-ZÀ-ÖØ-Þ]") & w.rlike(ANTIQUE))))


def skeleton(word: Column) -> Column:
    """A word without accents, reformed spellings and doubled letters: ``functions.align.skeleton`` as an expression."""
    plain = F.lower(F.translate(word, *accent_table()))
    reformed = reduce(lambda x, change: F.replace(x, F.lit(change[0]), F.lit(change[1])), REFORMS, plain)
    return F.regexp_replace(reformed, r"(.)\1+", "$1")


def _regular(word: Column) -> Column:
    return reduce(lambda x, rule: F.regexp_replace(x, *rule), RULES, word)


def _one_repair(word: Column) -> Column:
    """What each repair alone makes of a word, where it changes it."""
    made = [F.regexp_replace(word, *r) for r in REPAIRS] + [F.translate(word, *r) for r in REPAIR_ACCENTS]
    return F.array_distinct(F.filter(F.array(*made), lambda x: x != word))


def _accented(words: DataFrame, column: str, accents: DataFrame) -> DataFrame:
    """``words`` with ``column`` in its accented form, where the table has one."""
    return words.join(accents.select(F.col("base").alias(column), "accented"), column, "left").withColumn(column, F.coalesce("accented", column)).drop("accented")


def repairs(words: DataFrame, known: DataFrame, accents: DataFrame) -> DataFrame:
    """Words (word) to (word, repaired) where one repair, or else two in a row, leads to known words, and to one alone. What one repair makes is written once, for both."""
    known = known.select(F.col("word").alias("candidate")).distinct()

    def step(rows: DataFrame, source: str) -> DataFrame:
        made = rows.select("word", F.explode(_one_repair(F.col(source))).alias("candidate"))
        return _accented(made, "candidate", accents).distinct()

    def valid(candidates: DataFrame) -> DataFrame:
        return candidates.join(known, "candidate").groupBy("word").agg(F.count(F.lit(1)).alias("ways"), F.min("candidate").alias("repaired"))

    one = kept(step(words.select("word"), "word"), "repaired")
    first = valid(one)
    second = valid(step(one.join(first, "word", "left_anti"), "candidate"))
    return first.unionByName(second).where("ways = 1").select("word", "repaired")


def modernise(words: DataFrame, lexicon: DataFrame, accents: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Distinct words (word) to (word, modern). ``lexicon`` (old, new) goes first; proper names stay; regular changes follow. With ``known``
    (words of today) what is unknown then gets its accent or is repaired; without it, accents and two changes of ends apply to all."""
    rows = words.select("word", F.lower("word").alias("low")).join(lexicon.select(F.col("old").alias("low"), "new"), "low", "left")
    name = F.col("word").rlike("^[A-ZÀ-ÖØ-Þ]") & (F.upper("word") != F.col("word"))
    rows = rows.withColumns({"name": name, "regular": _regular(F.col("low"))})
    if known is not None:
        rows = kept(rows, "regular")
    if known is None:
        rows = _accented(rows, "regular", accents)
        plain = F.regexp_replace(F.regexp_replace("regular", "(?<=[aeiou])ct(?=[aeiou])", "t"), "(?<![qg])ue$", "ui")
        rows = rows.withColumn("made", plain)
    else:
        have = known.select(F.col("word").alias("regular"), F.lit(True).alias("exists")).distinct()
        rows = rows.join(have, "regular", "left").withColumn("exists", F.coalesce("exists", (F.length("regular") < 3) | F.contains("regular", F.lit("'"))))
        marked = accents.join(known.select(F.col("word").alias("accented")).distinct(), "accented").select(F.col("base").alias("regular"), "accented")
        odd = rows.where("NOT exists AND new IS NULL AND NOT name").select(F.col("regular").alias("word")).distinct()
        repaired = repairs(odd, known, accents).withColumnRenamed("word", "regular")
        rows = rows.join(marked, "regular", "left").join(repaired, "regular", "left")
        rows = rows.withColumn("made", F.when(F.col("exists"), F.col("regular")).otherwise(F.coalesce("accented", "repaired", "regular")))
    chosen = F.coalesce("new", F.when(F.col("name"), F.col("word")).otherwise(F.col("made")))
    capital = F.concat(F.upper(F.substring(chosen, 1, 1)), F.lower(F.expr("substring(coalesce(new, made), 2)")))
    shout = (F.upper("word") == F.col("word")) & (F.length("word") > 1)
    cased = F.when(shout, F.upper(chosen)).when(F.col("word").rlike("^[A-ZÀ-ÖØ-Þ]"), F.when(F.col("new").isNull() & F.col("name"), F.col("word")).otherwise(capital)).otherwise(chosen)
    return rows.select("word", cased.alias("modern"))
