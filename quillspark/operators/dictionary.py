"""A dictionary as tables: stems and affixes to forms, membership of distinct words, words that do not exist, accents that can be restored."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import lexicons
from quillspark.operators.search import fold
from quillspark.operators.tables import kept

MARK = r"</?[aib]\d+>|<n\d+/>|<br>"
#: Bits of the filter for each form; with one hash, one of as many unknown words passes and is left to the join.
FILTER_BITS = 16
#: Bits of a row of the filter, as Spark's bitmap functions have them.
ROW_BITS = 8 * 4096


def affixed_forms(stems: DataFrame, affixes: DataFrame) -> DataFrame:
    """All forms of ``stems`` (word, flags: array of strings) as (form, stem). ``affixes``: flag, kind (prefix or suffix), strip, add, condition (a pattern of
    the stem's start or end), crosses (whether it goes with affixes of the other kind that cross too). Null flags are none. Joins on the flag; a stem's
    prefixes meet its suffixed forms by a join on the stem."""
    flagged = stems.select("word", F.explode("flags").alias("flag")).join(affixes, "flag")
    ends = flagged.where((F.col("kind") == "suffix") & F.endswith("word", F.col("strip")) & F.rlike("word", F.concat(F.lit("(?:"), "condition", F.lit(")$"))))
    suffixed = ends.select(F.col("word").alias("stem"), F.concat(F.expr("left(word, length(word) - length(strip))"), "add").alias("form"), "crosses")
    starts = flagged.where((F.col("kind") == "prefix") & F.startswith("word", F.col("strip")) & F.rlike("word", F.concat(F.lit("^(?:"), "condition", F.lit(")"))))
    prefixes = starts.select(F.col("word").alias("stem"), "strip", "add", F.col("crosses").alias("_crosses"))
    prefixed = prefixes.select("stem", F.concat("add", F.expr("substring(stem, length(strip) + 1)")).alias("form"))
    both = suffixed.where("crosses").join(prefixes.where("_crosses"), "stem").where(F.startswith("form", F.col("strip")))
    both = both.select("stem", F.concat("add", F.expr("substring(form, length(strip) + 1)")).alias("form"))
    plain = stems.select(F.col("word").alias("stem"), F.col("word").alias("form"))
    return plain.unionByName(suffixed.drop("crosses")).unionByName(prefixed).unionByName(both).select("form", "stem").distinct()


def _bit(word: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(bits))


def form_filter(forms: DataFrame, bits: int, column: str = "form") -> DataFrame:
    """A Bloom filter of one hash as a table of bitmaps: (bucket, map), 4 KB a row, ``bits`` / 8 bytes in all."""
    at = _bit(F.col(column), bits) + 1
    return forms.select(F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("map"))


def may_hold(words: DataFrame, column: str, table: DataFrame, bits: int) -> DataFrame:
    """The rows of ``words`` whose ``column`` may be a form, by the filter's bitmaps; all that are forms stay."""
    at = _bit(F.col(column), bits) + 1
    rows = words.withColumns({"bucket": F.bitmap_bucket_number(at), "_bit": F.bitmap_bit_position(at)})
    byte = "CAST(conv(hex(substring(map, CAST(floor(_bit / 8) AS INT) + 1, 1)), 16, 10) AS INT)"
    return rows.join(table, "bucket").where(F.expr(f"getbit({byte}, CAST(_bit % 8 AS INT)) = 1")).drop("bucket", "_bit", "map")


def known_words(candidates: DataFrame, forms: DataFrame, column: str = "candidate") -> DataFrame:
    """The rows of ``candidates`` that are forms: most others go by the filter, before the join deals anything. The forms are written once, as they are counted,
    put in the filter and joined. The filter is broadcast while it has less than 32 MB (some 16 million forms), beyond that it is joined by bucket."""
    forms = kept(forms.select("form").distinct(), "forms")
    n = forms.count()
    bits = max(ROW_BITS, FILTER_BITS * n)
    table = form_filter(forms, bits)
    table = F.broadcast(table) if bits // 8 <= 32 << 20 else table
    return may_hold(candidates, column, table, bits).join(forms.select(F.col("form").alias(column)), column, "left_semi")


def _readings(word: Column) -> Column:
    """What a word may be made of: itself; what follows a prefix (four letters or more, a doubled r or s made single); the adjective of an adverb."""

    def rest(prefix: str) -> Column:
        own = F.expr(f"substring(word, {len(prefix) + 1})")
        single = F.when(own.rlike("^(rr|ss)"), F.expr(f"substring(word, {len(prefix) + 2})"))
        return F.when(F.startswith("word", F.lit(prefix)) & (F.length(word) >= len(prefix) + 4), F.array_compact(F.array(own, single))).otherwise(F.array().cast("array<string>"))

    adverb = F.when(F.endswith("word", F.lit("mente")), F.array(F.regexp_replace(word, "mente$", ""), F.regexp_replace(word, ".mente$", "o"))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(word), F.flatten(F.array(*map(rest, dict.fromkeys(lexicons.PREFIXES)))), adverb))


def existing(words: DataFrame, forms: DataFrame) -> DataFrame:
    """Which of ``words`` (word, distinct) exist or are a prefix or -mente away from a word that does."""
    word = F.col("word")
    return known_words(words.select("word", F.explode(_readings(word)).alias("candidate")), forms).select("word").distinct()


def invented(pairs: DataFrame, forms: DataFrame, key: list[str], source: str = "src", out: str = "out") -> DataFrame:
    """``key`` and invented (array, in order of appearance) of the pairs whose output has words of five letters or more, in lower case, that do not exist, and
    neither are words of the source nor begin like one. Null texts have no words; keys are unique. Only distinct words meet the dictionary."""
    from_source = F.regexp_extract_all(F.lower(F.coalesce(source, F.lit(""))), F.lit(r"(?U)[^\W\d_]+"), F.lit(0))
    roots = F.transform(F.filter(from_source, lambda w: F.length(w) >= 5), lambda w: F.substring(w, 1, 5))
    shown = F.regexp_replace(F.coalesce(out, F.lit("")), MARK, " ")
    words = F.array_distinct(F.regexp_extract_all(shown, F.lit(r"(?U)(?<![\w-])[a-zà-ÿ]{5,}(?![\w-])"), F.lit(0)))
    odd = F.filter(F.array_except(words, from_source), lambda w: ~F.array_contains(roots, F.substring(fold(w), 1, 5)))
    each = pairs.select(*key, F.posexplode(odd).alias("_place", "word"))
    exist = existing(each.select("word").distinct(), forms)
    rest = each.join(exist, "word", "left_anti")
    return rest.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_place", "word"))), lambda s: s["word"]).alias("invented"))


def unknown(texts: DataFrame, forms: DataFrame, key: list[str], text: str) -> DataFrame:
    """``key`` and unknown (sorted array) of texts with words of four letters or more, not capitalised, that are no forms."""
    from quillspark.operators.spelling import WORD

    words = F.array_distinct(F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0)), lambda w: (F.length(w) >= 4) & ~w.rlike("^[A-ZÀ-ÖØ-Þ]") & ~F.contains(w, F.lit("'"))))
    each = texts.select(*key, F.explode(words).alias("word"))
    lower = each.select(F.lower("word").alias("candidate")).distinct()
    have = known_words(lower, forms)
    rest = each.withColumn("candidate", F.lower("word")).join(have, "candidate", "left_anti")
    return rest.groupBy(*key).agg(F.array_sort(F.collect_set("word")).alias("unknown"))


def accent_pairs(words: DataFrame) -> DataFrame:
    """(base, accented) for words of today (word: lower-case letters; others are left out) that exist with accents alone: the base is no word, has just one accented
    form, four letters or more, is no function word and no form of a verb. Regular plurals and feminines of the pair follow, where they are as
    safe (six letters or more); of several that lead to one base, the least. A few pairs hold by themselves. The words are written once, as all steps meet them."""
    own = kept(words.where(F.col("word").rlike("^[a-zà-ÿ]+$")).select("word").distinct(), "words")
    based = own.withColumn("base", fold(F.col("word")))
    marked = kept(based.where("base != word AND length(base) > 2").groupBy("base").agg(F.min("word").alias("accented"), F.count(F.lit(1)).alias("ways")), "marked")
    functional = F.col("base").isin(*lexicons.FUNCTION_WORDS)

    def safe(rows: DataFrame, least: int) -> DataFrame:
        """Without words, function words and forms of verbs."""
        stem = F.regexp_replace("base", "(as|os|es|am|em|a|o|e)$", "")
        rows = rows.where((F.length("base") >= least) & ~functional).join(own.select(F.col("word").alias("base")), "base", "left_anti")
        infinitives = rows.select("base", F.explode(F.array(*(F.concat(stem, F.lit(e)) for e in ("ar", "er", "ir")))).alias("word"), F.length(stem).alias("_n"))
        verbs = infinitives.where("_n >= 3").join(own, "word", "left_semi").select("base").distinct()
        return rows.join(verbs, "base", "left_anti")

    pairs = safe(marked.where("ways = 1"), 4).select("base", "accented")
    form = lambda cut, add: F.struct(*(F.concat(F.expr(f"left({c}, length({c}) - {cut})"), F.lit(add)).alias(c) for c in ("base", "accented")))
    none = F.array().cast("array<struct<base:string,accented:string>>")
    derived = F.concat(F.when(F.col("accented").rlike("[aeio]$"), F.array(form(0, "s"))).otherwise(none), F.when(F.endswith("accented", F.lit("o")), F.array(form(1, "a"), form(1, "as"))).otherwise(none))
    more = safe(pairs.select(F.explode(derived).alias("d")).select("d.*"), 6).join(marked.select("base"), "base", "left_anti")
    fixed = words.sparkSession.createDataFrame(list(lexicons.ACCENTED.items()), "base string, accented string")
    ranked = fixed.withColumn("_rank", F.lit(1)).unionByName(pairs.withColumn("_rank", F.lit(0))).unionByName(more.withColumn("_rank", F.lit(2)))
    return ranked.groupBy("base").agg(F.min(F.struct("_rank", "accented"))["accented"].alias("accented"))
