"""Errors planted in outputs, for judging checks: native expressions over sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import lexicons
from quillspark.functions.checks import sentences

KINDS = ("clean", "omission", "addition", "number", "negation", "source language", "softening")


def planted(pairs: DataFrame, key: list[str], order: list[str], source: str = "src", out: str = "out", of_pair: dict[str, Column] | None = None) -> DataFrame:
    """Each pair as it is, and with one error of each type that its output allows: (columns of ``pairs``, ``of_pair``, type, planted). What ``of_pair`` says of a pair's
    columns is computed once for all its errors.

    ``key``: a book's pairs, ``order``: their order in it. An error is at sentence k (from 1 on, by the pair's number; outputs of one sentence have none there):
    that sentence goes, the first sentence of the pair five on comes before it, or the source's stands in its place (where both have as many). A number of
    two digits or more that the source has too grows by 7; the first ' não ' goes; the first strong word of the list gets its weak one."""
    own = Window.partitionBy(*key).orderBy(*order)
    said, asked = sentences(F.col(out)), sentences(F.col(source))
    rows = pairs.withColumns({"_fr": said, "_fe": asked, "_n": F.row_number().over(own) - 1})
    rows = rows.withColumn("_k", F.when(F.size("_fr") >= 2, 1 + F.col("_n") % (F.size("_fr") - 1)).cast("int"))
    # The pair five on, in a circle: only first sentences are looked at.
    first = rows.select(*key, ((F.col("_n") - 5)).alias("_at"), F.get("_fr", F.lit(0)).alias("_more"))
    count = pairs.groupBy(*key).agg(F.count(F.lit(1)).alias("_count"))
    turned = first.join(count, key).select(*key, F.pmod(F.col("_at"), F.col("_count")).cast("int").alias("_n"), "_more")
    rows = rows.join(turned, [*key, "_n"])

    joined = lambda parts: F.array_join(parts, " ")
    k, parts = F.col("_k"), F.col("_fr")
    before, after = F.slice(parts, F.lit(1), k), F.slice(parts, k + 2, F.size(parts))
    at = F.get(parts, k)
    text = F.col(out)
    around = r"(?sU)\A(.*?)\b(\d{2,})\b(.*)\z"
    number = F.regexp_extract(text, around, 2)
    grown = F.concat(F.regexp_extract(text, around, 1), (number.try_cast("decimal(38,0)") + 7).cast("string"), F.regexp_extract(text, around, 3))
    softer = F.lit(None).cast("string")
    for strong, weak in reversed(lexicons.WEAK.items()):
        word = rf"(?U)\b{strong}\b"
        softer = F.when(text.rlike(word), F.regexp_replace(text, rf"(?s){word}(.*)\z", f"{weak}$1")).otherwise(softer)
    made = {
        "clean": text,
        "omission": F.when(k.isNotNull(), joined(F.concat(before, after))),
        "addition": F.when(k.isNotNull(), joined(F.concat(before, F.array(F.coalesce("_more", F.lit(""))), F.array(at), after))),
        "number": F.when((number != "") & F.contains(F.col(source), number), grown),
        "negation": F.when(F.contains(text, F.lit(" não ")), F.regexp_replace(text, r"(?s) não (.*)\z", " $1")),
        "source language": F.when(k.isNotNull() & (F.size("_fe") == F.size("_fr")), joined(F.concat(before, F.array(F.get("_fe", k)), after))),
        "softening": softer,
    }
    every = F.explode(F.array(*(F.struct(F.lit(kind).alias("type"), made[kind].alias("planted")) for kind in KINDS)))
    kept = [*pairs.columns, *(of_pair or {})]
    rows = rows.withColumns(of_pair) if of_pair else rows
    return rows.select(*kept, every.alias("_x")).where("_x.planted IS NOT NULL").select(*kept, "_x.type", "_x.planted")
