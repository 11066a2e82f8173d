"""Accent-insensitive search over text units, with citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.folding import accent_table


def fold(text: Column) -> Column:
    """Lower case without accents, character by character, so that places stay."""
    return F.lower(F.translate(text, *accent_table()))


def search(units: DataFrame, terms: list[str], limit: int = 60, text: str = "text", order: tuple[str, ...] = ("book", "ord")) -> DataFrame:
    """Units that hold all terms, with a snippet around the first; the first ``limit`` in order (a top-k, no full sort)."""
    folded = [fold(F.lit(t)) for t in terms]
    hits = units.withColumn("_f", fold(F.col(text)))
    for term in folded:
        hits = hits.where(F.contains("_f", term))
    at = F.greatest(F.lit(1), F.instr("_f", folded[0]) - 90)
    return hits.withColumn("snippet", F.substring(text, at, F.lit(260))).drop("_f").orderBy(*order).limit(limit)


def cite(author: Column, title: Column, page: Column) -> Column:
    return F.concat_ws(", ", author, title, F.concat(F.lit("p. "), page.cast("string")))
