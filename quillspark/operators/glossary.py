"""A glossary over texts: all of its terms in one pass, by automata over blocks of them."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.search import fold

#: Letters of the terms of one automaton; each block of them is a pass over the texts.
BLOCK_LETTERS = 8_000_000


def term_blocks(terms: DataFrame, limit: int = BLOCK_LETTERS) -> Iterator[list[str]]:
    """Distinct terms (term), in blocks of about ``limit`` letters. A block at a time is on the driver."""
    distinct = terms.where(F.length("term") > 0).select("term").distinct()
    letters = distinct.agg(F.coalesce(F.sum(F.length("term") + 1), F.lit(0))).first()[0]
    blocks = max(1, -(-letters // limit))
    for k in range(blocks):
        own = [r["term"] for r in distinct.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == k).collect()]
        if own:
            yield own


def term_hits(units: DataFrame, key: list[str], text: str, terms: DataFrame, limit: int = BLOCK_LETTERS) -> DataFrame:
    """(key, term, hits, bounded) for each unit and term (folded) that is in the unit's folded text: ``hits`` occurrences with no letter to their left, left to right
    without overlap of a term with itself, so inflected ends count; ``bounded`` is false if it only stands within words. Null texts hold nothing."""
    kinds = dict(units.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in key), "term string", "hits long"])
    folded = units.select(*key, fold(F.col(text)).alias("_folded")).where(F.col("_folded").isNotNull())

    def scan(block: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = ahocorasick.Automaton()
            for k, term in enumerate(block):
                automaton.add_word(term, k)
            automaton.make_automaton()
            for batch in batches:
                rows, which, counts = [], [], []
                for row, body in enumerate(batch.column("_folded").to_pylist()):
                    found: dict[int, list[int]] = {}  # term: hits, end of the last one
                    for last, k in automaton.iter(body):
                        start = last + 1 - len(block[k])
                        own = found.setdefault(k, [0, 0])
                        if start >= own[1] and not (start and "a" <= body[start - 1] <= "z"):
                            own[0], own[1] = own[0] + 1, last + 1
                    rows += [row] * len(found)
                    which += [block[k] for k in found]
                    counts += [n for n, _ in found.values()]
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in key), pa.array(which, pa.string()), pa.array(counts, pa.int64())], [*key, "term", "hits"])

        return folded.mapInArrow(run, schema)

    found = None
    for block in term_blocks(terms, limit):
        found = scan(block) if found is None else found.unionAll(scan(block))
    if found is None:
        found = units.sparkSession.createDataFrame([], schema)
    return found.withColumn("bounded", F.col("hits") > 0)


def glossary_usage(units: DataFrame, key: list[str], text: str, glossary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``glossary``: source, use, avoid, unless (alternatives divided by '|'; null or empty: none). Two tables: (source, used) with how often the words to
    use are used; and (key, source, avoid) of units with a word to avoid and nothing of ``unless``, which counts within words too."""
    alternatives = lambda c: F.explode(F.array_distinct(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda x: fold(F.trim(x))), lambda x: x != "")))
    role = lambda name: glossary.select("source", alternatives(F.col(name)).alias("term"))
    use, avoid, unless = role("use"), role("avoid"), role("unless")
    hits = term_hits(units, key, text, use.unionAll(avoid).unionAll(unless).select("term"))
    used = hits.where("bounded").groupBy("term").agg(F.sum("hits").alias("n")).join(use, "term").groupBy("source").agg(F.sum("n").alias("used"))
    counted = glossary.select("source").distinct().join(used, "source", "left").select("source", F.coalesce("used", F.lit(0)).cast("long").alias("used"))
    wrong = hits.where("bounded").join(avoid, "term").select(*key, "source", F.col("term").alias("avoid"))
    excused = hits.join(unless, "term").select(*key, "source").distinct()
    return counted, wrong.join(excused, [*key, "source"], "left_anti")
