"""Spans of a text as array expressions: places of matches, unions of overlapping ones, risks of a source text."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import lexicons
from quillspark.operators.search import fold

KIND = "array<struct<start:int,end:int>>"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named within."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def occurrences(text: Column, term: Column) -> Column:
    """Spans (start, end; code points from 0, end exclusive) of a literal term, overlapping ones too. The text is split before each of them."""
    quoted = F.concat(F.lit(r"(?=\Q"), F.replace(term, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)"))
    first = F.when(F.startswith(text, term), F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    sizes = F.transform(F.split(text, quoted, -1), F.length)
    step = lambda at, n: F.struct((at["end"] + n).alias("end"), F.array_append(at["all"], at["end"] + n).alias("all"))
    starts = F.aggregate(F.slice(sizes, F.lit(1), F.greatest(F.size(sizes) - 1, F.lit(0))), F.struct(F.lit(0).alias("end"), F.array().cast("array<int>").alias("all")), step, lambda at: at["all"])
    spans = F.transform(F.concat(first, starts), lambda i: F.struct(i.alias("start"), (i + F.length(term)).alias("end")))
    return F.when(F.length(term) > 0, spans).otherwise(F.array().cast(KIND))


def union_spans(spans: Column) -> Column:
    """The union of spans as the fewest spans, in order; those that touch become one."""

    def step(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        meets = last.isNotNull() & (x["start"] <= last["end"])
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when(meets, F.array_append(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), longer)).otherwise(F.array_append(done, x))

    return F.aggregate(F.array_sort(spans), F.array().cast(KIND), step)


def _terms(query: Column) -> Column:
    return F.filter(F.split(F.trim(fold(query)), r"\s+"), lambda w: F.length(w) > 1)


def _holds(plain: Column, words: Column) -> Column:
    return (F.size(words) > 0) & F.forall(words, lambda w: F.contains(plain, w))


def holds(text: Column, query: Column) -> Column:
    """Whether a text has something that ``highlights`` shows: all of the query's terms. A text is folded once, and no places are looked for."""
    return bound(fold(text), lambda plain: _holds(plain, _terms(query)))


def covered(terms: list[str]) -> str:
    """A pattern of the stretches that the places of folded terms cover, overlapping and touching ones as one: each letter is one of a term's, with the rest of the term around it."""
    at = [(f"(?<={re.escape(t[:k])})" if k else "") + f"(?={re.escape(t[k:])})" for t in terms for k in range(len(t))]
    return f"(?s)(?:(?:{'|'.join(at)}).)+"


def highlights(text: Column, query: Column) -> Column:
    """What a reader highlights of a text: the union of all places of the query's terms (of two letters or more; case and accents aside); null if a term is
    nowhere in it or the query has none."""
    words = _terms(query)
    found = lambda plain: F.when(_holds(plain, words), union_spans(F.flatten(F.transform(words, lambda w: occurrences(plain, w)))))
    return bound(fold(text), found)


def marked(text: Column, spans: Column) -> Column:
    """The text in parts: (text, hit), in order, none empty."""
    edges = F.concat(F.array(F.lit(0)), F.flatten(F.transform(spans, lambda s: F.array(s["start"], s["end"]))), F.array(F.length(text)))

    def cut(e: Column) -> Column:
        part = lambda i: F.struct(F.substring(e["text"], F.get(e["edges"], i) + 1, F.get(e["edges"], i + 1) - F.get(e["edges"], i)).alias("text"), (i % 2 == 1).alias("hit"))
        return F.filter(F.transform(F.sequence(F.lit(0), F.size(e["edges"]) - 2), part), lambda p: p["text"] != "")

    return bound(F.struct(text.alias("text"), edges.alias("edges")), cut)


def matches(text: Column, pattern: str) -> Column:
    """Spans and texts of a pattern's matches, left to right without overlap. Their places follow from the lengths of what lies between them."""
    pair = F.arrays_zip(F.transform(F.split(text, pattern, -1), F.length).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("text"))

    def step(done: Column, x: Column) -> Column:
        start = F.coalesce(F.try_element_at(done, F.lit(-1))["end"], F.lit(0)) + x["gap"]
        return F.when(x["text"].isNull(), done).otherwise(F.array_append(done, F.struct(start.alias("start"), (start + F.length(x["text"])).alias("end"), x["text"].alias("text"))))

    return F.aggregate(pair, F.array().cast("array<struct<start:int,end:int,text:string>>"), step)


PARTICLE = r"(?i)\b([A-Za-z]+)\s+(up|off|out|down|over|away|back)\b"
EMPHASIS = r"[*_][^*_\n]+[*_]|!"
SPEECH = '["“”][^"“”\\n]{1,60}["“”]'


def common_verb(word: Column) -> Column:
    """Whether a word is one of the common verbs in a simple form."""
    verbs = F.array(*map(F.lit, lexicons.COMMON_VERBS))
    w = F.lower(word)
    ends = ((r"s$", ""), (r"ed$", ""), (r"d$", ""), (r"ing$", ""), (r"ing$", "e"))
    return reduce(lambda a, b: a | b, (F.array_contains(verbs, F.regexp_replace(w, *e)) for e in ends), F.array_contains(verbs, w))


def risks(source: Column) -> Column:
    """Where a translation is likely to go wrong: spans (start, end, reason) in order: a common verb with a particle, emphasis or exclamation, and
    quoted speech of six words or fewer."""
    tagged = lambda spans, reason: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(reason).alias("reason")))
    verbs = F.filter(matches(source, PARTICLE), lambda s: common_verb(F.regexp_extract(s["text"], r"^([A-Za-z]+)", 1)))
    short = F.filter(matches(source, SPEECH), lambda s: F.size(F.filter(F.split(s["text"], r"\s+"), lambda w: w != "")) <= 6)
    return F.array_sort(F.concat(tagged(verbs, "verb + particle"), tagged(matches(source, EMPHASIS), "emphasis or exclamation"), tagged(short, "short speech")))
