"""Quality rules and n-gram perplexity bands.

The base features are counts over whole texts. The method is a modified Kneser-Ney model of n-grams of ``ORDER`` characters (UTF-16 units:
case, accents and scripts stay apart; ASCII digits are one, and ASCII symbols but punctuation), counted by Spark over all distinct texts.
An n-gram is one 64-bit number. Probabilities of all orders are joins and sums
over tables of distinct n-grams; the model is the log probability of each n-gram of full order, in sorted arrays of 64-bit hashes. All that
is scored was counted, so one lookup, from a table of the leading bits, tells a character's probability.

A document's mean negative log probability, shrunk towards its language's mean as short texts vary more, has to lie in the band of its language:
quartiles of all distinct texts of the language, widened by ``LOWER`` and ``UPPER`` times their distance (``FLOOR`` at least).
Documents below are too repetitive, documents above are not prose of that language. Every row is judged; copies of a text (under
different ids) count once in the model, the mean and the quartiles. Sums are over integers, so that verdicts do not depend on the order of rows.

The model grows with the corpus. It is sent to the tasks in blocks of about ``BLOCK_GRAMS`` n-grams (12 bytes each), one block after
the other, with a pass over the texts for each; a task holds one block, whatever the model's size.

Cases: null text has no words and fails; null lang is a language of its own; rows that repeat are judged alike; a language of
few documents has the quartiles of those; very long texts are scored in runs; an empty table gives an empty result; other columns pass (names used
here start with an underscore).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm import kernels
from quillspark.llm.workspace import Workspace, hot_rows, join_by, small_side

ORDER = 4
#: How far the band goes below and above the quartiles, as multiples of their distance. Each is a fifth above the width at which 0.25 % of the
#: good documents are lost on its side, on the labelled rows of sf0.1 whose text has an even CRC-32; the others are held out for the test.
LOWER, UPPER = 1.8, 1.4
#: Least distance of the quartiles, in nats a character: a language whose texts are all alike still has a band.
FLOOR = 0.02
#: Characters of the language's mean that are mixed into a document's mean.
PRIOR = 1000
#: n-grams of the model that are broadcast at once.
BLOCK_GRAMS = 4_000_000
#: Distinct n-grams that a counting task holds before it sends them.
HELD_GRAMS = 400_000
#: Steps of a nat in which negative log probabilities are summed and perplexities are counted.
STEPS, BINS = 1_000_000, 1_000
SYMBOLS = "#*$%&|<>"
WINDOW_WORDS = 5
#: What stands before a text's first character; no character.
PAD = 0xFFFF
_UNIT_BITS = 16
PUNCTUATION = ".,;:!?'\"-()/"
_SAME = np.arange(1 << _UNIT_BITS, dtype=np.uint16)
_SAME[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) not in PUNCTUATION]] = ord("#")
_SAME[ord("0") : ord("9") + 1] = ord("0")


def units(data: np.ndarray) -> np.ndarray:
    """UTF-16 units of UTF-8 bytes that end at a code point, digits and symbols taken for one."""
    return _SAME[np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-16-le", "replace"), np.uint16)]


def grams(data: np.ndarray, offsets: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """For all characters of each text, the n-gram that ends there, as a number; and the texts' bounds."""
    b = data[int(offsets[first]) : int(offsets[last])]
    size = ((b & 0xC0) != 0x80).astype(np.int8) + (b >= 0xF0)
    bounds = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])[offsets[first : last + 1] - offsets[first]]
    pad = ORDER - 1
    starts = bounds + pad * np.arange(len(bounds))
    padded = np.full(int(starts[-1]), PAD, np.uint64)
    inside = np.ones(len(padded), bool)
    for k in range(pad):
        inside[starts[:-1] + k] = False
    padded[inside] = units(b)
    pairs = (padded[:-1] << np.uint64(_UNIT_BITS)) | padded[1:]
    key = (pairs[:-2] << np.uint64(2 * _UNIT_BITS)) | pairs[2:]
    return key[inside[pad:]], bounds


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct n-grams of a task's texts with their counts, combined as far as ``HELD_GRAMS`` allows."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def combine() -> tuple[np.ndarray, np.ndarray]:
        key, n = (np.concatenate(c) for c in zip(*held))
        key, where = np.unique(key, return_inverse=True)
        return key, np.bincount(where, n).astype(np.int64)

    def out(found: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in found], ["key", "n"])

    for batch in batches:
        data, offsets = kernels.text_buffers(batch.column("text"))
        for first, last in kernels.runs(offsets):
            held.append(np.unique(grams(data, offsets, first, last)[0], return_counts=True))
            size += len(held[-1][0])
            if size > HELD_GRAMS:
                held = [combine()]
                size = len(held[0][0])
                if 2 * size > HELD_GRAMS:
                    yield out(held[0])
                    held, size = [], 0
        pa.default_memory_pool().release_unused()
    if held:
        yield out(combine())


class Lookup:
    """n-grams with values, in the order of their hashes. A table of the leading bits of each hash tells where its search starts."""

    def __init__(self, grams: np.ndarray, values: np.ndarray):
        key = kernels.mix(grams)
        order = np.argsort(key)
        bits = max(1, 1 + len(key).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys, self.values = np.append(key[order], np.uint64(0)), np.append(values[order], np.int32(0))
        self.starts = np.searchsorted(self.keys[:-1] >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        """Values of n-grams, 0 where there is none."""
        key = kernels.mix(grams)
        slot = (key >> self.shift).astype(np.int64)
        at = self.starts[slot]
        miss = self.keys[at] != key
        out = self.values[at]
        out[miss] = 0
        left = np.flatnonzero(miss)
        at, end = at[left] + 1, self.starts[slot[left] + 1]
        while True:
            more = at < end
            left, at, end = left[more], at[more], end[more]
            if not len(left):
                return out
            hit = self.keys[at] == key[left]
            out[left[hit]] = self.values[at[hit]]
            at, end = np.where(hit, end, at + 1), end


# --- the model, in Spark ---


def _text_key() -> Column:
    return F.xxhash64("text")


def later_copies(docs: DataFrame, work: Workspace) -> DataFrame:
    """Rows (_id, _text) of texts that a document of smaller id has too."""
    keys = work.keep(docs.select(F.col("doc_id").alias("_id"), _text_key().alias("_text")), "keys")
    least = keys.groupBy("_text").agg(F.min("_id").alias("_least"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    least = work.keep(least, "texts")
    hot = least.where(F.col("_n") > hot_rows(keys.count())).select("_text")
    found = join_by(keys, least, "_text", hot).where(~F.col("_id").eqNullSafe(F.col("_least")))
    return work.keep(found.select("_id", "_text").distinct(), "copies")


def _probabilities(counted: DataFrame, work: Workspace) -> DataFrame:
    """Distinct n-grams (key, n) to (key, steps): negative log of the interpolated modified Kneser-Ney probability of the last character.

    Lower orders count distinct left extensions. Each order needs the totals of its contexts and the probabilities of the order below.
    """
    names = [f"c{k}" for k in range(ORDER)]
    unit = lambda k: F.shiftrightunsigned("key", (ORDER - 1 - k) * _UNIT_BITS).bitwiseAND(F.lit((1 << _UNIT_BITS) - 1)).cast("int")
    level = work.keep(counted.select("key", *(unit(k).alias(x) for k, x in enumerate(names)), "n"), f"order{ORDER}")
    levels = {ORDER: level}
    for k in range(ORDER - 1, 0, -1):
        levels[k] = work.keep(levels[k + 1].groupBy(*names[ORDER - k :]).agg(F.count(F.lit(1)).alias("n")), f"order{k}")
    below = None
    for k in range(1, ORDER + 1):
        seen = levels[k].agg(*(F.count_if(F.col("n") == j).alias(f"n{j}") for j in (1, 2, 3, 4)), F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("all")).first()
        c = [0, seen["n1"], seen["n2"], seen["n3"], seen["n4"]]
        y = c[1] / (c[1] + 2 * c[2]) if c[1] else 0.5
        d = [min(max(j - (j + 1) * y * c[j + 1] / c[j], 0.05), j - 0.05) if c[j] and c[j + 1] else 0.5 * j**0.5 for j in (1, 2, 3)]
        discount = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        own, context = names[ORDER - k :], names[ORDER - k : -1]
        kept = ["key"] if k == ORDER else own
        if k == 1:
            gamma = (d[0] * c[1] + d[1] * c[2] + d[2] * (seen["kinds"] - c[1] - c[2])) / max(seen["all"] or 0, 1)
            below = levels[1].select(*own, ((F.col("n") - discount) / (seen["all"] or 1) + F.lit(gamma / max(seen["kinds"], 1))).alias("p"))
            continue
        parts = [F.count_if(F.col("n") == 1) * d[0], F.count_if(F.col("n") == 2) * d[1], F.count_if(F.col("n") > 2) * d[2]]
        totals = levels[k].groupBy(*context).agg(F.sum("n").alias("total"), sum(parts, F.lit(0.0)).alias("spared"))
        joined = levels[k].join(totals, context).join(below, own[1:])
        below = joined.select(*kept, ((F.col("n") - discount + F.col("spared") * F.col("p")) / F.col("total")).alias("p"))
    return work.keep(below.select("key", F.round(F.log("p") * -STEPS).cast("int").alias("steps")), "model")


def fit(docs: DataFrame, work: Workspace) -> DataFrame:
    """The model (key, steps) of all distinct texts of ``docs`` (doc_id, text)."""
    copies = later_copies(docs, work)
    texts = docs.select("doc_id", _text_key().alias("_own"), "text")
    texts = texts.join(small_side(copies), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_text")), "left_anti")
    counted = texts.select("text").mapInArrow(_count, "key long, n long")
    return _probabilities(counted.groupBy("key").agg(F.sum("n").alias("n")), work)


def model_blocks(model: DataFrame, block: int = BLOCK_GRAMS) -> Iterator[Lookup]:
    """The model in parts of about ``block`` n-grams, by hash."""
    parts = max(1, -(-model.count() // block))
    for k in range(parts):
        table = model.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == k).toArrow()
        yield Lookup(table.column("key").to_numpy().view(np.uint64), table.column("steps").to_numpy())


# --- features ---


def _repeats(found: kernels.Words) -> np.ndarray:
    """For each row: words in windows of five that are found twice or more in it."""
    bounds, out = found.bounds, np.zeros(len(found.bounds) - 1, np.int64)
    size = WINDOW_WORDS
    counts = np.diff(bounds)
    if not (counts > size).any():
        return out
    value, starts = kernels.shingles(found, size)
    for r in np.flatnonzero(counts > size):
        h = value[starts[r] : starts[r + 1]]
        order = np.argsort(h, kind="stable")
        s = h[order]
        same = s[1:] == s[:-1]
        if same.any():
            twice = np.zeros(len(h) + 1, bool)
            twice[:-1][order[1:][same]] = True
            twice[:-1][order[:-1][same]] = True
            delta = np.zeros(len(h) + size + 1, np.int64)
            at = np.flatnonzero(twice)
            np.add.at(delta, at, 1)
            np.add.at(delta, at + size, -1)
            out[r] = np.count_nonzero(np.cumsum(delta) > 0)
    return out


def _dup_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(x) for x in SYMBOLS]] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_repeat_words", "n_dup_lines", "n_chars")


def features(texts: pa.Array) -> dict[str, np.ndarray]:
    """The base counts of each text, and its characters."""
    data, offsets = kernels.text_buffers(texts)
    rows = len(offsets) - 1
    out = {k: np.zeros(rows, np.int64) for k in COUNTS}
    for first, last in kernels.runs(offsets):
        found = kernels.words(data, offsets, first, last, fold=False)
        b = data[int(offsets[first]) : int(offsets[last])]
        at = offsets[first : last + 1] - offsets[first]
        sums = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[at])  # noqa: E731, B023
        place = slice(first, last)
        starts = (b & 0xC0) != 0x80
        out["n_words"][place] = np.diff(found.bounds)
        out["word_chars"][place] = sums(starts & ~kernels.WHITE[b])
        out["n_symbols"][place] = sums(_SYMBOL[b])
        out["n_repeat_words"][place] = _repeats(found)
        out["n_chars"][place] = sums(starts)
    out["n_dup_lines"] = np.fromiter((_dup_lines(t.as_py() or "") for t in texts), np.int64, rows)
    return out


def surprise(texts: pa.Array, model: Lookup) -> np.ndarray:
    """Negative log probability of each text's characters that ``model`` has, in steps of 1 / STEPS nat."""
    data, offsets = kernels.text_buffers(texts)
    out = np.zeros(len(offsets) - 1, np.int64)
    for first, last in kernels.runs(offsets):
        key, bounds = grams(data, offsets, first, last)
        sums = np.zeros(len(key) + 1, np.int64)
        np.cumsum(model(key), out=sums[1:])
        out[first:last] = np.diff(sums[bounds])
    return out


def _scored(docs: DataFrame, sent: Broadcast[Lookup], counts: bool) -> DataFrame:
    """``docs`` with ``_key``, ``_nll`` and, where asked, the base counts (an underscore before their names)."""
    names = [f"_{c}" for c in COUNTS] if counts else []

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = features(batch.column("text")) if counts else {}
            new = [pa.array(own[c]) for c in COUNTS if counts] + [pa.array(surprise(batch.column("text"), sent.value))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *names, "_nll"])
            pa.default_memory_pool().release_unused()

    keyed = docs.withColumn("_key", F.xxhash64("text", "lang"))
    fields = ", ".join(f"`{c}` {t}" for c, t in [*keyed.dtypes, *((n, "long") for n in [*names, "_nll"])])
    return keyed.mapInArrow(measure, fields)


def measure(docs: DataFrame, work: Workspace, text: bool = False, block: int = BLOCK_GRAMS) -> DataFrame:
    """``docs`` (without their text, if not asked for) with ``_key``, the base counts and ``_nll``, kept."""
    spark = docs.sparkSession
    found: DataFrame | None = None
    parts = []
    for k, lookup in enumerate(model_blocks(fit(docs, work), block)):
        sent = spark.sparkContext.broadcast(lookup)
        if found is None:
            scored = _scored(docs, sent, counts=True)
            found = work.keep(scored if text else scored.drop("text"), "features")
        else:
            more = _scored(docs.select("doc_id", "lang", "text"), sent, counts=False)
            parts.append(work.keep(more.groupBy("doc_id", "_key").agg(F.max("_nll").alias("_nll")), f"features{k}"))
        sent.destroy()
    if parts:
        rest = parts[0]
        for p in parts[1:]:
            rest = rest.unionAll(p)
        rest = rest.groupBy(F.col("doc_id").alias("_i"), F.col("_key").alias("_k")).agg(F.sum("_nll").alias("_more"))
        rest = small_side(work.keep(rest, "more"))
        columns = found.columns
        work.drop_but("features", "more")
        found = found.join(rest, F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("_key") == F.col("_k"))).withColumn("_nll", F.col("_nll") + F.col("_more")).select(*columns)
    else:
        work.drop_but("features")
    return found


def with_verdict(measured: DataFrame, work: Workspace, lower: float = LOWER, upper: float = UPPER) -> DataFrame:
    """Adds ``_base_failed``, ``_perplexity`` (shrunk mean negative log probability) and ``_kept`` to what ``measure`` gave."""
    failed = (F.col("_n_words") < 10) | (100 * F.col("_n_repeat_words") > 20 * F.col("_n_words"))
    measured = measured.withColumn("_base_failed", failed)
    # One row for each text of a language: copies move neither the mean nor the quartiles.
    once = measured.groupBy("lang", "_key").agg(*(F.first(c).alias(c) for c in ("_nll", "_n_chars", "_base_failed")))
    once = work.keep(once, "once")
    mean = once.groupBy("lang").agg((F.sum("_nll") / F.greatest(F.sum("_n_chars"), F.lit(1)) / STEPS).alias("_mean"))
    # A row a language: measured, and then broadcast, so that texts are not dealt by a key of few values.
    mean = small_side(work.keep(mean.select(F.col("lang").alias("_own_lang"), "_mean"), "means"))

    def with_perplexity(rows: DataFrame) -> DataFrame:
        value = (F.col("_nll") / STEPS + PRIOR * F.col("_mean")) / (F.col("_n_chars") + PRIOR)
        return rows.join(mean, F.col("lang").eqNullSafe(F.col("_own_lang"))).withColumn("_perplexity", value).drop("_own_lang", "_mean")

    # Quartiles of the counts by bin: exact to a bin, and the same whatever the order of rows.
    counted = with_perplexity(once).where(~F.col("_base_failed")).groupBy("lang", F.floor(F.col("_perplexity") * BINS).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("lang").orderBy("bin")
    ranked = counted.withColumns({"upto": F.sum("n").over(upto), "all": F.sum("n").over(Window.partitionBy("lang"))})
    quarter = lambda k: (F.min(F.when(4 * F.col("upto") >= k * F.col("all"), F.col("bin"))) / BINS).alias(f"_q{k}")
    bands = small_side(work.keep(ranked.groupBy(F.col("lang").alias("_band_lang")).agg(quarter(1), quarter(3)), "bands"))
    joined = with_perplexity(measured).join(bands, F.col("lang").eqNullSafe(F.col("_band_lang")), "left")
    apart = F.greatest(F.col("_q3") - F.col("_q1"), F.lit(FLOOR))
    inside = F.col("_perplexity").between(F.col("_q1") - lower * apart, F.col("_q3") + upper * apart)
    return joined.withColumn("_kept", ~F.col("_base_failed") & F.coalesce(inside, F.lit(True))).drop("_band_lang", "_q1", "_q3")


def judge(docs: DataFrame, lower: float = LOWER, upper: float = UPPER, block: int = BLOCK_GRAMS) -> DataFrame:
    """doc_id, lang, the base counts, base_failed, perplexity and kept for each row of docs."""
    work = Workspace(docs.sparkSession, "quality")
    found = with_verdict(measure(docs.select("doc_id", "lang", "text"), work, block=block), work, lower, upper)
    names = [*COUNTS, "base_failed", "perplexity", "kept"]
    return found.select("doc_id", "lang", *(F.col(f"_{c}").alias(c) for c in names))


def keep_quality(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns. The texts are kept with their scores, so no join moves them."""
    work = Workspace(docs.sparkSession, "quality")
    return with_verdict(measure(docs, work, text=True), work).where("_kept").select(*docs.columns)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "perplexity", "lang")
