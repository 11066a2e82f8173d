"""Benchmark decontamination by greedy string tiling.

Tokens are words split at white space and ASCII punctuation, A-Z lower-cased. A benchmark item and a document that share a seed (five
tokens in a row) are tiled: running Karp-Rabin hashes of windows of unmarked tokens, at lengths that close in on the longest at which
both sides have an equal window, give the longest matches; they are marked in both, again and again, until none of five tokens is left.
Tiles may lie in any order, so reordered passages are caught. A pair counts where tiles cover at least ``COVERAGE`` of the item's tokens.

The benchmark is read in blocks of at most ``BLOCK_TOKENS`` tokens (an item at least), each sent to all tasks. A pass over the documents
holds them against ``PASS_BLOCKS`` blocks; the corpus itself does not move. A pass is written before the next one's blocks come to the driver.

Cases: null or empty texts match nothing; items of fewer than five tokens are too short to be evidence and match nothing; repeated
rows get equal results; equal items match alike; ids of any type; an empty table on either side gives no pairs; other columns pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import kernels
from quillspark.llm.workspace import Workspace

SEED = 5
#: Share of an item that tiles must cover. One-sided containment, not a similarity of two texts.
COVERAGE = 0.6
BLOCK_TOKENS = 500_000
PASS_BLOCKS = 4

BREAKS = kernels.WHITE.copy()
BREAKS[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = True


class Index(NamedTuple):
    """A block of items: ids, token hashes, and all seeds in order of hash with the item and place of each."""

    ids: list[str | None]
    tokens: list[np.ndarray]
    seeds: np.ndarray
    item: np.ndarray
    place: np.ndarray


def build(ids: list[str | None], texts: list[str]) -> Index:
    data, offsets = kernels.text_buffers(pa.array(texts, pa.string()))
    found = kernels.words(data, offsets, 0, len(texts), breaks=BREAKS)
    value, bounds = kernels.shingles(found, SEED)
    counts = np.diff(found.bounds)
    tokens = [found.hash[a:b] for a, b in zip(found.bounds, found.bounds[1:])]
    item = np.repeat(np.arange(len(texts)), np.diff(bounds))
    place = np.arange(len(value)) - bounds[item]
    usable = counts[item] >= SEED
    value, item, place = value[usable], item[usable], place[usable]
    order = np.argsort(value, kind="stable")
    return Index(ids, tokens, value[order], item[order], place[order])


class Side:
    """One of the two token sequences, with running hashes of its windows and with its marks."""

    def __init__(self, tokens: np.ndarray):
        up, self.down = kernels.powers(len(tokens) + 1)
        self.sums = np.zeros(len(tokens) + 1, np.uint64)
        np.cumsum(tokens * up[: len(tokens)], out=self.sums[1:])
        self.used = np.zeros(len(tokens), bool)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of all windows of ``size`` unmarked tokens."""
        marks = np.concatenate([[0], np.cumsum(self.used)])
        at = np.flatnonzero(marks[size:] == marks[:-size]) if size < len(marks) else np.zeros(0, np.int64)
        return at, (self.sums[at + size] - self.sums[at]) * self.down[at]


def tile(pattern: np.ndarray, text: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy string tiling. Returns tiles (place in pattern, place in text, length), the longest first, earliest on ties."""
    a, b = Side(pattern), Side(text)
    tiles: list[tuple[int, int, int]] = []

    def shared(size: int) -> np.ndarray:
        """Places of the pattern whose window of ``size`` tokens the text has too."""
        at, h = a.windows(size)
        return at[np.isin(h, b.windows(size)[1])]

    most = min(len(pattern), len(text))
    while most >= least and len(shared(least)):
        low, high = least, most  # a run of ``low`` tokens is shared; none above ``high``
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if len(shared(middle)) else (low, middle - 1)
        most = low
        own = shared(most)
        value = (a.sums[own + most] - a.sums[own]) * a.down[own]
        for p, h in zip(own.tolist(), value):
            if a.used[p : p + most].any():
                continue
            places, hashes = b.windows(most)
            met = np.flatnonzero(hashes == h)
            if len(met):
                t = int(places[met[0]])
                a.used[p : p + most] = b.used[t : t + most] = True
                tiles.append((p, t, most))
    return tiles


def match(index: Index, data: np.ndarray, offsets: np.ndarray, coverage: float = COVERAGE) -> Iterator[tuple[int, int, int, int]]:
    """(row, item's place in the block, tokens covered, tiles) for each pair that reaches the coverage."""
    if not len(index.seeds):
        return
    for first, last in kernels.runs(offsets):
        found = kernels.words(data, offsets, first, last, breaks=BREAKS)
        value, bounds = kernels.shingles(found, SEED)
        at = np.minimum(np.searchsorted(index.seeds, value), len(index.seeds) - 1)
        hits = np.flatnonzero(index.seeds[at] == value)
        rows = np.searchsorted(bounds, hits, "right") - 1
        for lo, hi in zip(*_groups(rows)):
            row = int(rows[lo])
            own = found.hash[found.bounds[row] : found.bounds[row + 1]]
            if len(own) < SEED:
                continue
            spots: dict[int, set[int]] = {}
            for k, h in zip(*(x.tolist() for x in np.unique(at[hits[lo:hi]], return_index=True))):
                while k < len(index.seeds) and index.seeds[k] == value[hits[lo + h]]:
                    spots.setdefault(int(index.item[k]), set()).add(int(index.place[k]))
                    k += 1
            for item, places in sorted(spots.items()):
                pattern = index.tokens[item]
                reach = np.zeros(len(pattern), bool)
                for p in places:
                    reach[p : p + SEED] = True
                if reach.sum() < coverage * len(pattern):  # tiles consist of seeds
                    continue
                tiles = tile(pattern, own)
                covered = sum(k for _, _, k in tiles)
                if covered >= coverage * len(pattern):
                    yield first + row, item, covered, len(tiles)


def _groups(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(rows)) + 1
    return (np.concatenate([[0], edges]), np.concatenate([edges, [len(rows)]])) if len(rows) else (edges, edges)


def _blocks(benchmark: DataFrame, tokens: int) -> Iterator[tuple[list[str | None], list[str]]]:
    ids, texts, size = [], [], 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").orderBy("item_id", "text").toLocalIterator():
        ids.append(row[0])
        texts.append(row[1] or "")
        size += len(texts[-1].split())
        if size >= tokens:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _passes(benchmark: DataFrame, tokens: int) -> Iterator[list[Broadcast]]:
    """The benchmark's blocks as broadcasts, those of one pass together."""
    context = benchmark.sparkSession.sparkContext
    held: list[Broadcast] = []
    for block in _blocks(benchmark, tokens):
        held.append(context.broadcast(block))
        if len(held) == PASS_BLOCKS:
            yield held
            held = []
    if held:
        yield held


def find_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Pairs (doc_id, item_id, item_tokens, covered, tiles, coverage) of documents that hold benchmark items."""
    spark = docs.sparkSession
    kind, item_kind = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    schema = f"doc_id {kind}, item_id string, item_tokens long, covered long, tiles long, coverage double"

    def one_pass(sent: list[Broadcast]) -> DataFrame:
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            indexes = [build(*block.value) for block in sent]
            for batch in batches:
                data, offsets = kernels.text_buffers(batch.column("text"))
                for index in indexes:
                    found = list(match(index, data, offsets, coverage))
                    take = pa.array([f[0] for f in found], pa.int64())
                    size = [len(index.tokens[f[1]]) for f in found]
                    ids = pa.array([index.ids[f[1]] for f in found], pa.string())
                    counts = [pa.array(x, pa.int64()) for x in (size, [f[2] for f in found], [f[3] for f in found])]
                    share = pa.array([f[2] / n for f, n in zip(found, size)], pa.float64())
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), ids, *counts, share], ["doc_id", "item_id", "item_tokens", "covered", "tiles", "coverage"])

        return docs.select("doc_id", "text").mapInArrow(search, schema)

    out = _by_pass(benchmark, block_tokens, Workspace(spark, "leaks"), one_pass)
    return (spark.createDataFrame([], schema) if out is None else out).withColumn("item_id", F.col("item_id").cast(item_kind))


def _by_pass(benchmark: DataFrame, tokens: int, work: Workspace, one_pass: Callable[[list[Broadcast]], DataFrame]) -> DataFrame | None:
    """What all passes find. Of several, each is written before the next one's blocks are read, and its blocks go; so the driver holds one pass, however
    large the benchmark."""
    kept, last = None, None
    for k, sent in enumerate(_passes(benchmark, tokens)):
        if last is not None:
            written = work.keep(one_pass(last), f"pass{k - 1}")
            kept = written if kept is None else kept.unionAll(written)
            for block in last:
                block.destroy()
        last = sent
    if last is None:
        return None
    return one_pass(last) if kept is None else kept.unionAll(one_pass(last))


def decontaminate(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item. Each pass drops what its blocks cover, so nothing is joined or shuffled; where the
    benchmark takes several passes, what a pass leaves is written before the next."""
    work = Workspace(docs.sparkSession, "leaks")

    def cleaned(rows: DataFrame, sent: list[Broadcast]) -> DataFrame:
        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            indexes = [build(*block.value) for block in sent]
            for batch in batches:
                data, offsets = kernels.text_buffers(batch.column("text"))
                stays = np.ones(batch.num_rows, bool)
                for index in indexes:
                    stays[[f[0] for f in match(index, data, offsets, coverage)]] = False
                yield batch.filter(pa.array(stays))

        return rows.mapInArrow(clean, docs.schema)

    kept, last = docs, None
    for k, sent in enumerate(_passes(benchmark, block_tokens)):
        if last is not None:
            kept = work.keep(cleaned(kept, last), f"pass{k}")
            if k > 1:
                work.drop(f"pass{k - 1}")
            for block in last:
                block.destroy()
        last = sent
    return kept if last is None else cleaned(kept, last)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return find_leaks(docs, benchmark)
