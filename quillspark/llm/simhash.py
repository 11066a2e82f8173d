"""Near-duplicates by SimHash fingerprints, found with covering locality-sensitive hashing.

1. A fingerprint has 64 bits. Bit k is set if it is set in over half of the XXH64 hashes (seed 42) of a text's word shingles, repeats
   included. Texts are hashed whole, a run of rows at a time.
2. Equal fingerprints are one node from here on; so copies of a text, however many, are one row.
3. Covering masks: bit k stands for one of the ``2 ** (radius + 1) - 1`` non-zero vectors of ``radius + 1`` bits, in turn. Table v (a vector
   too) keeps the bits whose vector has an odd product with v. ``radius`` vectors span less than the whole space, so some v is orthogonal
   to all of them, and a pair that differs in those bits alone is equal on that table's mask. No pair within the radius is missed.
4. A table's bucket (equal masked bits) is searched in one task: those of up to ``PAIRED`` fingerprints by comparing them, larger ones by the
   fingerprints' neighbours at one flipped bit, as two within distance 2 share such a neighbour or are one themselves (radii above 2: by
   comparing, a row against all at once). Buckets of a large share of the rows never reach a task: their fingerprints' neighbours are
   shuffled instead, each neighbour having 65 fingerprints at most (radius 2 at most; beyond that a bucket is not split).
5. Components of the links; the least doc_id of a component is its name.

Cases: null and empty texts and those without words have the fingerprint zero and link like any other; texts of fewer words than a shingle
are one shingle; null ids keep their rows, and a component of null ids only has a null name; repeated rows keep a row each; an empty table
gives an empty result; other columns are left alone. Fingerprints of very many documents (a bounded number) meet their component by a broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import kernels
from quillspark.llm.components import components
from quillspark.llm.workspace import Workspace, hot_rows, join_by

SEED = 42
PAIRED = 64
#: Shingles whose bits are counted together.
COUNTED = 1 << 16
#: Longer shingles are hashed one by one.
LONG = 512

# The five primes of XXH64.
P1, P2, P3, P4, P5 = map(np.uint64, (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _round(acc: np.ndarray | np.uint64, lane: np.ndarray) -> np.ndarray:
    return _turn(acc + lane * P2, 31) * P1


def xxh64(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of all the strings ``data[start:end]`` at once."""
    size = end - start
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    eight = np.empty(len(data) + 8, np.uint64)  # the eight bytes from each place on
    for k in range(8):
        part = eight[k::8]
        part[:] = padded[k : k + 8 * len(part)].view("<u8")
    seed64 = np.uint64(seed)
    with np.errstate(over="ignore"):
        h = np.full(len(size), seed64 + P5, np.uint64)
        at = start.copy()
        own = np.flatnonzero((size >= 32) & (size <= LONG))
        if len(own):
            acc = [np.full(len(own), x, np.uint64) for x in (seed64 + P1 + P2, seed64 + P2, seed64, seed64 - P1)]
            stripes = size[own] // 32
            for s in range(int(stripes.max())):
                live = np.flatnonzero(stripes > s)
                place = start[own[live]] + 32 * s
                for k in range(4):
                    acc[k][live] = _round(acc[k][live], eight[place + 8 * k])
            total = _turn(acc[0], 1) + _turn(acc[1], 7) + _turn(acc[2], 12) + _turn(acc[3], 18)
            for k in range(4):
                total = (total ^ _round(np.uint64(0), acc[k])) * P1 + P4
            h[own] = total
            at[own] += 32 * stripes
        h += size.astype(np.uint64)
        left = np.where(size <= LONG, end - at, 0)
        for _ in range(3):
            own = np.flatnonzero(left >= 8)
            h[own] = _turn(h[own] ^ _round(np.uint64(0), eight[at[own]]), 27) * P1 + P4
            at[own] += 8
            left[own] -= 8
        own = np.flatnonzero(left >= 4)
        h[own] = _turn(h[own] ^ (eight[at[own]] & np.uint64(0xFFFFFFFF)) * P1, 23) * P2 + P3
        at[own] += 4
        left[own] -= 4
        for _ in range(3):
            own = np.flatnonzero(left > 0)
            h[own] = _turn(h[own] ^ padded[at[own]].astype(np.uint64) * P5, 11) * P1
            at[own] += 1
            left[own] -= 1
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
        h ^= h >> np.uint64(32)
    for k in np.flatnonzero(size > LONG):
        h[k] = xxhash.xxh64_intdigest(data[start[k] : end[k]].tobytes(), seed)
    return h


def fingerprints(data: np.ndarray, offsets: np.ndarray, size: int = 3) -> Iterator[np.ndarray]:
    """The fingerprints (uint64) of run after run of rows."""
    for first, last in kernels.runs(offsets):
        found = kernels.words(data, offsets, first, last, hashed=False)
        rows, lengths = last - first, found.end - found.start
        # All words with one space after each; so a shingle is a slice.
        after = np.cumsum(lengths + 1)
        start = after - lengths - 1
        body = data[int(offsets[first]) : int(offsets[last])]
        if len(after):
            source = np.arange(after[-1]) + np.repeat(found.start - start, lengths + 1)
            joined = _LOWER[body[np.minimum(source, len(body) - 1)]]
            joined[after - 1] = 32
        else:
            joined = np.zeros(0, np.uint8)
        words = np.diff(found.bounds)
        counts = np.where(words >= size, words - size + 1, np.minimum(words, 1))
        row = np.repeat(np.arange(rows), counts)
        low = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + found.bounds[:-1][row]
        high = low + np.minimum(words, size)[row] - 1
        bits = np.zeros((rows, 64), np.int64)
        for k in range(0, len(row), COUNTED):
            own, a, b = row[k : k + COUNTED], low[k : k + COUNTED], high[k : k + COUNTED]
            base = int(start[a[0]])
            h = xxh64(joined[base : int(after[b[-1]])], start[a] - base, after[b] - 1 - base)
            opens = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            single = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            bits[own[opens]] += np.add.reduceat(single, opens, axis=0, dtype=np.int64)
        yield np.packbits(2 * bits > counts[:, None], axis=1, bitorder="little").view("<u8").ravel()


def covering_masks(radius: int) -> list[int]:
    """The masks of the covering tables, of 64 bits each."""
    vectors = (1 << radius + 1) - 1
    return [sum(((1 + k % vectors) & v).bit_count() % 2 << k for k in range(64)) for v in range(1, vectors + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _neighbours(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): fingerprints that share themselves or a neighbour at one flipped bit with another, and the least that does."""
    spots = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)])
    own = np.repeat(fp.view(np.uint64), 65)
    near = (fp.view(np.uint64)[:, None] ^ spots).ravel()
    order = np.lexsort((own.view(np.int64), near))
    near, own = near[order], own[order].view(np.int64)
    opens = np.concatenate([[True], near[1:] != near[:-1]])
    least = own[opens][np.cumsum(opens) - 1]
    far = own != least
    return own[far], least[far]


def bucket_links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (table, key, fp) in that order to links (a, b) within the radius. Only the open bucket is held over."""
    columns = ("table", "key", "fp")
    held = [np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)]

    def search(table: np.ndarray, key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        opens = np.concatenate([[True], (table[1:] != table[:-1]) | (key[1:] != key[:-1])]) if len(fp) else np.zeros(0, bool)
        bucket = np.cumsum(opens) - 1
        sizes = np.bincount(bucket)
        paired = (sizes > 1) & ((sizes <= PAIRED) | (radius > 2))
        keep = paired[bucket]
        own, b = fp[keep], bucket[keep]
        pairs = []
        for s in range(1, int(sizes[paired].max(initial=1))):
            near = (b[s:] == b[:-s]) & (np.bitwise_count((own[s:] ^ own[:-s]).view(np.uint64)) <= radius)
            if near.any():
                pairs.append((own[s:][near], own[:-s][near]))
        starts = np.flatnonzero(opens)
        for k in np.flatnonzero((sizes > 1) & ~paired):
            part = fp[starts[k] : starts[k] + sizes[k]]
            if radius == 2:
                pairs.append(_neighbours(part))
            else:  # 0 or 1: equal or neighbours
                flipped = (part.view(np.uint64)[:, None] ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))).view(np.int64) if radius else np.zeros((len(part), 0), np.int64)
                hit = np.isin(flipped, part)
                pairs.append((np.broadcast_to(part[:, None], flipped.shape)[hit], flipped[hit]))
        if pairs:
            found = np.unique(np.stack([np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, columns)]
        last = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        yield from search(*(r[:cut] for r in rows))
        held = [r[cut:] for r in rows]
    yield from search(*held)


def fingerprint_texts(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed number) of each row of ``docs`` (doc_id, text)."""
    kind = dict(docs.dtypes)["doc_id"]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = list(fingerprints(*kernels.text_buffers(batch.column("text")), size))
            fp = np.concatenate(own).view(np.int64) if own else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(describe, f"doc_id {kind}, fp long")


def near_links(nodes: DataFrame, radius: int, work: Workspace) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``nodes`` (fp) that join all within the radius: not every pair, but every component."""
    tables = F.explode(F.array(*(F.struct(F.lit(k).alias("table"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(covering_masks(radius)))))
    keyed = nodes.select("fp", tables.alias("t")).select("t.table", "t.key", "fp")
    hot = None
    if radius == 2:
        sizes = keyed.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n"))
        hot = work.keep(sizes.where(F.col("n") > hot_rows(nodes.count())).select("table", "key"), "crowded")
        hot = None if hot.isEmpty() else hot
    rest = keyed if hot is None else keyed.join(F.broadcast(hot), ["table", "key"], "left_anti")
    links = rest.repartition("table", "key").sortWithinPartitions("table", "key", "fp").mapInArrow(lambda b: bucket_links(b, radius), "a long, b long")
    if hot is None:
        return links
    crowd = keyed.join(F.broadcast(hot), ["table", "key"], "left_semi").select("fp").distinct()
    spots = F.array(F.lit(0).cast("long"), *(F.lit(_signed(1 << k)).cast("long") for k in range(64)))
    near = work.keep(crowd.select("fp", F.explode(spots).alias("spot")).select("fp", F.col("fp").bitwiseXOR(F.col("spot")).alias("near")), "neighbours")
    least = near.groupBy("near").agg(F.min("fp").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return links.unionAll(near.join(least, "near").where("fp != least").select(F.col("fp").alias("a"), F.col("least").alias("b")))


def simhash_components(docs: DataFrame, size: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fp (signed) and component_id for each row of ``docs`` (doc_id, text)."""
    work = Workspace(docs.sparkSession, "simhash")
    described = work.keep(fingerprint_texts(docs, size), "fingerprints")
    nodes = described.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows"))
    nodes = work.keep(nodes, "nodes")
    hot = work.keep(nodes.where(F.col("rows") > hot_rows(described.count())).select("fp"), "hot")
    linked = components(near_links(nodes.select("fp"), radius, work), work, "linked").join(nodes.select(F.col("fp").alias("node"), "first"), "node")
    linked = work.keep(linked, "members")
    names = linked.groupBy("comp").agg(F.min("first").alias("name"), F.count(F.lit(1)).alias("n"))
    names = work.keep(names, "names")
    large = work.keep(names.where(F.col("n") > hot_rows(described.count())).select("comp"), "large")
    linked = join_by(linked, names.select("comp", "name"), "comp", None if large.isEmpty() else large)
    owners = nodes.join(linked.select(F.col("node").alias("fp"), "name", F.lit(True).alias("linked")), "fp", "left")
    owners = work.keep(owners.select("fp", F.when(F.col("linked"), F.col("name")).otherwise(F.col("first")).alias("component_id")), "owners")
    work.drop_but("fingerprints", "owners", "hot")
    return join_by(described, owners, "fp", None if hot.isEmpty() else hot).select("doc_id", "fp", "component_id")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = simhash_components(docs, size=3, radius=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
