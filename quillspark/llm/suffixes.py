"""Removal of repeated byte strings by a distributed difference-cover suffix sort.

Each byte covered by a string of ``LENGTH`` bytes that also starts earlier (in a document of smaller id, or earlier in the same) is
removed. Strings are judged on the input.

1. Whole copies of an earlier text are covered whole, and leave.
2. Partition, without loss: a string of LENGTH bytes has an anchor, its leftmost ``GRAM`` bytes of least hash. Equal strings
   have equal anchors at equal places. So an anchor with the bytes around it that strings over it may span (its context) meets all
   it can equal in the group of its hash. A context met earlier (anchor and context hash, 128 bits) is covered whole. That is seen within
   a batch before anything moves: of equal contexts the first goes on, what the others cover goes on as runs. So a passage that a
   third of all documents share reaches the shuffle once a batch. Then anchors are sorted by group and context; groups of one
   distinct context are done. This sort moves slim rows only, and is read as a stream.
3. The first contexts of groups of two or more go, with their bytes, to the suffix sort, many groups to a task, groups never
   split: difference cover modulo 3. Positions 1 and 2 modulo 3 are sorted by triples of packed 8-byte characters, their names by
   triples of names, and so on until names stand for LENGTH bytes; the rest is sorted by its first byte and the
   name after, and merged. Adjacent suffixes that agree on LENGTH bytes are a class; all but its earliest are covered.
4. Groups of more than ``GROUP_CONTEXTS`` distinct contexts don't go to one task: their strings are counted by 128-bit hashes, with
   partial sums before the shuffle, which is the same result by another way.

The suffix sort is distributed by groups, not by ranges of suffixes: sorting the sampled triples of all bytes by Spark would move some 20 bytes
for each of two thirds of the positions and for each level of names, several times what the disks may take (README).

Cases: null text is empty; texts shorter than LENGTH lose nothing; texts are taken as UTF-8 bytes and may be cut within a
character; rows of equal id and text are one document and share a result, rows of equal id and other texts are ordered by the
text's hash, null ids come first; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import kernels
from quillspark.llm.workspace import Workspace, small_side

LENGTH = 100
GRAM = 32
SPAN = LENGTH - GRAM  # an anchor lies at most so far into its string
GROUP_CONTEXTS = 10_000
#: Bytes of contexts that a task sorts at once, a group at least.
SORT_BYTES = 768 << 10
#: Anchors that are compared within a task before the shuffle.
HELD_ANCHORS = 2_000_000
#: Rows of contexts looked at together; a group is closed at the first slice that ends it.
SLICE_ROWS = 2000


def slide(best: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """best over each run of ``width`` values."""
    n = 1
    while 2 * n <= width:
        x = best(x[:-n], x[n:])
        n *= 2
    rest = width - n
    return best(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(data: np.ndarray, offsets: np.ndarray, first: int, last: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, places, hashes, context hashes) of the anchors of each text of at least LENGTH bytes."""
    lo = int(offsets[first])
    b = data[lo : int(offsets[last])]
    up, down = kernels.powers(len(b) + 1)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(kernels._letters(False)[b] * up[: len(b)], out=sums[1:])
    pad = np.zeros(SPAN, np.uint64)
    for row in range(first, last):
        start, end = int(offsets[row]) - lo, int(offsets[row + 1]) - lo
        n = end - start
        if n < LENGTH:
            continue
        h = kernels.mix((sums[start + GRAM : end + 1] - sums[start : end - GRAM + 1]) * down[start : end - GRAM + 1])
        least = slide(np.minimum, h, SPAN + 1)
        place = np.flatnonzero(h == slide(np.maximum, np.concatenate([pad, least, pad]), SPAN + 1))
        left, right = np.maximum(place - SPAN, 0), np.minimum(place + LENGTH, n)
        context = (sums[start + right] - sums[start + left]) * down[start + left]
        shape = ((place - left) * 1000 + (right - place)).astype(np.uint64)
        yield row, place, h[place], kernels.mix(kernels.mix(context) + shape)


# --- difference cover ---


def _names(key: np.ndarray) -> tuple[np.ndarray, int]:
    """Dense ranks, from 1."""
    order = np.argsort(key, kind="stable")
    s = key[order]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(np.concatenate([[1], s[1:] != s[:-1]])) if len(key) else []
    return rank, int(rank.max(initial=0))


def suffix_order(text: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """All positions of ``text`` in the order of their suffixes, as far as ``depth`` bytes tell them apart."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(16, np.uint8)])
    char = np.zeros(n, np.uint64)  # eight bytes as one character
    for k in range(8):
        char = (char << np.uint64(8)) | padded[k : k + n]
    cover = np.flatnonzero(np.arange(n) % 3 != 0)
    name = np.zeros(n + 1, np.int64)
    name[cover], top = _names(char[cover])
    length = 8
    while length < depth and top < len(cover):
        # Triples of names of ``length`` bytes; steps that 3 divides stay in the cover, so names may overlap.
        step = length // 3 * 3
        at = [np.minimum(cover + k * step, n) for k in range(3)]
        if top < 1 << 20:
            key = (name[at[0]] << 42) | (name[at[1]] << 21) | name[at[2]]
        else:
            pair, _ = _names((name[at[0]] << 31) | name[at[1]])
            key = (pair << 31) | name[at[2]]
        name[cover], top = _names(key)
        length = length + 2 * step
    one, two, zero = (np.flatnonzero(np.arange(n) % 3 == k) for k in (1, 2, 0))
    byte = padded.astype(np.int64)
    after = lambda p, k: name[np.minimum(p + k, n)]
    by1 = lambda p: (byte[p] << 32) | after(p, 1)
    by2 = lambda p: (byte[p] << 40) | (byte[p + 1] << 32) | after(p, 2)
    zero = zero[np.argsort(by2(zero), kind="stable")]  # the deeper of the two keys, so that both rise along it
    mixed = cover[np.argsort(name[cover], kind="stable")]
    # Merge: a suffix 0 is compared with suffixes 1 by one byte and a name, with suffixes 2 by two.
    before = np.searchsorted(np.sort(by1(one)), by1(zero)) + np.searchsorted(np.sort(by2(two)), by2(zero))
    place = before + np.arange(len(zero))
    out = np.empty(n, np.int64)
    taken = np.zeros(n, bool)
    taken[place] = True
    out[place] = zero
    out[~taken] = mixed
    return out


def repeated(text: np.ndarray, starts: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which of ``starts`` begin a string of LENGTH bytes that an earlier one (by ``owner``) equals."""
    n = len(text)
    wanted = np.zeros(n, bool)
    wanted[starts] = True
    rank = np.full(n, -1, np.int64)
    rank[starts] = owner
    order = suffix_order(text)
    order = order[wanted[order]]
    padded = np.concatenate([text, np.zeros(LENGTH + 8, np.uint8)])
    char = np.zeros(n + LENGTH, np.uint64)
    for k in range(8):
        char = (char << np.uint64(8)) | padded[k : k + n + LENGTH]
    same = np.arange(1, len(order))  # places in order that agree with the one before, as far as compared
    for k in [*range(0, LENGTH - 8, 8), LENGTH - 8]:
        same = same[char[order[same] + k] == char[order[same - 1] + k]]
    opens = np.ones(len(order), bool)
    opens[same] = False
    first = np.minimum.reduceat(rank[order], np.flatnonzero(opens)) if len(order) else rank[order]
    out = np.zeros(n, bool)
    out[order] = rank[order] > first[np.cumsum(opens) - 1] if len(order) else False
    return out[starts]


def runs_of(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted places of strings to covered runs (start, end)."""
    if not len(places):
        return places, places
    cut = np.flatnonzero(np.diff(places) > LENGTH)
    return places[np.concatenate([[0], cut + 1])], places[np.concatenate([cut, [len(places) - 1]])] + LENGTH


# --- Spark ---


def _sort_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts in order of group (rows: group, doc, key, left, bytes), to covered runs."""
    held: list[pa.RecordBatch] = []
    size = 0

    def work() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        data, offsets = kernels.text_buffers(table.column("bytes"))
        text = data[offsets[0] : offsets[-1]]
        at = offsets - offsets[0]
        lengths = np.diff(at)
        left = table.column("left").to_numpy()
        doc, key = table.column("doc"), table.column("key")
        order = np.array(pc.sort_indices(pa.table({"d": doc, "k": key, "l": table.column("left")}), sort_keys=[("d", "ascending"), ("k", "ascending"), ("l", "ascending")], null_placement="at_start"))
        same = np.zeros(len(order), bool)
        if len(order) > 1:
            d, k = doc.take(order), key.take(order)
            eq = pc.fill_null(pc.equal(d[1:], d[:-1]), False).to_numpy(zero_copy_only=False)
            null = pc.and_(pc.is_null(d[1:]), pc.is_null(d[:-1])).to_numpy(zero_copy_only=False)
            same[1:] = (eq | null) & pc.equal(k[1:], k[:-1]).to_numpy(zero_copy_only=False)
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(~same)
        count = np.maximum(lengths - LENGTH + 1, 0)
        row = np.repeat(np.arange(len(count)), count)
        inner = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        hit = repeated(text, at[row] + inner, (number[row] << 32) | (left[row] + inner))
        rows, lows, highs = [], [], []
        for r in np.unique(row[hit]):
            a, b = np.searchsorted(row, [r, r + 1])
            lo, hi = runs_of(left[r] + inner[a:b][hit[a:b]])
            rows.append(np.full(len(lo), r))
            lows.append(lo)
            highs.append(hi)
        take = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))
        gather = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
        c = lambda x: x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
        return pa.RecordBatch.from_arrays([c(doc.take(take)), c(key.take(take)), gather(lows), gather(highs)], ["doc", "key", "lo", "hi"])

    for batch in (b.slice(k, SLICE_ROWS) for b in batches for k in range(0, b.num_rows, SLICE_ROWS)):
        at = 0
        if size >= SORT_BYTES and held:  # the group that is open may go on in this batch
            last = held[-1].column("group")[-1].as_py()
            groups = batch.column("group").to_numpy()
            at = int(np.argmax(groups != last)) if (groups != last).any() else len(groups)
            held.append(batch.slice(0, at))
            if at == len(groups):
                continue
            yield work()
            held, size = [], 0
        rest = batch.slice(at)
        if rest.num_rows:
            held.append(rest)
            size += rest.column("bytes").nbytes
    if held:
        yield work()


def _hash_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts to their strings' hashes: (a, b, doc, key, at), by two running hashes over different values of the bytes."""
    values = kernels._letters(False), kernels.mix(np.arange(256, dtype=np.uint64) + np.uint64(0x51ED2701))
    for whole in batches:
        for first in range(0, whole.num_rows, 2000):
            batch = whole.slice(first, 2000)
            data, offsets = kernels.text_buffers(batch.column("bytes"))
            text, at = data[offsets[0] : offsets[-1]], offsets - offsets[0]
            count = np.maximum(np.diff(at) - LENGTH + 1, 0)
            row = np.repeat(np.arange(len(count)), count)
            inner = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            start = at[row] + inner
            up, down = kernels.powers(len(text) + 1)
            pair = []
            for value in values:
                sums = np.zeros(len(text) + 1, np.uint64)
                np.cumsum(value[text] * up[: len(text)], out=sums[1:])
                pair.append(kernels.mix((sums[start + LENGTH] - sums[start]) * down[start]).view(np.int64))
            take = pa.array(row)
            places = batch.column("left").to_numpy()[row] + inner
            yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1]), batch.column("doc").take(take), batch.column("key").take(take), pa.array(places)], ["a", "b", "doc", "key", "at"])


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (doc, key, text) to anchors (group, context, doc, key, place, hi). Of equal contexts within a batch the first goes on (hi
    is null); what the others cover goes on as runs from place to hi, dealt by document."""
    for batch in batches:
        order = pc.sort_indices(batch.select(["doc", "key"]), sort_keys=[("doc", "ascending"), ("key", "ascending")], null_placement="at_start")
        batch = batch.take(order)
        if batch.num_rows > 1:  # rows of equal id and text are one document
            doc, key = batch.column("doc"), batch.column("key")
            same = pc.or_(pc.fill_null(pc.equal(doc[1:], doc[:-1]), False), pc.and_(pc.is_null(doc[1:]), pc.is_null(doc[:-1])))
            same = pc.and_(same, pc.equal(key[1:], key[:-1])).to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(np.concatenate([[True], ~same])))
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            row, place, group, context = (np.concatenate(c) for c in zip(*held))  # noqa: B023
            order = np.argsort(kernels.mix(group) + context, kind="stable")
            g, c = group[order], context[order]
            again = np.zeros(len(row), bool)
            again[order[1:]] = (g[1:] == g[:-1]) & (c[1:] == c[:-1])
            first = np.flatnonzero(~again)
            late, at = row[again], place[again]
            lo, hi = np.maximum(at - SPAN, 0), at + LENGTH
            opens = np.ones(len(lo), bool)
            opens[1:] = (late[1:] != late[:-1]) | (lo[1:] > hi[:-1])
            starts = np.flatnonzero(opens)
            ends = np.append(starts[1:], len(lo)) - 1 if len(starts) else starts
            for rows, columns in (
                (row[first], (group[first].view(np.int64), context[first].view(np.int64), place[first].astype(np.int32), pa.nulls(len(first), pa.int32()))),
                (late[starts], (None, np.zeros(len(starts), np.int64), lo[starts].astype(np.int32), pa.array(hi[ends].astype(np.int32)))),
            ):
                take = pa.array(rows)
                key = batch.column("key").take(take)  # noqa: B023
                own, ctx, start, end = columns
                yield pa.RecordBatch.from_arrays([key if own is None else pa.array(own), pa.array(ctx), batch.column("doc").take(take), key, pa.array(start), end], ["group", "context", "doc", "key", "place", "hi"])  # noqa: B023

        data, offsets = kernels.text_buffers(batch.column("text"))
        for first, last in kernels.runs(offsets):
            for row, place, group, context in anchors(data, offsets, first, last):
                held.append((np.full(len(place), row), place, group, context))
                size += len(place)
            if size > HELD_ANCHORS:
                yield from out()
                held, size = [], 0
        if held:
            yield from out()


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors in order of (group, context, doc, key, place), to rows that are covered whole (later = true) and to the first of each
    context in groups of two distinct ones or more. A group's first row waits until a second context comes."""
    waiting = None  # first row of the open group, until it is sent
    group = context = None
    for batch in batches:
        known = batch.column("hi").is_valid()
        ready = batch.filter(known)
        if ready.num_rows:
            yield ready.append_column("later", pa.array(np.ones(ready.num_rows, bool))).select(_MET)
        batch = batch.filter(pc.invert(known))
        g, c = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("group", "context"))
        if not len(g):
            continue
        new_group = np.concatenate([[g[0] != group], g[1:] != g[:-1]])
        new_context = new_group | np.concatenate([[c[0] != context], c[1:] != c[:-1]])
        later = ~new_context
        starts = np.flatnonzero(new_group)
        number = np.cumsum(new_group)  # 0: the group open before
        distinct = np.bincount(number, new_context, minlength=len(starts) + 1).astype(int)
        out = [batch.filter(pa.array(later)).append_column("later", pa.array(np.ones(int(later.sum()), bool)))]
        firsts = new_context & ~new_group & (number == 0) | new_context & (number > 0) & (distinct[number] > 1)
        if distinct[0] and waiting is not None:
            out.append(waiting.append_column("later", pa.array([False])))
            waiting = None
        out.append(batch.filter(pa.array(firsts)).append_column("later", pa.array(np.zeros(int(firsts.sum()), bool))))
        if len(starts):
            waiting = batch.slice(int(starts[-1]), 1) if distinct[-1] < 2 else None
        group, context = g[-1], c[-1]
        for o in out:
            if o.num_rows:
                yield o.select(_MET)


_MET = ["group", "doc", "key", "place", "hi", "later"]


def covered_runs(docs: DataFrame, work: Workspace, group_contexts: int = GROUP_CONTEXTS) -> DataFrame:
    """Rows (doc, key, lo, hi): covered byte runs, which may overlap. key: hash of the text."""
    kind = dict(docs.dtypes)["doc_id"]
    slim = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("key"), F.xxhash64(F.lit(5), "text").alias("key2"), F.octet_length("text").cast("long").alias("n"), "text")
    whole = slim.where(F.col("n") >= LENGTH).select("doc", "key", "key2", "n").distinct()
    least = whole.groupBy("key", "key2").agg(F.min(F.struct(F.col("doc").isNotNull(), "doc")).alias("least"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    copies = work.keep(whole.join(least, ["key", "key2"]).where(~F.col("doc").eqNullSafe(F.col("least.doc"))).select("doc", "key", F.lit(0).cast("long").alias("lo"), F.col("n").alias("hi")), "copies")
    out = small_side(copies.select("doc", "key"))
    left = slim.select("doc", "key", "text").alias("d").join(out.alias("c"), F.col("d.doc").eqNullSafe(F.col("c.doc")) & (F.col("d.key") == F.col("c.key")), "left_anti")

    found = left.select("doc", "key", "text").mapInArrow(_anchor_rows, f"group long, context long, doc {kind}, key long, place int, hi int")
    ordered = found.repartition("group").sortWithinPartitions("group", "context", "doc", "key", "place")
    met = work.keep(ordered.mapInArrow(_stream, f"group long, doc {kind}, key long, place int, hi int, later boolean"), "met")
    # Rows of repeated rows of the table meet themselves as later ones, at the same place: those are no repeats.
    alone = work.keep(docs.groupBy("doc_id", F.xxhash64("text").alias("key")).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"), "again")
    if not alone.isEmpty():
        met = work.keep(_without_own_copies(found, alone, kind), "met2")
    first = met.where(~F.col("later"))
    crowd = first.groupBy("group").agg(F.count(F.lit(1)).alias("contexts")).where(F.col("contexts") > group_contexts).select("group")
    crowd = work.keep(crowd, "crowd")
    wanted = first.join(crowd.withColumn("hot", F.lit(True)), "group", "left").groupBy("doc", "key").agg(F.collect_list(F.struct("group", "place", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("wanted")).hint("shuffle_hash")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for r, (text, wants) in enumerate(zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist())):
                raw = text.encode()
                for w in wants:
                    lo = max(0, w["place"] - SPAN)
                    rows.append((w["group"], w["hot"], r, lo, raw[lo : w["place"] + LENGTH]))
            for k in range(0, len(rows), 20_000):
                part = rows[k : k + 20_000]
                take = pa.array([p[2] for p in part], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p[0] for p in part], pa.int64()), pa.array([p[1] for p in part], pa.bool_()), batch.column("doc").take(take), batch.column("key").take(take), pa.array([p[3] for p in part], pa.int64()), pa.array([p[4] for p in part], pa.binary())],
                    ["group", "hot", "doc", "key", "left", "bytes"],
                )

    texts = slim.select("doc", "key", "text").dropDuplicates(["doc", "key"]) if not alone.isEmpty() else slim.select("doc", "key", "text")
    joined = texts.alias("t").join(wanted.alias("w"), F.col("t.doc").eqNullSafe(F.col("w.doc")) & (F.col("t.key") == F.col("w.key"))).select("t.doc", "t.key", "t.text", "w.wanted")
    contexts = joined.mapInArrow(cut, f"group long, hot boolean, doc {kind}, key long, left long, bytes binary")
    run_schema = f"doc {kind}, key long, lo long, hi long"
    if crowd.isEmpty():
        sorted_runs = contexts.drop("hot").repartition("group").sortWithinPartitions("group").mapInArrow(_sort_groups, run_schema)
        runs = work.keep(sorted_runs, "runs")
    else:
        contexts = work.keep(contexts, "contexts")
        cool = contexts.where(~F.col("hot")).drop("hot").repartition("group").sortWithinPartitions("group").mapInArrow(_sort_groups, run_schema)
        strings = contexts.where("hot").select("doc", "key", "left", "bytes").mapInArrow(_hash_strings, f"a long, b long, doc {kind}, key long, at long")
        place = F.struct(F.col("doc").isNotNull().alias("known"), "doc", "key", "at")
        strings = strings.select("a", "b", place.alias("p"))
        again = strings.groupBy("a", "b").agg(F.min("p").alias("least"), F.max("p").alias("most")).where("least != most").select("a", "b", "least")
        hot = strings.join(again, ["a", "b"]).where("p > least").select("p.doc", "p.key", F.col("p.at").alias("lo"), (F.col("p.at") + LENGTH).alias("hi")).distinct()
        runs = work.keep(cool.unionAll(hot), "runs")
    start = F.when(F.col("hi").isNotNull(), F.col("place").cast("long")).otherwise(F.greatest(F.col("place").cast("long") - SPAN, F.lit(0)))
    wide = met.where("later").select("doc", "key", start.alias("lo"), F.coalesce(F.col("hi"), F.col("place") + LENGTH).cast("long").alias("hi"))
    work.drop_but("copies", "met", "met2", "runs")
    return copies.unionAll(wide).unionAll(runs)


def _without_own_copies(found: DataFrame, alone: DataFrame, kind: str) -> DataFrame:
    """The stream's result for tables in which rows repeat: equal rows count once."""
    once = found.dropDuplicates(["group", "context", "doc", "key", "place", "hi"])
    return once.repartition("group").sortWithinPartitions("group", "context", "doc", "key", "place").mapInArrow(_stream, f"group long, doc {kind}, key long, place int, hi int, later boolean")


def _apply(batches: Iterator[pa.RecordBatch], text_out: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, lows, highs in zip(*(batch.column(c).to_pylist() for c in ("text", "lows", "highs"))):
            raw = (text or "").encode()
            gone, spans = 0, 0
            kept, at = [], 0
            for lo, hi in sorted(zip(lows or (), highs or ())):
                hi = min(hi, len(raw))
                if hi <= at:
                    continue
                if lo > at or not spans:
                    kept.append(raw[at:lo])
                    spans += 1
                    at = lo
                gone += hi - at
                at = hi
            kept.append(raw[at:])
            body = b"".join(kept)
            rows.append((len(raw), gone, spans, body.decode("utf-8", "replace") if text_out else hashlib.sha256(body).hexdigest()))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "text" if text_out else "kept_sha256"])


def remove_repeats(docs: DataFrame, group_contexts: int = GROUP_CONTEXTS, text_out: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256, or text (what is left; cut characters become U+FFFD)."""
    work = Workspace(docs.sparkSession, "suffixes")
    kind = dict(docs.dtypes)["doc_id"]
    runs = covered_runs(docs, work, group_contexts).groupBy("doc", "key").agg(F.collect_list("lo").alias("lows"), F.collect_list("hi").alias("highs")).hint("shuffle_hash")
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("own"))
    joined = keyed.join(runs, F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("own") == F.col("key")), "left").select("doc_id", "text", "lows", "highs")
    last = "text" if text_out else "kept_sha256"
    return joined.mapInArrow(lambda b: _apply(b, text_out), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, {last} string")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
