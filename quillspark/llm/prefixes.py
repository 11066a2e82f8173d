"""The prefix trie of conversations, by preorder intervals.

1. Turns are sorted by conversation and turn over ranges of both, so that a long conversation lies in several tasks. A task counts and hashes
   (128 bits, rolling) the prefixes of the runs it sees; what a run brings along from earlier tasks is one row a task, and is added afterwards.
2. Equal prefixes are one node: its least conversation, its members, the bytes of its last turn.
3. Order of the nodes, lexicographic over paths: a child with over half of its parent's members continues its parent's path, other children
   leave it. A conversation leaves paths log2(members) times at most, so a node's key is short: (depth of leaving, child) for each, and its
   own depth. Keys sort as a preorder in which the continuing child comes last; all nodes of a path end their subtrees where the
   path ends, and a closing row for each path sorts there.
4. Nodes and closing rows are sorted by key over ranges. Running counts of nodes, leaves and saved bytes give each node its place, and its
   path's closing row the end of its subtree; leaves and savings of a subtree are differences.
5. Members that end at a node are sorted by node and id over ranges, joined to texts of ``CHUNK`` ids, and hashed as a stream. SHA-256 has to
   read one node's ids one after the other; so a task gets all chunks of a node, and holds one at a time.

Cases: null roles and texts are empty ones; turns that are null come first, and equal turns follow the hash of role and text; repeated rows are
turns of their own; rows without conv_id belong to no conversation and are left out; an empty table has no nodes; other columns are left alone.
Keys of many rows (of which there is a bounded number: parents of many children, nodes of many members, long conversations and paths) meet their
tables by a broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import kernels
from quillspark.llm.workspace import Workspace, hot_rows, join_by

CHUNK = 10_000
_M = (1 << 64) - 1
_BASE = int(kernels._BASE)
_DEPTH = np.uint64(0x9FB21C651E98DF25)
NODE, UP = ["n1", "n2"], ["u1", "u2"]


def _with(rows: DataFrame, table: list[tuple], schema: str) -> DataFrame:
    """Rows joined with a row for each task (part)."""
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(table, schema)), "part")


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (conv_id, h1, h2, bytes) to k (place in the conversation's run, from 0), the rolling hashes p1, p2 of the run so far, and whether it
    is the task's first run."""
    part = TaskContext.get().partitionId()
    last, count, held, runs = None, 0, [np.uint64(0)] * 2, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        own = batch.column("conv_id")
        number = np.asarray(own.dictionary_encode().indices)
        opens = np.concatenate([[runs == 0 or own[0].as_py() != last], number[1:] != number[:-1]])
        run = runs + np.cumsum(opens)
        place = np.arange(n)
        start = np.maximum.accumulate(np.where(opens, place, -1))  # -1: the run that was open before
        k = np.where(start >= 0, place - start, place + count)
        up, down = kernels.powers(n + 1)
        out = []
        for x in range(2):
            h = batch.column(f"h{x + 1}").to_numpy().view(np.uint64)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * down[:n])])
            value = (sums[1:] - sums[np.maximum(start, 0)]) * up[:n]
            value = np.where(start >= 0, value, value + held[x] * up[1 : n + 1])
            out.append(value)
            held[x] = value[-1]
        last, count, runs = own[-1].as_py(), int(k[-1]) + 1, int(run[-1])
        columns = [own, pa.array(k), *(pa.array(v.view(np.int64)) for v in out), batch.column("h1"), batch.column("h2"), batch.column("bytes"), pa.array(np.full(n, part, np.int32)), pa.array(run == 1)]
        yield pa.RecordBatch.from_arrays(columns, ["conv_id", "k", "p1", "p2", "h1", "h2", "bytes", "part", "first"])


def _runs(rows: DataFrame, order: list[Column | str], work: Workspace, name: str) -> tuple[DataFrame, dict[int, tuple[int, int, int]]]:
    """Rows (conv_id, h1, h2, bytes) in order over ranges, as ``_prefixes`` has them (materialised); and for each task, what the conversation of its
    first run has before it: the number of turns and their rolling hashes. A conversation may lie in any number of tasks."""
    kind = dict(rows.dtypes)["conv_id"]
    placed = rows.repartitionByRange("conv_id", *order).sortWithinPartitions("conv_id", *order).select("conv_id", "h1", "h2", "bytes")
    schema = f"conv_id {kind}, k long, p1 long, p2 long, h1 long, h2 long, bytes long, part int, first boolean"
    placed = work.keep(placed.mapInArrow(_prefixes, schema), name)
    ends = placed.groupBy("part").agg(
        F.min("conv_id").alias("low"),
        F.max(F.when(F.col("first"), F.struct("k", "p1", "p2"))).alias("low_end"),
        F.max(F.struct("conv_id", "k", "p1", "p2")).alias("high"),
    )
    before, conv, state = {}, None, (0, 0, 0)
    for r in sorted(ends.collect(), key=lambda r: r["part"]):
        before[r["part"]] = state if r["low"] == conv else (0, 0, 0)
        end = r["low_end"] if r["high"]["conv_id"] == r["low"] else r["high"]
        own = (end["k"] + 1, end["p1"] & _M, end["p2"] & _M)
        if r["high"]["conv_id"] == r["low"]:
            n, power = before[r["part"]], pow(_BASE, own[0], 1 << 64)
            own = (n[0] + own[0], n[1] * power + own[1] & _M, n[2] * power + own[2] & _M)
        conv, state = r["high"]["conv_id"], own
    return placed, before


def turns_in_order(conversations: DataFrame, work: Workspace) -> DataFrame:
    """conv_id, ord (place in the conversation, from 0), h1, h2 (hashes of role and text), bytes (of the text) for each turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    slim = conversations.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", F.xxhash64(role, text).alias("h1"), F.xxhash64(F.lit(7), role, text).alias("h2"), F.octet_length(text).cast("long").alias("bytes"))
    placed, before = _runs(slim, [F.asc_nulls_first("turn"), "h1", "h2"], work, "turns")
    carried = _with(placed, [(p, n) for p, (n, _, _) in before.items()], "part int, before long") if before else placed.withColumn("before", F.lit(0).cast("long"))
    return carried.select("conv_id", (F.col("k") + F.when(F.col("first"), F.col("before")).otherwise(0)).alias("ord"), "h1", "h2", "bytes")


def borrowed_heads(turns: DataFrame, ids: DataFrame, base: Column, head: Column, most: int) -> DataFrame:
    """Turns (as ``turns_in_order`` has them, with the column seg before ord) of conversations that start with the first ``head`` (``most`` at most) turns of the
    conversation ``base``, and go on with their own turns after their first ``head``. Both are expressions of conv_id."""
    heads = turns.where((F.col("ord") < most) & (F.col("conv_id") == base)).groupBy("conv_id")
    heads = heads.agg(F.array_sort(F.collect_list(F.struct("ord", "h1", "h2", "bytes"))).alias("head")).withColumnRenamed("conv_id", "_base")
    other = ids.where(F.col("conv_id") != base).select("conv_id", base.alias("_base"), head.cast("int").alias("_n"))
    taken = other.join(heads, "_base").select("conv_id", F.lit(0).alias("seg"), F.explode(F.slice("head", F.lit(1), F.col("_n"))).alias("t"))
    own = turns.where((F.col("conv_id") == base) | (F.col("ord") >= head)).select("conv_id", F.lit(1).alias("seg"), "ord", "h1", "h2", "bytes")
    return own.unionAll(taken.select("conv_id", "seg", "t.ord", "t.h1", "t.h2", "t.bytes"))


def _hot(rows: DataFrame, key: list[str], work: Workspace, name: str) -> DataFrame | None:
    """The keys of a large share of the rows, if any."""
    sizes = work.keep(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("rows")), name)
    total, most = sizes.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.max("rows"), F.lit(0))).first()
    return sizes.where(F.col("rows") > hot_rows(total)).select(*key) if most > hot_rows(total) else None


def _ends(steps: DataFrame, ids: DataFrame, work: Workspace) -> DataFrame:
    """n1, n2, ends_sha256 of nodes at which members end."""
    kind = dict(ids.dtypes)["conv_id"]
    last = steps.groupBy("conv_id").agg(F.max(F.struct("depth", *NODE)).alias("end"))
    last = ids.select("conv_id").join(last, "conv_id", "left").select(*(F.coalesce(f"end.{x}", F.lit(0)).alias(x) for x in NODE), "conv_id")

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(x).to_numpy() for x in NODE], 1)
            ids = batch.column("conv_id").to_pylist()
            opens = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)])).tolist()
            cuts = [(a + k, min(a + k + CHUNK, b)) for a, b in zip(opens, [*opens[1:], len(ids)]) for k in range(0, b - a, CHUNK)]
            at = np.array([a for a, _ in cuts])
            texts = pa.array([",".join(map(str, ids[a:b])) for a, b in cuts], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(key[at, 0].copy()), pa.array(key[at, 1].copy()), batch.column("conv_id").take(pa.array(at)), texts], [*NODE, "conv_id", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, state = None, None
        for batch in batches:
            done = []
            for a, b, text in zip(*(batch.column(x).to_pylist() for x in (*NODE, "ids"))):
                if (a, b) == open_key:
                    state.update(b"," + text.encode())
                    continue
                if open_key is not None:
                    done.append((*open_key, state.hexdigest()))
                open_key, state = (a, b), hashlib.sha256(text.encode())
            yield pa.RecordBatch.from_pylist([dict(zip((*NODE, "ends_sha256"), x)) for x in done], sums)
        if open_key is not None:
            yield pa.RecordBatch.from_pylist([dict(zip((*NODE, "ends_sha256"), (*open_key, state.hexdigest())))], sums)

    sums = pa.schema([("n1", pa.int64()), ("n2", pa.int64()), ("ends_sha256", pa.string())])
    sorted_ids = last.repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    joined = sorted_ids.mapInArrow(chunks, f"n1 long, n2 long, conv_id {kind}, ids string")
    return joined.repartition(*NODE).sortWithinPartitions(*NODE, "conv_id").mapInArrow(digest, "n1 long, n2 long, ends_sha256 string")


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the task and its running counts before each row: of nodes, leaves and saved bytes."""
    part, before = TaskContext.get().partitionId(), [0, 0, 0]
    for batch in batches:
        columns, names = list(batch.columns), list(batch.schema.names)
        for k, name in enumerate(("node", "leaf", "saved")):
            own = batch.column(name).to_numpy()
            after = np.cumsum(own) + before[k]
            columns.append(pa.array(after - own))
            names.append(f"{name}s_before")
            before[k] = int(after[-1]) if len(after) else before[k]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(batch.num_rows, part, np.int32))], [*names, "part"])


def trie(rows: DataFrame, order: list[str], ids: DataFrame, work: Workspace) -> DataFrame:
    """The nodes of the sequences ``rows`` (conv_id, the columns of ``order``, h1, h2, bytes) and of the empty sequences of other ``ids`` (conv_id)."""
    kind = dict(ids.dtypes)["conv_id"]
    placed, before = _runs(rows, order, work, "prefixes")

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The nodes of each prefix and of the one before."""
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            k, first, part = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("k", "first", "part"))
            parts, at = np.unique(part, return_inverse=True)
            held = np.array([before[p] for p in parts.tolist()], np.uint64)[at]
            held[~first] = 0
            up = np.array([pow(_BASE, x + 1, 1 << 64) for x in k[first].tolist()], np.uint64)
            depth = k.astype(np.uint64) + held[:, 0] + np.uint64(1)
            out = []
            for x in (1, 2):
                own, h = batch.column(f"p{x}").to_numpy().view(np.uint64).copy(), batch.column(f"h{x}").to_numpy().view(np.uint64)
                own[first] += held[first, x] * up
                above = (own - h) * np.uint64(pow(_BASE, -1, 1 << 64))
                out += [kernels.mix(own + depth * _DEPTH), np.where(depth > 1, kernels.mix(above + (depth - np.uint64(1)) * _DEPTH), np.uint64(0))]
            columns = [batch.column("conv_id"), pa.array(depth.view(np.int64)), *(pa.array(out[j].view(np.int64)) for j in (0, 2, 1, 3)), batch.column("bytes")]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "depth", *NODE, *UP, "bytes"])

    steps = work.keep(placed.mapInArrow(name, f"conv_id {kind}, depth long, n1 long, n2 long, u1 long, u2 long, bytes long"), "steps")
    work.drop("prefixes")
    found = steps.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), *(F.max(c).alias(c) for c in ("depth", *UP, "bytes")))
    zero = F.lit(0).cast("long")
    root = ids.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select(zero.alias("n1"), zero.alias("n2"), "conv_id", "n_convs", zero.alias("depth"), F.lit(None).cast("long").alias("u1"), F.lit(None).cast("long").alias("u2"), zero.alias("bytes"))
    found = work.keep(found.unionAll(root), "found")
    children = work.keep(found.where("depth > 0").groupBy(*UP).agg(F.count(F.lit(1)).alias("n_children")), "children")
    total = found.count()
    wide = children.where(F.col("n_children") > hot_rows(total)).select(*UP)
    wide = None if wide.isEmpty() else wide
    own = children.select(F.col("u1").alias("n1"), F.col("u2").alias("n2"), "n_children")
    parents = found.select(F.col("n1").alias("u1"), F.col("n2").alias("u2"), F.col("conv_id").alias("parent_conv_id"), F.col("n_convs").alias("_above"))
    nodes = join_by(found.join(own, NODE, "left"), parents, UP, wide, "left")
    nodes = nodes.select(*NODE, "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "bytes", F.coalesce(2 * F.col("n_convs") <= F.col("_above"), F.lit(True)).alias("leaves_path"))
    nodes = work.keep(nodes, "nodes")
    work.drop("found", "children")

    # Where conversations leave paths. The root starts the first one.
    leaving = nodes.where("leaves_path AND depth > 0")
    many = leaving.where(F.col("n_convs") > hot_rows(steps.count())).select(*NODE)
    taken = join_by(steps.select("conv_id", "depth", *NODE), leaving.select(*NODE), NODE, None if many.isEmpty() else many)
    entry = lambda at, own, a, b: F.struct(at.cast("long").alias("at"), F.lit(own).alias("own"), a.alias("a"), b.alias("b"))
    left = taken.groupBy("conv_id").agg(F.array_sort(F.collect_list(entry(F.col("depth") - 1, 1, F.col("n1"), F.col("n2")))).alias("left"))
    left = work.keep(left, "left")
    keyed = join_by(nodes, left, "conv_id", _hot(nodes, ["conv_id"], work, "per_conv"), "left")
    none = F.array().cast("array<struct<at:bigint,own:int,a:bigint,b:bigint>>")
    keyed = keyed.withColumn("left", F.filter(F.coalesce("left", none), lambda x: x["at"] < F.col("depth")))
    keyed = keyed.withColumns({"path1": F.coalesce(F.try_element_at("left", F.lit(-1))["a"], zero), "path2": F.coalesce(F.try_element_at("left", F.lit(-1))["b"], zero)})
    leaf, saved = (F.col("n_children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("bytes")
    open_row = F.struct(F.concat("left", F.array(entry(F.col("depth"), 0, zero, zero))).alias("key"), F.lit(1).cast("long").alias("node"), leaf.alias("leaf"), saved.alias("saved"))
    close_row = F.struct(F.concat("left", F.array(entry(F.lit((1 << 63) - 1), 0, zero, zero))).alias("key"), zero.alias("node"), zero.alias("leaf"), zero.alias("saved"))
    keyed = keyed.withColumn("row", F.explode(F.when(F.col("leaves_path"), F.array(open_row, close_row)).otherwise(F.array(open_row))))
    plain = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", *NODE, "path1", "path2"]
    keyed = work.keep(keyed.select(*plain, "row.*"), "keyed")
    ranked = keyed.repartitionByRange("key").sortWithinPartitions("key").drop("key")
    counts = ["nodes_before", "leafs_before", "saveds_before"]
    schema = ", ".join([*(f"{c} {t}" for c, t in ranked.dtypes), *(f"{c} long" for c in counts), "part int"])
    ranked = work.keep(ranked.mapInArrow(_running, schema), "ranked")
    sums, offsets = [0, 0, 0], []
    for r in sorted(ranked.groupBy("part").agg(*(F.sum(c).alias(c) for c in ("node", "leaf", "saved"))).collect(), key=lambda r: r["part"]):
        offsets.append((r["part"], *sums))
        sums = [a + b for a, b in zip(sums, r[1:])]
    if offsets:
        ranked = _with(ranked, offsets, "part int, o0 long, o1 long, o2 long").withColumns({c: F.col(c) + F.col(f"o{k}") for k, c in enumerate(counts)})
    path = ["path1", "path2"]
    closing = ranked.where("node = 0").select(*path, *(F.col(c).alias(f"_{c}") for c in counts))
    opened = ranked.where("node = 1").select(*plain, *counts)
    inside = join_by(opened, closing, path, _hot(opened, path, work, "per_path"))
    inside = inside.join(_ends(steps, ids, work), NODE, "left")
    difference = lambda k: F.col(f"_{counts[k]}") - F.col(counts[k])
    return inside.select(
        *plain[:5], difference(1).alias("n_leaves"), difference(2).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        F.col("nodes_before").alias("preorder"), (F.col("_nodes_before") - 1).alias("subtree_end"),
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of ``conversations`` (conv_id, turn, role, text): a row a node, with conv_id (its least member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens (bytes that members share, over the subtree), ends_sha256, preorder (from 0) and subtree_end (the last place in its subtree)."""
    work = Workspace(conversations.sparkSession, "prefixes")
    turns = work.keep(turns_in_order(conversations, work), "ordered")
    work.drop("turns")
    return trie(turns, ["ord"], work.keep(turns.select("conv_id").distinct(), "ids"), work)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations are rebuilt with the head of every fifth one."""
    work = Workspace(spark, "prefixes")
    turns = work.keep(turns_in_order(spark.read.parquet(f"{sf_dir}/conversations.parquet"), work), "ordered")
    work.drop("turns")
    ids = work.keep(turns.select("conv_id").distinct(), "ids")
    base, head = F.col("conv_id") - F.col("conv_id") % 5, F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    rebuilt = borrowed_heads(turns, ids, base, head, 8)
    found = trie(rebuilt, ["seg", "ord"], ids, work)
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
