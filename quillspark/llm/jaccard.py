"""Jaccard join of documents on word shingles by signature trees.

Two documents link when their sets of word shingles have a Jaccard similarity of at least ``num / den``. The result is each
document's component under links.

1. Equal sets are one from here on (64-bit set hash).
   Of shingles of ``RARE_SIZE`` words or more, sets that link share the least of their common hashes within the first of each (its
   prefix, ``1 - num / den`` of its shingles and as many again). A set with fewer of them in other sets' prefixes than any partner
   would share has none, and leaves, as most documents that merely share a passage do. Only prefixes are shuffled for that, in
   ``PASSES`` passes if they are many, so that the disk holds the hashes of one pass at a time.
2. Partition, without loss: sets that link differ in at most d shingles, d by their size, so of k > d hash ranges of the shingle space
   at least k - d hold the same shingles in both. Each set has one signature for each range (ranges are scaled by size level; a set
   also signs for the level below if a smaller partner may be there). Sets that share a signature fall into one group, by
   components over (set, least set of the signature): no pairs are made, and groups are supersets of components. Signatures are combined
   in each task before their one shuffle, and read as a sorted stream after it.
   Empty ranges need no signature, unless a set has no more than d that are not empty; ``ranges`` makes that rare.
3. In a group a signature tree is built: its leaves hold sets, nodes the OR of their token bitmaps, the range of sizes and the
   least number of bits. Dual traversal of the tree with itself leaves out node pairs whose largest possible overlap is too small,
   and those already connected; what remains at the leaves is verified on the shingle hashes.
4. Groups of more than ``BLOCK_SETS`` sets, of shingles of ``RARE_SIZE`` words or more, are parted anew before that, again without loss: a
   popular passage joins very many sets that link with none of its other owners. In an order of shingles that has the popular ones last, sets
   that link share one of the first ``1 - num / den`` and one more of each; sets that share such a one stay together.
5. Groups that are still as large are cut in blocks. Each block is joined with itself and with ``PIVOTS`` sets of the
   group, which connects most of it; then all sets outside the group's largest component are held, block by block, against
   all its sets. So no pair between different components is left out, whatever the group's size.

Cases: a document of fewer words than a shingle is one shingle as a whole; without words or text it has none, links with nothing and
is its own component; null ids and repeated rows are kept, each with its own row; an empty table gives an empty result; other
columns are left alone. Sets of very many documents (a bounded number) are joined with their rows by a broadcast of those sets, so that no
task gets all copies of a text.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import kernels
from quillspark.llm.components import components
from quillspark.llm.workspace import Workspace, hot_rows, join_by, small_side

SPARE = 2
LEVEL_RATIO = 1.4
BLOCK_SETS = 2000
BLOCK_SHINGLES = 2_000_000
PIVOTS = 8
LEAF = 8
#: Signatures (or shingles) that a task looks at together before they are shuffled.
CHUNK_ROWS = 500_000
#: From this many words on, shingles are rare by themselves, and counting the shared ones pays.
RARE_SIZE = 5
#: Shingles of large groups that are known as popular to all tasks; of more, those of the most sets.
POPULAR = 1 << 20
#: Rows of prefixes that one shuffle takes; of more, each pass takes a share of the hashes.
PASS_ROWS, PASSES = 20_000_000, 4
_SEG = np.uint64(0xC2B2AE3D27D4EB4F)
_LEVEL = np.uint64(0x165667B19E3779F9)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) for every row; empty rows too."""
    for first, last in kernels.runs(offsets):
        found = kernels.words(data, offsets, first, last)
        value, bounds = kernels.shingles(found, size)
        for r in range(last - first):
            part = np.sort(value[bounds[r] : bounds[r + 1]])
            if len(part) > 1:
                part = part[np.concatenate([[True], part[1:] != part[:-1]])]
            yield first + r, part


def set_hash(s: np.ndarray) -> int:
    total = np.add.reduce(kernels.mix(s ^ _SEG)) if len(s) else np.uint64(0)
    salted = (int(total) + len(s) * int(_LEVEL)) & 0xFFFFFFFFFFFFFFFF
    return int(kernels.mix(np.array([salted], np.uint64)).view(np.int64)[0])


def level_bounds(most: int) -> np.ndarray:
    bounds = [1]
    while bounds[-1] <= most:
        bounds.append(max(bounds[-1] + 1, int(bounds[-1] * LEVEL_RATIO)))
    return np.array(bounds, np.int64)


def ranges(least: int, differ: int) -> int:
    """How many ranges a level has: so many that a set of ``least`` shingles has more than ``differ`` that are not empty, but for
    about four standard deviations; at most four a shingle."""
    k = differ + 1 + SPARE
    while k < 4 * least:
        x = least / k
        mean, variance = k * (1 - math.exp(-x)), k * (math.exp(-x) - (1 + x) * math.exp(-2 * x))
        if mean - 4 * math.sqrt(max(variance, 0.0)) >= differ + 1:
            break
        k += max(1, k // 50)
    return k


def signatures(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """The signatures of a set of shingle hashes (sorted)."""
    n = len(s)
    if not n:
        return np.zeros(0, np.uint64)
    bounds = level_bounds(n)
    level = int(np.searchsorted(bounds, n, "right")) - 1
    out = []
    high = s >> np.uint64(32)
    sums = None
    while level >= 0:
        differ = (int(bounds[level + 1]) - 1) * (den - num) // num
        if differ:
            k = ranges(int(bounds[level]), differ)
            seg = (high * np.uint64(k)) >> np.uint64(32)
            starts = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
            if sums is None:
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(kernels.mix(s))])
            part = sums[np.append(starts[1:], n)] - sums[starts]
            salt = np.uint64((level + 1) * int(_LEVEL) & 0xFFFFFFFFFFFFFFFF)
            out.append(kernels.mix(part + seg[starts] * _SEG + salt))
            if len(starts) <= differ:
                empty = np.setdiff1d(np.arange(k, dtype=np.uint64), seg[starts])
                out.append(kernels.mix(empty * _SEG + salt))
        level -= 1
        if level < 0 or (int(bounds[level + 1]) - 1) * den < n * num:
            break
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def spare(n: int, num: int, den: int) -> int:
    """Common shingles that the prefixes of linked sets show, if the smaller has ``n`` shingles."""
    return max(1, -(-n * (den - num) // den))


def prefix(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """The least hashes of a set: those that a partner may lack, and ``spare`` more. Of linked sets a and b with o shingles in common,
    the k-th least common one is at place |a| - o + k of a at most; o is at least num / den of either size."""
    n = len(s)
    return s[: n - -(-n * num // den) + spare(n, num, den)]


def rare_first(s: np.ndarray, often: np.ndarray, rank: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a set (sorted) the first shingles that a partner may lack and one more, and which of them are popular. Shingles not in ``often`` (sorted) come first, by hash, then
    those in it by ``rank``. So sets that link share one: the order is the same for all, and o common shingles leave |a| - o others of a."""
    if len(often):
        at = np.minimum(np.searchsorted(often, s), len(often) - 1)
        place = np.where(often[at] == s, rank[at], -1)
    else:
        place = np.full(len(s), -1)
    first = np.lexsort((s, place))[: len(s) + 1 - -(-len(s) * num // den)]
    return s[first], place[first] >= 0


# --- signature tree ---


class Forest:
    """Union-find; the root is the least member."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


class SignatureTree:
    """Levels of nodes over sets ordered by size: ``bits[l]`` OR of bitmaps, ``low/high[l]`` sizes, ``least[l]`` fewest bits, of nodes of
    ``LEAF ** l`` sets."""

    def __init__(self, members: list[int], sets: list[np.ndarray], width: int):
        self.members = sorted(members, key=lambda i: (len(sets[i]), i))
        n = len(self.members)
        bits = np.zeros((n, width // 8), np.uint8)
        for row, i in enumerate(self.members):
            flags = np.zeros(width, bool)
            flags[(sets[i] & np.uint64(width - 1)).astype(np.int64)] = True
            bits[row] = np.packbits(flags)
        sizes = np.array([len(sets[i]) for i in self.members], np.int64)
        self.bits, self.low, self.high, self.least = [bits], [sizes], [sizes], [np.bitwise_count(bits).sum(1, dtype=np.int64)]
        while len(self.low[-1]) > 1:
            at = np.arange(0, len(self.low[-1]), LEAF)
            self.bits.append(np.bitwise_or.reduceat(self.bits[-1], at, axis=0))
            self.low.append(np.minimum.reduceat(self.low[-1], at))
            self.high.append(np.maximum.reduceat(self.high[-1], at))
            self.least.append(np.minimum.reduceat(self.least[-1], at))

    @property
    def top(self) -> int:
        return len(self.low) - 1

    def under(self, level: int, node: int) -> range:
        return range(node * LEAF**level, min((node + 1) * LEAF**level, len(self.members)))

    def children(self, level: int, node: int) -> range:
        return range(node * LEAF, min((node + 1) * LEAF, len(self.low[level - 1])))


def _possible(x: SignatureTree, lx: int, i: int, y: SignatureTree, ly: int, js: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which nodes js of y may hold a partner of a set under node i of x: a set has at least as many shingles outside the other
    as bits outside the other node, and sets link from num / (num + den) of their sizes' sum in common."""
    common = np.bitwise_count(y.bits[ly][js] & x.bits[lx][i]).sum(1, dtype=np.int64)
    most_x = x.high[lx][i] - np.maximum(x.least[lx][i] - common, 0)
    most_y = y.high[ly][js] - np.maximum(y.least[ly][js] - common, 0)
    fits = most_x * (num + den) >= num * (x.high[lx][i] + y.low[ly][js])
    return fits & (most_y * (num + den) >= num * (y.high[ly][js] + x.low[lx][i]))


def dual_join(x: SignatureTree, y: SignatureTree, sets: list[np.ndarray], forest: Forest, num: int, den: int) -> None:
    """Joins in ``forest`` all members of x and y that link (x may be y). Pairs already connected are left out."""

    def single(tree: SignatureTree, level: int, node: int) -> int:
        """The one component under a node, or -1."""
        places = tree.under(level, node)
        root = forest.root(tree.members[places[0]])
        return root if all(forest.root(tree.members[p]) == root for p in places[1:]) else -1

    stack = [(x.top, 0, y.top, 0)]
    while stack:
        lx, i, ly, j = stack.pop()
        if lx == 0 and ly == 0:
            a, b = x.members[i], y.members[j]
            if a != b and forest.root(a) != forest.root(b):
                both = len(sets[a]) + len(sets[b])
                small, large = (sets[a], sets[b]) if len(sets[a]) < len(sets[b]) else (sets[b], sets[a])
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                overlap = int(np.count_nonzero(large[at] == small))
                if overlap * (num + den) >= num * both:
                    forest.join(a, b)
            continue
        root = single(x, lx, i)
        if root >= 0 and root == single(y, ly, j):
            continue
        # Of a tree with itself, only pairs whose x comes first or that overlap.
        if lx >= ly:
            kids = np.array(x.children(lx, i))
            if x is y:
                kids = kids[kids * LEAF ** (lx - 1) < (j + 1) * LEAF**ly]
            kids = kids[_possible(y, ly, j, x, lx - 1, kids, num, den)]
            stack += [(lx - 1, int(k), ly, j) for k in kids[::-1]]
        else:
            kids = np.array(y.children(ly, j))
            if x is y:
                kids = kids[i * LEAF**lx < (kids + 1) * LEAF ** (ly - 1)]
            kids = kids[_possible(x, lx, i, y, ly - 1, kids, num, den)]
            stack += [(lx, i, ly - 1, int(k)) for k in kids[::-1]]


def join_group(ids: list[int], known: list[int], side: list[int], sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Links of a block as (id, id of its component). Sets of side 1 are held against all; without any, all against all.
    ``known``: components so far, equal ones need no link."""
    forest = Forest(len(ids))
    first: dict[int, int] = {}
    for i, c in enumerate(known):
        forest.join(first.setdefault(c, i), i)
    width = 1 << max(8, min(15, (2 * max(len(s) for s in sets)).bit_length()))
    inner, outer = [i for i in range(len(ids)) if side[i] == 0], [i for i in range(len(ids)) if side[i] == 1]
    if outer and inner:
        everything, some = SignatureTree(inner + outer, sets, width), SignatureTree(outer, sets, width)
        dual_join(some, everything, sets, forest, num, den)
    else:
        tree = SignatureTree(inner or outer, sets, width)
        dual_join(tree, tree, sets, forest, num, den)
    return [(ids[i], ids[forest.root(i)]) for i in range(len(ids)) if forest.root(i) != i]


# --- Spark ---


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (hash, set_id, counted) in order of (hash, set_id), to (set_id, n): how many hashes of a set, not yet counted, another set
    has too. Of the open hash only its first row is held, until a second set comes."""
    open_hash = last = waiting = None
    for batch in batches:
        h, own = (batch.column(c).to_numpy() for c in ("hash", "set_id"))
        if not len(h):
            continue
        counted = batch.column("counted").to_numpy(zero_copy_only=False)
        opens = np.concatenate([[h[0] != open_hash], h[1:] != h[:-1]])
        new = opens | np.concatenate([[own[0] != last], own[1:] != own[:-1]])
        number = np.cumsum(opens)  # 0: the hash that was open before
        distinct = np.bincount(number, new, minlength=int(number[-1]) + 1).astype(int)
        take = new & ~counted & ((number == 0) | (distinct[number] > 1))
        sets = own[take]
        if distinct[0] and waiting is not None:
            sets = np.append(sets, waiting)
            waiting = None
        starts = np.flatnonzero(opens)
        if len(starts):
            k = int(starts[-1])
            waiting = own[k] if distinct[-1] < 2 and not counted[k] else None
        open_hash, last = h[-1], own[-1]
        if len(sets):
            ids, n = np.unique(sets, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n.astype(np.int64))], ["set_id", "n"])


def _tokens(batches: Iterator[pa.RecordBatch], size: int, num: int, den: int, nth: int = 0, passes: int = 1) -> Iterator[pa.RecordBatch]:
    """Hashes of the prefixes' shingles, 48 bits (a collision weakens the filter and loses nothing), of them those of the pass. Sets that share one
    within a chunk are counted here, as rows without hash; one of them goes on for all."""

    def out(parts: list[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        h = (np.concatenate([p for _, p in parts]) >> np.uint64(16)).view(np.int64)
        own = np.repeat(np.array([x for x, _ in parts], np.int64), [len(p) for _, p in parts])
        order = np.lexsort((own, h))
        h, own = h[order], own[order]
        opens = np.concatenate([[True], h[1:] != h[:-1]])
        new = opens | np.concatenate([[True], own[1:] != own[:-1]])
        number = np.cumsum(opens) - 1
        many = np.bincount(number, new) > 1
        sets, n = np.unique(own[new & many[number]], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(h[opens]), pa.array(own[opens]), pa.array(many), pa.nulls(int(opens.sum()), pa.int64())], ["hash", "set_id", "counted", "n"])
        yield pa.RecordBatch.from_arrays([pa.array(sets), pa.array(sets), pa.array(np.ones(len(sets), bool)), pa.array(n.astype(np.int64))], ["hash", "set_id", "counted", "n"])

    parts, rows = [], 0
    for batch in batches:
        for _, s in shingle_sets(*kernels.text_buffers(batch.column("text")), size):
            own = prefix(s, num, den) if len(s) else s
            if passes > 1:
                own = own[(own >> np.uint64(16)) % np.uint64(passes) == np.uint64(nth)]
            if len(own):
                parts.append((set_hash(s), own))
                rows += len(own)
            if rows > CHUNK_ROWS:
                yield from out(parts)
                parts, rows = [], 0
    if parts:
        yield from out(parts)


def _count_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that a chunk counted pass; the others are read by ``_shared``."""

    def others() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ready = batch.filter(batch.column("n").is_valid())
            if ready.num_rows:
                done.append(ready.select(["set_id", "n"]))
            yield batch.filter(batch.column("n").is_null())

    done: list[pa.RecordBatch] = []
    for found in _shared(others()):
        yield from done
        done.clear()
        yield found
    yield from done


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (sig, set_id) to links of each set with the least that shares its signature; ready links pass. Only the
    open signature and its least set are held."""
    sig = least = None
    for batch in batches:
        other = batch.column("other")
        ready = batch.filter(other.is_valid())
        if ready.num_rows:
            yield pa.RecordBatch.from_arrays([ready.column("set_id"), ready.column("other")], ["a", "b"])
        rows = batch.filter(other.is_null())
        if not rows.num_rows:
            continue
        g, own = rows.column("sig").to_numpy(), rows.column("set_id").to_numpy()
        opens = np.concatenate([[g[0] != sig], g[1:] != g[:-1]])
        first = own[opens] if opens[0] else np.concatenate([[least], own[opens]])
        pivot = first[np.cumsum(opens) - int(opens[0])]
        far = own != pivot
        if far.any():
            pairs = np.unique(np.stack([own[far], pivot[far]], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])
        sig, least = g[-1], pivot[-1]



def _popular(texts: DataFrame, size: int, work: Workspace) -> tuple[np.ndarray, np.ndarray, bool]:
    """Shingles (sorted) of more than one set, their places from the least popular one on, and whether these are all; ``POPULAR`` of them at most, those of the most sets."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(parts: list[np.ndarray]) -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(parts), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["hash", "n"])

        parts, rows = [], 0
        for batch in batches:
            for _, s in shingle_sets(*kernels.text_buffers(batch.column("text")), size):
                parts.append(s)
                rows += len(s)
                if rows > CHUNK_ROWS:
                    yield out(parts)
                    parts, rows = [], 0
        if rows:
            yield out(parts)

    counted = texts.select("text").mapInArrow(count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).where("n > 1")
    counted = work.keep(counted, "popular")
    least, rows, whole = 0, 0, True
    for n, shingles in sorted(counted.groupBy("n").agg(F.count(F.lit(1))).collect(), reverse=True):
        rows += shingles
        whole = rows <= POPULAR
        if not whole:
            break
        least = n
    found = counted.where(F.col("n") >= least if least else F.lit(False)).toArrow()
    h, n = (found.column(c).to_numpy() for c in ("hash", "n"))
    h = h.view(np.uint64)
    order = np.argsort(h)
    rank = np.empty(len(h), np.int64)
    rank[np.lexsort((h, n))] = np.arange(len(h))
    return h[order], rank[order], whole


def _rarely_shared(texts: DataFrame, size: int, num: int, den: int, signed: Callable[[Iterator[tuple[int, np.ndarray]]], Iterator[pa.RecordBatch]], work: Workspace) -> DataFrame:
    """Signatures (sig, set_id, other) of the sets of large groups (set_id, group, text): of each group's sets that link, two share one."""
    often, rank, whole = _popular(texts, size, work)
    sent = texts.sparkSession.sparkContext.broadcast((often, rank))

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        for batch in batches:
            own, group = batch.column("set_id").to_numpy(), batch.column("group").to_numpy().view(np.uint64)
            for row, s in shingle_sets(*kernels.text_buffers(batch.column("text")), size):
                if set_hash(s) == own[row]:
                    first, known = rare_first(s, *sent.value, num, den)
                    # If all shared shingles are known, no other set has one that is not.
                    yield int(own[row]), kernels.mix((first[known] if whole else first) ^ kernels.mix(group[row : row + 1]))

    return texts.select("set_id", "group", "text").mapInArrow(lambda batches: signed(rare(batches)), "sig long, set_id long, other long")


def _linked(docs: DataFrame, size: int, num: int, den: int, block: int, work: Workspace) -> DataFrame:
    """doc_id, text_key, n, set_id, component (least doc_id) and group (a set of the component) for each row of ``docs`` (doc_id, text)."""
    kind = dict(docs.dtypes)["doc_id"]
    slim = docs.select("doc_id", "text")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(len(s), set_hash(s)) for _, s in shingle_sets(*kernels.text_buffers(batch.column("text")), size)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array([n for n, _ in found], pa.int64()), pa.array([h for _, h in found], pa.int64())], ["doc_id", "text_key", "n", "set_id"]
            )

    def signed(own_of: Iterator[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        """Signatures (sig, set_id) of sets, one a chunk: of sets that share one within a chunk, the least goes on for all, and the others
        become links to it here. So a hot signature reaches the shuffle once a chunk."""

        def out(parts: list[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            sig = np.concatenate([p for _, p in parts]).view(np.int64)
            own = np.repeat(np.array([h for h, _ in parts], np.int64), [len(p) for _, p in parts])
            order = np.lexsort((own, sig))
            sig, own = sig[order], own[order]
            opens = np.concatenate([[True], sig[1:] != sig[:-1]])
            least = own[opens][np.cumsum(opens) - 1]
            pairs = np.unique(np.stack([own, least], 1)[own != least], axis=0)
            none = pa.nulls(int(opens.sum()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(sig[opens]), pa.array(own[opens]), none], ["sig", "set_id", "other"])
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["sig", "set_id", "other"])

        parts, rows = [], 0
        for set_id, own in own_of:
            if len(own):
                parts.append((set_id, own))
                rows += len(own)
            if rows > CHUNK_ROWS:
                yield from out(parts)
                parts, rows = [], 0
        if parts:
            yield from out(parts)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return signed((set_hash(s), signatures(s, num, den)) for batch in batches for _, s in shingle_sets(*kernels.text_buffers(batch.column("text")), size))

    def grouped(rows: DataFrame, name: str) -> DataFrame:
        """set_id, group: components of sets that share a signature, of rows (sig, set_id, other)."""
        near = rows.repartition("sig").sortWithinPartitions("sig", "set_id").mapInArrow(_near, "a long, b long")
        return components(near, work, name).select(F.col("node").alias("set_id"), F.col("comp").alias("group"))

    def measured(groups: DataFrame) -> DataFrame:
        """set_id, group, first, n, sets, shingles, blocks: groups' sets with their group's size."""
        members = groups.join(firsts.select("set_id", "first", "n"), "set_id")
        sizes = members.groupBy("group").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("shingles"))
        cut = F.ceil(F.greatest(F.col("sets") / block, F.col("shingles") / BLOCK_SHINGLES)).cast("long")
        return members.join(sizes, "group").withColumn("blocks", F.greatest(cut, F.lit(1)))

    keyed = slim.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    described = work.keep(keyed.mapInArrow(describe, f"doc_id {kind}, text_key long, n long, set_id long"), "sets")
    firsts = described.where("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("first"), F.max("n").alias("n"), F.count(F.lit(1)).alias("rows"))
    firsts = work.keep(firsts, "firsts")
    hot = work.keep(firsts.where(F.col("rows") > hot_rows(described.count())).select("set_id"), "hot")
    hot = None if hot.isEmpty() else hot
    signing = slim
    if size >= RARE_SIZE:
        shown = F.col("n") - F.ceil(F.col("n") * num / den) + F.greatest(F.ceil(F.col("n") * (den - num) / den), F.lit(1))
        passes = max(1, min(PASSES, -(-(described.agg(F.sum(shown)).first()[0] or 0) // PASS_ROWS)))
        shared = None
        for k in range(passes):
            counted = slim.mapInArrow(lambda batches, k=k: _tokens(batches, size, num, den, k, passes), "hash long, set_id long, counted boolean, n long")
            counted = counted.repartition("hash").sortWithinPartitions("hash", "set_id").mapInArrow(_count_shared, "set_id long, n long")
            part = work.keep(counted.groupBy("set_id").agg(F.sum("n").alias("n")), f"shared{k}")
            shared = part if shared is None else shared.unionAll(part)
        shared = shared.groupBy("set_id").agg(F.sum("n").alias("shared"))
        least = F.ceil(F.ceil(F.col("n") * num / den) * (den - num) / den)
        # Equal texts of different rows are one set: a set of several rows needs no partner, and one without may leave.
        able = firsts.join(shared, "set_id").where(F.col("shared") >= F.greatest(least, F.lit(1))).select("set_id")
        able = work.keep(join_by(described, able, "set_id", hot).select(F.col("doc_id").alias("_id")).distinct(), "able")
        signing = work.keep(slim.join(small_side(able), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi"), "candidates")
    groups = grouped(signing.mapInArrow(sign, "sig long, set_id long, other long"), "groups")
    members = work.keep(measured(groups), "members")
    wanted = small_side(work.keep(members.select("set_id", "first", "group", "blocks", "n"), "wanted"))
    # A row of the id with another text is dropped in the block, where its set is known.
    texts = work.keep(signing.join(wanted, F.col("doc_id").eqNullSafe(F.col("first"))).select("set_id", "group", "blocks", "n", "text"), "texts")
    large = texts.where("blocks > 1")
    if size >= RARE_SIZE and not large.isEmpty():
        rarer = work.keep(measured(grouped(_rarely_shared(large, size, num, den, signed, work), "rarer")), "rarer-members")
        parted = work.keep(large.select("set_id", "text").join(small_side(rarer.select("set_id", "group", "blocks", "n")), "set_id").select(*texts.columns), "parted")
        texts = texts.where("blocks = 1").unionByName(parted)
        members = members.where("blocks = 1").unionByName(rarer)
        large = parted.where("blocks > 1")

    def join(table: pa.Table) -> pa.Table:
        ids, known, side, sets, seen = [], [], [], [], set()
        at = [table.column(c).to_pylist() for c in ("set_id", "known", "side")]
        for row, s in shingle_sets(*kernels.text_buffers(table.column("text")), size):
            if at[0][row] not in seen and set_hash(s) == at[0][row]:
                seen.add(at[0][row])
                for keep, values in zip((ids, known, side), at):
                    keep.append(values[row])
                sets.append(s)
        found = join_group(ids, known, side, sets, num, den) if len(ids) > 1 else []
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    own_block = F.pmod(F.xxhash64("set_id"), F.col("blocks"))
    rows = texts.select("group", own_block.alias("block"), "set_id", F.col("set_id").alias("known"), F.lit(0).alias("side"), "text")
    if large.isEmpty():
        return _result(described, firsts, hot, work.keep(rows.groupBy("group", "block").applyInArrow(join, "a long, b long"), "links"), work)
    # Groups of several blocks: pivots go to every block of their group.
    picked = members.where("blocks > 1").where(F.pmod(F.xxhash64("set_id"), F.col("sets")) < 4 * PIVOTS)
    ranked = picked.groupBy("group").agg(F.slice(F.array_sort(F.collect_set("set_id")), 1, PIVOTS).alias("pivots"))
    pivots = large.join(ranked.select("group", F.explode("pivots").alias("set_id")), ["group", "set_id"])
    pivots = pivots.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.unionByName(pivots.select("group", "block", "set_id", F.col("set_id").alias("known"), F.lit(0).alias("side"), "text"))
    links = work.keep(rows.groupBy("group", "block").applyInArrow(join, "a long, b long"), "links1")
    known = components(links, work, "known")
    state = large.join(known, F.col("set_id") == F.col("node"), "left").select("set_id", "group", "blocks", "n", F.coalesce("comp", "set_id").alias("known"), "text")
    weight = state.groupBy("group", "known").agg(F.count(F.lit(1)).alias("sets"))
    main = weight.groupBy("group").agg(F.max_by("known", F.struct("sets", "known")).alias("main"), F.count(F.lit(1)).alias("parts"), F.sum("sets").alias("all"), F.max("sets").alias("most"))
    main = main.where("parts > 1").withColumn("chunks", F.ceil((F.col("all") - F.col("most")) / block).cast("long"))
    state = work.keep(state.join(main.select("group", "main", "chunks"), "group"), "state")
    rest = state.where("known != main").withColumn("chunk", F.pmod(F.xxhash64("set_id", F.lit(3)), F.col("chunks")))
    place = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")
    inner = state.select("group", own_block.alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), "set_id", "known", F.lit(0).alias("side"), "text")
    outer = rest.select("group", place, "chunk", "set_id", "known", F.lit(1).alias("side"), "text")
    # A set that is on both sides of a task counts once, as one that is held against all.
    both = outer.unionByName(inner.join(rest.select("set_id", "chunk"), ["set_id", "chunk"], "left_anti").select(*outer.columns))
    more = work.keep(both.groupBy("group", "block", "chunk").applyInArrow(join, "a long, b long"), "links2")
    return _result(described, firsts, hot, links.unionAll(more), work)


def _result(described: DataFrame, firsts: DataFrame, hot: DataFrame | None, links: DataFrame, work: Workspace) -> DataFrame:
    linked = components(links, work, "linked").join(firsts.select(F.col("set_id").alias("node"), "first"), "node")
    least = linked.groupBy("comp").agg(F.min("first").alias("component"))
    linked = linked.join(least, "comp").select(F.col("node").alias("set_id"), "component", F.col("comp").alias("group"))
    owners = firsts.join(linked, "set_id", "left").select("set_id", F.coalesce("component", "first").alias("component"), F.coalesce("group", "set_id").alias("group"))
    owners = work.keep(owners, "owners")
    work.drop_but("sets", "owners", "hot")
    alone = described.where("n = 0").withColumns({"component": F.col("doc_id"), "group": F.lit(None).cast("long")})
    return join_by(described.where("n > 0"), owners, "set_id", hot).unionByName(alone)


def link_components(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, block: int = BLOCK_SETS, work: Workspace | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs`` (doc_id, text)."""
    found = _linked(docs, size, num, den, block, work or Workspace(docs.sparkSession, "jaccard"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def keep_first(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of ``docs`` for each component: that whose doc_id is the component's. Of several such rows, the one of the least set and text
    hash; of rows with equal id and text, the one that comes first as JSON."""
    work, kept = Workspace(docs.sparkSession, "jaccard"), Workspace(docs.sparkSession, "copies")
    found = kept.keep(_linked(docs, size, num, den, BLOCK_SETS, work).where("n > 0"), "found")
    work.drop()
    heads = F.col("doc_id").eqNullSafe(F.col("component"))
    own = found.where(heads).groupBy("group").agg(F.min(F.struct("set_id", "text_key")).alias("least"), F.count(F.lit(1)).alias("rows"))
    own = kept.keep(own.where("rows > 1").select("group", "least"), "several")
    gone = found.where(~heads).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_text"))
    again = None
    if not own.isEmpty():
        same = found.where(heads).join(small_side(own), "group").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_text"), (F.struct("set_id", "text_key") == F.col("least")).alias("first"))
        gone = gone.unionAll(same.where("NOT first").select("_id", "_text"))
        again = same.where("first").groupBy("_id", "_text").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
        again = small_side(kept.keep(again.select("_id", "_text"), "again"))
    gone = small_side(kept.keep(gone.distinct(), "gone"))
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col("doc_id").alias("_own"), F.xxhash64("text").alias("_key"))
    same = F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_text"))
    out = keyed.join(gone, same, "left_anti")
    if again is not None:
        once = out.join(again, same, "left_semi").groupBy("_own", "_key").agg(F.min_by("_row", F.to_json("_row")).alias("_row"))
        out = out.join(again, same, "left_anti").select("_row").unionAll(once.select("_row"))
    return out.select("_row.*")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return link_components(docs, size=3, num=90, den=100)
