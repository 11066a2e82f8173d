"""op11 to op13 against brute force: nulls, empty and very long texts, ties, repeated rows, empty tables, hot keys, clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillspark.llm import components, prefixes, simhash, whitening, workspace
from quillspark.llm.workspace import Workspace

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture
def all_hot(monkeypatch):
    """Every key of more than three rows is treated as a hot one."""
    for module in (workspace, prefixes, simhash, components):
        monkeypatch.setattr(module, "hot_rows", lambda rows: 3, raising=False)
    monkeypatch.setattr(components, "FEW", 0)


# --- op11 ---


def order_of(role, text):
    """What equal turns follow: Spark's 64-bit hashes of role and text."""
    own = []
    for seeds in ((), (7,)):
        h = 42
        for s in seeds:
            h = xxhash.xxh64_intdigest(s.to_bytes(4, "little", signed=True), h)
        for s in (role, text):
            h = xxhash.xxh64_intdigest(s.encode(), h)
        own.append(h - (1 << 64) if h >> 63 else h)
    return tuple(own)


def own_turns(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            by[conv].append((turn is not None, turn or 0, *order_of(role or "", text or ""), role or "", text or ""))
    return {c: tuple(x[4:] for x in sorted(v)) for c, v in by.items()}


def rebuilt(rows):
    own = own_turns(rows)
    out = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - int(math.fmod(c, 5)), ())[:h] + v[h:]
    return out


def brute_trie(sequences):
    members, kids, leaves, saved = defaultdict(list), Counter(), Counter(), Counter()
    for c, v in sequences.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    end = lambda p, m: hashlib.sha256(",".join(map(str, sorted(c for c in m if len(sequences[c]) == len(p)))).encode()).hexdigest()
    return Counter((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], end(p, m)) for p, m in members.items())


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def awkward_turns():
    rng = random.Random(3)
    say = lambda: rng.choice(["a", "bé", "", None, "long " * 3000, "x", "y", "z"])
    rows = [(c, rng.choice([0, 1, 2, 3, 4, None, 2]), rng.choice(["user", "assistant", None]), say()) for c in range(-7, 40) for _ in range(rng.randint(1, 9))]
    rows += [(c, t, "user", f"same {t}") for c in range(100, 160) for t in range(3)]  # a hot conversation
    rows += [(200, t, "user", str(t % 7)) for t in range(700)] + [(205, t, "user", str(t % 7)) for t in range(650)] + [(201, 650, "user", "tail")]  # long ones
    rows += [(300 + k, t, "u", "one" if t < k else f"{k}") for k in range(12) for t in range(k + 1)]  # leaves a path at every depth
    rows += [(9, 1, "user", "a")] * 3 + [(None, 1, "user", "lost")] + [(77, 0, "u", "t")]
    return rows


@pytest.mark.parametrize("hot", [False, True])
def test_op11_against_brute_force(spark, tmp_path, hot, monkeypatch, request):
    if hot:
        request.getfixturevalue("all_hot")
        monkeypatch.setattr(prefixes, "CHUNK", 3)
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = awkward_turns()
        frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], TURNS + ", depth string, n1 long").repartition(6)
        found = prefixes.prefix_trie(frame).collect()
        assert Counter(tuple(r[c] for c in COLUMNS) for r in found) == brute_trie(own_turns(rows))
        # Preorder intervals: places are 0 to n - 1, and a node's interval holds as many nodes as its subtree.
        assert sorted(r["preorder"] for r in found) == list(range(len(found)))
        place = {r["preorder"]: r for r in found}
        for r in found:
            inside = [place[k] for k in range(r["preorder"] + 1, r["subtree_end"] + 1)]
            assert all(x["depth"] > r["depth"] for x in inside) and sum(x["depth"] == r["depth"] + 1 for x in inside) == r["n_children"]
        frame.write.parquet(f"{tmp_path}/conversations.parquet")
        assert Counter(map(tuple, prefixes.op11(spark, str(tmp_path)).collect())) == brute_trie(rebuilt(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_op11_on_the_table_and_on_nothing(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert Counter(map(tuple, prefixes.op11(spark, SF).collect())) == brute_trie(rebuilt(rows))
    assert prefixes.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
    assert prefixes.prefix_trie(spark.createDataFrame([(None, 1, "a", "b")], TURNS)).count() == 0


# --- op12 ---


def test_op12_against_exact_numbers(spark):
    rng = random.Random(5)
    base = [[rng.gauss(0, s) for s in (1, 2, 0.5, 30000, 1)] for _ in range(300)]
    rows = [(k, v) for k, v in enumerate(base)] + [(7, base[7]), (None, base[0]), (400, None), (401, [1.0, None, 2.0, 3.0, 4.0]), (402, [float("nan")] * 5), (403, [float("inf")] * 5), (404, []), (405, [1.0, 2.0])]
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id long, embedding array<double>, component string, n long")
    own = [(k, [math.floor(Fraction(c) * 1024) + 100_000 for c in v]) for k, v in rows[:302]]
    n, sums = len(own), [sum(c) for c in zip(*(v for _, v in own))]
    covariance = np.array([[float(Fraction(sum(x[i] * x[j] for _, x in own) * n - sums[i] * sums[j], n * n)) for j in range(5)] for i in range(5)])
    values, vectors = np.linalg.eigh(covariance)
    found = whitening.whiten(frame, count=3).collect()
    assert len(found) == 3 * n and {r["n"] for r in found} == {n} and {r["component"] for r in found} == {1, 2, 3}
    deviation = Counter((k, sum((n * c - s) ** 2 for c, s in zip(v, sums))) for k, v in own)
    assert Counter((r["vec_id"], int(r["deviation"])) for r in found if r["component"] == 2) == deviation
    for c in (1, 2, 3):
        axis = vectors[:, -c]
        expected = sorted((k if k is not None else -1, float((np.array(v) - np.array(sums) / n) @ axis / math.sqrt(values[-c]))) for k, v in own)
        got = sorted((r["vec_id"] if r["vec_id"] is not None else -1, r["whitened"]) for r in found if r["component"] == c)
        sign = 1 if abs(got[5][1] - expected[5][1]) < abs(got[5][1] + expected[5][1]) else -1
        assert all(a == b and abs(x - sign * y) < 1e-9 for (a, x), (b, y) in zip(sorted(got), sorted(expected)) if a != 7)
        assert abs(next(r["explained"] for r in found if r["component"] == c) / (values[-c] / covariance.trace()) - 1) < 1e-9
    assert {r["identity_error"] for r in found}.pop() < 1e-6


def test_op12_awkward_tables(spark):
    kind = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], kind)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], kind)).count() == 0  # no variance
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], kind)).count() == 0
    huge = [(1, [1e30, -2.5]), (2, [-3e30, 4.0]), (3, [2e29, 0.25])]  # beyond a long
    found = whitening.whiten(spark.createDataFrame(huge, "vec_id long, embedding array<double>"), count=1).collect()
    assert len(found) == 3 and all(r["deviation"] is None and abs(r["whitened"]) < 3 for r in found) and found[0]["identity_error"] < 1e-6


def test_op12_residues():
    rng = np.random.default_rng(1)
    x = rng.integers(-(10**12), 10**12, (5000, 3))
    bound = 2 * len(x) * 10**24 + 2
    moduli = whitening.primes(bound)
    assert math.prod(moduli) >= bound and all(p < whitening.PRIME_LIMIT for p in moduli)
    parts = whitening.residue_products(x, moduli)
    exact = np.concatenate([np.ones((len(x), 1), object), x.astype(object)], 1)
    exact = exact.T @ exact
    assert all(whitening.remainders([int(p[i, j]) for p in parts], moduli) == exact[i, j] for i in range(4) for j in range(4))
    assert whitening.squared_lengths(x) == [sum(int(c) ** 2 for c in r) for r in x] == whitening.squared_lengths(x.astype(object))
    assert whitening.whole(np.array([[1e300, -0.1]]))[0, 0] == math.floor(Fraction(1e300) * 1024) + 100_000


# --- op13 ---


def fingerprint(text, size=3):
    own = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
    parts = [" ".join(own[k : k + size]) for k in range(len(own) - size + 1)] if len(own) >= size else [" ".join(own)] * bool(own)
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_near(points, radius):
    """The least of the ids that links reach, for (id, fingerprint)."""
    up = list(range(len(points)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (_, a) in enumerate(points):
        for j in range(i):
            if (a ^ points[j][1]).bit_count() <= radius:
                up[max(root(i), root(j))] = min(root(i), root(j))
    least = defaultdict(list)
    for i, (d, _) in enumerate(points):
        least[root(i)].append(d)
    return Counter((d, f, min((x for x in least[root(i)] if x is not None), default=None)) for i, (d, f) in enumerate(points))


def test_op13_xxh64():
    rng = random.Random(1)
    data = np.frombuffer(rng.randbytes(6000), np.uint8)
    start = np.array([rng.randrange(0, 4000) for _ in range(2000)])
    end = start + np.array([rng.choice([0, 1, 3, 4, 5, 7, 8, 9, 15, 16, 31, 32, 33, 63, 64, 100, 511, 512, 513, 1500]) for _ in start])
    assert [int(x) for x in simhash.xxh64(data, start, end)] == [xxhash.xxh64_intdigest(data[a:b].tobytes(), 42) for a, b in zip(start, end)]


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_op13_masks_cover(radius):
    masks, rng = simhash.covering_masks(radius), random.Random(2)
    for _ in range(3000):
        bits = sum(1 << b for b in rng.sample(range(64), rng.randint(0, radius)))
        assert any(not bits & m for m in masks)


def test_op13_texts(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(200)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long = say(60_000)
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One"), (5, "one"), (6, "one Two"), (7, "x" * 100_000), (8, long), (9, long + " tail"), (9, long + " tail"), (None, long), (None, "lonely text here"), (10, long.upper()), (11, say(3)), (12, say(4))]
    rows += [(20 + k, say(rng.randint(1, 90))) for k in range(30)]
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, fp string, component_id long")
    found = Counter((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.simhash_components(frame).collect())
    assert found == brute_near([(d, fingerprint(t)) for d, t in rows], 2)
    assert simhash.simhash_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = simhash.op13(spark, SF).collect()
    docs = [(r["doc_id"], fingerprint(r["text"])) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert Counter((r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in got) == brute_near(docs, 2) and all(len(r["fingerprint"]) == 16 for r in got)


@pytest.mark.parametrize("radius, hot", [(1, False), (2, False), (2, True), (3, False)])
def test_op13_links_join_all_within_the_radius(spark, radius, hot, request):
    """Crowds of fingerprints around a few centres, so that buckets are paired, searched by neighbours, or spread over tasks."""
    if hot:
        request.getfixturevalue("all_hot")
    rng = random.Random(radius)
    centres = [rng.getrandbits(64) for _ in range(4)]
    points = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centres for _ in range(150)} | {rng.getrandbits(64) for _ in range(100)}
    points = sorted(p - (1 << 64) if p >> 63 else p for p in points)
    work = Workspace(spark, "test")
    links = simhash.near_links(spark.createDataFrame([(p,) for p in points], "fp long"), radius, work)
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= radius for a, b in links.collect())
    comp = {r["node"]: r["comp"] for r in components.components(links, work, "linked").collect()}
    assert Counter((p, p & (1 << 64) - 1, comp.get(p, p)) for p in points) == brute_near([(p, p & (1 << 64) - 1) for p in points], radius)


def test_components_of_a_hub_and_of_a_path(spark, all_hot):
    edges = [(0, k) for k in range(1, 40)] + [(k, k + 1) for k in range(1000, 1012)] + [(5, 5), (2000, 2001)]
    got = {r["node"]: r["comp"] for r in components.components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "test"), "c").collect()}
    assert got == {k: 0 for k in range(40)} | {k: 1000 for k in range(1000, 1013)} | {2000: 2000, 2001: 2000}
