"""Operators against brute force and DuckDB, with nulls, empty texts, ties, repeated rows, extra columns and empty tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from html import unescape

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import html_text, jaccard, lines, mixing, pii, quality, queries, suffixes, tiling, urls, warc
from tests.oracle import assert_same, connect

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PAGES = "page_id long, url string, html string"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_duckdb(spark, name):
    assert_same(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLES[name])


def awkward(spark, extra=()):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [say(80) for _ in range(4)]
    rows = [(1, None, "en", "a", None), (2, "", None, "a", 0), (3, " \n\t", "en", None, 3), (4, "x" * 5000, "en", "b", 5000), (5, base[0], "en", "a", 1), (5, base[0], "en", "a", 1), (6, base[0] + " tail", "de", "b", 1), (None, base[1], "en", "a", 1), (7, base[1], "xx", "b", 1), (8, base[2].upper(), "en", None, 1), (9, base[2], "en", "a", 1)]
    rows += [(10 + k, say(rng.randint(3, 120)), rng.choice(("en", "de")), rng.choice("abc"), 1) for k in range(30)]
    rows += list(extra)
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], DOCS + ", key string, group long")


def empty(spark, schema=DOCS):
    return spark.createDataFrame([], schema)


def test_op1_edges(spark):
    got = pii.find_pii(awkward(spark, [(90, "a@b.cd 1.2.3.4 +1 (319) 555-5132", "en", "a", 1)])).collect()
    row = next(r for r in got if r["doc_id"] == 90)
    assert (row["n_email"], row["n_ip"], row["n_card"], row["n_phone"]) == (1, 1, 0, 1) and row["spans"] == "email:0:6,ip:7:14,phone:15:32"
    assert next(r for r in got if r["doc_id"] == 1)["base_sha256"] == hashlib.sha256(b"").hexdigest() and len(got) == 42
    assert pii.find_pii(empty(spark)).count() == 0
    clean = pii.redact(awkward(spark, [(90, "a@b.cd x", "en", "a", 1)])).where("doc_id = 90").first()
    assert clean["text"] == "[EMAIL] x" and clean["key"] == "clash"


def test_op1_long_tokens_and_capitals(spark):
    rng = random.Random(1)
    token = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    own = [token(n) for n in (200, 201, 300, 600, 5000)]
    rows = [(k, f"the file {t} was here") for k, t in enumerate(own)] + [(10 + k, f"use token = {t} for now") for k, t in enumerate(own)]
    rows += [(20, f"Authorization: Bearer {token(40)} ok"), (21, f"Authorization: Bearer {own[3]} ok"), (30, "JOHN [AT] EXAMPLE [DOT] COM"), (31, "see john at example {dot} com")]
    for doc, text in rows:
        found = {(x.kind, text[x.start : x.end]) for x in pii.candidates(text, pii.number_zones(text))}
        assert any(kind == (6 if doc < 30 else 0) and len(x) >= (40 if doc < 30 else 19) and not re.search("[0-9a-f]{30}", text.replace(x, "")) for kind, x in found), doc
    clean = pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r["doc_id"] for r in clean if re.search("[0-9a-f]{20}|EXAMPLE", r["text"])] == []


def test_op2_rules_and_propagation(spark):
    page = lambda *hosts: "".join(f'<a href="https://{h}/x">l</a>' for h in hosts)
    rows = [(1, "http://A.com/en/1?q", page("b.org")), (2, "https://x.example.com/en/77", None), (3, "ftp://n.net/de/8", ""), (4, "http://example.net/de/80#f", ""), (5, "http://o.org/es/", ""), (6, None, None), (7, "nothing", ""), (8, "http://spam.xyz", page("a.com")), (8, "http://spam.xyz", page("a.com")), (9, "http://good.xyz/a", page("n.net")), (10, "http://n.net/de/", page("good.xyz"))]
    got = urls.judge_urls(spark.createDataFrame(rows, PAGES)).collect()
    by = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got}
    assert by[1] == ("a.com", "/en/1", "com/en/", "block") and by[2] == ("x.example.com", "/en/77", "example.com/en/7", "allow")
    assert by[3][2:] == ("net/de/", "allow") and by[4][2:] == ("example.net/de/8", "block") and by[5][2:] == ("org/es/", "block")
    assert by[6] == ("", "", None, "allow") == by[7] and by[8] == ("spam.xyz", "", None, "block") and by[9][2:] == (None, "allow") and len(got) == 11
    assert urls.judge_urls(empty(spark, PAGES)).count() == 0


def test_op2_against_dense_power_iteration(spark):
    rng = random.Random(2)
    hosts = [f"h{k}.t{k % 3}" for k in range(12)]
    links = Counter((a, b) for a, b in (rng.sample(hosts, 2) for _ in range(40)))
    out = Counter()
    for (a, _), n in links.items():
        out[a] += n
    seeds = {hosts[0]: 2.0, hosts[3]: 1.0}
    start = {h: w / 3 for h, w in seeds.items()}
    score = dict(start)
    for _ in range(urls.STEPS):
        following = defaultdict(float)
        for (a, b), n in links.items():
            following[b] += 0.85 * score.get(a, 0) * n / out[a]
        left = 1 - sum(following.values())
        for h, w in start.items():
            following[h] += left * w
        score = following
    frames = spark.createDataFrame([("trust", h, w) for h, w in seeds.items()], "kind string, host string, weight double"), spark.createDataFrame([("trust", a, b, n / out[a]) for (a, b), n in links.items()], "kind string, src string, dst string, w double")
    got = urls.propagate(*frames, urls.Workspace(spark, "test"))
    got = {r["host"]: r["score"] for r in got.collect()}
    assert all(abs(got.get(h, 0) - s) < 2e-3 for h, s in score.items()) and abs(sum(got.values()) - 1) < 1e-6


def shingle_set(text, size):
    own = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
    return frozenset(tuple(own[k : k + size]) for k in range(len(own) - size + 1)) if len(own) >= size else frozenset([tuple(own)] * bool(own))


def brute_components(rows, size, num, den):
    sets, up = [(d, shingle_set(t, size)) for d, t in rows], list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and den * len(a & b) >= num * len(a | b):
                up[max(root(i), root(j))] = min(root(i), root(j))
    least = defaultdict(list)
    for i, (d, s) in enumerate(sets):
        least[root(i)].append(d)
    return Counter((d, len(s), min((x for x in least[root(i)] if x is not None), default=None)) for i, (d, s) in enumerate(sets))


@pytest.mark.parametrize("size,num,block", [(3, 90, 2000), (5, 80, 2000), (5, 80, 12)])
def test_op3_against_all_pairs(spark, size, num, block):
    rng = random.Random(size)
    words = [f"w{k}" for k in range(2000)]
    extra = []
    for family in range(3):
        base = [rng.choice(words) for _ in range((30, 90, 200)[family])]
        for _ in range(40):
            copy = list(base)
            for _ in range(rng.randint(0, len(base) // 30)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            extra.append((100 + len(extra), " ".join(copy), "en", "a", 1))
    docs = awkward(spark, extra)
    got = Counter(tuple(r) for r in jaccard.link_components(docs, size, num, 100, block).collect())
    assert got == brute_components([(r["doc_id"], r["text"]) for r in docs.collect()], size, num, 100)


def test_prefixes_of_linked_sets_share(spark):
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a = rng.integers(0, 1 << 40, n, np.uint64)
        b = np.concatenate([a[: n - int(rng.integers(0, n // 4 + 1))], rng.integers(0, 1 << 40, int(rng.integers(0, n // 4 + 1)), np.uint64)])
        a, b = np.unique(a), np.unique(b)
        if 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)):
            common = len(np.intersect1d(jaccard.prefix(a, 80, 100), jaccard.prefix(b, 80, 100)))
            for own in (a, b):
                assert common >= jaccard.spare(-(-len(own) * 80 // 100), 80, 100)


def test_keep_first_takes_one_of_each_group(spark):
    rng = random.Random(5)
    say = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    base, other = say(100), say(100)
    near = base + " tail"
    rows = [(1, base, "x"), (1, base, "w"), (1, near, "a"), (2, near, "b"), (3, other, "c"), (3, say(50), "d"), (None, say(60), "e"), (4, "", "f"), (4, "", "g"), (5, None, "h"), (6, other, "i")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, lang string, _row int, _key int")
    got = jaccard.keep_first(docs)
    assert got.columns == docs.columns
    found = sorted((r["doc_id"] or 0, r["lang"]) for r in got.collect())
    assert [x for x in found if x[0] != 1] == [(0, "e"), (3, "c"), (3, "d"), (4, "f"), (4, "g"), (5, "h")]
    assert [x for x in found if x[0] == 1] in ([(1, "w")], [(1, "a")])
    assert jaccard.keep_first(docs.unionAll(docs)).where("text != ''").count() == 4  # four groups have words


def test_op3_hot_set(spark):
    rows = [(k, "one and the same text in very many rows") for k in range(3000)] + [(5000, "one and the same text in very many rows indeed"), (5001, "another")]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.link_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80, 100).collect()}
    assert got == {**dict.fromkeys(range(3000), 0), 5000: 0, 5001: 5001}


def test_op3_empty(spark):
    assert jaccard.link_components(empty(spark)).count() == 0
    assert jaccard.keep_first(empty(spark)).count() == 0


def test_op4_base_features(spark):
    docs = awkward(spark, [(91, "a b c d e " * 4, "en", "a", 1), (92, "x\nx\n\n \ny #*$ |é", "en", "a", 1)])
    found = quality.judge(docs).collect()
    assert len(found) == docs.count() == 43
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r for r in found}
    assert len(got) == 42  # one row stands twice, and is judged alike
    for doc, r in got.items():
        own = WORD.findall(texts[doc] or "")
        places = defaultdict(list)
        for k in range(len(own) - 4):
            places[tuple(own[k : k + 5])].append(k)
        covered = {j for v in places.values() if len(v) > 1 for k in v for j in range(k, k + 5)}
        full = [x for x in (texts[doc] or "").split("\n") if WORD.search(x)]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (len(own), sum(map(len, own)), len(covered), len(full) - len(set(full)))
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", texts[doc] or ""))
        assert r["base_failed"] == (len(own) < 10 or 100 * len(covered) > 20 * len(own)) and not (r["kept"] and r["base_failed"])
    assert quality.judge(empty(spark)).count() == 0 and quality.keep_quality(empty(spark)).count() == 0
    kept = quality.keep_quality(docs)
    assert kept.columns == docs.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in found if r["kept"])


def brute_kneser_ney(texts, order):
    """p(last | rest) of all n-grams of ``texts``, by the definition, with dictionaries."""
    counts = {order: Counter(t[k : k + order] for t in texts for k in range(len(t) - order + 1))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    p = {}
    for k in range(1, order + 1):
        c = Counter(counts[k].values())
        y = c[1] / (c[1] + 2 * c[2]) if c[1] else 0.5
        d = [min(max(j - (j + 1) * y * c[j + 1] / c[j], 0.05), j - 0.05) if c[j] and c[j + 1] else 0.5 * j**0.5 for j in (1, 2, 3)]
        total, spared = Counter(), Counter()
        for g, n in counts[k].items():
            total[g[:-1]] += n
            spared[g[:-1]] += d[min(n, 3) - 1]
        for g, n in counts[k].items():
            p[g] = (n - d[min(n, 3) - 1] + spared[g[:-1]] * (p[g[1:]] if k > 1 else 1 / len(counts[1]))) / total[g[:-1]]
    assert abs(sum(p[g] for g in counts[1]) - 1) < 1e-9
    return p


@pytest.mark.parametrize("block", [quality.BLOCK_GRAMS, 60])
def test_op4_model_against_definition(spark, block):
    texts = ["abracadabra alakazam", "Abra Kadabra, simsalabim!", "ünïcödé \U0001F600 Кириллица", "abracadabra again and again", "", "aa", "12 345 $%& <b> a_b"]
    rows = [(k, x, "en" if k % 2 else "de", None, 1) for k, x in enumerate([*texts, texts[0]])]
    normal = lambda x: re.sub(r"[#$%&*+<=>@\[\]\\^_`{|}~]", "#", re.sub("[0-9]", "0", x))
    units = lambda x: (quality.PAD,) * (quality.ORDER - 1) + tuple(np.frombuffer(normal(x).encode("utf-16-le"), np.uint16).tolist())
    p = brute_kneser_ney([units(x) for x in texts if x], quality.ORDER)
    docs = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r["_nll"] for r in quality.measure(docs, quality.Workspace(spark, "test"), block=block).collect()}
    for k, x, *_ in rows:
        padded = units(x)
        want = -sum(np.log(p[padded[i : i + quality.ORDER]]) for i in range(len(padded) - quality.ORDER + 1))
        assert abs(got[k] / quality.STEPS - want) < 1e-4


def test_op2_clashing_columns_and_trusted_seeds(spark):
    page = lambda *hosts: "".join(f'<a href="https://{h}/x">l</a>' for h in hosts)
    rows = [(1, "http://s.net/de/1", page("friend.xyz")), (2, "http://s.net/q", None), (3, "http://friend.xyz/", None), (4, "http://a.com/en/1", None), (5, "http://mill.xyz", page("a.com"))]
    docs = spark.createDataFrame([(*r, "t", "d", 1, 2, 3) for r in rows], PAGES + ", trust string, host string, rules int, allowed int, _fit int")
    got = {r["page_id"]: r.asDict() for r in urls.judge_urls(docs).collect()}
    assert got[3]["trust"] > 0 and got[3]["verdict"] == "allow" and got[1]["trust"] > got[3]["trust"]
    assert got[5]["verdict"] == "block" and got[5]["distrust"] > 0 and (got[5]["rules"], got[5]["allowed"]) == (1, 2)


def test_op4_bands_against_labels(spark):
    sf = "/root/testdata/sf0.01"
    judged = quality.op4(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("NOT base_failed").toPandas()
    assert judged[judged.quality == 1].kept.mean() > 0.99
    assert judged[judged.quality == 0].kept.mean() < 0.6


def test_op4_bands_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = docs.where("crc32(encode(text, 'utf-8')) % 2 = 1").select("doc_id").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    judged = quality.judge(docs).join(held, "doc_id").where("NOT base_failed").toPandas()
    assert judged[judged.quality == 1].kept.mean() > 0.99
    assert judged[judged.quality == 0].kept.mean() < 0.25


@pytest.mark.parametrize("copies", [40, 400])
def test_op4_copies_move_no_verdict(spark, copies):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en'").dropDuplicates(["text"])
    hot = docs.orderBy(docs.n_chars.desc(), "doc_id").limit(1).selectExpr(f"explode(sequence(1000, {999 + copies})) doc_id", "text", "lang", "source", "n_chars")
    own = {r["doc_id"]: (r["kept"], round(r["perplexity"], 6)) for r in quality.judge(docs).collect()}
    got = {r["doc_id"]: (r["kept"], round(r["perplexity"], 6)) for r in quality.judge(docs.unionByName(hot)).collect()}
    assert {d: v for d, v in got.items() if d < 1000} == own and len(got) == len(own) + copies
    assert sum(kept for kept, _ in own.values()) > 0.7 * len(own)


def test_op5_rows(spark):
    rows = [(1, "u", "<article><p>a  b</p></article>"), (2, None, None), (3, "u", ""), (3, "u", "")]
    got = sorted(map(tuple, html_text.extract_text(spark.createDataFrame([(*r, 5) for r in rows], PAGES + ", text long")).collect()), key=str)
    assert got == [(1, "u", "a b", 3), (2, None, "", 0), (3, "u", "", 0), (3, "u", "", 0)]
    assert html_text.extract_text(empty(spark, PAGES)).count() == 0


def plain_article(page):
    """The text of the one article element, cut at its paragraphs and headings, by regular expressions."""
    found = re.search(r"<article>(.*)</article>", page or "", re.S)
    parts = re.split(r"</?(?:p|h1)>", found[1].replace("<br>", " ").replace("<b>", "")) if found else []
    return " ".join(filter(None, (" ".join(unescape(x).split()) for x in parts)))


def test_op5_against_plain_articles(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r["page_id"]: plain_article(r["html"]) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.op5(spark, sf).collect()}
    assert got == {k: (v, len(v)) for k, v in pages.items()}


def test_op5_very_long_pages(spark):
    text = " ".join(f"word{k % 977}" for k in range(300_000))
    rows = [(1, "u", f"<nav><a href=x>m</a></nav><article><p>{text}</p></article>"), (2, "u", "<div>" * 50_000 + "<p>" + "deep words in here. " * 40)]
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {1: text, 2: ("deep words in here. " * 40).strip()}


def brute_repeats(rows):
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = (text or "").encode()
        cover = np.zeros(len(raw), bool)
        for k in range(len(raw) - 99):
            if raw[k : k + 100] in seen:
                cover[k : k + 100] = True
            seen.add(raw[k : k + 100])
        spans = int((cover & ~np.concatenate([[False], cover[:-1]])).sum()) if len(raw) else 0
        out[doc] = (len(raw), int(cover.sum()), spans, hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~cover])).hexdigest())
    return out


@pytest.mark.parametrize("crowd", [10_000, 4])
def test_op6_against_all_strings(spark, crowd):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6)))
    say = lambda n: " ".join(word() for _ in range(n))
    passages = [say(60) for _ in range(3)]
    rows = [(k, f"{say(rng.randint(0, 40))}{rng.choice(passages)[rng.randint(0, 40):]}{say(rng.randint(0, 30))}") for k in range(40)]
    rows += [(50, None), (51, ""), (52, "a" * 300), (53, "a" * 130), (54, "ab" * 90), (55, rows[3][1]), (56, rows[3][1]), (57, "x" * 99), (None, passages[0])]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, key string").repartition(3)
    got = {r[0]: tuple(r)[1:] for r in suffixes.remove_repeats(df, crowd).collect()}
    assert got == brute_repeats(rows)


def test_op6_repeated_rows_and_empty(spark):
    text = "".join(chr(97 + (7 * k * k + k) % 26) for k in range(300))
    got = suffixes.remove_repeats(spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")).collect()
    assert sorted((r[0], r[2]) for r in got) == [(1, brute_repeats([(1, text)])[1][1])] * 2 + [(2, 300)]
    assert suffixes.remove_repeats(empty(spark)).count() == 0


def test_op7_edges(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\n\nb\nc\ny"), (3, None), (4, ""), (5, "a\nb"), (6, "z\nz\nz\nz\nz"), (7, "q\nr\ns"), (7, "q\nr\ns"), (None, "m\nn\no"), (8, "m\nn\no")]
    got = {(r["doc_id"], r["text"], r["_n_removed"]) for r in lines.dedup_lines(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, key long")).collect()}
    assert {(1, "a\nb\nc\nd", 0), (2, "x\n\ny", 3), (3, None, 0), (4, "", 0), (5, "a\nb", 0), (6, "z", 4), (7, "q\nr\ns", 0), (None, "m\nn\no", 0), (8, "", 3)} == got
    assert lines.dedup_lines(empty(spark)).count() == 0


def test_op8_targets(spark):
    docs = awkward(spark, [(200 + k, "w " * (5 + k % 7), "en", "hot", 1) for k in range(300)])
    got = mixing.mix_sources(docs)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, mixing.mix_sources(docs.repartition(7)).collect()), key=str)
    rows = got.collect()
    assert len(rows) == docs.count() and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    taken, target, size = Counter(), {}, Counter()
    for r in rows:
        taken[r["source"]] += r["taken"]
        size[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 1 and target[s] <= 2 * size[s] for s in target)
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6
    assert mixing.mix_sources(empty(spark)).count() == 0


def test_op9_edges(spark):
    rows = [(3, "http://a b/\n", "<p>WARC/1.1\r\n\r\n"), (1, None, "<p>WARC/1.1\r\n\r\n"), (2, "", None), (4, "u", ""), (5, "u", "é" * 10), (5, "u", "é" * 10), (None, "u", "n")]
    got = {tuple(r) for r in warc.archive_pages(spark.createDataFrame([(*r, "clash") for r in rows], PAGES + ", digest string")).collect()}
    assert len(got) == 6  # the row that stands twice
    short = {(r[0], r[1], r[3], r[4]) for r in got}
    assert short == {(1, 15, "response", None), (3, 15, "revisit", 1), (2, 0, "response", None), (4, 0, "revisit", 2), (5, 20, "response", None), (None, 1, "response", None)}
    assert {r[2] for r in got if r[0] == 2} == {warc.base32_sha1(b"")}
    assert warc.archive_pages(empty(spark, PAGES)).count() == 0


def test_op10_edges(spark):
    items = [(1, "one two three four five six seven eight nine ten"), (2, None), (3, "short one"), (4, "one two three four five six seven eight nine ten")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(1, "xx six seven eight nine ten yy ONE, two three four five zz"), (2, None), (3, "one two three four"), (4, ""), (4, "")], "doc_id long, text string")
    for block in (1, 1000):
        got = sorted((r["doc_id"], r["item_id"], r["covered"], r["tiles"]) for r in tiling.find_leaks(docs, bench, block_tokens=block).collect())
        assert got == [(1, 1, 10, 2), (1, 4, 10, 2)]
    assert tiling.decontaminate(docs, bench).count() == 4
    assert tiling.find_leaks(docs, bench.limit(0)).count() == 0 and tiling.find_leaks(empty(spark), bench).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = awkward(spark).drop("key", "group")
    assert [f(spark, docs, SF).columns for _, f in corpus_pipeline.STAGES[:-1]] == [docs.columns] * 4
    out = corpus_pipeline.run(spark, SF)
    kept = {r["doc_id"] for r in out.collect()}
    source = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert kept and not any(item in source[d] for d in kept for item in items)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty(spark), SF).count() == 0


def test_pipeline_stages_on_awkward_tables(spark):
    """Nulls in any column, empty and very long texts, repeated rows, columns of clashing names."""
    import corpus_pipeline

    rng = random.Random(8)
    long = " ".join(f"word{rng.randrange(5000)}" for _ in range(200_000))
    bench = " ".join(r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").limit(1).collect())
    rows = [(300, long, "en", "a", None), (301, long + " more", None, None, 1), (302, f"before {bench} after", "en", "a", 2), (302, f"before {bench} after", "en", "a", 2), (None, None, None, None, None)]
    docs = awkward(spark, rows).withColumns({c: F.lit(c) for c in ("trust", "doc", "hash", "n", "rows", "first", "component", "set_id", "first_finish")})
    total = docs.count()
    got = {name: stage(spark, docs, SF) for name, stage in corpus_pipeline.STAGES}
    for name, frame in got.items():
        found = frame.collect()
        assert len(found) <= total and (name == "mixing" or frame.columns == docs.columns), name
    ids = {name: Counter(r["doc_id"] for r in frame.collect()) for name, frame in got.items()}
    assert ids["lines"] == Counter(r["doc_id"] for r in docs.collect())
    assert ids["jaccard"][300] == 1 and ids["jaccard"][301] == 0 and ids["jaccard"][302] == 1 and ids["jaccard"][5] == 1
    assert ids["decontaminate"][302] == 0 and ids["decontaminate"][300] == 1 and sum(ids["decontaminate"].values()) == total - 2


def test_very_long_texts_and_clashing_columns(spark):
    rng = random.Random(9)
    long = " ".join(f"w{rng.randrange(4000)}" for _ in range(250_000))
    docs = spark.createDataFrame([(1, f"{long} a@b.cd {long}", "s"), (2, "one two three four five six", "s"), (3, None, None)], "doc_id long, text string, source string")
    docs = docs.withColumns({c: F.lit(1) for c in ("size", "target", "taken", "rank", "weight", "item_id", "covered", "spans", "kind", "_one")})
    spans = {r["doc_id"]: r["spans"] for r in pii.find_pii(docs).collect()}
    assert spans == {1: f"email:{len(long) + 1}:{len(long) + 7}", 2: "", 3: ""}
    bench = spark.createDataFrame([("q1", "one two three four five six", 7), ("q2", " ".join(long.split()[100_000:150_000]), 7)], "item_id string, text string, doc_id int")
    assert sorted((r["doc_id"], r["item_id"], r["tiles"]) for r in tiling.find_leaks(docs, bench).collect()) == [(1, "q2", 1), (2, "q1", 1)]
    assert [r["doc_id"] for r in tiling.decontaminate(docs, bench).collect()] == [3]
    mixed = {r["doc_id"]: r["size"] for r in mixing.mix_sources(docs).collect()}
    assert mixed == {1: 500_001, 2: 6, 3: 0}
    pages = spark.createDataFrame([(1, "u", "<p>" + long * 8), (2, "v", "<p>" + long * 8), (3, "w", "x")], PAGES)
    got = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.archive_pages(pages).collect()}
    n = 3 + 8 * len(long)
    assert n > 2 * warc.PACK_BYTES and got == {1: (n, "response", None), 2: (n, "revisit", 1), 3: (1, "response", None)}


def test_op9_revisits_name_their_first(spark):
    arc = warc.ArcRecord(b"http://b/", b"0.0.0.0", b"20240101000000", b"text/html", b"HTTP/1.1 200 OK\r\n\r\nbody")
    first = warc.ArcRecord(b"http://a/", *arc[1:])
    records = list(warc.read_warc(warc.warcinfo(b"x") + warc.warc_record(first, b"1", None) + warc.warc_record(arc, b"2", warc.First(b"1", first.url, first.date))))
    info, one, two = (fields for fields, _ in records)
    assert info[b"warc-type"] == b"warcinfo" and two[b"warc-refers-to"] == one[b"warc-record-id"] and two[b"warc-refers-to-target-uri"] == b"http://a/"
    assert two[b"warc-refers-to-date"] == one[b"warc-date"] and two[b"warc-payload-digest"] == one[b"warc-payload-digest"]


def test_results_are_the_same_without_broadcasts(spark, monkeypatch):
    from quillspark.llm import workspace

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(docs.limit(20).withColumn("doc_id", F.col("doc_id") + 5000))

    def results():
        kept = sorted(r["doc_id"] for r in jaccard.keep_first(docs).collect())
        judged = sorted((r["doc_id"], r["kept"]) for r in quality.judge(docs).collect())
        lined = sorted((r["doc_id"], r["_n_removed"]) for r in lines.dedup_lines(docs).collect())
        return kept, judged, lined

    want = results()
    monkeypatch.setattr(workspace.small_side, "__defaults__", (-1,))
    monkeypatch.setattr(lines, "BROADCAST_BYTES", -1)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert results() == want and len(want[0]) < docs.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
