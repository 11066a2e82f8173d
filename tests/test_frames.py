"""Operators of DataFrames against brute force and reference values."""

import datetime
import json
import random
import re
import unicodedata
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.functions import align, checks
from quillspark.operators import audits, containment, dictionary, folds, glossary, hyphens, layout, notes, numbering, planting, spans, tables, terms
from quillspark.plans import catalogue as registry
from quillspark.sources import fictionbook, pdf
from quillspark.streaming import throttle

SENTENCE_END = re.compile(r"(?<=[.!?…])[\"”’»)\]*]*\s+(?=[\"“‘«(\[*]*[A-ZÀ-Ý0-9])")


# --- folds ---


def test_live_pages(spark):
    rng = random.Random(1)
    rows = [(d, k, rng.choice(["heading", "paragraph", "paragraph"]), "x" * rng.choice([0, 5, 150, 201, 700, 1900])) for d in range(4) for k in range(60)] + [(9, 0, "paragraph", None)]
    found = {(r["doc_id"], r["ord"]): r["page"] for r in folds.live_pages(spark.createDataFrame(rows, "doc_id long, ord long, kind string, text string")).collect()}
    want = {}
    for d in {r[0] for r in rows}:
        page, size, count, prose = 1, 0, 0, False
        for _, k, kind, text in [r for r in rows if r[0] == d]:
            n = len(text or "")
            if size and (size + n > 1800 or count >= 14 or kind == "heading" and prose):
                page, size, count, prose = page + 1, 0, 0, False
            size, count, prose = size + n, count + 1, prose or kind != "heading" and n > 200
            want[d, k] = page
    assert found == want


@pytest.mark.parametrize("limit", [5, 17, 60])
def test_pieces(spark, limit):
    rng = random.Random(limit)
    texts = ["".join(rng.choice("ab. !?A\n”") for _ in range(rng.randint(0, 200))) for _ in range(80)] + [None, "", "   ", "x" * 500, "One. Two. Three."]
    got = [r["p"] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string").orderBy("k").select(folds.pieces(F.col("t"), limit).alias("p")).collect()]
    for text, pieces in zip(texts, got):
        if text is None:
            assert pieces is None
            continue
        assert "".join("".join(pieces).split()) == "".join(text.split()) and all(0 < len(p) <= limit for p in pieces)
        ends = [0, *(m.end() for m in SENTENCE_END.finditer(text)), len(text)]
        whole = [text[a:b] for a, b in zip(ends, ends[1:])]
        if max(map(len, whole)) <= limit:  # whole sentences, as many as fit
            packed = [""]
            for s in whole:
                packed = [*packed, s] if len(packed[-1]) + len(s) > limit else [*packed[:-1], packed[-1] + s]
            assert pieces == [p.strip() for p in packed if p.strip()]
    assert got[-1] == {5: ["One.", "Two.", "Three", "."], 17: ["One. Two. Three."], 60: ["One. Two. Three."]}[limit]


# --- spans ---


def brute_union(text, terms_):
    plain = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn")
    flags = [False] * len(text)
    for t in terms_:
        for k in range(len(plain)):
            if plain.startswith(t, k):
                flags[k : k + len(t)] = [True] * len(t)
    edges = [k for k in range(len(text) + 1) if (k < len(text) and flags[k]) != (k > 0 and flags[k - 1])]
    return list(zip(edges[::2], edges[1::2]))


def test_texts_of_a_batch_are_read_in_parts(spark):
    """What a task holds as Python objects follows a part of its batch: anchors of 32 files, places of a million letters (a longer text is a part)."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["a" * 600_000, None, "b" * 600_000, "c" * 3_000_000, "", "d"])], ["k", "t"])
    parts = [p.column("k").to_pylist() for p in containment._parts(batch, "t")]
    assert parts == [[0, 1], [2], [3], [4, 5]]
    files = spark.createDataFrame([(k, f'<p><a id="x{k}" href="#y">{k}</a>' if k % 3 else None) for k in range(100)], "k long, page string")
    found = notes.anchors(files.coalesce(1), ["k"], "page")
    assert {(r["k"], r["place"], r["id"], r["target"], r["shown"], r["opens"]) for r in found.collect()} == {(k, 0, f"x{k}", "y", str(k), True) for k in range(100) if k % 3}
    assert "MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString()


def test_covered_stretches_are_the_union_of_places(spark):
    """The pattern finds what ``highlights`` does, and the query folds a line twice at most and looks for places by patterns alone."""
    rng = random.Random(4)
    texts = ["".join(rng.choice("aab.\n") for _ in range(rng.randint(0, 30))) for _ in range(150)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for terms in (["ab", "aa"], ["aba", "bab"], ["a.", "ba"], ["aaa"]):
        got = rows.select("t", spans.highlights(F.col("t"), F.lit(" ".join(terms))).alias("s"), spans.holds(F.col("t"), F.lit(" ".join(terms))).alias("h"), F.regexp_replace("t", F.lit(spans.covered(terms)), F.lit("«$0»")).alias("x")).collect()
        for r in got:
            assert r["h"] == (r["s"] is not None)
            if r["h"]:
                cuts = [0, *(e for x in r["s"] for e in (x.start, x.end)), len(r["t"])]
                assert r["x"] == "".join(f"«{r['t'][a:b]}»" if k % 2 else r["t"][a:b] for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
    plan = registry.QUERIES["flt_03_highlight_search"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") <= 3 and "aggregate(" not in plan


def test_dictionaries_read_the_texts_once(spark):
    """Words, stems and forms are tables by then: the plan of the result does not read the documents for each of its branches."""
    for name in ("s_17_unknown_words", "s_24_accent_dictionary"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp_extract_all(lower(text#" not in plan and "regexp_extract_all(text#" not in plan, name


def test_marks_are_ordered_without_their_texts(spark):
    """Lines are dealt and sorted by what they measure; a paragraph whose text is the copy's is not cut in words."""
    copies = spark.createDataFrame([(1, "1. a\n\n2. b\n3.\n\n 5. c")], "k long, text string")
    most = spark.createDataFrame([(1, 5)], "k long, n_max long")
    found = numbering.number_marks(copies, "k", most)
    assert sorted((r["n"], r["start"]) for r in found.collect()) == [(1, 3), (2, 9), (3, 14), (5, 19)]
    below = found._jdf.queryExecution().optimizedPlan().toString().split("Window [")[1].split("\n")[1]
    assert "_size" in below and not re.search(r"[\[ ]_text#\d+[,\]]", below)


def test_highlights(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abAé .") for _ in range(rng.randint(0, 60))) for _ in range(120)] + [None, "", "aaaa", r"a\Eab"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string").orderBy("k")
    for query, words in (("AB é aá", ["ab", "aa"]), ("a b", []), ("ab bab", ["ab", "bab"])):
        got = [r["s"] and [tuple(x) for x in r["s"]] for r in rows.select(spans.highlights(F.col("t"), F.lit(query)).alias("s")).collect()]
        for text, found in zip(texts, got):
            plain = (text or "").lower().replace("é", "e").replace("á", "a")
            hit = text is not None and bool(words) and all(w in plain for w in words)
            assert found == (brute_union(text, words) if hit else None), (text, query)
    parts = rows.where("k = 122").select(spans.marked(F.lit("xaby"), F.array(F.struct(F.lit(1).alias("start"), F.lit(3).alias("end")))).alias("p")).first()["p"]
    assert [tuple(p) for p in parts] == [("x", False), ("ab", True), ("y", False)]


def test_risks(spark):
    text = 'He took off! She rethrew “a few words here”. *Note* turning back; "one two three four five six seven".'
    found = [tuple(r) for r in spark.range(1).select(spans.risks(F.lit(text)).alias("r")).first()["r"]]
    assert [(text[a:b], why) for a, b, why in found] == [("took off", "verb + particle"), ("!", "emphasis or exclamation"), ("“a few words here”", "short speech"), ("*Note*", "emphasis or exclamation"), ("turning back", "verb + particle")]


# --- numbered paragraphs ---


def test_numbered_paragraphs(spark):
    rng = random.Random(3)
    texts = []
    for k in range(60):
        lines = [rng.choice(["", f"{rng.randint(1, 9)}. word{j} more", f" \t{rng.randint(1, 9)}.", "plain words", f"0{j}. no", f"{j}.x", "12. beyond"]) for j in range(rng.randint(1, 30))]
        texts.append("\n".join(lines))
    texts += ["1. a\n\n2. b\n\n3. c", "1.\n2. x\n2. y", ""]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "book long, text string")
    most = frame.select("book", F.lit(9).cast("long").alias("n_max"))
    got = {(r["book"], r["n"]): r["text"] for r in numbering.numbered_paragraphs(frame, "book", most).collect()}
    want = {}
    for book, text in enumerate(texts):
        marks, since = [], 0
        for n in range(1, 10):
            m = re.compile(rf"(?:^|\n)\s*{n}\.\s").search(text, since)
            if m:
                marks.append((n, m.end()))
                since = m.end()
        for (n, a), following in zip(marks, [*marks[1:], None]):
            b = following[1] - len(str(following[0])) - 4 if following else len(text)
            want[book, n] = text[a : max(a, b)]
    assert got == want
    own = spark.createDataFrame([(60, 1, "a"), (60, 2, "another b"), (60, 4, "d"), (60, 3, "c x")], "book long, n long, text string")
    rows = {r["n"]: (r["outcome"], r["changed"]) for r in numbering.collate(own, frame.where("book = 60"), "book").collect()}
    assert rows == {1: ("equal", False), 2: ("different", True), 3: ("different", True), 4: ("absent", False)}


# --- containment ---


def test_found_places(spark):
    rng = random.Random(4)
    books = {b: "".join(rng.choice("abc") for _ in range(rng.choice([0, 10, 400, 1500]))) for b in range(6)}
    books[6] = "ab" * 300
    parts = []
    for b, text in books.items():
        for k in range(25):
            n = rng.choice([1, 2, 3, 5, 12, 29, 30, 31, 59, 60, 61, 140])
            at = rng.randrange(max(1, len(text)))
            own = text[at : at + n] if rng.random() < 0.7 else "".join(rng.choice("abc") for _ in range(n))
            parts.append((b, k, own))
        parts += [(b, 90, None), (b, 91, "")]
    frame = spark.createDataFrame(parts, "book long, part long, text string")
    shelf = spark.createDataFrame([*books.items(), (7, None)], "book long, text string")
    got = Counter(map(tuple, containment.found_places(frame, shelf).collect()))
    want = Counter((b, k, i) for b, k, t in parts if t for i in range(len(books[b])) if books[b].startswith(t, i))
    assert got == want
    checked = {(r["book"], r["part"]): (r["whole"], r["in_pages"]) for r in containment.completeness(frame, shelf).collect()}
    for b, k, t in parts:
        if t and len(t) > 3:
            chunks = [t[i : i + 30] for i in range(0, len(t) - 29, 30)] or [t]
            assert checked[b, k] == (t in books[b], sum(c not in books[b] for c in chunks) <= 2)


def test_parts_and_books_are_shuffled_once(spark):
    """What is shuffled for a book are its letters and its parts', and no index of its places; sampled runs with what stands around them were some ten times the letters, twice."""
    plan = registry.QUERIES["aln_08_completeness"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("MapInArrow") == 1
    plan = containment.found_places(*(spark.createDataFrame([], s) for s in ("book long, part long, text string", "book long, text string")))._jdf.queryExecution().optimizedPlan().toString()
    assert "context" not in plan and "hash" not in plan


@pytest.mark.parametrize("direct", [0, 1 << 30])
def test_places_by_hashes_and_one_by_one(monkeypatch, direct):
    monkeypatch.setattr(containment, "DIRECT", direct)
    rng = random.Random(6)
    for body in ["", "a", "ab" * 200, *("".join(rng.choice("abcé😀") for _ in range(n)) for n in (29, 30, 31, 90, 700, 700))]:
        cut = {body[i : i + rng.choice([1, 2, 29, 30, 31, 60, 61, 140])] for i in range(0, len(body), 9)} | {"a", "b" * 30, "ab" * 40, "z" * 31}
        parts = sorted(p for p in cut if p)
        want = {(k, i) for k, p in enumerate(parts) for i in range(len(body)) if body.startswith(p, i)}
        assert sorted(containment.places(body, parts)) == sorted(want)
        some = list(containment.places(body, parts, first=True))
        assert set(some) <= want and sorted(k for k, _ in some) == sorted({k for k, _ in want})


def test_relocated_and_anchored(spark):
    lines = [(1, k, t) for k, t in enumerate(["alpha beta", "", "gamma beta", "delta " * 20, None, "beta"])] + [(2, 5, "x")]
    marks = [(1, "a", 2, "beta"), (1, "b", 1, "beta"), (1, "c", 0, "nowhere"), (1, "d", 0, "delta delta delta delta delta delta"), (1, "e", 9, ""), (1, "f", 2, ""), (1, "g", 2, None), (1, "h", 2, "a\nb"), (2, "i", 5, "beta")]
    frames = spark.createDataFrame(marks, "book long, mark string, ord long, snippet string"), spark.createDataFrame(lines, "book long, ord long, line string")
    assert {r["mark"]: r["moved"] for r in containment.relocated(*frames).collect()} == {"a": 2, "b": 0, "c": None, "d": 3, "e": 0, "f": 2, "g": None, "h": None, "i": None}
    anchors = spark.createDataFrame([(1, "a", "gam"), (1, "b", "delta delta d"), (1, "c", "beta"), (1, "d", "alpha beta gamma"), (1, "e", ""), (1, "f", None), (2, "a", "alpha")], "book long, anchor string, start string")
    assert {(r["book"], r["anchor"]): r["ord"] for r in containment.anchored(anchors, frames[1]).collect()} == {(1, "a"): 2, (1, "b"): 3, (1, "c"): 5, (1, "d"): None, (1, "e"): 0, (1, "f"): None, (2, "a"): None}


# --- glossary ---


@pytest.mark.parametrize("limit", [8, 10**6])
def test_glossary(spark, limit):
    rng = random.Random(5)
    texts = [(k, "".join(rng.choice("abé .") for _ in range(rng.randint(0, 80)))) for k in range(60)] + [(60, None), (61, "")]
    words = ["ab", "a", "ba.", "be b", "aab", "aa", "éa", ""]
    hits = glossary.term_hits(spark.createDataFrame(texts, "k long, t string"), ["k"], "t", spark.createDataFrame([(w.replace("é", "e"),) for w in words], "term string"), limit)
    got = {(r["k"], r["term"]): r["hits"] for r in hits.where("bounded").collect()}
    want = {}
    for k, t in texts:
        for w in words:
            n = len(re.findall(r"(?<![a-z])" + re.escape(w.replace("é", "e")), (t or "").replace("é", "e"))) if w else 0
            if n:
                want[k, w.replace("é", "e")] = n
    assert got == want
    book = spark.createDataFrame([("t1", "casa|lar", "caso|caza", "acaso"), ("t2", "sim", None, ""), ("t3", "x", "mau", None)], "source string, use string, avoid string, unless string")
    units = spark.createDataFrame([(1, "A Casa e as casas do lar"), (2, "o caso"), (3, "o caso por acaso"), (4, "descaso maus"), (5, None)], "k long, t string")
    used, wrong = glossary.glossary_usage(units, ["k"], "t", book)
    assert dict(map(tuple, used.collect())) == {"t1": 3, "t2": 0, "t3": 0} and sorted(map(tuple, wrong.collect())) == [(2, "t1", "caso"), (4, "t3", "mau")]


# --- dictionary ---


def test_affixed_forms(spark):
    stems = spark.createDataFrame([("gato", ["s", "p"]), ("azul", ["l"]), ("ver", None), ("real", ["l", "q"])], "word string, flags array<string>")
    rules = [("s", "suffix", "", "s", "[aeiou]", True), ("s", "suffix", "o", "a", "[^i]o", True), ("p", "prefix", "", "re", "[a-z]", True), ("l", "suffix", "l", "is", "[aeou]l", True), ("q", "prefix", "r", "ir", "re", False)]
    got = {(r["form"], r["stem"]) for r in dictionary.affixed_forms(stems, spark.createDataFrame(rules, "flag string, kind string, strip string, add string, condition string, crosses boolean")).collect()}
    assert got == {("gato", "gato"), ("gatos", "gato"), ("gata", "gato"), ("regato", "gato"), ("regatos", "gato"), ("regata", "gato"), ("azul", "azul"), ("azuis", "azul"), ("ver", "ver"), ("real", "real"), ("reais", "real"), ("ireal", "real")}


def test_invented_and_unknown(spark):
    forms = spark.createDataFrame([(w,) for w in ("casa", "reacionário", "corporações", "rápida", "lento", "senhor", "casas")], "form string")
    out = "O máscaros <a1>fdido</a1> supercorporações neorreacionário rapidamente rápidamente lentamente casas Inventado citadels merds-x chapters fdido"
    pairs = spark.createDataFrame([(1, "The chapter and merds", out), (2, "x", "casas senhor"), (3, None, None)], "k long, src string, out string")
    got = {r["k"]: r["invented"] for r in dictionary.invented(pairs, forms, ["k"]).collect()}
    assert got == {1: ["máscaros", "fdido", "rapidamente", "citadels"]}
    rest = dictionary.unknown(pairs, forms, ["k"], "out").collect()
    assert {r["k"]: r["unknown"] for r in rest} == {1: sorted(["máscaros", "fdido", "supercorporações", "neorreacionário", "rapidamente", "rápidamente", "lentamente", "citadels", "merds-x", "chapters"])}


def test_filter_loses_no_form(spark):
    forms = spark.range(3000).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("form"))
    words = spark.range(0, 9000, 3).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("candidate"))
    for bits in (dictionary.ROW_BITS, 3 * dictionary.ROW_BITS + 17):
        passed = dictionary.may_hold(words, "candidate", dictionary.form_filter(forms, bits), bits)
        assert passed.where("CAST(substring(candidate, 2) AS INT) < 3000").count() == 1000 and passed.count() < 1400
    assert dictionary.known_words(words, forms).count() == 1000


def test_accent_pairs(spark):
    words = ["político", "prática", "praticar", "está", "esta", "ônibus", "água", "pública", "mãe", "avô", "avó", "dô", "cômodo"]
    got = {r["base"]: r["accented"] for r in dictionary.accent_pairs(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert {k: v for k, v in got.items() if k not in dictionary.lexicons.ACCENTED} == {
        "politico": "político", "politicos": "políticos", "politica": "política", "politicas": "políticas", "onibus": "ônibus", "agua": "água", "publica": "pública", "publicas": "públicas",
        "comodo": "cômodo", "comodos": "cômodos", "comoda": "cômoda", "comodas": "cômodas",
    }


# --- hyphens, terms, notes ---


def test_joined_lines(spark):
    rows = [(1, 1, ["reconheci-", "mento"]), (2, 1, ["obriga-", "se"]), (3, 1, ["a", " ", None, "b"]), (4, 1, ["government-", "sanctioned here"]), (5, 1, ["government government sanctioned sanctioned"]), (6, 2, ["government-", "sanctioned"]), (7, 1, ["Mr-", "Smith", "self -", "x", "end-"])]
    lines = spark.createDataFrame([(d, b, k, t) for d, b, own in rows for k, t in enumerate(own)], "doc_id long, book long, ord long, line string")
    got = {r["doc_id"]: r["text"] for r in hyphens.joined_lines(lines, hyphens.vocabulary(lines), ["doc_id"]).collect()}
    assert got == {1: "reconhecimento", 2: "obriga-se", 3: "a b", 4: "government-sanctioned here", 5: "government government sanctioned sanctioned", 6: "governmentsanctioned", 7: "Mr- Smith self x end-"}


def test_terms(spark):
    texts = [(1, "We saw the Citadel. The Citadel is old, and Lindqvist’s Citadel too."), (2, "Of the House of Lords I’m sure. In 1940 Citadel fell; *Lindqvist* [knew](http://x.y/A_B)."), (3, "Old. Old. Old."), (4, None)]
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    found = [(r["doc_id"], r["term"], r["inside"]) for r in terms.found_terms(rows, ["doc_id"]).orderBy("doc_id", "place").collect()]
    assert found == [(1, "Citadel", True), (1, "Citadel", True), (1, "Lindqvist’s Citadel", True), (2, "House of Lords I’m", True)][:3] + [x for x in found if x[0] > 1]
    assert [tuple(r)[:2] for r in terms.mined(rows, ["doc_id"], spark.createDataFrame([], "term string")).collect()] == [("Citadel", 3)]
    assert terms.mined(rows, ["doc_id"], spark.createDataFrame([("CITADEL ",)], "term string")).count() == 0


def test_notes(spark):
    one = "<p>Text<a id='c1' href='n.html#d1'><sup>1</sup></a> and<a id=c2 href='#d2'>2</a> and <a id='c3' href='#d3'>too long to be</a></p><P>open <a id='c4' href='#d4'>*</a>"
    two = "<div><p> <b><A ID='d1' HREF='one#c1'>1</A></b> first</p></div><p>see <a id='d2' href='#c2'>2</a></p><li><a id='d3' href='#c3'>3</a></li><aside><a id='d4' href='#c5'>4</a></aside><p><a id='d5' href=''>5</a>"
    files = spark.createDataFrame([(1, "a", one), (1, "b", two), (2, "a", one), (3, "a", None)], "book long, file string, html string")
    assert [tuple(r) for r in notes.note_pairs(notes.anchors(files, ["book", "file"]), "book", "file").collect()] == [(1, 1, "a", "c1", "b", "d1")]


def test_note_pairs_of_any_book(spark):
    """A null book's anchors pair like others; one that points at itself, two that both open a block or that neither does are no pair; the last of an id counts."""
    page = "<p>a <a id='c' href='#d'>1</a> <a id='s' href='#s'>2</a> <a id='m' href='#n'>3</a> <a id='n' href='#m'>4</a> <a id='x' href='#y'>5</a></p>"
    more = "<p><a id='d' href='#c'>1</a></p><p><a id='o' href='#p'>1</a></p><p><a id='p' href='#o'>1</a></p><p><a id='y' href='#x'>5</a></p><p>again <a id='x' href='#z'>6</a></p>"
    files = spark.createDataFrame([(b, f, t) for b in (None, 7) for f, t in (("a", page), ("b", more))], "book long, file string, html string")
    got = [tuple(r) for r in notes.note_pairs(notes.anchors(files, ["book", "file"]), "book", "file").collect()]
    assert sorted(got, key=str) == [(7, 1, "a", "c", "b", "d"), (None, 1, "a", "c", "b", "d")]


# --- audits and planted errors ---


def verdict(spark, reply, output=""):
    found = spark.createDataFrame([(reply, output)], "r string, o string").select(audits.verdict(F.col("r"), F.col("o")).alias("v")).first()["v"]
    return found["faithful"], found["problems"]


def test_audit(spark):
    assert verdict(spark, 'x {"fidelity": []} y') == (True, [])
    assert verdict(spark, '{"fidelity": [{"passage": "a", "problem": "b"}], "style": ["s"]}') == (False, ["“a”: b", "style: s"])
    assert verdict(spark, '{"fidelity": [{"passage": "a", "problem": "b"}, {"pass') == (False, ["“a”: b"])
    assert verdict(spark, "no") == (False, ["no valid reply: no"]) and verdict(spark, None) == (False, ["no valid reply: "])
    objections = [{"passage": "a", "problem": "deve ser outro", "right": "The Right, Word"}, {"passage": "b", "problem": "a tradução está correta"}, {"passage": "c", "problem": "palavra ofensiva"}]
    ok, problems = verdict(spark, json.dumps({"fidelity": objections}, ensure_ascii=False), "It has <i1>the right word</i1>.")
    assert ok and len(problems) == 3 and all(p.startswith("style: (named") for p in problems)
    kept = {"passage": "d", "problem": "palavra ofensiva foi suavizada"}, {"passage": "e", "problem": "está correto, mas falta uma palavra"}
    assert verdict(spark, json.dumps({"fidelity": [*objections, *kept]}, ensure_ascii=False))[0] is False
    assert verdict(spark, json.dumps({"fidelity": list(kept)}, ensure_ascii=False)) == (False, ["“d”: palavra ofensiva foi suavizada", "“e”: está correto, mas falta uma palavra"])
    assert verdict(spark, '{"fidelity": [], "sty') == (True, []) and verdict(spark, '{"ok": true, "problems": ["p"]}') == (True, ["p"])


def test_planted(spark):
    texts = [(1, k, f"Source {k} of 1925. Second here. Third.", f"Fonte {k} de 1925. Não é não daqui, ele não odeia o lixo. Terceira {k}.") for k in range(7)] + [(2, 0, "One.", "Uma.")]
    rows = planting.planted(spark.createDataFrame(texts, "book long, k long, src string, out string"), ["book"], ["k"]).collect()
    got = {(r["book"], r["k"], r["type"]): r["planted"] for r in rows}
    assert got[1, 0, "omission"] == "Fonte 0 de 1925. Terceira 0." and got[1, 1, "omission"] == "Fonte 1 de 1925. Não é não daqui, ele não odeia o lixo."
    assert got[1, 3, "addition"] == "Fonte 3 de 1925. Não é não daqui, ele não odeia o lixo. Fonte 1 de 1925. Terceira 3."
    assert got[1, 0, "number"] == "Fonte 0 de 1932. Não é não daqui, ele não odeia o lixo. Terceira 0." and got[1, 0, "negation"] == "Fonte 0 de 1925. Não é daqui, ele não odeia o lixo. Terceira 0."
    assert got[1, 0, "source language"] == "Fonte 0 de 1925. Second here. Terceira 0." and got[1, 0, "softening"] == "Fonte 0 de 1925. Não é não daqui, ele não não aprecia o lixo. Terceira 0."
    assert {t for b, _, t in got if b == 2} == {"clean"}


# --- FictionBook ---


def test_fictionbook_repair():
    once, chars = fictionbook.repaired("<FictionBook><body><title><p>t</p></title>loose<section>in<p>x</p>after</section>tail<p>end</p></body></FictionBook>")
    assert once == "<FictionBook><body><title><p>t</p></title><section><p>loose</p></section><section><p>in</p><p>x</p><p>after</p><p>tail</p><p>end</p></section></body></FictionBook>"
    assert chars == len("tlooseinxaftertailend") and fictionbook.repaired(once) == (once, chars) and fictionbook.repaired("<a>") == ("<a>", -1)
    named = '<?xml version="1.0"?><!-- x --><f:FictionBook xmlns:f="u" xmlns:l="v"><f:body>a &amp; b<f:section/><f:image l:href="a>b"/>c<!-- d --></f:body></f:FictionBook>'
    assert fictionbook.repaired(named)[0] == '<?xml version="1.0"?><!-- x --><f:FictionBook xmlns:f="u" xmlns:l="v"><f:body><f:section><f:p>a &amp; b</f:p></f:section><f:section><f:image l:href="a>b"/><f:p>c<!-- d --></f:p></f:section></f:body></f:FictionBook>'


def test_fictionbook_sections_lose_nothing():
    book = '<FictionBook xmlns="http://www.gribuser.ru/xml/fictionbook/2.0"><description><p>no</p></description><body>a<section><p>b</p><section><title><p>T</p></title><p>c</p><p>d</p></section>e<p>f</p></section></body><body name="notes"><section><p>g</p></section></body></FictionBook>'
    assert fictionbook.sections(book) == ["a", "b", "T\nc\nd", "e\nf", "g"]
    cyrillic = '<?xml version="1.0" encoding="windows-1251"?><FictionBook><body><section><p>Текст</p></section></body></FictionBook>'.encode("cp1251")
    assert fictionbook.sections(fictionbook.decoded(cyrillic)) == ["Текст"]
    with pytest.raises(ValueError):
        fictionbook.sections("<a>")


# --- versions, merges, throttle ---


def test_two_writers(spark):
    place = tables.own_place(spark, "test")
    frame = lambda rows: spark.createDataFrame(rows, "k long, a string, b string")
    read = tables.replace_table(frame([(1, "x", "p"), (2, "y", "q"), (None, "z", "r")]), place)
    mine, theirs = frame([(1, "mine", None)]).select("k", "a"), frame([(1, "theirs", None)]).select("k", "a")
    assert tables.upsert(spark, place, theirs, ["k"], read=read) == read + 1
    with pytest.raises(tables.Conflict):
        tables.upsert(spark, place, mine, ["k"], read=read)
    with pytest.raises(tables.Conflict):  # the other commit comes between the check and the last step
        checked = tables.current_version
        tables.current_version = lambda *_: read
        try:
            tables.commit(frame([(9, "late", "")]), place, read)
        finally:
            tables.current_version = checked
    assert {tuple(r) for r in tables.read_table(spark, place).collect()} == {(1, "theirs", "p"), (2, "y", "q"), (None, "z", "r")}
    with pytest.raises(tables.UnknownKeys):
        tables.upsert(spark, place, frame([(7, "new", "")]), ["k"], known_only=True)
    assert tables.upsert(spark, place, frame([(None, "n", None), (7, "new", "s")]), ["k"]) == read + 2
    assert {tuple(r) for r in tables.read_table(spark, place).collect()} == {(1, "theirs", "p"), (2, "y", "q"), (None, "n", None), (7, "new", "s")}
    assert tables.read_table(spark, place, read).count() == 3


def throttle_rows():
    rng = random.Random(6)
    start = datetime.datetime(2024, 1, 1)
    return [(u, k, start + datetime.timedelta(seconds=rng.choice([k * 7, k * 31, k * 31 // 5 * 5]))) for u in range(5) for k in range(60)]


def brute_throttle(rows, seconds=60):
    kept, last = set(), {}
    for u, k, ts in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        if u not in last or (ts - last[u]).total_seconds() >= seconds:
            kept.add((u, k))
            last[u] = ts
    return kept


def test_throttle(spark):
    rows = throttle_rows()
    frame = spark.createDataFrame([*rows, (1, 99, None)], "user long, k long, ts timestamp")
    assert {(r["user"], r["k"]) for r in throttle.throttled(frame, "user", "ts", "k").collect()} == brute_throttle(rows)


def test_throttle_stream_agrees_with_the_batch(spark, tmp_path):
    rows = sorted(throttle_rows(), key=lambda r: r[2])
    before = spark.conf.get(throttle.PROVIDER[0], None)
    spark.conf.set(*throttle.PROVIDER)
    try:
        schema = "user long, k long, ts timestamp"
        (tmp_path / "in").mkdir()
        stream = throttle.throttle_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "user", "ts", "k", 60, "2 minutes")
        # Some come again, a little late and very late: neither are commits.
        late = [(r[0], 1000 + r[1], r[2] + datetime.timedelta(seconds=1)) for r in rows[:20]]
        parts = [rows[:100], rows[100:150] + late[:10], rows[150:], late[10:]]
        for n, part in enumerate(parts):
            spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/part{n}")
            for f in (tmp_path / f"part{n}").glob("*.parquet"):
                f.rename(tmp_path / "in" / f"{n}.parquet")
            run = stream.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
            run.awaitTermination(120)
            assert run.exception() is None
        got = {(r["user"], r["k"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
        assert got == brute_throttle(rows)
    finally:
        spark.conf.unset(throttle.PROVIDER[0]) if before is None else spark.conf.set(throttle.PROVIDER[0], before)


def test_long_tokens_and_texts():
    places = align._Places(["a"] * 1000 + ["x" * 1_000_000, "b", "c", "d"], [["x" * 1_000_000, "b", "c", "d"]])
    assert len(places.keys) and align.cut_repetition("".join(chr(97 + k * k % 23) for k in range(50)) * 2, 20) != ""
    long = "".join(random.Random(1).choices("abcdefgh ", k=3_000_000))
    assert align.cut_repetition(long) == long


# --- PDF ---


def test_pdf_spans(spark, tmp_path):
    pages = [[("Large (title) \\ é", 18.0, "Times-Bold"), ("", 30.0, "Helvetica"), ("first line", 10.0, "Helvetica"), ("second line", 10.0, "Helvetica-Oblique")], [], [("page three", 10.0, "Helvetica")]]
    rows = pdf.spans(pdf.written(pages))
    assert [(r[0], r[1], r[4], r[5], r[6], r[7], r[8]) for r in rows] == [(1, 0, "Large (title) \\ é", "Times-Bold", 18.0, True, False), (1, 1, "first line", "Helvetica", 10.0, False, False), (1, 1, "second line", "Helvetica-Oblique", 10.0, False, True), (3, 0, "page three", "Helvetica", 10.0, False, False)]
    # A hand-written file: parts with steps, a table to Unicode, an object stream, a matrix, and contents in two streams.
    table = b"1 beginbfchar <0041> <00DF> endbfchar 1 beginbfrange <0001> <0003> <0061> endbfrange"
    head = b"3 0 4 43 "
    held = head + b"<< /Type /Font /BaseFont /ABCDEF+Odd-Bold >>".ljust(43) + b"<< /Type /Font /Subtype /Type0 /BaseFont /Wide /ToUnicode 9 0 R >>"
    one, two = b"BT /A 12 Tf 2 0 0 2 10 700 Tm [(He) -20 (llo) -400 (you)] TJ", b"0 -20 Td /B 10 Tf <000100410003> Tj T* (\\101) ' ET"
    stream = lambda body: b"<< /Length %d >>\nstream\n%s\nendstream" % (len(body), body)
    bodies = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [ 5 0 R ] /Resources << /Font << /A 3 0 R /B 4 0 R >> >> /MediaBox [0 0 600 800] >>", 5: b"<< /Type /Page /Contents [6 0 R 7 0 R] >>", 6: stream(one), 7: stream(two), 8: b"<< /Type /ObjStm /N 2 /First %d /Length %d >>\nstream\n%s\nendstream" % (len(head), len(held), held), 9: stream(table)}
    data = b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in bodies.items())
    assert [(r[4], r[5], r[6], r[7]) for r in pdf.spans(data)][:2] == [("Hello you", "Odd-Bold", 24.0, True), ("aßc", "Wide", 20.0, False)]
    (tmp_path / "a.pdf").write_bytes(pdf.written(pages))
    (tmp_path / "b.PDF").write_bytes(b"not one")
    found = pdf.read_spans(spark, str(tmp_path)).collect()
    assert len(found) == 5 and [r["problem"] for r in found if r["problem"]] == ["ValueError: no PDF"]


def test_titles_of_spans(spark):
    row = lambda page, block, text, size, bold, y: ("b", page, block, 0, 0, text, "F", size, bold, False, 0.0, y, 9.0, y + size, 600.0, 800.0, None)
    rows = [row(1, 0, "ASLEEP AT A STOPLIGHT, AWOKEN", 14.0, False, 10.0), row(1, 1, "ONLY BY HORN", 14.2, False, 26.0), row(1, 2, "x" * 300, 10.0, False, 60.0), row(1, 3, "Bold one.", 10.0, True, 90.0), row(1, 4, "Bold two", 10.0, True, 101.0), row(1, 5, "y" * 250, 14.0, True, 120.0), row(2, 0, "Far", 14.0, False, 10.0), row(2, 1, "Apart", 14.0, False, 60.0), row(2, 2, " ", 14.0, False, 80.0)]
    spans_ = spark.createDataFrame(rows, pdf.SCHEMA)
    found = layout.titled(layout.blocks(spans_), layout.body_size(spans_)).where("title").orderBy("page", "block").collect()
    assert [(r["page"], r["block"], r["text"]) for r in found] == [(1, 0, "ASLEEP AT A STOPLIGHT, AWOKEN ONLY BY HORN"), (1, 3, "Bold one."), (1, 4, "Bold two"), (2, 0, "Far"), (2, 1, "Apart")]
    assert layout.body_size(spans_).first()["body"] == 10.0 and layout.dominant_font(spans_).first()["font"] == "F"


def test_rules_of_a_dictionary(spark):
    pairs = spark.createDataFrame([("The house is big and red today.", "A casa é grande e xyzzyx hoje aqui."), ("O theatro é bello hoje", "O theatro é bello hoje")], "s string, o string")
    alert = lambda task, **more: [r["c"] for r in pairs.select(checks.checks(F.col("s"), F.col("o"), task, **more).alias("c")).collect()]
    words = F.when(F.contains("o", F.lit("xyzzyx")), F.array(F.lit("xyzzyx"), F.lit("plugh")))
    assert alert("translate", invented=words)[0] == ["no word of the language: xyzzyx, plugh"] and all("no word" not in a for x in alert("translate") for a in x)
    found = alert("modernise", unknown=F.array(F.lit("zzz"), F.lit("theatro")), same_words=F.lit(0.5))
    assert found[1] == ["old spelling: bello, theatro, zzz", "changed beyond spelling (50% of the words equal)"]
    assert alert("modernise")[1] == ["old spelling: bello, theatro"]


def test_spans_of_files_are_made_once(spark):
    """Titles, page texts and fonts read each file once, and spans of a book are dealt by it once."""
    for name in ("src_01_page_text", "blk_05_typographic_titles", "src_22_dominant_font"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
        assert len(re.findall(r"MapInArrow|MapInPandas|ArrowEvalPython", plan)) == 2, name
