"""Operators as DataFrame functions: the rule engine, search, structure, joins, editions."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import checks
from quillspark.operators import editions, joins, search, structure
from quillspark.sources import books, epub


def alerts(spark, source, out, task="translate", terms=()):
    row = spark.createDataFrame([(source, out)], "s string, o string").select(checks.checks(F.col("s"), F.col("o"), task, terms).alias("c")).first()
    return list(row["c"])


LONG = "The first sentence tells of a house on a hill. The second one says that it was not sold in 1912."
GOOD = "A primeira frase fala de uma casa numa colina alta. A segunda diz que ela não foi vendida em 1912."


@pytest.mark.parametrize(
    "source,out,task,starts",
    [
        (LONG, GOOD, "translate", []),
        (LONG, "Sinto muito, " + GOOD, "translate", ["possible refusal"]),
        (LONG, GOOD.replace(" em 1912", " em 1919"), "translate", ["number of the source missing: 1912"]),
        (LONG, GOOD.replace("1912", "MCMXII"), "translate", []),
        (LONG, GOOD.replace("não ", ""), "translate", ["fewer negations"]),
        (LONG, GOOD.replace("alta. A", "alta, a"), "translate", ["fewer sentences"]),
        (LONG, "<a1>" + GOOD, "translate", ["marks differ"]),
        ("<a1>x</a1> " + LONG, "<a1> </a1> " + GOOD, "translate", ["marks differ; no text in a1"]),
        (LONG, GOOD.replace("casa", "*casa*"), "translate", ["emphasis"]),
        (LONG, "", "translate", ["suspicious size", "number of", "fewer sentences", "fewer negations", "empty result"]),
        (LONG, GOOD + " " + GOOD + " " + GOOD, "translate", ["suspicious size", "more sentences"]),
        (LONG, LONG, "translate", ["fewer negations", "left in the source"]),
        (LONG.replace("house", "damned house"), GOOD, "translate", ["strong word without strong equivalent: damned"]),
        (LONG.replace("house", "damned house"), GOOD.replace("casa", "casa maldita"), "translate", []),
        (LONG, GOOD + " Nota do tradutor", "translate", ["more sentences", "possible comment"]),
        ("A casa", "A casa de pedra no alto", "clean_ocr", ["unexpected size"]),
        ("Ella foi ao theatro hoje", "Ela foi ao theatro hoje", "modernise", ["old spelling: theatro"]),
    ],
)
def test_rules(spark, source, out, task, starts):
    found = alerts(spark, source, out, task)
    assert len(found) == len(starts) and all(f.startswith(s) for f, s in zip(found, starts)), found


def test_rules_share_what_they_look_at(spark):
    """A source's facts can be a column of its own, for all its outputs; sentences are split once for a text, whatever rules ask for them."""
    outs = [GOOD, GOOD.replace("não ", ""), LONG, "", GOOD.replace("1912", "1919") + " Nota do tradutor"]
    pairs = spark.createDataFrame([(LONG.replace("house", "damned house"), o) for o in outs], "s string, o string")
    terms = (("house", "morada"),)
    own = checks.checks(F.col("s"), F.col("o"), "translate", terms)
    given = pairs.withColumn("f", checks.asked(F.col("s"), "translate", terms)).select(checks.checks(F.col("s"), F.col("o"), "translate", terms, of_source=F.col("f")).alias("c"))
    assert [r["c"] for r in given.collect()] == [r["c"] for r in pairs.select(own.alias("c")).collect()]
    plan = pairs.select(own.alias("c"))._jdf.queryExecution().analyzed().toString()
    assert plan.count(checks.BOUNDARY) == 2


def test_glossary_counts_inflected_terms(spark):
    assert alerts(spark, LONG, GOOD, terms=(("house", "casa"),)) == []
    assert alerts(spark, LONG, GOOD, terms=(("house", "morada"),)) == ['glossary: "house" should be "morada"']


def test_roman(spark):
    rows = spark.range(0, 4001).select("id", checks.roman(F.col("id")).alias("r")).collect()
    assert [rows[k]["r"] for k in (1, 4, 9, 14, 40, 90, 400, 1912, 3999)] == ["I", "IV", "IX", "XIV", "XL", "XC", "CD", "MCMXII", "MMMCMXCIX"]
    assert rows[0]["r"] == rows[4000]["r"] == "(?!)" and len({r["r"] for r in rows}) == 4000


def test_search(spark):
    units = spark.createDataFrame([("a", 1, "Não há AÇÃO aqui"), ("a", 0, "acao nao"), ("b", 0, "acao só")], "book string, ord long, text string")
    assert [(r["book"], r["ord"]) for r in search.search(units, ["nao", "Ação"]).collect()] == [("a", 0), ("a", 1)]


def test_structure(spark):
    docs = spark.createDataFrame([(1, "Head 1\na b\nc\n\n1. d\n2. e"), (2, None)], "doc_id long, text string")
    got = [(r["paragraph"], r["text"]) for r in structure.paragraphs(structure.lines(docs)).orderBy("doc_id", "paragraph").collect()]
    assert got == [(1, "Head 1 a b c"), (2, "1. d"), (3, "2. e")]
    pages = spark.createDataFrame([("b", p, o, t) for p in range(10) for o, t in enumerate((f"Title {p}", f"body {chr(97 + p)}{chr(98 + p)}", str(p)))], "book string, page long, ord long, line string")
    assert [(r["key"], r["pages"]) for r in structure.running_heads(pages).collect()] == [("title", 10)]
    blocks = spark.createDataFrame([(1, 0, "paragraph", "so it", 1), (1, 1, "paragraph", "goes on.", 1), (1, 2, "paragraph", "Then", 1), (1, 3, "paragraph", "Next", 2), (1, 4, "heading", "T", 2)], "doc_id long, ord long, kind string, text string, page long")
    assert [(r["text"], r["pages"]) for r in structure.continuations(blocks).orderBy("block").collect()] == [("so it goes on.", [1]), ("Then Next", [1, 2]), ("T", [2])]
    titled = spark.createDataFrame([(1, 0, 1, "A"), (1, 1, 2, "B"), (1, 2, None, "x"), (1, 3, 1, "C"), (1, 4, None, "y")], "doc_id long, ord long, level int, text string")
    assert [(r["h1"], r["h2"]) for r in structure.section_path(titled).orderBy("ord").collect() if r["level"] is None] == [("A", "B"), ("C", None)]


def test_joins(spark):
    left = spark.createDataFrame([("u", 1, "a"), ("u", 5, "b"), ("v", 1, "c"), ("u", 3, "d")], "k string, t long, x string")
    right = spark.createDataFrame([("u", 3, 30), ("u", 4, 40)], "k string, t long, v long")
    got = {r["x"]: r["v"] for r in joins.as_of_following(left, right, "k", "t", "v").collect()}
    assert got == {"a": 30, "b": None, "c": None, "d": 30}
    more = joins.multiset_difference(left.select("k"), right.select("k"), ["k"]).collect()
    assert sorted(map(tuple, more)) == [("u", 1), ("v", 1)]


def test_editions(spark):
    text = [f"word{k} alpha{k} beta{k} gamma{k} delta{k} eps{k} zeta{k} eta{k} theta{k} iota{k} kappa{k}" for k in range(8)]
    blocks = spark.createDataFrame([("x", f"b{k}", k, t) for k, t in enumerate(text)], "book string, id string, ord long, text string")
    copies = spark.createDataFrame([("x", "\n".join([*text[:3], text[3].replace("eps3", "other"), *text[5:]]))], "book string, text string")
    compared = editions.compare_editions(blocks, copies)
    assert {r["id"]: r["outcome"] for r in compared.orderBy("place").collect()} == {**{f"b{k}": "equal" for k in (0, 1, 2, 5, 6, 7)}, "b3": "different", "b4": "absent"}
    assert tuple(editions.summary(compared).first())[1:] == (6, 1, 1, 0, 0, 8, 8)
    pairs = spark.createDataFrame([("pharmacia velha", "farmacia velha"), ("casa velha", "loja nova")], "a string, b string")
    assert [r[0] for r in pairs.select(editions.beyond_spelling(F.col("a"), F.col("b"))).collect()] == [False, True]


def test_editions_are_placed_once(spark):
    """A book's blocks and copies are dealt and read once for all outcomes; books without a copy have no rows, null names are a book, null texts no words."""
    rows = [("x", "b0", 0, "one two three four five six seven"), ("x", "b1", 1, None), (None, "b0", 0, "one two three four five six seven"), ("y", "b0", 0, "lost")]
    blocks = spark.createDataFrame(rows, "book string, id string, ord long, text string")
    copies = spark.createDataFrame([("x", rows[0][3]), (None, rows[0][3]), ("z", "more")], "book string, text string")
    compared = editions.compare_editions(blocks, copies)
    assert sorted((r["book"] or "", r["id"], r["outcome"], r["total"]) for r in compared.collect()) == [("", "b0", "equal", 0), ("x", "b0", "equal", 0), ("x", "b1", "not compared", 0)]
    plan = compared._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Group" not in plan


def test_books_are_read_from_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "a.epub").write_bytes(epub.pack(["one & only", "two"]))
    (tmp_path / "in" / "b.html").write_text('<script>x</script><p>blog <a href="x">makes</a>the <em>point</em> &eacute;.</p>', encoding="utf-8")
    (tmp_path / "c.fb2").write_text("<FictionBook><body>loose<section>in</section></body></FictionBook>", encoding="utf-8")
    (tmp_path / "d.txt").write_text("plain", encoding="utf-8")
    (tmp_path / "e.epub").write_bytes(b"broken")
    (tmp_path / "f.exe").write_bytes(b"x")
    got = {(r["path"].rpartition("/")[2], r["place"]): r for r in books.read_books(spark, str(tmp_path)).collect()}
    texts = {k: " ".join((r["text"] or "").split()) for k, r in got.items()}
    assert texts == {("a.epub", 0): "one only", ("a.epub", 1): "two", ("b.html", 0): "blog makesthe point é.", ("c.fb2", 0): "loose", ("c.fb2", 1): "in", ("d.txt", 0): "plain", ("e.epub", 0): "", ("f.exe", 0): ""}
    assert "BadZipFile" in got["e.epub", 0]["problem"] and "not read" in got["f.exe", 0]["problem"] and got["d.txt", 0]["problem"] is None
