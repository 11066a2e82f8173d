"""Spelling of today, tables of state, and values that operators have to give."""

import re

from pyspark.sql import functions as F

from quillspark.functions import align, prose
from quillspark.operators import spelling, tables
from quillspark.plans.catalogue import QUERIES

LEXICON = "old string, new string"
ACCENTS = "base string, accented string"


def modern(spark, words, lexicon=(), accents=(), known=None):
    frames = [spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame(list(lexicon), LEXICON), spark.createDataFrame(list(accents), ACCENTS)]
    if known is not None:
        frames.append(spark.createDataFrame([(w,) for w in known], "word string"))
    return {r["word"]: r["modern"] for r in spelling.modernise(*frames).collect()}


def test_regular_changes_without_a_dictionary(spark):
    lexicon = (("politico", "político"), ("delle", "dele"), ("acção", "ação"))
    got = modern(spark, ["O", "programma", "politico", "delle", "theoria", "philosophia", "Thyssen", "ACÇÃO", "que", "possue", "naturaes", "agencias", "Delle", "actual"], lexicon)
    assert got == {
        "O": "O", "programma": "programa", "politico": "político", "delle": "dele", "theoria": "teoria", "philosophia": "filosofia", "Thyssen": "Thyssen", "ACÇÃO": "AÇÃO",
        "que": "que", "possue": "possui", "naturaes": "naturais", "agencias": "agências", "Delle": "Dele", "actual": "atual",
    }


def test_repairs_need_just_one_known_word(spark):
    known = ["director", "ontem", "impacto", "coisa", "couza", "empresa", "óptica", "pé", "sabia", "sábia", "história"]
    got = modern(spark, ["hontem", "empreza", "impacto", "cousa", "historia", "xyzzy", "Hontem", "HONTEM"], accents=[("historia", "história"), ("pe", "pé")], known=known)
    assert got == {"hontem": "ontem", "empreza": "empresa", "impacto": "impacto", "cousa": "cousa", "historia": "história", "xyzzy": "xizzi", "Hontem": "Hontem", "HONTEM": "ONTEM"}


def test_words_are_counted_and_changed_once(spark):
    """The texts are not read again, and no word is changed again, by the plan of the result."""
    for name in ("s_21_modernise", "s_22_repairs"):
        found = QUERIES[name](spark, "/root/testdata/sf0.001")
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "documents.parquet" not in plan and "regexp_extract_all" not in plan and plan.count("mpt, nt") == 0, name
        assert found.count() > 0


def test_leftovers(spark):
    text = spark.createDataFrame([("O programma politico de Thyssen, que possue philosophia.",), ("delle d'alma elle naturaes segue",)], "t string")
    assert [r[0] for r in text.select(spelling.leftovers(F.col("t"))).collect()] == [["philosophia", "possue", "programma"], ["d'alma", "delle", "elle", "naturaes"]]


def test_skeleton_is_the_plain_functions(spark):
    words = ["pharmácia", "Theatro", "assumpto", "kilo", "sciencia", "d'água", "óptimo", "rhythmo", "ÀÉÎÕÜÇñ", "aaabbb", "", "guerra", "prompto"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", spelling.skeleton(F.col("w")).alias("s")).collect()
    assert {r["w"]: r["s"] for r in rows} == {w: align.skeleton(w) for w in words}


def test_sentences_end_at_an_ellipsis():
    assert prose.sentences("Então foi… Depois veio. Ok") == ["Então foi…", "Depois veio.", "Ok"]


def test_replaced_table_is_whole_and_migrated(spark):
    place = tables.own_place(spark, "test")
    tables.replace_table(spark.range(5).toDF("id"), place)
    held = tables.read_table(spark, place)
    tables.replace_table(spark.range(3).toDF("id"), place)
    assert held.count() == 5 and tables.read_table(spark, place).count() == 3
    former, latter = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string"), spark.createDataFrame([(2, "c", "new")], "k int, x string, context string")
    rows = tables.migrated(former.withColumn("v", F.lit(1)), latter.withColumn("v", F.lit(2)), {"context": ""})
    got = {(r["k"], r["x"], r["context"]) for r in tables.latest(rows, ["k"], [F.desc("v")]).collect()}
    assert got == {(1, "a", ""), (2, "c", "new")}


def test_decisive_columns_take_several_values(spark):
    """Queries whose result once was the same for all rows."""
    sf = "/root/testdata/sf0.001"
    for name, column in (("aln_08_completeness", "whole"), ("aln_08_completeness", "in_pages"), ("blk_08_image_pages", "image"), ("s_31_model_default", "model"), ("s_48_font_equivalents", "family"), ("s_42_config_merge", "value"), ("agg_08_language_guess", "guessed")):
        assert QUERIES[name](spark, sf).select(column).distinct().count() > 1, name
    heads = {r["k"] for r in QUERIES["agg_05_running_heads"](spark, sf).collect()}
    assert any(k.startswith("thebookof") for k in heads)
    kept = [r["line"] for r in QUERIES["src_04_copy_text"](spark, sf).collect()]
    assert kept and not any(re.match(r"The Book of|\d+$", x) for x in kept)
    for r in QUERIES["s_04_clean_line"](spark, sf).limit(60).collect():
        assert re.fullmatch(r"\d+\. [^*\[\]]*#", r["clean"]), r["clean"]


def test_collation_places_what_changed_words_first(spark):
    rows = [r for r in QUERIES["aln_04_collation"](spark, "/root/testdata/sf0.001").collect()]
    outcomes = {r["outcome"] for r in rows}
    assert outcomes == {"equal", "different", "absent"} and all((r["place"] is not None) == (r["outcome"] == "different") for r in rows)
    by = {}
    for r in rows:
        if r["place"]:
            by.setdefault(r["doc_id"], []).append((r["place"], all(x.startswith("insert") for x in r["changes"].split("|")), r["ratio"]))
    for own in by.values():
        own.sort()
        assert [p for p, _, _ in own] == list(range(1, len(own) + 1)) and [x[1:] for x in own] == sorted(x[1:] for x in own)


def test_scoreboard_and_agreement(spark):
    sf = "/root/testdata/sf0.01"
    score = {r["type"]: r for r in QUERIES["agg_16_scoreboard"](spark, sf).collect()}
    assert set(score) >= {"clean", "omission", "addition", "negation", "softening"} and all(max(r["rules"], r["auditor"]) <= r["either"] <= r["cases"] and r["standing"] <= r["either"] for r in score.values())
    agree = QUERIES["aln_05_reader_agreement"](spark, sf).collect()
    assert {(r["ok"], r["refused"]) for r in agree} >= {(True, False), (False, True)} and all(r["ok"] == (r["agreement"] >= 0.85 and not r["refused"]) for r in agree)


def test_terms_are_new_and_found_within_sentences(spark):
    terms = {r["term"]: r for r in QUERIES["agg_12_term_mining"](spark, "/root/testdata/sf0.001").collect()}
    assert "Grand Canal" in terms and "Treaty of Verdun" in terms and "Upper Saxony" not in terms and "Old Bridge" not in terms
    assert all(t in r["example"] and r["n"] >= 3 for t, r in terms.items() if t in ("Grand Canal",))


def test_pages_are_unescaped_and_contexts_quoted(spark):
    sf = "/root/testdata/sf0.001"
    endings = [r["ending"] for r in QUERIES["src_05_page_text_unescaped"](spark, sf).collect()]
    assert {e for e in endings if e and not e.endswith("café — A… ¬it; <b>")} == set()
    found = QUERIES["flt_02_regex_search"](spark, sf).collect()
    assert found and all(re.search(r"«\w+»", r["context"]) for r in found)
