"""Rows of larger tables on which queries differed from their SQL."""

from quillspark.plans import catalogue as registry
from tests.oracle import assert_same, connect

SF = "/root/testdata/sf0.1"


def _part(spark, place, **tables):
    for name, which in tables.items():
        spark.read.parquet(f"{SF}/{name}.parquet").where(which).coalesce(1).write.parquet(f"{place}/{name}.parquet")
    return str(place)


def test_completeness_of_lines_of_odd_length(spark, tmp_path):
    sf = _part(spark, tmp_path, documents="doc_id IN (1863, 2729, 4387, 8133)")
    assert_same(registry.QUERIES["aln_08_completeness"](spark, sf), connect(sf), registry.ORACLES["aln_08_completeness"])


def test_negations_end_where_the_sql_ends_them(spark, tmp_path):
    sf = _part(spark, tmp_path, documents="doc_id < 40", conversations="conv_id = 789")
    assert_same(registry.QUERIES["s_18_checks"](spark, sf), connect(sf), registry.ORACLES["s_18_checks"])


def test_notes_of_lines_with_nothing_to_show(spark, tmp_path):
    rows = [(1, ""), (2, None), (3, "a\n\n \nb"), (4, "<>&\n&\nc\n\t"), (5, "\u00a0\n\u2003\n\x1c\x85"), (6, "d"), (None, "e\n\nf")]
    spark.createDataFrame([(d, t, "en", "a", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("src_09_note_pairs", "join_11_note_pairs"):
        assert_same(registry.QUERIES[name](spark, str(tmp_path)), connect(str(tmp_path)), registry.ORACLES[name])
