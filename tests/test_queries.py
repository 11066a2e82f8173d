"""Every registered query runs; those with DuckDB SQL agree with it."""

import pytest

from quillspark.plans import catalogue as registry
from tests.oracle import assert_same, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_duckdb(spark, con, name):
    assert_same(registry.QUERIES[name](spark, SF), con, registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    rows = registry.QUERIES[name](spark, SF).collect()  # all columns, as counting would leave out most of the work
    assert rows and len({len(r) for r in rows}) == 1


def long_documents(tmp_path, spark):
    rows = [(1, "\n".join(f"line {k} {'w' * (k % 250)}" for k in range(260))), (2, "a\nb")]
    spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    return {d: t.split("\n") for d, t in rows}


def test_sources_take_whole_documents(spark, tmp_path):
    own = long_documents(tmp_path, spark)
    chapters = sorted(map(tuple, registry.QUERIES["src_03_epub_order"](spark, str(tmp_path)).select("doc_id", "place", "body").collect()))
    assert chapters == [(d, k, f"<p>{t}</p>") for d, texts in own.items() for k, t in enumerate(texts)]
    pages = sorted(map(tuple, registry.QUERIES["src_01_page_text"](spark, str(tmp_path)).select("doc_id", "page", "text").collect()))
    assert {d: [t for doc, _, text in pages if doc == d for t in text.split("\n\n") if t not in ("A title of two lines", "A title of", "two lines")] for d in own} == {d: [t.strip() for t in texts] for d, texts in own.items()}
    titles = {(r["doc_id"], r["ord"]): r["html"] for r in registry.QUERIES["src_08_mobi_titles"](spark, str(tmp_path)).collect()}
    assert len(titles) == 262 and all(any(t in html for t in own[d]) for (d, _), html in titles.items())
    assert {html[:2] == "<h" for html in titles.values() if len(html) > 260} == {False} and sum(t in html for t in own[1] for html in titles.values()) >= 260


def test_entry(spark):
    import __spark_entry__

    found = __spark_entry__.entry(spark)
    assert found.columns == ["book", "doc_id", "ord", "snippet"] and found.count() <= 60
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
