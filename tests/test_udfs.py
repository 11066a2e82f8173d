"""Functions that UDFs call: what they hold, and how often they run."""

import pyarrow as pa

from quillspark.functions import align


def test_equal_skeletons_are_not_aligned(monkeypatch):
    monkeypatch.setattr(align, "SequenceMatcher", None)
    assert align.combine("o  pharol,\nda", "o farol, da") == "o  farol,\nda"
    assert align.ratio(["a"], ["a"]) == 1.0


def test_same_words_are_compared_once(spark):
    from quillspark.plans import udf_queries

    plan = udf_queries.checks_same_language(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("[skeleton_ratio(") == 1 and plan.count("skeleton_ratio(") == 1


def test_functions_of_texts_take_a_part_of_a_batch_at_a_time(monkeypatch):
    from quillspark.plans import udf_queries

    monkeypatch.setattr(udf_queries, "_AT_ONCE", 2)
    found = udf_queries._by_parts("array<string>", str.split, pa.array(["a b", None, "c", "", "d e f"]))
    assert found.type == pa.list_(pa.string()) and found.to_pylist() == [["a", "b"], None, ["c"], [], ["d", "e", "f"]]
    assert udf_queries._by_parts("long", lambda a, b: len(a + b), pa.array(["a", None, "b"]), pa.array(["x", "y", None])).to_pylist() == [2, None, None]
    assert len(udf_queries._by_parts("string", str, pa.array([], pa.string()))) == 0
