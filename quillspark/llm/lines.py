"""Line de-duplication by overlapping windows of three lines.

Lines are ``\\n``-separated; a line without a word is blank, is never removed and does not count in windows. A window is
three consecutive other lines, compared exactly (128 hash bits). Windows are ordered by doc_id (null first), the text's hash and
place; each occurrence of a window but the first is covered, and covered lines go, with their line ends.
A document of fewer than three lines stays as it is.

Cases: null and empty texts pass unchanged, as does a text that loses nothing; rows with equal id and text are one document
and share a result; an empty table gives an empty result; further columns pass (names used here start with an underscore, to keep clear of them).

Work that moves: one slim row a window. Counts are pre-aggregated before the shuffle, and only rows of repeated
windows are joined (a join that adaptive execution splits where one window is hot). The covered places meet the texts by a broadcast while
they are measured to be small; beyond that by one shuffle of the texts, by id and text hash, which are not sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.workspace import BROADCAST_BYTES, Workspace

WINDOW = 3
#: A line with at least one word.
SOLID = r"[^\x20\x09-\x0D]"


def _text_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def repeated_lines(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """Rows (_doc, _key, _lines): the sorted places (from 0) of the lines that later occurrences of windows cover."""
    split = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    lines = docs.select(F.col("doc_id").alias("_doc"), _text_key().alias("_key"), split.alias("_all")).where(F.size("_all") >= size)
    solid = F.filter(F.transform("_all", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: s.x.rlike(SOLID))
    hashed = F.transform(solid, lambda s: F.struct(s.i.alias("i"), F.xxhash64(s.x).alias("a"), F.xxhash64(F.lit(7), s.x).alias("b")))
    lines = lines.select("_doc", "_key", hashed.alias("_hash")).where(F.size("_hash") >= size)
    places = F.sequence(F.lit(0), F.size("_hash") - size)
    part = lambda p, k, f: F.get("_hash", p + k)[f]
    window = lambda p: F.struct(
        F.xxhash64(*(part(p, k, "a") for k in range(size))).alias("a"),
        F.xxhash64(F.lit(11), *(part(p, k, "b") for k in range(size))).alias("b"),
        F.array(*(part(p, k, "i") for k in range(size))).alias("lines"),
        p.alias("at"),
    )
    found = lines.select("_doc", "_key", F.explode(F.transform(places, window)).alias("w"))
    found = found.select("_doc", "_key", F.col("w.a").alias("a"), F.col("w.b").alias("b"), F.col("w.lines").alias("lines"), F.struct("_doc", "_key", F.col("w.at")).alias("at"))
    again = found.groupBy("a", "b").agg(F.min("at").alias("first"), F.max("at").alias("last")).where("first < last")
    later = found.join(again.select("a", "b", "first"), ["a", "b"]).where("at > first")
    return later.select("_doc", "_key", F.explode("lines").alias("line")).groupBy("_doc", "_key").agg(F.array_sort(F.collect_set("line")).alias("_lines"))


def dedup_lines(docs: DataFrame, size: int = WINDOW, columns: tuple[str, str, str] = ("_n_lines", "_n_removed", "_n_spans")) -> DataFrame:
    """``docs`` with repeated lines gone from ``text``, and the number of lines, of removed ones and of their runs."""
    work = Workspace(docs.sparkSession, "lines")
    covered = work.keep(repeated_lines(docs, size), "covered")
    rows, places = covered.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("_lines")), F.lit(0))).first()
    covered = F.broadcast(covered) if 48 * rows + 8 * places <= BROADCAST_BYTES else covered.hint("shuffle_hash")
    keyed = docs.withColumn("_own_key", _text_key())
    joined = keyed.join(covered, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_own_key") == F.col("_key")), "left")
    split = F.split("text", "\n", -1)
    gone = F.coalesce("_lines", F.array().cast("array<int>"))
    kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(split) - 1), gone), lambda i: F.get(split, i)), "\n")
    text = F.when(F.size(gone) > 0, kept).otherwise(F.col("text"))
    runs = F.size(F.filter(F.transform(gone, lambda x, i: F.coalesce(x - F.get(gone, i - 1), F.lit(0))), lambda step: step != 1))
    counts = (F.when(F.col("text").isNull(), 0).otherwise(F.size(split)).cast("long"), F.size(gone).cast("long"), runs.cast("long"))
    out = joined.withColumns(dict(zip(columns, counts)))
    return out.withColumn("text", text).drop("_own_key", "_doc", "_key", "_lines")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs, columns=("n_lines", "n_removed", "n_spans"))


OP7_SQL = r"""
WITH docs AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
named AS (SELECT doc_id, text, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM docs),
solid AS (SELECT *, row_number() OVER (PARTITION BY doc_id, text ORDER BY i) AS k FROM named WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
windows AS (
  SELECT doc_id, k, i, lead(i) OVER w AS i2, lead(i, 2) OVER w AS i3,
         line || chr(10) || lead(line) OVER w || chr(10) || lead(line, 2) OVER w AS body
  FROM solid WINDOW w AS (PARTITION BY doc_id, text ORDER BY i)),
later AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, k) AS nth FROM windows WHERE i3 IS NOT NULL) WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, unnest([i, i2, i3]) AS i FROM later),
marked AS (SELECT n.*, g.i IS NOT NULL AS out FROM named n LEFT JOIN gone g ON n.doc_id = g.doc_id AND n.i = g.i),
runs AS (SELECT *, out AND NOT coalesce(lag(out) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM marked)
SELECT doc_id, CASE WHEN count(*) FILTER (out) = 0 THEN any_value(text) ELSE coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT out), '') END AS text,
       count(*)::BIGINT AS n_lines, count(*) FILTER (out)::BIGINT AS n_removed, count(*) FILTER (opens)::BIGINT AS n_spans
FROM runs GROUP BY doc_id
"""
