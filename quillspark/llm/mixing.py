"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Each source is a queue of its documents in shuffled order, read up to ``most`` times over. A copy of a document gets
as virtual finish time its source's tokens so far, divided by the source's target. All copies are ordered by that time
over the whole corpus, and the order is cut where its running total reaches the budget. A source has served just
its target at virtual time 1, so the copy that it is serving then is taken up to that time.

Both running totals (within a source and over the corpus) are taken in two levels: totals of equal slices of a uniform
key, and rows within a slice. So a source with a third of all rows is spread over as many tasks as any others. Copies that are not
served take no part in the second total. Targets are windows over one row for each source, in one task: sources are named
collections (some millions at most), not documents.

Cases: null text has size 0; null source is a source of its own, the last; a source without words has target 0; rows
with equal id and text are copies with places of their own; an empty table gives an empty result. Other columns pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.workspace import Workspace

WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that a slice of a running total should hold, at least; beyond its square a slice grows with the root of the rows, as their number does.
SLICE_ROWS = 2_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """Rows (source, source_size) to (source, source_size, weight, target): weights repeat over the sources by code point, null
    last; ``share`` of all words is divided by weight, at most ``most`` times its size to a source, the excess reshared.

    Sources in order of size by weight are the order in which they reach their limit as the water level rises, so running
    sums over that order give the level: the first source that stays below its limit fixes it (later ones compute less). One row for
    each source; no documents pass here.
    """
    named = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    named = named.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long"))
    named = named.withColumn("limit", F.col("source_size") * most)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy((F.col("limit") / F.col("weight")).asc(), F.col("rank")).rowsBetween(Window.unboundedPreceding, -1)
    named = named.withColumns({"all_words": F.sum("source_size").over(everything), "all_weight": F.sum("weight").over(everything)})
    named = named.withColumns({"gone": F.coalesce(F.sum("limit").over(before), F.lit(0)), "gone_weight": F.coalesce(F.sum("weight").over(before), F.lit(0))})
    named = named.withColumn("level", (F.col("all_words") * share[0] / share[1] - F.col("gone")) / (F.col("all_weight") - F.col("gone_weight")))
    named = named.withColumn("open", F.max(F.when(F.col("limit") / F.col("weight") > F.col("level"), F.col("level"))).over(everything))
    target = F.when(F.col("open").isNull() | (F.col("limit") <= F.col("open") * F.col("weight")), F.col("limit").cast("double")).otherwise(F.col("open") * F.col("weight"))
    return named.select("source", "source_size", "weight", target.alias("target"))


def _slices(rows: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(rows / F.greatest(F.lit(SLICE_ROWS), F.sqrt(rows))))


def _running(df: DataFrame, keys: list[str], place: str, order: list[str], amount: str, out: str, slices: Column) -> DataFrame:
    """Adds the running total of ``amount`` by ``order`` within ``keys``; ``place`` in [0, 1) rises with the order."""
    df = df.withColumn("_slice", F.floor(F.col(place) * slices).cast("long"))
    totals = df.groupBy(*keys, "_slice").agg(F.sum(amount).alias("_amount"))
    upto = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_before", F.coalesce(F.sum("_amount").over(upto), F.lit(0)))
    left, right = df.alias("l"), totals.alias("r")
    same = F.col("l._slice") == F.col("r._slice")
    for k in keys:
        same &= F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    joined = left.join(right, same).select("l.*", "r._before")
    inner = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn(out, F.col("_before") + F.sum(amount).over(inner)).drop("_before", "_slice")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = (3, 2), most: int = 2, seed: int = 0) -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target, taken (words, repeats counted), first_finish
    (virtual time at which its first copy is served) and mix_end (the corpus' running total at that copy, null if not served).
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.md5("text"), F.lit(""))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key))
    slim = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), digest.alias("_h"))
    slim = slim.withColumn("_u", F.conv(F.substring("_h", 1, 12), 16, 10).cast("double") / float(1 << 48))
    work = Workspace(docs.sparkSession, "mixing")
    slim = work.keep(slim, "sizes")  # texts are read once; a few numbers a document are kept
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    targets = source_targets(sizes.select("source", "source_size"), weights, share, most)
    targets = targets.alias("t").join(sizes.alias("s"), F.col("t.source").eqNullSafe(F.col("s.source"))).select("t.*", "s._rows")
    slim = slim.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select("d.*", "t.source_size", "t.target", "t._rows")
    slim = _running(slim, ["source"], "_u", ["_h", "doc_id", "size"], "size", "_cum", _slices(F.col("_rows")))
    copies = slim.withColumn("_pass", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    end = F.col("_cum") + F.col("_pass") * F.col("source_size")
    served = F.least(F.col("size"), F.floor(F.col("target")).cast("long") - (end - F.col("size")))
    copies = copies.withColumns({"_end": end, "_served": F.greatest(F.lit(0), served)}).where((F.col("_served") > 0) | (F.col("_pass") == 0))
    copies = copies.withColumn("_finish", F.coalesce(F.try_divide(F.col("_end").cast("double"), F.col("target")), F.lit(0.0)))
    # Every served copy starts before virtual time 1. What ends later (one copy of a source) is served to time 1 only, and comes last.
    rows, words = sizes.agg(F.sum("_rows"), F.sum("source_size")).first()
    budget = (words or 0) * share[0] // share[1]
    copies = copies.withColumns({"_place": F.least(F.col("_finish"), F.lit(1.0 - 2.0**-40)), "_one": F.lit(1)})
    served = _running(copies.where("_served > 0"), ["_one"], "_place", ["_finish", "_h", "_pass", "doc_id", "size"], "_served", "_total", _slices(F.lit((rows or 0) * most)))
    copies = served.unionByName(copies.where("_served = 0").withColumn("_total", F.lit(None).cast("long")))
    kept = F.when(F.col("_total").isNull(), 0).otherwise(F.greatest(F.lit(0), F.least(F.col("_served"), F.lit(budget) - (F.col("_total") - F.col("_served")))))
    first = F.col("_pass") == 0
    rows = copies.groupBy("doc_id", "source", "size", "source_size", "target", "_cum", "_h").agg(
        F.sum(kept).cast("long").alias("taken"),
        F.min(F.when(first, F.col("_finish"))).alias("first_finish"),
        F.min(F.when(first & (F.col("_served") > 0), F.col("_total"))).alias("mix_end"),
        F.count_if(first).alias("_copies"),
    )
    # Rows of size 0 with equal ids have met in one group.
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return rows.select("doc_id", "source", "size", "source_size", "target", "taken", "first_finish", "mix_end")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


#: The same queue in plain SQL: running sums over whole sources and over the whole corpus.
OP8_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+'))::BIGINT AS size,
         md5('0:' || coalesce(doc_id::VARCHAR, md5(text), '')) AS h FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sizes),
weighed AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS weight, 2 * source_size AS lim FROM ranked),
levels AS (
  SELECT *, (sum(source_size) OVER () * 3 / 2.0::DOUBLE - coalesce(sum(lim) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM weighed WINDOW w AS (ORDER BY lim / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
opened AS (SELECT *, max(CASE WHEN lim / weight > level THEN level END) OVER () AS open FROM levels),
targets AS (SELECT source, source_size, CASE WHEN open IS NULL OR lim <= open * weight THEN lim::DOUBLE ELSE open * weight END AS target FROM opened),
queued AS (
  SELECT d.*, t.source_size, t.target, sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS cum
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT *, cum + pass * source_size AS fin,
         greatest(0, least(size, floor(target)::BIGINT - (cum + pass * source_size - size))) AS served
  FROM queued CROSS JOIN (VALUES (0), (1)) AS p(pass)),
totals AS (SELECT *, sum(served) OVER (ORDER BY coalesce(fin::DOUBLE / nullif(target, 0), 0), h, pass, doc_id, size ROWS UNBOUNDED PRECEDING) AS total FROM copies),
budget AS (SELECT floor(sum(size) * 3 / 2.0)::BIGINT AS budget FROM docs)
SELECT doc_id, size, source_size, target, sum(greatest(0, least(served, budget - (total - served))))::BIGINT AS taken
FROM totals CROSS JOIN budget GROUP BY doc_id, size, source_size, target, cum, h
"""
