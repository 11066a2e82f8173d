"""Joins that Spark has no operator for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of_following(left: DataFrame, right: DataFrame, by: str, on: str, value: str) -> DataFrame:
    """Each row of ``left`` with the first ``value`` of ``right`` at or after its time: one shuffle by key, no pairs."""
    rest = [c for c in left.columns if c not in (by, on)]
    a = left.select(by, on, F.struct(*rest).alias("_row"), F.lit(None).alias("_value"), F.lit(True).alias("_left"))
    b = right.select(by, on, F.lit(None).alias("_row"), F.struct(F.col(value).alias("v")).alias("_value"), F.lit(False).alias("_left"))
    w = Window.partitionBy(by).orderBy(on).rangeBetween(Window.currentRow, Window.unboundedFollowing)
    found = a.unionByName(b).withColumn("_found", F.first("_value", True).over(w)).where("_left")
    return found.select(by, on, *(F.col("_row")[c].alias(c) for c in rest), F.col("_found")["v"].alias(value))


def multiset_difference(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of ``left`` by how many more there are than in ``right`` (which keeps what a set difference would lose)."""
    count = lambda df, name: df.groupBy(*columns).agg(F.count(F.lit(1)).alias(name))
    joined = count(left, "_a").join(count(right, "_b"), columns, "left")
    return joined.withColumn("missing", F.col("_a") - F.coalesce("_b", F.lit(0))).where("missing > 0").drop("_a", "_b")
