"""Connected components by contraction, in joins and minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.workspace import Workspace, hot_rows, join_by

#: Rows (of two numbers) that a task may get for one key without harm. Smaller graphs are not searched for hubs.
FEW = 1_000_000


def _follow(rows: DataFrame, column: str, jump: DataFrame, hot: DataFrame | None) -> DataFrame:
    """``rows`` with ``column`` replaced by where ``jump`` (node, comp) takes it, if anywhere. Rows of hot nodes stay where they are."""
    table = jump.select(F.col("node").alias("_key"), F.col("comp").alias("_to"))
    moved = join_by(rows.withColumnRenamed(column, "_key"), table, "_key", None if hot is None else hot.select(F.col("node").alias("_key")), "left")
    return moved.withColumn(column, F.coalesce("_to", "_key")).drop("_key", "_to")


def components(edges: DataFrame, work: Workspace, name: str) -> DataFrame:
    """Edges (a, b) to rows (node, comp): comp is the least node that links reach. Nodes without edges have no row.

    Each round maps every node to the least of its neighbours' least neighbours and contracts the edges by that map; the
    graph shrinks geometrically. No neighbourhood is ever gathered. Nodes of a large share of the edges, and components of a large
    share of the nodes (a bounded number of either), meet their rows by a broadcast.
    """
    ordered = lambda df: df.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = work.keep(ordered(edges), f"{name}-edges0")
    found = None
    for step in range(200):
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
        least = both.groupBy("node").agg(F.min("other").alias("other"), F.count(F.lit(1)).alias("n")).select("node", F.least("node", "other").alias("comp"), "n")
        least = work.keep(least, f"{name}-least{step}")
        hubs = None
        if 2 * edges.count() > FEW:
            ends, most = least.agg(F.sum("n"), F.max("n")).first()
            hubs = least.where(F.col("n") > hot_rows(ends)).select("node") if most > hot_rows(ends) else None
        jump = work.keep(_follow(least.select("node", "comp"), "comp", least, hubs), f"{name}-jump{step}")
        if found is None:
            found = jump
        else:
            large = None
            if found.count() > FEW:
                sizes = found.groupBy("comp").agg(F.count(F.lit(1)).alias("n"))
                nodes, most = sizes.agg(F.sum("n"), F.max("n")).first()
                large = sizes.where(F.col("n") > hot_rows(nodes)).select(F.col("comp").alias("node")) if most > hot_rows(nodes) else None
            found = work.keep(_follow(found, "comp", jump, large), f"{name}-found{step}")
            work.drop(*([f"{name}-found{step - 1}"] if step > 1 else [f"{name}-jump0"]))
        edges = work.keep(ordered(_follow(_follow(edges, "a", jump, hubs), "b", jump, hubs)), f"{name}-edges{step + 1}")
        work.drop(f"{name}-edges{step}", f"{name}-least{step}", *([f"{name}-jump{step}"] if step else []))
        if edges.isEmpty():
            return found
    raise RuntimeError("components did not converge")
