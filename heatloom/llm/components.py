"""Connected components by alternating large and small stars, as joins and minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatloom.llm.store import checkpointed


def _large_star(edges: DataFrame) -> DataFrame:
    """Neighbours above a node are hung on the smallest neighbour of that node."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are hung on the smallest of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, turns: int | None = None) -> DataFrame:
    """``(node, root)`` for every end of ``links(u, v)``; the root is the smallest node of the component.

    Each turn moves minima and edges, never a component, so a component of any size is no single row or task. With
    ``turns`` it stops early: nodes of one root are connected then, but a component may still have several roots.
    """
    edges = checkpointed(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while turns is None or turns > 0:
        if turns is not None:
            turns -= 1
            edges = checkpointed(_small_star(_large_star(edges)))
            continue
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            break
        seen = state
        edges = checkpointed(_small_star(_large_star(edges)))
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v"))
    return ends.groupBy("node").agg(F.min("root").alias("root"))
