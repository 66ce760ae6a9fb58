"""Connected components by alternating large-star and small-star steps, with written tables between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketebb.llm.shared import discard, stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step on edges (a, b) with b < a: every node hands its (larger or smaller) neighbours its least neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    least = least.withColumn("m", F.least("m", "a"))
    out = both.join(least, "a")
    if large:
        return out.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    return out.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, label) of every node of the undirected edges (a, b): the least node of its component.

    The number of rounds grows with the logarithm of the longest path. Nothing but counts reaches the driver.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    e, known = stage(e, "edges"), None
    for _ in range(most_rounds):
        old, e = e, stage(_star(_star(e, True).where("a > b"), False).where("a > b"), "edges")
        discard(old)
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 31))).first()
        if state == known:
            break
        known = state
    else:
        raise RuntimeError(f"components not settled after {most_rounds} rounds")
    ends = e.groupBy("a").agg(F.min("b").alias("label")).select(F.col("a").alias("node"), "label")
    return ends.unionByName(ends.select(F.col("label").alias("node"), "label").distinct())
