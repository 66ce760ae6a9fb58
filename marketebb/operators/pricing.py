"""Exact price statistics per group.

The rows of a group are first folded to one row per distinct price (combined before the shuffle).
What then meets per group is at most one row per price in use, in a spillable sorted window: the
median needs no buffer of the group's rows, however many there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def price_stats(
    df: DataFrame,
    keys: Sequence[str],
    item: Column | None = None,
    order: Column | None = None,
    positive_only: bool = True,
) -> DataFrame:
    """avg, median, min, max, population stddev (NULL when 0) and sample_count of ``price``.

    ``weight`` counts how often a row stands. ``item`` is the struct kept for the cheapest and the
    dearest row; ``order`` breaks ties (smallest first). Non-positive prices are left out unless
    ``positive_only`` is off.
    """
    if positive_only:
        df = df.filter("price > 0")
    aggs = [F.sum("weight").alias("n")]
    if item is not None:
        aggs.append(F.min_by(item, order).alias("item"))
    per_price = df.groupBy(*keys, "price").agg(*aggs)

    group = Window.partitionBy(*keys)
    ranked = (
        per_price.withColumn("upto", F.sum("n").over(group.orderBy("price")))
        .withColumn("total", F.sum("n").over(group))
        .withColumn("mean", F.sum(F.col("price").cast("double") * F.col("n")).over(group) / F.col("total"))
    )
    # 0-based positions of the two middle values; equal when the count is odd
    low = F.floor((F.col("total") - 1) / 2)
    high = F.floor(F.col("total") / 2)
    start = F.col("upto") - F.col("n")
    middle = F.when((start <= low) & (low < F.col("upto")), F.col("price")).otherwise(0) + F.when(
        (start <= high) & (high < F.col("upto")), F.col("price")
    ).otherwise(0)
    spread = F.sqrt(
        F.sum(F.col("n") * F.pow(F.col("price") - F.col("mean"), F.lit(2.0))) / F.sum("n")
    )
    out = [
        F.max("mean").alias("avg_price"),
        (F.sum(middle.cast("long")) / 2).alias("median_price"),
        F.min("price").alias("min_price"),
        F.max("price").alias("max_price"),
        F.when(spread > 0, spread).alias("price_stddev"),
        F.sum("n").alias("sample_count"),
    ]
    if item is not None:
        out += [F.min_by("item", "price").alias("min_item"), F.max_by("item", "price").alias("max_item")]
    return ranked.groupBy(*keys).agg(*out)
