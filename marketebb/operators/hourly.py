"""Hour buckets per entity: flow totals and prices of what was sold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketebb.functions import times
from marketebb.functions.measures import liquidity
from marketebb.operators.pricing import price_stats
from marketebb.operators.transitions import SOLD_KINDS


def sold_sample(trans: DataFrame) -> DataFrame:
    """Sold transitions with the price of the listing's last sighting in that crawl.

    First crawls are still in it; :func:`crawl_stats` and :func:`hourly` leave them out.
    """
    detail = [F.col("detail")] if "detail" in trans.columns else []
    return trans.filter(F.col("kind").isin(*SOLD_KINDS)).select(
        "ip_id",
        "crawl_ts",
        "source_id",
        F.col("close_price").alias("price"),
        F.col("copies").alias("weight"),
        "last_pos",
        *detail,
    )


def _item(sample: DataFrame):
    """Struct kept for the cheapest and dearest item, and the order in which items were met."""
    fields = ["source_id", "price"]
    item = F.struct(*fields, "detail.*") if "detail" in sample.columns else F.struct(*fields)
    return item, F.struct("crawl_ts", "last_pos", "source_id")


def crawl_stats(flow: DataFrame, sample: DataFrame) -> DataFrame:
    """Flow and price statistics of each crawl; a first crawl has no price sample."""
    item, order = _item(sample)
    prices = price_stats(sample, ["ip_id", "crawl_ts"], item, order)
    joined = flow.join(prices, ["ip_id", "crawl_ts"], "left")
    for name in prices.columns[2:]:
        joined = joined.withColumn(name, F.when(~F.col("first_crawl"), F.col(name)))
    return joined.withColumn("sample_count", F.coalesce("sample_count", F.lit(0)))


def hours_from_crawls(crawls: DataFrame) -> DataFrame:
    """Hour rows in ``last_crawl`` mode from the rows of :func:`crawl_stats`."""
    hour = times.hour_floor(F.col("crawl_ts")).alias("hour_bucket")
    last = F.max_by(F.struct("avg_price", "median_price", "price_stddev"), F.col("crawl_ts"))
    cheap = F.when(F.col("min_price").isNotNull(), F.struct("min_price", "crawl_ts"))
    # of equal maxima the earlier crawl wins, so its time counts downwards
    downwards = (-times.micros(F.col("crawl_ts"))).alias("r")
    dear = F.when(F.col("max_price").isNotNull(), F.struct(F.col("max_price"), downwards))
    merged = (
        crawls.groupBy("ip_id", hour)
        .agg(
            F.sum("inflow").alias("inflow"),
            F.sum("outflow").alias("outflow"),
            last.alias("last"),
            F.min("min_price").alias("min_price"),
            F.max("max_price").alias("max_price"),
            F.min_by("min_item", cheap).alias("min_item"),
            F.max_by("max_item", dear).alias("max_item"),
            F.sum("sample_count").alias("sample_count"),
        )
        .select("*", "last.*")
    )
    return _hour_row(merged)


def hours_exact(flow: DataFrame, sample: DataFrame) -> DataFrame:
    """Hour rows with all statistics taken over all items sold in the hour."""
    hour = times.hour_floor(F.col("crawl_ts")).alias("hour_bucket")
    item, order = _item(sample)
    counted = sample.join(flow.filter("first_crawl").select("ip_id", "crawl_ts"), ["ip_id", "crawl_ts"], "left_anti")
    prices = price_stats(counted.withColumn("hour_bucket", hour), ["ip_id", "hour_bucket"], item, order)
    merged = (
        flow.groupBy("ip_id", hour)
        .agg(F.sum("inflow").alias("inflow"), F.sum("outflow").alias("outflow"))
        .join(prices, ["ip_id", "hour_bucket"], "left")
        .withColumn("sample_count", F.coalesce("sample_count", F.lit(0)))
    )
    return _hour_row(merged)


def hourly(flow: DataFrame, sample: DataFrame, merge_mode: str = "last_crawl") -> DataFrame:
    """Hour rows.

    ``last_crawl``: average, median and deviation are those of the hour's last crawl, while flow
    and sample counts add up and min/max hold over all crawls. ``exact``: all statistics over all
    items sold in the hour.
    """
    if merge_mode == "last_crawl":
        return hours_from_crawls(crawl_stats(flow, sample))
    if merge_mode == "exact":
        return hours_exact(flow, sample)
    raise ValueError(f"unknown merge_mode {merge_mode!r}")


def _hour_row(merged: DataFrame) -> DataFrame:
    return merged.select(
        "ip_id",
        "hour_bucket",
        "inflow",
        "outflow",
        liquidity(F.col("inflow"), F.col("outflow")).alias("liquidity_index"),
        F.lit(0).alias("active_count"),
        "avg_price",
        "median_price",
        "min_price",
        "max_price",
        "min_item",
        "max_item",
        "price_stddev",
        "sample_count",
    )


def hour_totals(flow: DataFrame) -> DataFrame:
    """Only the flow part of an hour row, for callers that need no prices."""
    return (
        flow.groupBy("ip_id", times.hour_floor(F.col("crawl_ts")).alias("hour_bucket"))
        .agg(F.sum("inflow").alias("inflow"), F.sum("outflow").alias("outflow"))
        .withColumn("liquidity_index", liquidity(F.col("inflow"), F.col("outflow")))
    )


def merge_hours(old: DataFrame, new: DataFrame) -> DataFrame:
    """Hour rows after a further delta: counts add, min/max keep the better side, the rest is new."""
    tagged = old.withColumn("gen", F.lit(0)).unionByName(new.withColumn("gen", F.lit(1)))
    last = F.max_by(F.struct("active_count", "avg_price", "median_price", "price_stddev"), F.col("gen"))
    cheap = F.when(F.col("min_price").isNotNull(), F.struct("min_price", "gen"))
    dear = F.when(F.col("max_price").isNotNull(), F.struct(F.col("max_price"), (-F.col("gen")).alias("r")))
    return (
        tagged.groupBy("ip_id", "hour_bucket")
        .agg(
            F.sum("inflow").alias("inflow"),
            F.sum("outflow").alias("outflow"),
            last.alias("last"),
            F.min("min_price").alias("min_price"),
            F.max("max_price").alias("max_price"),
            F.min_by("min_item", cheap).alias("min_item"),
            F.max_by("max_item", dear).alias("max_item"),
            F.sum("sample_count").alias("sample_count"),
        )
        .select("*", "last.*")
        .drop("last")
        .withColumn("liquidity_index", liquidity(F.col("inflow"), F.col("outflow")))
        .select(*old.columns)
    )


def latest_hour(hours: DataFrame, entities: DataFrame, now=None) -> DataFrame:
    """Latest hour row of each entity; entities without rows give zeros.

    With ``now`` only complete hours count (hour_bucket before the hour of ``now``).
    """
    if now is not None:
        hours = hours.filter(F.col("hour_bucket") < times.ntz(times.current_hour(now)))
    row = F.max_by(F.struct("hour_bucket", "inflow", "outflow", "liquidity_index"), F.col("hour_bucket"))
    latest = hours.groupBy("ip_id").agg(row.alias("r")).select("ip_id", "r.*")
    return (
        entities.select(F.col("id").alias("ip_id"))
        .join(latest, "ip_id", "left")
        .fillna(0, ["inflow", "outflow"])
    )


def last_hours(hours: DataFrame, n: int = 24) -> DataFrame:
    """The newest ``n`` hour rows of each entity (a per-key limit applied before the shuffle)."""
    w = Window.partitionBy("ip_id").orderBy(F.desc("hour_bucket"))
    return hours.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)


def hours_between(hours: DataFrame, start=None, end=None, closed: bool = True) -> DataFrame:
    """Rows with optional ends; ``closed=False`` leaves the upper end out."""
    if start is not None:
        hours = hours.filter(F.col("hour_bucket") >= times.ntz(start))
    if end is not None:
        upper = times.ntz(end)
        hours = hours.filter(F.col("hour_bucket") <= upper if closed else F.col("hour_bucket") < upper)
    return hours
