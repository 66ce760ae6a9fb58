"""Roll-ups: hour to day, day to week, week to month, for all entities at once."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketebb.functions import times
from marketebb.operators.pricing import price_stats


def daily(hours: DataFrame, snapshots: DataFrame, on: date | None = None) -> DataFrame:
    """Day rows: flow from hour rows, prices from the items whose ``sold_at`` lies in the day.

    An entity without hour rows on a day gets no row, even if it sold something.
    """
    if on is not None:
        start, end = times.ntz(f"{on} 00:00:00"), times.ntz(f"{on + timedelta(days=1)} 00:00:00")
        hours = hours.filter((F.col("hour_bucket") >= start) & (F.col("hour_bucket") < end))
        snapshots = snapshots.filter((F.col("sold_at") >= start) & (F.col("sold_at") < end))
    flow = hours.groupBy("ip_id", F.col("hour_bucket").cast("date").alias("date_bucket")).agg(
        F.sum("inflow").alias("total_inflow"),
        F.sum("outflow").alias("total_outflow"),
        F.avg("liquidity_index").alias("avg_liquidity"),
        F.count(F.lit(1)).alias("hourly_records"),
    )
    sold = snapshots.filter(F.col("sold_at").isNotNull()).select(
        "ip_id",
        F.col("sold_at").cast("date").alias("date_bucket"),
        "sold_at",
        "source_id",
        "price",
        F.lit(1).cast("long").alias("weight"),
        *[c for c in ("title", "image_url", "item_url") if c in snapshots.columns],
    )
    item = F.struct(*[c for c in sold.columns if c not in ("ip_id", "date_bucket", "sold_at", "weight")])
    prices = price_stats(sold, ["ip_id", "date_bucket"], item, F.struct("sold_at", "source_id"), positive_only=False)
    prices = prices.select(
        "ip_id",
        "date_bucket",
        F.col("max_price").alias("max_sold_price"),
        F.col("min_price").alias("min_sold_price"),
        F.col("median_price").alias("median_sold_price"),
        F.col("avg_price").alias("avg_sold_price"),
        F.col("min_item").alias("min_price_item"),
        F.col("max_item").alias("max_price_item"),
        "sample_count",
    )
    return flow.join(prices, ["ip_id", "date_bucket"], "left").withColumn(
        "sample_count", F.coalesce("sample_count", F.lit(0))
    )


def _roll(rows: DataFrame, bucket: str, target: str, to: Column, records: str) -> DataFrame:
    """Common fold of day and week rows; a group holds at most seven days or five weeks."""
    sampled = F.col("avg_sold_price").isNotNull() & (F.col("sample_count") > 0)
    cheap = F.when(F.col("min_sold_price").isNotNull(), F.struct("min_sold_price", bucket))
    dear = F.when(
        F.col("max_sold_price").isNotNull(),
        F.struct(F.col("max_sold_price"), (-F.unix_date(bucket)).alias("r")),
    )
    return rows.groupBy("ip_id", to.alias(target)).agg(
        F.sum("total_inflow").alias("total_inflow"),
        F.sum("total_outflow").alias("total_outflow"),
        F.avg("avg_liquidity").alias("avg_liquidity"),
        F.max("max_sold_price").alias("max_sold_price"),
        F.min("min_sold_price").alias("min_sold_price"),
        F.median("median_sold_price").alias("median_sold_price"),
        (
            F.sum(F.when(sampled, F.col("avg_sold_price") * F.col("sample_count")))
            / F.sum(F.when(sampled, F.col("sample_count")))
        ).alias("avg_sold_price"),
        F.min_by("min_price_item", cheap).alias("min_price_item"),
        F.max_by("max_price_item", dear).alias("max_price_item"),
        F.sum("sample_count").alias("sample_count"),
        F.count(F.lit(1)).alias(records),
    )


def weekly(days: DataFrame, week: date | None = None) -> DataFrame:
    """Week rows (Monday). Median is the median of daily medians; average is weighted by samples."""
    if week is not None:
        week = times.monday(week)
        days = days.filter(
            (F.col("date_bucket") >= times.day(week)) & (F.col("date_bucket") < times.day(week + timedelta(days=7)))
        )
    return _roll(days, "date_bucket", "week_start", times.monday_of(F.col("date_bucket")), "daily_records")


def monthly(weeks: DataFrame, month: date | None = None) -> DataFrame:
    """Month rows; a week belongs to the month in which its Monday lies."""
    if month is not None:
        month = month.replace(day=1)
        weeks = weeks.filter(
            (F.col("week_start") >= times.day(month)) & (F.col("week_start") < times.day(times.next_month(month)))
        )
    return _roll(weeks, "week_start", "month_start", times.month_start(F.col("week_start")), "weekly_records")
