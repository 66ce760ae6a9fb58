"""Retention: which rows of each table stay. Cut-offs are midnights of the market zone."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketebb.functions import times
from marketebb.session import stage
from marketebb.sources import sinks

HOUR_DAYS, DAY_DAYS, WEEK_DAYS, SNAPSHOT_LAG_DAYS = 7, 90, 365, 8


def hour_cutoff(now: datetime, days: int = HOUR_DAYS):
    return now.date() - timedelta(days=days)


def week_cutoff(now: datetime, days: int = WEEK_DAYS):
    return times.monday(now.date() - timedelta(days=days))


def keep_hours(hours: DataFrame, now: datetime, days: int = HOUR_DAYS) -> DataFrame:
    return hours.filter(F.col("hour_bucket") >= times.ntz(f"{hour_cutoff(now, days)} 00:00:00"))


def keep_days(rows: DataFrame, now: datetime, days: int = DAY_DAYS) -> DataFrame:
    return rows.filter(F.col("date_bucket") >= times.day(hour_cutoff(now, days)))


def keep_weeks(rows: DataFrame, now: datetime, days: int = WEEK_DAYS) -> DataFrame:
    return rows.filter(F.col("week_start") >= times.day(week_cutoff(now, days)))


def _spent(on) -> Column:
    """Snapshots to remove for one day: sold on it, or unsold and last updated on it."""
    start, end = times.ntz(f"{on} 00:00:00"), times.ntz(f"{on + timedelta(days=1)} 00:00:00")
    sold = (F.col("sold_at") >= start) & (F.col("sold_at") < end)
    stale = (F.col("status") != "sold") & (F.col("updated_at") >= start) & (F.col("updated_at") < end)
    return F.coalesce(sold, F.lit(False)) | F.coalesce(stale, F.lit(False))


def keep_snapshots(snapshots: DataFrame, on) -> DataFrame:
    """Snapshots without those spent on the given day."""
    return snapshots.filter(~_spent(on))


def clean_stored(spark: SparkSession, root: str, now: datetime) -> None:
    """One clean-up run over the tables that the write path stores under a root.

    Hour rows lie by day and what batches left behind by batch, so whole partitions go and the others are not read. Snapshots lie
    in buckets: those that hold a spent row are rewritten without it. Run again, it finds nothing to do.
    """
    sinks.drop_partitions(spark, f"{root}/ip_stats_hourly", "day", hour_cutoff(now))
    sinks.drop_partitions(spark, f"{root}/crawls", "day", hour_cutoff(now))
    path, on = f"{root}/item_snapshots", now.date() - timedelta(days=SNAPSHOT_LAG_DAYS)
    if sinks.exists(spark, path):
        stored = spark.read.parquet(path)
        hit = [r.bucket for r in stored.filter(_spent(on)).select("bucket").distinct().collect()]  # as many as the layout has, at most
        if hit:
            rows = stored.filter(F.col("bucket").isin(hit))
            kept = stage(keep_snapshots(rows, on), "snapshots")
            sinks.overwrite_partitions(kept.repartition("bucket"), path, ["bucket"])
            full = {r.bucket for r in kept.select("bucket").distinct().collect()}
            for bucket in set(hit) - full:
                sinks.drop_partition(spark, path, f"bucket={bucket}")


def clean_up(
    hours: DataFrame, days: DataFrame, weeks: DataFrame, snapshots: DataFrame, now: datetime
) -> dict[str, DataFrame]:
    """What stays of each table after one clean-up run; month rows are kept for ever."""
    return {
        "hours": keep_hours(hours, now),
        "days": keep_days(days, now),
        "weeks": keep_weeks(weeks, now),
        "snapshots": keep_snapshots(snapshots, now.date() - timedelta(days=SNAPSHOT_LAG_DAYS)),
    }
