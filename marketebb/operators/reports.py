"""Reports that join the stored tables."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketebb.functions import times
from marketebb.operators import boards, hourly


def _names(metadata: DataFrame) -> DataFrame:
    return metadata.select(F.col("id").alias("ip_id"), F.col("name").alias("ip_name"))


def lookup(df: DataFrame, **keys) -> DataFrame:
    """Rows with the given key values, such as one hour row, one snapshot or one entity by name.

    The literals reach the scan, so partitions and row groups without the key are skipped.
    """
    for name, wanted in keys.items():
        literal = times.ntz(wanted) if isinstance(wanted, datetime) else F.lit(wanted)
        df = df.filter(F.col(name) == literal)
    return df


def hour_report(hours: DataFrame, metadata: DataFrame, now: datetime, limit: int = 20) -> DataFrame:
    """Newest hour rows of the last 24 hours with entity names."""
    recent = hours.filter(F.col("hour_bucket") >= times.ntz(now - timedelta(hours=24)))
    return (
        recent.join(_names(metadata), "ip_id", "inner")
        .orderBy(F.desc("hour_bucket"), "ip_id")
        .limit(limit)
        .select(
            "ip_id",
            "ip_name",
            F.date_format("hour_bucket", "MM-dd HH:00").alias("hour"),
            "inflow",
            "outflow",
            F.round("liquidity_index", 2).alias("liquidity"),
        )
    )


def snapshot_summary(snapshots: DataFrame, metadata: DataFrame) -> DataFrame:
    """Items per entity: total, on sale, sold, rounded mean price. Grouped first, joined after."""
    per_entity = snapshots.groupBy("ip_id").agg(
        F.count(F.lit(1)).alias("total_items"),
        F.count_if(F.col("status") == "on_sale").alias("on_sale"),
        F.count_if(F.col("status") == "sold").alias("sold"),
        F.round(F.avg("price"), 0).alias("avg_price"),
    )
    return per_entity.join(_names(metadata), "ip_id", "inner")


def status_counts(snapshots: DataFrame) -> DataFrame:
    return snapshots.groupBy("ip_id", "status").agg(F.count(F.lit(1)).alias("items"))


def active_hour_board(hours: DataFrame, metadata: DataFrame, now: datetime, limit: int = 10) -> DataFrame:
    """Board of the last complete hour over active entities only."""
    end = times.current_hour(now)
    rows = boards.hour_board_rows(hours, end - timedelta(hours=1), end)
    alive = metadata.filter(F.col("status") == "active").select(F.col("id").alias("ip_id"))
    return boards.with_names(boards.top_k(rows.join(alive, "ip_id", "left_semi"), "hot", limit), metadata)


def system_counts(metadata: DataFrame, alert_rows: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Active entities, open alerts and items on sale, as one row."""
    count = F.count(F.lit(1))
    return (
        metadata.filter(F.col("status") == "active")
        .agg(count.alias("active_entities"))
        .withColumn("open_alerts", alert_rows.filter(~F.col("acknowledged")).agg(count).scalar())
        .withColumn("items_on_sale", snapshots.filter(F.col("status") == "on_sale").agg(count).scalar())
    )


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count of each table."""
    counted = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    out = counted[0]
    for one in counted[1:]:
        out = out.unionAll(one)
    return out


def entities_with_board(entities: DataFrame, board: DataFrame) -> DataFrame:
    """Entity list with rank and score of those on a board."""
    ranked = board.select(F.col("ip_id").alias("id"), "rank", "score", "inflow", "outflow")
    return entities.join(ranked, "id", "left")


def entity_detail(
    entities: DataFrame, hours: DataFrame, snapshots: DataFrame, now: datetime, n_hours: int = 12, n_items: int = 16
) -> DataFrame:
    """Entity with its latest liquidity, its last hours (oldest first) and its newest items.

    Both lists are cut per entity before they are collected, so each is of fixed length.
    """
    recent = hourly.last_hours(hours.filter(F.col("hour_bucket") < times.ntz(times.current_hour(now))), n_hours)
    hour_lists = recent.groupBy("ip_id").agg(
        F.max_by("liquidity_index", "hour_bucket").alias("liquidity_index"),
        F.array_sort(F.collect_list(F.struct("hour_bucket", "inflow", "outflow"))).alias("hours"),
    )
    w = Window.partitionBy("ip_id").orderBy(F.desc("last_seen_at"), "source_id")
    newest = snapshots.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n_items)
    item_lists = newest.groupBy("ip_id").agg(
        F.array_sort(F.collect_list(F.struct("rn", "source_id", "price", "status"))).alias("items")
    )
    return (
        entities.withColumnRenamed("id", "ip_id")
        .join(hour_lists, "ip_id", "left")
        .join(item_lists, "ip_id", "left")
    )


def display_board(board: DataFrame) -> DataFrame:
    """Board rows for a chart: name and score with two decimals."""
    return board.select("ip_id", "ip_name", F.round("score", 2).alias("score"))


def display_hours(hours: DataFrame) -> DataFrame:
    """Hour rows with the clock time as text."""
    return hours.withColumn("clock", F.substring(F.col("hour_bucket").cast("string"), 12, 5))
