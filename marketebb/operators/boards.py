"""Leaderboards and the paging helper."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketebb.functions import times
from marketebb.functions.measures import hot_score
from marketebb.session import scratch_dir, stage

KINDS = ("hot", "inflow", "outflow")


class Request(NamedTuple):
    """What a list or board is asked for."""

    hours: int
    limit: int
    page: int
    size: int
    last: int


def normalise_request(
    hours: int = 24, limit: int = 10, page: int = 1, size: int = 20, last: int = 24, most: int = 100, most_hours: int = 168
) -> Request:
    """The request rules of a public list, for callers that want them; the operators themselves have no bounds.

    A board is over 1..23 hours, 24 (yesterday) or 168 (last full week); sizes that are not positive take their default,
    larger ones the given maximum.
    """
    window = 24 if hours <= 0 else 168 if hours >= 168 else min(hours, 24)
    return Request(
        window, 10 if limit <= 0 else min(limit, most), max(page, 1), 20 if size <= 0 else min(size, most), 24 if last <= 0 else min(last, most_hours)
    )


def positive(name: str, value: int) -> int:
    if value < 1:
        raise ValueError(f"{name} must be positive, not {value}")
    return value


def hour_board_rows(hours: DataFrame, start, end) -> DataFrame:
    """Flow per entity over [start, end); entities without any flow drop out."""
    return (
        hours.filter((F.col("hour_bucket") >= times.ntz(start)) & (F.col("hour_bucket") < times.ntz(end)))
        .groupBy("ip_id")
        .agg(F.sum("inflow").alias("inflow"), F.sum("outflow").alias("outflow"))
        .filter((F.col("inflow") > 0) | (F.col("outflow") > 0))
    )


def bucket_board_rows(rows: DataFrame, bucket: str, value) -> DataFrame:
    """Flow per entity from the day or week rows of one bucket."""
    return rows.filter(F.col(bucket) == times.day(value)).select(
        "ip_id", F.col("total_inflow").alias("inflow"), F.col("total_outflow").alias("outflow")
    )


def top_k(rows: DataFrame, kind: str = "hot", limit: int = 10) -> DataFrame:
    """The k best rows with score and rank; 0/0 rows drop out, ties go to the smaller ip_id."""
    if kind not in KINDS:
        raise ValueError(f"unknown board {kind!r}")
    score = {
        "hot": hot_score(F.col("inflow"), F.col("outflow")),
        "inflow": F.col("inflow").cast("double"),
        "outflow": F.col("outflow").cast("double"),
    }[kind]
    best = (
        rows.filter((F.col("inflow") > 0) | (F.col("outflow") > 0))
        .withColumn("score", score)
        .orderBy(F.desc("score"), "ip_id")
        .limit(positive("limit", limit))
    )
    # no more than the rows asked for meet in this window
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "ip_id"))
    return best.withColumn("rank", rank.cast("long"))


def with_names(board: DataFrame, metadata: DataFrame) -> DataFrame:
    """Names of the entities on a board; a missing entity gives empty names."""
    names = metadata.select(
        F.col("id").alias("ip_id"), F.col("name").alias("ip_name"), F.col("name_en").alias("ip_name_en")
    )
    return board.join(names, "ip_id", "left").fillna("", ["ip_name", "ip_name_en"])


def leaderboard(
    kind: str,
    hours: int,
    limit: int,
    now: datetime,
    metadata: DataFrame,
    hour_rows: DataFrame | None = None,
    day_rows: DataFrame | None = None,
    week_rows: DataFrame | None = None,
) -> DataFrame:
    """Board over the last complete hours (1..23), yesterday's day rows (24) or last week's week rows (168).

    An unknown kind counts as "hot".
    """
    kind = kind if kind in KINDS else "hot"
    if hours not in (*range(1, 25), 168):
        raise ValueError(f"no board covers {hours} hours")
    if hours == 168:
        rows = bucket_board_rows(week_rows, "week_start", times.last_full_week(now))
    elif hours == 24:
        rows = bucket_board_rows(day_rows, "date_bucket", times.yesterday(now))
    else:
        end = times.current_hour(now)
        rows = hour_board_rows(hour_rows, end - timedelta(hours=hours), end)
    return with_names(top_k(rows, kind, limit), metadata)


def dashboard_totals(hot: DataFrame, inflow: DataFrame, outflow: DataFrame) -> DataFrame:
    """Median volume over the three boards (repeats count) and total volume of the hot board."""
    volume = F.col("inflow") + F.col("outflow")
    boards = [hot.select(volume.alias("volume"), volume.alias("ops"))] + [
        b.select(volume.alias("volume"), F.lit(0).cast("long").alias("ops")) for b in (inflow, outflow)
    ]
    everything = boards[0].unionAll(boards[1]).unionAll(boards[2])
    return everything.agg(
        F.coalesce(F.median("volume"), F.lit(0.0)).alias("median_volume"),
        F.coalesce(F.sum("ops"), F.lit(0)).alias("total_ops"),
    )


class PagedList(NamedTuple):
    """An ordered list laid out in ranges of its order, and for each range how many rows it and those before it have."""

    rows: DataFrame
    ranges: DataFrame
    order: list[Column]


def paged(df: DataFrame, order: list[Column]) -> PagedList:
    """Write a list in ranges, each a folder; ties share one, so the order should end with a unique column."""
    path = scratch_dir(df.sparkSession, "paged")
    cut = df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id())
    cut.write.partitionBy("__range").parquet(path)
    rows = df.sparkSession.read.schema(cut.schema).parquet(path)
    counts = stage(rows.groupBy("__range").agg(F.count(F.lit(1)).alias("n")), "ranges")
    upto = F.sum("n").over(Window.orderBy("__range"))  # one row for each range
    return PagedList(rows, stage(counts.withColumn("before", upto - F.col("n")), "ranges"), order)


def page_of(listed: PagedList, number: int = 1, size: int = 20) -> DataFrame:
    """One page, with the size of the whole list in ``total``; only the ranges that hold its rows are read."""
    first = (positive("number", number) - 1) * positive("size", size)
    held = listed.ranges.filter((F.col("before") < first + size) & (F.col("before") + F.col("n") > first)).collect()
    total = listed.ranges.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    before = F.coalesce(*[F.when(F.col("__range") == r["__range"], F.lit(r["before"])) for r in held], F.lit(0))
    at = F.row_number().over(Window.partitionBy("__range").orderBy(*listed.order)) + before
    rows = listed.rows.filter(F.col("__range").isin([r["__range"] for r in held])).withColumn("__at", at)
    rows = rows.filter((F.col("__at") > first) & (F.col("__at") <= first + size)).orderBy("__at")
    return rows.drop("__at", "__range").withColumn("total", F.lit(total).cast("long"))


def page(df: DataFrame, order: list[Column], number: int = 1, size: int = 20) -> DataFrame:
    """One page of an ordered list, with the size of the whole list in ``total``."""
    return page_of(paged(df, order), number, size)


def page_after(df: DataFrame, keys: list[tuple[str, bool]], cursor: Sequence | None, size: int = 20) -> DataFrame:
    """The rows that follow a cursor, the key values of the last row seen (None: from the start).

    ``keys`` are (column, descending), together unique. Each partition gives its next ``size`` rows at most, however far the cursor is.
    """
    order = [F.desc(c) if down else F.asc(c) for c, down in keys]
    if cursor is not None:
        same, later = F.lit(True), F.lit(False)
        for (c, down), value in zip(keys, cursor, strict=True):
            column = F.col(c)
            if value is None:  # nulls come first, or last where the order goes down
                past = F.lit(False) if down else column.isNotNull()
            else:
                past = (column < F.lit(value)) | column.isNull() if down else column > F.lit(value)
            later, same = later | (same & F.coalesce(past, F.lit(False))), same & column.eqNullSafe(F.lit(value))
        df = df.filter(later)
    return df.orderBy(*order).limit(positive("size", size))
