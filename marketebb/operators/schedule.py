"""Observation schedule as a table (ip_id, next_at); times are kept to the second."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketebb.functions import times
from marketebb.functions.measures import interval_us
from marketebb.operators.slices import global_rank

BASE_S, MIN_S, MAX_S = 7200, 3600, 7200
STAGGER_S = 10
SLOT_MINUTES = 15


def active(entities: DataFrame) -> DataFrame:
    return entities.filter(F.col("status") == "active")


def initial(
    entities: DataFrame, now: datetime, base: int = BASE_S, low: int = MIN_S, high: int = MAX_S
) -> DataFrame:
    """First schedule: last observation plus interval, or staggered from ``now``.

    Entities never observed or already due start at now + 10 s x position among the active ones.
    """
    placed = global_rank(active(entities), [F.col("id")])
    regular = times.plus_micros(F.col("last_crawled_at"), interval_us(F.col("weight"), base, low, high))
    staggered = times.plus_seconds(times.ntz(now), (F.col("position") - 1) * STAGGER_S)
    return placed.select(
        F.col("id").alias("ip_id"),
        times.seconds_floor(F.when(regular >= times.ntz(now), regular).otherwise(staggered)).alias("next_at"),
    )


def next_times(
    crawled: DataFrame, base: int = BASE_S, low: int = MIN_S, high: int = MAX_S, slot_minutes: int = SLOT_MINUTES
) -> DataFrame:
    """Next time after an observation: interval of the new weight, aligned up to a slot.

    Input: ip_id, crawl_ts, new_weight.
    """
    raw = times.plus_micros(F.col("crawl_ts"), interval_us(F.col("new_weight"), base, low, high))
    aligned = times.seconds_floor(times.align_up(raw, slot_minutes))
    return crawled.select("ip_id", "crawl_ts", aligned.alias("next_at"))


def due(schedule: DataFrame, now: datetime) -> DataFrame:
    """Entities whose time has come, in order of time."""
    return schedule.filter(F.col("next_at") <= times.ntz(now)).orderBy("next_at", "ip_id")


def due_batches(schedule: DataFrame, now: datetime, size: int = 50) -> DataFrame:
    """Due entities numbered into batches of ``size`` (10 if not positive), earliest first."""
    size = size if size > 0 else 10
    waiting = schedule.filter(F.col("next_at") <= times.ntz(now))
    ranked = global_rank(waiting, [F.col("next_at"), F.col("ip_id")])
    return ranked.withColumn("batch", F.ceil(F.col("position") / size).cast("long"))


def split_due(due_rows: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(due entities that exist and are active, due entities to take off the schedule)."""
    ids = active(entities).select(F.col("id").alias("ip_id"))
    return due_rows.join(ids, "ip_id", "left_semi"), due_rows.join(ids, "ip_id", "left_anti")


def to_add(schedule: DataFrame, entities: DataFrame, now: datetime) -> DataFrame:
    """Active entities without a time: scheduled at ``now``."""
    ids = active(entities).select(F.col("id").alias("ip_id"))
    return ids.join(schedule.select("ip_id"), "ip_id", "left_anti").withColumn("next_at", times.ntz(now))


def to_drop(schedule: DataFrame, entities: DataFrame) -> DataFrame:
    """Scheduled entities that are no longer active."""
    return schedule.join(active(entities).select(F.col("id").alias("ip_id")), "ip_id", "left_anti")


def refresh(schedule: DataFrame, entities: DataFrame, now: datetime) -> DataFrame:
    """Schedule after adding new and dropping inactive entities; other times stay."""
    ids = active(entities).select(F.col("id").alias("ip_id"))
    return ids.join(schedule, "ip_id", "left").select(
        "ip_id", F.coalesce("next_at", times.ntz(now)).alias("next_at")
    )


def apply_changes(
    schedule: DataFrame, changes: DataFrame, now: datetime, base: int = BASE_S, low: int = MIN_S, high: int = MAX_S
) -> DataFrame:
    """Apply a change set (ip_id, action, weight), at most one change per entity.

    ``reweight`` schedules ``now`` + interval of the new weight, ``add`` and ``trigger`` schedule
    ``now``, ``remove`` takes the entity off.
    """
    joined = schedule.join(changes, "ip_id", "full")
    later = times.plus_micros(times.ntz(now), interval_us(F.col("weight"), base, low, high))
    return (
        joined.filter(F.coalesce(F.col("action"), F.lit("")) != "remove")
        .withColumn(
            "next_at",
            F.when(F.col("action") == "reweight", times.seconds_floor(later))
            .when(F.col("action").isin("add", "trigger"), times.ntz(now))
            .otherwise(F.col("next_at")),
        )
        .select("ip_id", "next_at")
    )


def status(schedule: DataFrame, entities: DataFrame, now: datetime) -> DataFrame:
    """Seconds until each time (negative when overdue), with names."""
    wait = (times.micros(F.col("next_at")) - times.micros(times.ntz(now))) / times.US_PER_SECOND
    names = entities.select(F.col("id").alias("ip_id"), F.col("name").alias("ip_name"))
    return (
        schedule.join(names, "ip_id", "left")
        .fillna("", ["ip_name"])
        .select("ip_id", "ip_name", "next_at", wait.alias("time_until_s"), (wait < 0).alias("is_overdue"))
    )


def stats(schedule: DataFrame, now: datetime) -> DataFrame:
    """Total, overdue, and seconds to the next time (0 when none lies ahead, at most 24 h)."""
    wait = (times.micros(F.col("next_at")) - times.micros(times.ntz(now))) / times.US_PER_SECOND
    ahead = F.min(F.when(wait >= 0, F.least(wait, F.lit(86_400.0))))
    return schedule.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(wait < 0).alias("overdue"),
        F.coalesce(ahead, F.lit(0.0)).alias("next_in_s"),
    )


def earliest(schedule: DataFrame) -> DataFrame:
    return schedule.agg(F.min("next_at").alias("next_at"))


def write_times(schedule: DataFrame, new_times: DataFrame) -> DataFrame:
    """Schedule after setting the given times (one or many); of several the last crawl's wins."""
    order = "crawl_ts" if "crawl_ts" in new_times.columns else "next_at"
    latest = new_times.groupBy("ip_id").agg(F.max_by("next_at", order).alias("__new"))
    return schedule.join(latest, "ip_id", "full").select("ip_id", F.coalesce("__new", "next_at").alias("next_at"))
