"""The whole write path as one streaming query over the batch operators.

Each micro-batch runs the same operators as a batch job, with the stored listing state as starting
point. A micro-batch that is run again after a failure starts from the same state and writes the same again.

Layout under ``root``; tables in capitals have the schema of :mod:`marketebb.schemas` and are read with ``readers.table``:

====================  ===========================================================================
messages              every message by batch_id, with its fate: taken, failed or repeat
tasks                 tasks taken, by day and batch_id
observations          sightings of taken messages by batch_id
late                  those that change nothing, by batch_id: ``late`` or ``ahead`` of the clock
state                 live listings in buckets of (entity, listing); a batch rewrites those it touches
crawls                one row per crawl: flow, first-crawl flag, price statistics, by day and batch
IP_STATS_HOURLY       hour rows, by day; rebuilt for the days a batch touches
IP_ALERTS             alerts by batch_id
ITEM_SNAPSHOTS        current snapshots, in the buckets of the state
SCHEDULE              (ip_id, weight, next_at) in buckets of entities
====================  ===========================================================================

Assumes that one message carries one whole crawl.
"""

from __future__ import annotations

from datetime import datetime, timedelta
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marketebb import schemas
from marketebb.functions import times
from marketebb.operators import alerts as alert_rules
from marketebb.operators import hourly, schedule, transitions, weights
from marketebb.operators.snapshots import snapshot_delta, upsert_snapshots
from marketebb.operators.transitions import LISTING
from marketebb.session import stage
from marketebb.sources import readers, sinks

STATE_DDL = (
    "bucket int, ip_id long, source_id string, status string, price int, first_seen timestamp_ntz, "
    "last_seen timestamp_ntz, expires_at timestamp_ntz"
)
SCHEDULE_DDL = "bucket int, ip_id long, weight double, next_at timestamp_ntz"


class Layout(NamedTuple):
    """Buckets of the keyed tables: groups of entities, and parts of each group by listing. It must stay as it is for a root."""

    groups: int = 16
    parts: int = 4

    def group(self) -> Column:
        return F.pmod(F.xxhash64("ip_id"), F.lit(self.groups)).cast("int")

    def listing(self) -> Column:
        return (self.group() * self.parts + F.pmod(F.xxhash64("source_id"), F.lit(self.parts))).cast("int")

    def buckets(self, groups: list[int]) -> list[int]:
        return [g * self.parts + k for g in groups for k in range(self.parts)]


def _stored(spark: SparkSession, root: str, table: str, ddl: str, keys: list[str], batch_id: int, buckets: list[int]) -> DataFrame:
    """Rows of these buckets as they were before a batch."""
    rows = sinks.bucketed(spark, f"{root}/{table}", StructType.fromDDL(ddl), keys).filter(F.col("bucket").isin(buckets))
    return sinks.before_batch(rows, batch_id).drop("changed_in")


def _batch(spark: SparkSession, root: str, table: str, batch_id: int) -> DataFrame | None:
    path = f"{root}/{table}/batch_id={batch_id}"
    return spark.read.parquet(path) if sinks.exists(spark, path) else None


def process(
    observations: DataFrame,
    crawls: DataFrame | None,
    batch_id: int,
    root: str,
    entities: DataFrame | None = None,
    lateness: timedelta = timedelta(hours=2),
    rules: weights.WeightRules = weights.WeightRules(),
    sold_at: str = "first_insert",
    now: datetime | None = None,
    ahead: timedelta = timedelta(hours=1),
    layout: Layout = Layout(),
) -> None:
    """Run one micro-batch. ``crawls`` (ip_id, crawl_ts) also names crawls that saw nothing.

    With ``now``, what claims to be later than ``now + ahead`` is set aside, so that one wrong time does not make all later
    rows of its entity late.
    """
    spark = observations.sparkSession
    sinks.write_batch(observations, f"{root}/observations", batch_id)
    seen = _batch(spark, root, "observations", batch_id) or spark.createDataFrame([], observations.schema)
    named = seen.select("ip_id") if crawls is None else seen.select("ip_id").unionByName(crawls.select("ip_id"))
    named = named.distinct()
    groups = [r.g for r in named.select(layout.group().alias("g")).distinct().collect()]  # layout.groups at most
    state = _stored(spark, root, "state", STATE_DDL, LISTING, batch_id, layout.buckets(groups)).join(named, "ip_id", "left_semi")

    # each entity has its own clock: one that runs ahead or is replayed makes no other entity late
    horizon = stage(state.groupBy("ip_id").agg((F.max("last_seen") - F.lit(lateness)).alias("horizon")), "horizon")
    fits = F.lit(True) if now is None else F.col("crawl_ts") <= times.ntz(now + ahead)
    old = F.coalesce(F.col("crawl_ts") < F.col("horizon"), F.lit(False))
    checked = seen.join(state.select(*LISTING, "last_seen"), LISTING, "left").join(horizon, "ip_id", "left")
    reason = F.when(~fits, "ahead").when(F.coalesce(F.col("crawl_ts") <= F.col("last_seen"), F.lit(False)) | old, "late")
    checked = stage(checked.select(*seen.columns, reason.alias("reason")), "checked")
    sinks.write_batch(checked.filter("reason IS NOT NULL"), f"{root}/late", batch_id)
    fresh = checked.filter("reason IS NULL").drop("reason")
    if crawls is not None:
        crawls = crawls.join(horizon, "ip_id", "left").filter(fits & ~old).select("ip_id", "crawl_ts")

    again = fresh.filter(F.length("source_id") > 0).select(*LISTING).distinct()
    moved = stage(transitions.transitions(fresh, state.join(again, LISTING, "left_semi")), "transitions")
    # listings of these entities that the batch does not see: what they tell is until when the entity was alive
    silent = state.join(again, LISTING, "left_anti").groupBy("ip_id", F.col("last_seen").alias("crawl_ts"))
    silent = silent.agg((times.micros(F.max("expires_at")) - 1).alias("live_until")).select(
        "*", F.lit(0).cast("long").alias("copies"), F.lit(None).cast("string").alias("kind"), F.lit(True).alias("given")
    )
    flow = transitions.crawl_flow(moved.select(*silent.columns).unionByName(silent), crawls)
    stats = stage(hourly.crawl_stats(flow, hourly.sold_sample(moved)), "crawls")

    clock = moved.filter("NOT given").groupBy("ip_id").agg((F.max("crawl_ts") - F.lit(lateness)).alias("__clock"))

    def living(rows: DataFrame) -> DataFrame:
        gone = (F.col("changed_in") < batch_id) & F.coalesce(F.col("expires_at") <= F.col("__clock"), F.lit(False))
        return rows.join(clock, "ip_id", "left").filter(~gone).drop("__clock")

    live = transitions.state_table(moved).withColumn("bucket", layout.listing())
    sinks.upsert_buckets(live.select(StructType.fromDDL(STATE_DDL).fieldNames()), f"{root}/state", LISTING, batch_id, living)

    by_day = stats.withColumn("day", F.col("crawl_ts").cast("date"))
    sinks.overwrite_partitions(by_day.withColumn("batch_id", F.lit(batch_id).cast("long")), f"{root}/crawls", ["day", "batch_id"])
    sinks.write_batch(sinks.conform(alert_rules.alerts(stats), schemas.ALERTS), f"{root}/ip_alerts", batch_id)
    _merge_snapshots(snapshot_delta(fresh, sold_at).withColumn("bucket", layout.listing()), f"{root}/item_snapshots", sold_at)

    if sinks.exists(spark, f"{root}/crawls"):
        stored = sinks.touched(spark.read.schema(by_day.schema).parquet(f"{root}/crawls"), by_day, ["day"])
        sinks.replace_buckets(sinks.conform(hourly.hours_from_crawls(stored), schemas.HOURS), f"{root}/ip_stats_hourly", "hour_bucket")

    if entities is not None:
        known = _stored(spark, root, "schedule", SCHEDULE_DDL, ["ip_id"], batch_id, groups)
        sinks.upsert_buckets(_new_schedule(stats, known, entities, rules, layout), f"{root}/schedule", ["ip_id"], batch_id)


def _merge_snapshots(delta: DataFrame, path: str, sold_at: str) -> None:
    """Merge snapshots into the buckets they touch; merging the same ones again changes nothing."""
    spark, ddl = delta.sparkSession, f"{schemas.SNAPSHOTS}, bucket int"
    if not sinks.exists(spark, path):
        sinks.overwrite_partitions(sinks.conform(delta, ddl).repartition("bucket"), path, ["bucket"])
        return
    delta = stage(delta, "snapshots")
    buckets = [r.bucket for r in delta.select("bucket").distinct().collect()]  # as many as the layout has, at most
    if not buckets:
        return
    new = sinks.conform(delta, ddl)
    old = spark.read.schema(new.schema).parquet(path).filter(F.col("bucket").isin(buckets))
    new = stage(upsert_snapshots(old, new, sold_at), "snapshots")
    sinks.overwrite_partitions(new.repartition("bucket"), path, ["bucket"])


def _new_schedule(stats: DataFrame, known: DataFrame, entities: DataFrame, rules: weights.WeightRules, layout: Layout) -> DataFrame:
    """Weights and times of the entities that the batch has crawled, from the stored weight or else that of the entity."""
    current = entities.select("id", F.col("weight").cast("double").alias("weight"))
    current = current.join(known.select(F.col("ip_id").alias("id"), F.col("weight").alias("stored")), "id", "left")
    steps = weights.adjust_over_time(stats, current.select("id", F.coalesce("stored", "weight").alias("weight")), rules)
    last = steps.groupBy("ip_id").agg(F.max_by(F.struct("crawl_ts", "new_weight"), "crawl_ts").alias("s")).select("ip_id", "s.*")
    timed = schedule.next_times(last, rules.base * 60, rules.low * 60, rules.high * 60).drop("crawl_ts")
    moved = last.select("ip_id", F.col("new_weight").alias("weight")).join(timed, "ip_id")
    return moved.select(layout.group().alias("bucket"), "ip_id", "weight", "next_at")


def judged(results: DataFrame, root: str, batch_id: int, window: timedelta = timedelta(hours=24)) -> DataFrame:
    """The messages of a batch with their fate: ``repeat`` if the task was taken before, else ``failed`` or ``taken``.

    A task is taken by its first message; others of it within the window are repeats. A message without a task is no repeat. Taken tasks are a table by day
    and batch, of which only the days around the batch are read. Messages of any age are judged. Run again, a batch finds its own tasks
    untaken. Every message is in ``messages`` once.
    """
    spark, path = results.sparkSession, f"{root}/tasks"
    whole = stage(results.withColumn("__id", F.monotonically_increasing_id()), "results")
    # messages are judged on rows without their items; these meet their fates by id at the end
    content = F.xxhash64("error_message", F.to_json("items")).alias("__content")
    rows = stage(whole.select("__id", "task_id", "ip_id", "crawl_ts", "error_message", content), "headers")
    order = F.struct("crawl_ts", "ip_id", "__content", "__id")
    first = rows.filter("task_id <> ''").groupBy("task_id").agg(F.min_by("__id", order).alias("__first")).select("__first")
    rows = rows.join(first, F.col("__id") == F.col("__first"), "left")
    rows = rows.withColumn("__again", F.col("__first").isNull() & (F.col("task_id") != "")).drop("__first").withColumn("__taken", F.lit(False))
    if sinks.exists(spark, path):
        low, high = rows.agg(F.min("crawl_ts") - F.lit(window), F.max("crawl_ts") + F.lit(window)).first()
        if low is not None:
            taken = spark.read.schema("task_id string, taken_at timestamp_ntz, day date, batch_id long").parquet(path)
            taken = taken.filter(F.col("day").between(low.date(), high.date()) & (F.col("batch_id") < batch_id))
            taken = taken.filter("task_id <> ''").select(F.col("task_id").alias("__task"), "taken_at")
            same = (F.col("task_id") == F.col("__task")) & F.col("crawl_ts").between(F.col("taken_at") - F.lit(window), F.col("taken_at") + F.lit(window))
            hit = rows.join(taken, same, "left_semi").withColumn("__taken", F.lit(True))
            rows = rows.join(taken, same, "left_anti").unionByName(hit)
    failed = ~F.col("error_message").isin("", "no_items")
    fate = F.when(F.col("__taken") | F.col("__again"), "repeat").when(failed, "failed").otherwise("taken")
    fates = stage(rows.select("__id", "task_id", "ip_id", "crawl_ts", fate.alias("fate")), "fates")
    sinks.write_batch(fates.drop("__id"), f"{root}/messages", batch_id)
    marks = fates.filter("fate <> 'repeat'").select("task_id", F.col("crawl_ts").alias("taken_at"), F.col("crawl_ts").cast("date").alias("day"))
    sinks.overwrite_partitions(marks.withColumn("batch_id", F.lit(batch_id).cast("long")), path, ["day", "batch_id"])
    return whole.join(fates.select("__id", "fate"), "__id").drop("__id")


def start(results: DataFrame, root: str, checkpoint: str, entities: DataFrame | None = None, now: datetime | None = None, **options):
    """Start the stream over result messages (as from ``readers.crawl_results``); returns the query.

    Messages from after ``now`` (the market's present time by default, asked in each batch) are set aside.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        held = judged(batch, root, batch_id).filter("fate = 'taken'").drop("fate")
        clock = now or batch.sparkSession.sql(f"SELECT convert_timezone('{times.MARKET_ZONE}', localtimestamp()) AS t").first()["t"]
        process(readers.observations(held), held.select("ip_id", "crawl_ts"), batch_id, root, entities, now=clock, **options)

    return (
        results.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def start_on_observations(observations: DataFrame, root: str, checkpoint: str, **options):
    """Start the stream over plain observations; returns the query."""
    return (
        observations.writeStream.foreachBatch(lambda batch, batch_id: process(batch, None, batch_id, root, **options))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def state(spark: SparkSession, root: str) -> DataFrame:
    """The listings remembered after the last batch."""
    rows = sinks.bucketed(spark, f"{root}/state", StructType.fromDDL(STATE_DDL), LISTING)
    return rows.drop("bucket", "changed_in", "before")


def hours(spark: SparkSession, root: str) -> DataFrame:
    return readers.table(spark, root, "ip_stats_hourly")


def snapshots(spark: SparkSession, root: str) -> DataFrame:
    return readers.table(spark, root, "item_snapshots")
