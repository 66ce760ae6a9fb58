"""Task events and run logs in micro-batches: the batch operators, with a small stored record for each key.

Rows may come in any order and of any age: nothing stands before the state that would drop them. Each batch is judged with the records
as they were before it (``sinks.before_batch``), so a batch may run again. Rows of one key are never gathered: windows run over
(key, hour or day), so a hot entity or node is spread. Records live in buckets; those of keys that have been silent for a time
to live by the clock of the events go when their bucket is rewritten.

Layout under ``root``: a table of records and a table of results (by batch_id) for each of ``gate``, ``stuck``, ``streak``, and ``clock``,
the latest time seen, by batch_id.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marketebb.functions import times
from marketebb.operators import slices, tasks
from marketebb.session import stage
from marketebb.sources import sinks

BUCKETS = 16
GATE = "bucket int, ip_id long, event string, ts timestamp_ntz, seq long"
STUCK = "bucket int, task_id string, ip_id long, event string, ts timestamp_ntz, seq long, retry_count int, created_at timestamp_ntz, started_at timestamp_ntz, told boolean"
STREAK = "bucket int, node string, streak long, ts timestamp_ntz"


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def _clock(rows: DataFrame, root: str, batch_id: int):
    """The latest time of this and earlier batches; NULL without rows."""
    spark, path = rows.sparkSession, f"{root}/clock"
    sinks.write_batch(rows.agg(F.max("ts").alias("ts")), path, batch_id)
    return spark.read.parquet(path).filter(F.col("batch_id") <= batch_id).agg(F.max("ts").alias("ts")).first()["ts"]


def _records(rows: DataFrame, root: str, name: str, ddl: str, key: str, batch_id: int, every: bool = False) -> DataFrame:
    """Records before the batch, of the buckets that its rows touch or of all."""
    spark = rows.sparkSession
    stored = sinks.bucketed(spark, f"{root}/{name}", StructType.fromDDL(ddl), [key])
    if not every:
        stored = stored.filter(F.col("bucket").isin([r.b for r in rows.select(_bucket(key).alias("b")).distinct().collect()]))
    return sinks.before_batch(stored, batch_id).drop("changed_in")


def _keeper(clock, ttl: timedelta, batch_id: int, done: Column | None = None) -> Callable[[DataFrame], DataFrame]:
    """Drops records that have been silent for longer than the time to live."""
    limit = times.ntz(clock - ttl) if clock is not None else F.lit(None).cast("timestamp_ntz")
    open_ = F.lit(False) if done is None else ~done
    return lambda rows: rows.filter((F.col("changed_in") >= batch_id) | open_ | F.coalesce(F.col("ts") >= limit, F.lit(True)))


def gate(events: DataFrame, batch_id: int, root: str, ttl: timedelta = timedelta(days=7)) -> None:
    """Pushes with the verdict of the one-open-task rule (task_id, ip_id, ts, seq, accepted, late).

    ``late`` pushes are older than what their entity's record has judged; they get no verdict and change nothing.
    """
    rows = stage(events.filter(F.col("event").isin("pushed", "acked", "dead") & F.col("ip_id").isNotNull()).select("task_id", "ip_id", "event", "ts", "seq"), "gate")
    clock = _clock(rows, root, batch_id)
    known = _records(rows, root, "gate", GATE, "ip_id", batch_id).select("ip_id", F.lit("").alias("task_id"), "event", "ts", "seq", F.lit(True).alias("given"))
    last = known.select("ip_id", F.struct("ts", "seq").alias("__last"))
    late = F.coalesce(F.struct("ts", "seq") < F.col("__last"), F.lit(False))
    marked = stage(rows.join(last, "ip_id", "left").withColumn("late", late).drop("__last"), "gate-marked")
    fresh = marked.filter("NOT late").drop("late").withColumn("given", F.lit(False))
    chain = known.unionByName(fresh).withColumn("slice", F.col("ts").cast("date"))
    chain = slices.previous(chain, ["ip_id"], "slice", ["ts", "seq", "given"], {"before": "event"})
    judged = chain.filter("event = 'pushed' AND NOT given").select("task_id", "ip_id", "ts", "seq", (F.col("before").isNull() | (F.col("before") != "pushed")).alias("accepted"), F.lit(False).alias("late"))
    aside = marked.filter("late AND event = 'pushed'").select("task_id", "ip_id", "ts", "seq", F.lit(None).cast("boolean").alias("accepted"), "late")
    sinks.write_batch(judged.unionByName(aside), f"{root}/gate_results", batch_id)
    new = fresh.groupBy("ip_id").agg(F.max_by(F.struct("event", "ts", "seq"), F.struct("ts", "seq")).alias("e")).select(_bucket("ip_id").alias("bucket"), "ip_id", "e.*")
    sinks.upsert_buckets(new, f"{root}/gate", ["ip_id"], batch_id, _keeper(clock, ttl, batch_id))


def stuck(
    events: DataFrame, batch_id: int, root: str, timeout_s: int = 1800, max_retries: int = tasks.MAX_RETRIES,
    lateness: timedelta = timedelta(hours=2), ttl: timedelta = timedelta(days=7),
) -> None:
    """Tasks that started and did not end within the timeout by the clock of all events, each start once.

    Late events count: the record of a task is its latest event, whenever that comes.
    """
    rows = stage(events.filter(F.col("task_id").isNotNull()).select("task_id", "ip_id", "event", "ts", "seq", "retry_count"), "stuck")
    clock = _clock(rows, root, batch_id)
    if clock is None:
        return
    fields = ["ip_id", "event", "ts", "seq", "retry_count", "told"]
    known = _records(rows, root, "stuck", STUCK, "task_id", batch_id, every=True)
    seen = rows.select(
        "task_id", *fields[:-1], F.lit(False).alias("told"), F.when(F.col("event") == "pushed", F.col("ts")).alias("created_at"), F.when(F.col("event") == "started", F.col("ts")).alias("started_at")
    )
    touched = rows.select("task_id").distinct()
    open_ = F.col("event") == "started"
    both = known.join(touched, "task_id", "left_semi").drop("bucket").unionByName(seen)
    now = both.groupBy("task_id").agg(
        F.max_by(F.struct(*fields), F.struct("ts", "seq", "told")).alias("e"), F.min("created_at").alias("created_at"), F.max("started_at").alias("started_at")
    ).select("task_id", "e.*", "created_at", "started_at")
    silent = known.join(touched, "task_id", "left_anti").filter(open_ & ~F.col("told")).drop("bucket")
    age = times.micros(times.ntz(clock - lateness)) - times.micros(F.coalesce("started_at", "created_at"))
    now = now.unionByName(silent).withColumn("due", open_ & ~F.col("told") & (age > timeout_s * times.US_PER_SECOND))
    now = stage(now.join(touched.withColumn("__new", F.lit(True)), "task_id", "left").filter(F.col("due") | F.col("__new")), "stuck-now")
    retry = (F.col("retry_count") + 1).cast("int")
    told = now.filter("due").select("task_id", "ip_id", "ts", "seq", retry.alias("retry_count"), F.when(retry > max_retries, "dead").otherwise("retry").alias("outcome"))
    sinks.write_batch(told, f"{root}/stuck_results", batch_id)
    new = now.withColumn("told", F.col("told") | F.col("due")).withColumn("bucket", _bucket("task_id"))
    sinks.upsert_buckets(new.select(StructType.fromDDL(STUCK).fieldNames()), f"{root}/stuck", ["task_id"], batch_id, _keeper(clock, ttl, batch_id, ~open_ | F.col("told")))


def streak(log: DataFrame, batch_id: int, root: str, threshold: int = tasks.BLOCK_STREAK, pause_s: int = tasks.STREAK_TTL_S, ttl: timedelta = timedelta(days=1)) -> None:
    """Blocked runs with the node's count of blocks since its last success or long pause (node, task_id, ts, streak, cooldown, late).

    ``late`` runs are older than what the node's record counts; they get no streak and change nothing. A record that a pause has
    ended says nothing any more and goes.
    """
    counts = F.col("outcome").isin("success", "empty_result", "403_forbidden")
    rows = stage(log.filter(counts & F.col("node").isNotNull()).select("node", "task_id", "outcome", "ts"), "streak")
    clock = _clock(rows, root, batch_id)
    known = _records(rows, root, "streak", STREAK, "node", batch_id)
    late = F.coalesce(F.col("ts") < F.col("__last"), F.lit(False))
    marked = stage(rows.join(known.select("node", F.col("ts").alias("__last")), "node", "left").withColumn("late", late).drop("__last"), "streak-marked")
    fresh = marked.filter("NOT late").drop("late")
    counted = stage(tasks.block_streaks(fresh, threshold, pause_s, before=known.drop("bucket")), "streak-counted")
    aside = marked.filter("late AND outcome = '403_forbidden'").select("node", "task_id", "ts", F.lit(None).cast("long").alias("streak"), F.lit(None).cast("boolean").alias("cooldown"), F.lit(True).alias("late"))
    sinks.write_batch(counted.withColumn("late", F.lit(False)).unionByName(aside), f"{root}/streak_results", batch_id)
    last = fresh.groupBy("node").agg(F.max(F.struct("ts", "task_id", "outcome")).alias("e"))
    ends = counted.select(F.col("node").alias("__node"), F.col("task_id").alias("__task"), F.col("ts").alias("__ts"), "streak")
    new = last.join(ends, (F.col("node") == F.col("__node")) & (F.col("e.task_id") == F.col("__task")) & (F.col("e.ts") == F.col("__ts")), "left")
    blocked = F.col("e.outcome") == "403_forbidden"
    new = new.select(_bucket("node").alias("bucket"), "node", F.when(blocked, F.col("streak")).otherwise(0).cast("long").alias("streak"), F.col("e.ts").alias("ts"))
    sinks.upsert_buckets(new, f"{root}/streak", ["node"], batch_id, _keeper(clock, ttl, batch_id))


def start(rows: DataFrame, step: Callable[..., None], root: str, checkpoint: str, **options):
    """Run one of the steps over a stream of rows; returns the query."""
    return (
        rows.writeStream.foreachBatch(lambda batch, batch_id: step(stage(batch, "lot"), batch_id, root, **options))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def results(spark: SparkSession, root: str, name: str) -> DataFrame:
    """All results of ``gate``, ``stuck`` or ``streak`` so far."""
    return spark.read.parquet(f"{root}/{name}_results")
