"""Queries of the message path: lots of messages, late, repeated, failed and misdated ones among them, run through the stream one after the other."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketebb.plans import oracle as o
from marketebb.plans.market import ALERTS
from marketebb.plans.registry import query, rounded
from marketebb.session import scratch_dir, stage
from marketebb.sources import driver, readers
from marketebb.streaming import flow, task_flow

NOW = datetime(2024, 1, 31)

#: Messages as they arrive, and the sightings of those taken; ``obs`` are the ones that are neither late nor ahead.
MESSAGES = """
crawled AS (SELECT ip_id, crawl_ts AS t, CAST(epoch(crawl_ts) AS BIGINT) AS s, CAST(epoch(crawl_ts) AS BIGINT) // 21600 + ip_id AS n FROM busy GROUP BY ip_id, crawl_ts),
message AS (
  SELECT ip_id, t, 't-' || ip_id || '-' || s AS task_id, t + CASE WHEN (n + ip_id) % 97 = 7 THEN INTERVAL 40 DAY ELSE INTERVAL 0 DAY END AS told, n % 13 = 5 AS failed,
         n % 5 = 0 AS twice, CAST(least((extract(day FROM t) - 1) // 8 + CASE WHEN n % 11 = 3 THEN 1 ELSE 0 END, 3) AS INTEGER) AS lot FROM crawled),
rows_ AS (SELECT b.ip_id, b.source_id, b.status, b.price, m.told AS crawl_ts, b.pos, m.lot FROM busy b JOIN message m ON m.ip_id = b.ip_id AND m.t = b.crawl_ts WHERE NOT m.failed),
fit AS (SELECT * FROM rows_ WHERE crawl_ts <= TIMESTAMP '2024-01-31 01:00:00'),
clock AS (SELECT a.ip_id, l.lot, max(a.crawl_ts) AS high FROM fit a JOIN (SELECT DISTINCT lot FROM fit) l ON a.lot < l.lot GROUP BY a.ip_id, l.lot),
known AS (SELECT a.ip_id, a.source_id, l.lot, max(a.crawl_ts) AS last_seen FROM fit a JOIN (SELECT DISTINCT lot FROM fit) l ON a.lot < l.lot GROUP BY a.ip_id, a.source_id, l.lot),
fate AS (
  SELECT r.*, CASE WHEN r.crawl_ts > TIMESTAMP '2024-01-31 01:00:00' THEN 'ahead'
                   WHEN r.crawl_ts <= k.last_seen OR r.crawl_ts < c.high - INTERVAL 2 HOUR THEN 'late' END AS reason
  FROM rows_ r LEFT JOIN known k ON k.ip_id = r.ip_id AND k.source_id = r.source_id AND k.lot = r.lot LEFT JOIN clock c ON c.ip_id = r.ip_id AND c.lot = r.lot),
obs AS (SELECT ip_id, source_id, status, price, crawl_ts, pos FROM fate WHERE reason IS NULL)"""
PARTS = (o.busy(360).replace("obs AS", "busy AS", 1), MESSAGES)

_REPLAYS: dict[tuple[str, str], str] = {}


def replay(spark: SparkSession, sf: str) -> str:
    """Folder of the tables after all lots have gone through the stream, one start of it for each; one replay serves a session."""
    key = spark.sparkContext.applicationId, sf
    if key not in _REPLAYS:
        messages, root, checkpoint = scratch_dir(spark, "messages"), scratch_dir(spark, "message-flow"), scratch_dir(spark, "message-checkpoint")
        rows = stage(driver.crawl_messages(spark, sf), "sent")
        for lot in range(4):
            rows.filter(F.col("arrival") == lot).select("value").write.mode("append").text(messages)
            results = readers.crawl_results(spark, messages, streaming=True, zone="UTC")
            flow.start(results, root, checkpoint, now=NOW).awaitTermination()
        _REPLAYS[key] = root
    return _REPLAYS[key]


@query(
    o.select(
        """SELECT ip_id, task_id, told AS crawl_ts, CASE WHEN failed THEN 'failed' ELSE 'taken' END AS fate, CAST(1 AS BIGINT) AS messages FROM message
           UNION ALL
           SELECT ip_id, task_id, told, 'repeat', 1 FROM message WHERE twice AND lot < 3""",
        *PARTS,
    )
)
def stream_task_dedup(spark, sf):
    """The fate of every message: each task is taken once."""
    judged = spark.read.parquet(f"{replay(spark, sf)}/messages")
    return judged.groupBy("ip_id", "task_id", "crawl_ts", "fate").agg(F.count(F.lit(1)).alias("messages"))


@query(
    o.select(
        """SELECT ip_id, source_id, crawl_ts, status, price, coalesce(reason, 'used') AS reason, count(*) AS sightings FROM fate
           GROUP BY ip_id, source_id, crawl_ts, status, price, reason""",
        *PARTS,
    )
)
def stream_late_rows(spark, sf):
    """Every sighting of a taken message, in exactly one of: used, late, ahead of the clock."""
    root = replay(spark, sf)
    columns = ["ip_id", "source_id", "crawl_ts", "status", "price"]
    aside = spark.read.parquet(f"{root}/late").groupBy(*columns, "reason").agg(F.count(F.lit(1)).alias("sightings"))
    every = spark.read.parquet(f"{root}/observations").groupBy(*columns, "batch_id").agg(F.count(F.lit(1)).alias("n"))
    out = spark.read.parquet(f"{root}/late").groupBy(*columns, "batch_id").agg(F.count(F.lit(1)).alias("m"))
    used = every.join(out, [*columns, "batch_id"], "left").withColumn("left", F.col("n") - F.coalesce("m", F.lit(0)))
    used = used.groupBy(*columns).agg(F.sum("left").alias("sightings")).filter("sightings > 0")
    return used.withColumn("reason", F.lit("used")).unionByName(aside)


@query(o.select("SELECT ip_id, source_id, price, status, first_seen_at, last_seen_at, sold_at, price_changed FROM snap", *PARTS, o.SNAP))
def stream_snapshots(spark, sf):
    """Item snapshots after all lots, through the table contract."""
    rows = readers.table(spark, replay(spark, sf), "item_snapshots")
    return rows.select("ip_id", "source_id", "price", "status", "first_seen_at", "last_seen_at", "sold_at", "price_changed")


@query(
    o.select(
        """SELECT ip_id, alert_type, severity, message, round(metric_value, 4) AS metric_value, CAST(threshold_value AS DOUBLE) AS threshold_value,
                  date_trunc('hour', crawl_ts) AS hour_bucket, crawl_ts AS created_at FROM alerts""",
        *PARTS,
        o.TRANS,
        o.FLOW.replace("known", "alive_before"),
        ALERTS.replace("outflow, 5)", "outflow, 50)").replace("5.0 AS threshold_value", "50.0 AS threshold_value").replace("outflow >= 5", "outflow >= 50"),
    )
)
def stream_alerts(spark, sf):
    """Alerts of all lots, through the table contract."""
    rows = readers.table(spark, replay(spark, sf), "ip_alerts").drop("acknowledged", "acknowledged_at")
    rows = rows.withColumn("metric_value", F.col("metric_value").cast("double")).withColumn("threshold_value", F.col("threshold_value").cast("double"))
    return rounded(rows, "metric_value", digits=4)


@query(
    o.select(
        """SELECT ip_id, hour_bucket, inflow, outflow, round(liquidity_index, 4) AS liquidity_index FROM hours""",
        *PARTS,
        o.TRANS,
        o.FLOW.replace("known", "alive_before"),
        o.HOURS,
    )
)
def stream_message_hours(spark, sf):
    """Hour rows of all lots, through the table contract; hours of crawls whose sightings were all late are left out."""
    rows: DataFrame = readers.table(spark, replay(spark, sf), "ip_stats_hourly")
    return rows.select("ip_id", "hour_bucket", "inflow", "outflow", F.col("liquidity_index").cast("double").alias("liquidity_index"))


# Task events and run logs in four lots, every tenth event a lot late.

LOT = "CAST(least((extract(day FROM ts) - 1) // 8 + CASE WHEN event_id % 10 = 3 THEN 1 ELSE 0 END, 3) AS INTEGER)"
GATE = f"""
ends AS (SELECT *, {LOT.replace("event_id", "seq")} AS lot FROM tasks WHERE event IN ('pushed', 'acked', 'dead')),
judged AS (SELECT e.*, coalesce((SELECT max({{'ts': x.ts, 'seq': x.seq}}) FROM ends x WHERE x.ip_id = e.ip_id AND x.lot < e.lot) > {{'ts': e.ts, 'seq': e.seq}}, false) AS late FROM ends e),
chained AS (SELECT *, lag(event) OVER (PARTITION BY ip_id ORDER BY ts, seq) AS before FROM judged WHERE NOT late)"""
STUCK = f"""
lots AS (SELECT *, {LOT.replace("event_id", "seq")} AS lot FROM tasks),
upto AS (SELECT DISTINCT lot AS k, (SELECT max(ts) FROM lots y WHERE y.lot <= x.lot) - INTERVAL 2 HOUR AS clock FROM lots x),
latest AS (
  SELECT k, clock, task_id, arg_max(ip_id, {{'ts': ts, 'seq': seq}}) AS ip_id, arg_max(event, {{'ts': ts, 'seq': seq}}) AS event, max({{'ts': ts, 'seq': seq}}) AS last, arg_max(retry_count, {{'ts': ts, 'seq': seq}}) AS retry_count,
         max(ts) FILTER (WHERE event = 'started') AS started_at
  FROM upto JOIN lots ON lots.lot <= k GROUP BY k, clock, task_id),
due AS (SELECT task_id, last, any_value(ip_id) AS ip_id, any_value(retry_count) AS retry_count, min(k) AS k FROM latest
        WHERE event = 'started' AND started_at + INTERVAL 30 MINUTE < clock GROUP BY task_id, last)"""
STREAK = f"""
logged AS (SELECT CASE WHEN event_id % 3 = 0 THEN 'hot' ELSE node END AS node, task_id, ts, outcome, {LOT.replace("event_id", "task_id")} AS lot
           FROM (SELECT *, task_id AS event_id FROM runs) WHERE outcome IN ('success', 'empty_result', '403_forbidden')),
judged AS (SELECT e.*, coalesce((SELECT max(x.ts) FROM logged x WHERE x.node = e.node AND x.lot < e.lot) > e.ts, false) AS late FROM logged e),
gaps AS (SELECT *, CASE WHEN outcome <> '403_forbidden' OR ts - lag(ts) OVER (PARTITION BY node ORDER BY ts, task_id) > INTERVAL 600 SECOND THEN 1 ELSE 0 END AS restart
         FROM judged WHERE NOT late),
parts AS (SELECT *, sum(restart) OVER (PARTITION BY node ORDER BY ts, task_id) AS part FROM gaps),
counted AS (SELECT *, sum(CASE WHEN outcome = '403_forbidden' THEN 1 ELSE 0 END) OVER (PARTITION BY node, part ORDER BY ts, task_id) AS streak FROM parts)"""


def _in_lots(spark: SparkSession, rows: DataFrame, number: str, name: str, step: Callable[..., None]) -> DataFrame:
    """Results of a step after four lots, one start of the stream for each. The lots are further apart than records usually live."""
    folder, root, checkpoint = (scratch_dir(spark, f"{name}-{part}") for part in ("in", "root", "checkpoint"))
    lot = F.least(F.floor((F.dayofmonth("ts") - 1) / 8) + (F.col(number) % 10 == 3).cast("int"), F.lit(3))
    for k in range(4):
        rows.filter(lot == k).write.mode("append").parquet(folder)
        task_flow.start(spark.readStream.schema(rows.schema).parquet(folder), step, root, checkpoint, ttl=timedelta(days=60)).awaitTermination()
    return task_flow.results(spark, root, name)


@query(
    o.select(
        """SELECT task_id, ip_id, ts, seq, before IS NULL OR before <> 'pushed' AS accepted, late FROM chained WHERE event = 'pushed'
           UNION ALL SELECT task_id, ip_id, ts, seq, NULL, late FROM judged WHERE late AND event = 'pushed'""",
        o.TASKS,
        GATE,
    )
)
def stream_gate_lots(spark, sf):
    """The one-open-task rule over lots that overlap: late pushes come out marked."""
    return _in_lots(spark, driver.task_events(spark, sf), "seq", "gate", task_flow.gate).drop("batch_id")


@query(
    o.select(
        """SELECT task_id, ip_id, last.ts AS ts, last.seq AS seq, CAST(retry_count + 1 AS INTEGER) AS retry_count,
                  CASE WHEN retry_count + 1 > 3 THEN 'dead' ELSE 'retry' END AS outcome FROM due""",
        o.TASKS,
        STUCK,
    )
)
def stream_stuck_tasks(spark, sf):
    """Tasks that did not end in time, told once for each start, over lots that overlap."""
    return _in_lots(spark, driver.task_events(spark, sf), "seq", "stuck", task_flow.stuck).drop("batch_id")


@query(
    o.select(
        """SELECT node, task_id, ts, CAST(streak AS BIGINT) AS streak, streak = 3 AS cooldown, late FROM counted WHERE outcome = '403_forbidden'
           UNION ALL SELECT node, task_id, ts, NULL, NULL, late FROM judged WHERE late AND outcome = '403_forbidden'""",
        o.RUNS,
        STREAK,
    )
)
def stream_streak_lots(spark, sf):
    """Block streaks over lots that overlap, a third of all runs being of one node."""
    log = driver.run_log(spark, sf).withColumn("node", F.when(F.col("task_id") % 3 == 0, "hot").otherwise(F.col("node")))
    return _in_lots(spark, log, "task_id", "streak", task_flow.streak).drop("batch_id")
