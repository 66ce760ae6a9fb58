"""Rules of the operations manual and of the interval adjustment that earlier forms got wrong."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from marketebb.operators import schedule, slices, tasks, weights
from tests.conftest import at, rows

FLOW = "ip_id long, crawl_ts timestamp_ntz, inflow long, sold long, first_crawl boolean"


def test_weight_stays_until_an_interval_changes(spark):
    t = at("02 06:00")
    crawls = [(1, t, 999, 999, True), (1, t + timedelta(hours=1), 300, 10, False), (1, t + timedelta(days=1), 999, 0, False), (1, t + timedelta(days=2), 999, 999, True), (2, t, 0, 0, True)]
    entities = spark.createDataFrame([(1, 1.0), (2, 1.75)], "id long, weight double")
    got = weights.adjust_over_time(spark.createDataFrame(crawls, FLOW), entities).orderBy("ip_id", "crawl_ts").collect()
    assert [(r.old_minutes, r.new_minutes, r.adjustment, round(r.new_weight, 4)) for r in got] == [
        (120, 120, "none", 1.0), (120, 120, "none", 1.0), (120, 105, "active", 1.1429), (105, 105, "none", 1.1429), (69, 69, "none", 1.75),
    ]


def _log(spark, marks):
    return spark.createDataFrame([(t, o, float(d)) for t, o, d in marks], "ts timestamp_ntz, outcome string, duration_s double")


def _events(spark):
    return spark.createDataFrame([], "ts timestamp_ntz, event string")


def test_blocks_around_a_window_border_raise(spark):
    t = at("02 06:04")
    log = _log(spark, [(t + timedelta(seconds=12 * i), "403_forbidden", 1) for i in range(10)])
    assert rows(tasks.operation_alerts(_events(spark), log), "rule", "value") == [("collector_blocked", 10.0)]
    few = _log(spark, [(t + timedelta(seconds=12 * i), "403_forbidden", 1) for i in range(5)])
    assert tasks.operation_alerts(_events(spark), few).count() == 0


def test_latency_must_hold(spark):
    t = at("02 06:00")
    # one slow minute is seen by windows over four further minutes, and then over
    brief = _log(spark, [(t, "ok", 200), (t, "ok", 250), (t, "ok", 280)])
    assert tasks.operation_alerts(_events(spark), brief).count() == 0
    held = _log(spark, [(t + timedelta(minutes=i), "ok", 200) for i in range(3)])
    got = tasks.operation_alerts(_events(spark), held).collect()
    assert [(r.rule, r.since, r.until) for r in got] == [("high_latency", t, t + timedelta(minutes=6))]


def test_rank_is_distributed(spark):
    """All names share a prefix and all times differ: no bucket of the values bounds a task, the partitions do."""
    n = 3000
    names = spark.range(n).select(F.format_string("same-long-prefix-%08d", (F.col("id") * 7919) % n).alias("name"))
    ranked = slices.global_rank(names, [F.col("name")])
    got = ranked.collect()
    assert {r["name"]: r["position"] for r in got} == {f"same-long-prefix-{i:08d}": i + 1 for i in range(n)}
    batches = schedule.due_batches(spark.range(100).select(F.col("id").alias("ip_id"), F.timestamp_micros(F.col("id") * 1000).cast("timestamp_ntz").alias("next_at")), at("02 06:00"), 30)
    assert rows(batches.groupBy("batch").agg(F.count("*").alias("n"), F.min("ip_id").alias("least")), "batch", "n", "least") == [(1, 30, 0), (2, 30, 30), (3, 30, 60), (4, 10, 90)]
