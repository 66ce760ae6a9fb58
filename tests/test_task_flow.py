"""Task events in micro-batches: late rows, batches that run again, records that go."""

from __future__ import annotations

from datetime import datetime, timedelta

from marketebb.operators import tasks
from marketebb.sources import sinks
from marketebb.streaming import task_flow
from tests.conftest import rows

T0 = datetime(2024, 1, 2, 10)
EVENTS = "task_id string, ip_id long, event string, ts timestamp_ntz, retry_count int, seq long"
LOG = "node string, task_id long, ts timestamp_ntz, outcome string"


def events(spark, *data):
    return spark.createDataFrame([(t, ip, e, T0 + timedelta(minutes=m), 0, m) for t, ip, e, m in data], EVENTS)


def test_gate_keeps_late_pushes_and_forgets_silent_entities(spark, tmp_path):
    root, day = str(tmp_path), 24 * 60
    lots = [[("a", 1, "pushed", 10), ("b", 2, "pushed", 0)], [("c", 1, "pushed", 5), ("d", 1, "pushed", 20)], [("a", 1, "acked", 10 * day), ("e", 1, "pushed", 10 * day + 1)]]
    for i, lot in enumerate(lots):
        for _ in range(2):  # every batch runs twice
            task_flow.gate(events(spark, *lot), i, root)
    got = rows(task_flow.results(spark, root, "gate"), "task_id", "accepted", "late")
    assert got == [("a", True, False), ("b", True, False), ("c", None, True), ("d", False, False), ("e", True, False)]
    task_flow.gate(events(spark, *[(f"x{i}", i, "pushed", 10 * day + 2) for i in range(3, 200)]), 3, root)
    held = spark.read.parquet(f"{root}/gate")
    assert held.filter("ip_id = 2").count() == 0 and held.filter("ip_id = 1").count() == 1


def test_stuck_tasks_are_told_once_whatever_the_order(spark, tmp_path):
    root = str(tmp_path)
    task_flow.stuck(events(spark, ("a", 1, "started", 0), ("b", 1, "acked", 50), ("z", 9, "pushed", 60)), 0, root)
    task_flow.stuck(events(spark, ("b", 1, "started", 10), ("c", 2, "started", 20), ("z", 9, "pushed", 200)), 1, root)
    task_flow.stuck(events(spark, ("c", 2, "acked", 30), ("z", 9, "pushed", 400)), 2, root)
    task_flow.stuck(events(spark, ("z", 9, "pushed", 500)), 3, root)
    got = task_flow.results(spark, root, "stuck")
    assert rows(got, "task_id", "batch_id") == [("a", 1), ("c", 1)]


def test_streaks_run_on_over_batches_of_a_hot_node(spark, tmp_path):
    data = [("hot" if i % 3 else f"n{i % 5}", i, T0 + timedelta(minutes=i * 2 + (i % 17 == 0) * 1), "403_forbidden" if i % 7 else "success") for i in range(300)]
    root, parts = str(tmp_path), [data[:120], data[120:200], data[200:]]
    for i, part in enumerate(parts):
        task_flow.streak(spark.createDataFrame(part, LOG), i, root)
    task_flow.streak(spark.createDataFrame(parts[2], LOG), 2, root)
    columns = ("node", "task_id", "streak", "cooldown")
    assert rows(task_flow.results(spark, root, "streak"), *columns) == rows(tasks.block_streaks(spark.createDataFrame(data, LOG)), *columns)
    task_flow.streak(spark.createDataFrame(data[:3], LOG), 3, root)
    late = task_flow.results(spark, root, "streak").filter("batch_id = 3")
    assert rows(late, "streak", "late") == [(None, True)] * late.count() and late.count() == sum(x[3] != "success" for x in data[:3])
    assert sinks.exists(spark, f"{root}/streak")
