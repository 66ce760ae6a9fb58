from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marketebb.operators import alerts, schedule, slices, weights
from tests.conftest import rows

FLOW = "ip_id long, crawl_ts timestamp_ntz, inflow long, outflow long"
T0 = datetime(2024, 1, 2, 10, 20)


@pytest.mark.parametrize(
    ("i", "o", "expected"),
    [
        (100, 50, ["high_outflow"]),
        (100, 20, ["low_liquidity"]),
        (100, 0, []),
        (0, 40, []),
        (10, 21, ["surge"]),
        (10, 20, []),
        (20, 60, ["high_outflow", "surge"]),
        (100, 30, []),
    ],
)
def test_alert_rules(spark, i, o, expected):
    df = spark.createDataFrame([(1, T0, i, o)], FLOW)
    assert [r["alert_type"] for r in alerts.alerts(df).collect()] == expected


def test_alert_rows(spark):
    df = spark.createDataFrame([(1, T0, 20, 60)], FLOW)
    got = {r["alert_type"]: r for r in alerts.alerts(df).collect()}
    assert got["high_outflow"]["message"] == "出货量达到 60，超过阈值 50"
    assert got["surge"]["message"] == "流动性指数 3.0000，超过阈值 2.0000 (供不应求)"
    assert (got["surge"]["severity"], got["surge"]["metric_value"], got["surge"]["threshold_value"]) == ("critical", 3.0, 2.0)
    assert got["surge"]["hour_bucket"] == datetime(2024, 1, 2, 10)
    assert alerts.alerts(df, high_outflow=0, high_liquidity=0).count() == 0


def test_alert_list_and_acknowledge(spark):
    df = spark.createDataFrame([(1, T0, 20, 60), (2, T0, 100, 20)], FLOW)
    found = alerts.alerts(df)
    assert alerts.alert_list(found, severity="critical").count() == 1
    assert alerts.alert_list(found, ip_id=2).count() == 1
    keys = found.filter("ip_id = 1").select("ip_id", "alert_type")
    once = alerts.acknowledge(found, keys, "2024-01-03 00:00:00")
    assert rows(once, "alert_type", "outcome") == [
        ("high_outflow", "acknowledged"),
        ("low_liquidity", "untouched"),
        ("surge", "acknowledged"),
    ]
    again = alerts.acknowledge(once.drop("outcome"), keys, "2024-01-09 00:00:00")
    assert rows(again.filter("ip_id = 1"), "outcome", "acknowledged_at") == [
        ("already acknowledged", datetime(2024, 1, 3))
    ] * 2
    assert alerts.alert_list(again.drop("outcome")).count() == 1
    assert alerts.alert_list(again.drop("outcome"), acknowledged=None).count() == 3
    names = spark.createDataFrame([(1, "one")], "id long, name string")
    assert rows(alerts.recent(found, names, 2), "ip_name") == [("one",), ("one",)]


SCHED = "ip_id long, next_at timestamp_ntz"
ENT = "id long, name string, weight double, status string, last_crawled_at timestamp_ntz"
NOW = datetime(2024, 1, 10, 12)


@pytest.fixture
def entities(spark):
    return spark.createDataFrame(
        [
            (1, "a", 1.0, "active", None),
            (2, "b", 1.0, "paused", None),
            (3, "c", 2.0, "active", NOW - timedelta(minutes=30)),
            (4, "d", 1.0, "active", NOW - timedelta(hours=5)),
            (5, "e", 0.0, "active", NOW - timedelta(minutes=30)),
            (6, "f", 1.0, "active", NOW - timedelta(hours=2)),
        ],
        ENT,
    )


def test_initial_schedule(entities):
    got = dict(rows(schedule.initial(entities, NOW), "ip_id", "next_at"))
    assert got == {
        1: NOW,
        3: NOW + timedelta(minutes=30),
        4: NOW + timedelta(seconds=20),
        5: NOW + timedelta(minutes=90),
        6: NOW,  # exactly due counts as its regular time
    }


def test_due_stats_status(spark, entities):
    sched = spark.createDataFrame(
        [(1, NOW), (3, NOW - timedelta(hours=1)), (4, NOW + timedelta(seconds=1)), (9, NOW - timedelta(hours=2))], SCHED
    )
    assert [r["ip_id"] for r in schedule.due(sched, NOW).collect()] == [9, 3, 1]
    kept, dropped = schedule.split_due(schedule.due(sched, NOW), entities)
    assert rows(kept, "ip_id") == [(1,), (3,)] and rows(dropped, "ip_id") == [(9,)]
    s = schedule.stats(sched, NOW).first()
    assert (s["total"], s["overdue"], s["next_in_s"]) == (4, 2, 0.0)
    far = spark.createDataFrame([(1, NOW + timedelta(days=3)), (2, NOW - timedelta(days=1))], SCHED)
    assert schedule.stats(far, NOW).first()["next_in_s"] == 86400.0
    late = spark.createDataFrame([(1, NOW - timedelta(days=3))], SCHED)
    assert schedule.stats(late, NOW).first()["next_in_s"] == 0.0
    assert schedule.stats(late.limit(0), NOW).first()["total"] == 0
    assert schedule.earliest(sched).first()[0] == NOW - timedelta(hours=2)
    st = {r["ip_id"]: (r["ip_name"], r["time_until_s"], r["is_overdue"]) for r in schedule.status(sched, entities, NOW).collect()}
    assert st[3] == ("c", -3600.0, True) and st[9] == ("", -7200.0, True) and st[4] == ("d", 1.0, False)


def test_refresh(spark, entities):
    old = spark.createDataFrame([(1, NOW + timedelta(hours=1)), (2, NOW), (99, NOW)], SCHED)
    got = dict(rows(schedule.refresh(old, entities, NOW), "ip_id", "next_at"))
    assert got == {1: NOW + timedelta(hours=1), 3: NOW, 4: NOW, 5: NOW, 6: NOW}
    assert rows(schedule.to_add(old, entities, NOW), "ip_id") == [(3,), (4,), (5,), (6,)]
    assert rows(schedule.to_drop(old, entities), "ip_id") == [(2,), (99,)]


def test_changes_and_writes(spark):
    old = spark.createDataFrame([(i, NOW + timedelta(hours=9)) for i in (1, 2, 3, 4)], SCHED)
    changes = spark.createDataFrame(
        [(1, "remove", None), (2, "reweight", 2.0), (3, "trigger", None), (7, "add", 1.0)],
        "ip_id long, action string, weight double",
    )
    got = dict(rows(schedule.apply_changes(old, changes, NOW), "ip_id", "next_at"))
    assert got == {2: NOW + timedelta(hours=1), 3: NOW, 4: NOW + timedelta(hours=9), 7: NOW}
    new = spark.createDataFrame([(1, NOW), (8, NOW)], SCHED)
    assert dict(rows(schedule.write_times(old, new), "ip_id", "next_at"))[8] == NOW


def test_next_times(spark):
    df = spark.createDataFrame([(1, datetime(2024, 1, 2, 10, 17), 2.0), (2, datetime(2024, 1, 2, 10, 15), 9.0)], "ip_id long, crawl_ts timestamp_ntz, new_weight double")
    got = dict(rows(schedule.next_times(df), "ip_id", "next_at"))
    assert got == {1: datetime(2024, 1, 2, 11, 30), 2: datetime(2024, 1, 2, 11, 15)}
    # 7200 / 1.75 is 4114.28... seconds: just past the quarter, so the next one
    close = spark.createDataFrame([(1, datetime(2024, 1, 2, 10, 6, 26), 1.75)], df.schema)
    assert schedule.next_times(close).first()["next_at"] == datetime(2024, 1, 2, 11, 30)
    assert schedule.next_times(close, slot_minutes=0).first()["next_at"] == datetime(2024, 1, 2, 11, 15)


def test_batches_follow_the_order(spark):
    sched = spark.createDataFrame([(i * 70_000, NOW - timedelta(minutes=i % 3)) for i in range(120)], SCHED)
    got = [r for r in schedule.due_batches(sched, NOW, 50).orderBy("position").collect()]
    assert [r["ip_id"] for r in got] == [r["ip_id"] for r in sched.orderBy("next_at", "ip_id").collect()]
    assert [r["position"] for r in got] == list(range(1, 121))
    assert [r["batch"] for r in got] == [1] * 50 + [2] * 50 + [3] * 20
    assert schedule.due_batches(sched, NOW, 0).agg(F.max("batch")).first()[0] == 12


ADJ = "ip_id long, weight double, inflow long, sold long, first_crawl boolean"


@pytest.mark.parametrize(
    ("weight", "i", "o", "first", "minutes", "what"),
    [
        (1.0, 501, 0, False, 105, "active"),
        (1.0, 0, 501, False, 105, "active"),
        (1.0, 500, 0, False, 120, "none"),
        (2.0, 600, 600, False, 60, "none"),
        (120 / 105, 300, 20, False, 110, "regress"),
        (120 / 105, 249, 14, False, 120, "cold"),
        (1.14, 999, 999, True, 105, "none"),
        (0.0, 501, 0, False, 105, "active"),
        (10.0, 501, 0, False, 60, "active"),
        (0.5, 300, 300, False, 235, "regress"),
    ],
)
def test_interval_adjustment(spark, weight, i, o, first, minutes, what):
    r = weights.adjust_once(spark.createDataFrame([(1, weight, i, o, first)], ADJ)).first()
    assert (r["new_minutes"], r["adjustment"]) == (minutes, what)
    flow = spark.createDataFrame([(1, T0, i, o, first)], "ip_id long, crawl_ts timestamp_ntz, inflow long, sold long, first_crawl boolean")
    ent = spark.createDataFrame([(1, weight)], "id long, weight double")
    folded = weights.adjust_over_time(flow, ent).first()
    assert (folded["new_minutes"], folded["adjustment"]) == (minutes, what)


def test_fold_runs_in_order_of_time(spark):
    data = [(ip, T0 + timedelta(hours=h), 999 if h < 3 else 0, 0, False) for h in range(6) for ip in (1, 2)]
    flow = spark.createDataFrame(data[::-1], "ip_id long, crawl_ts timestamp_ntz, inflow long, sold long, first_crawl boolean")
    ent = spark.createDataFrame([(1, 1.0)], "id long, weight double")
    got = weights.adjust_over_time(flow, ent).orderBy("ip_id", "crawl_ts").collect()
    assert [r["new_minutes"] for r in got] == [105, 90, 75, 90, 105, 120] * 2


def test_running_and_previous_across_slices(spark):
    data = [(k, d, i, (i * 7 + d) % 5) for k in ("hot", "x") for d in range(4) for i in range(5) if k == "hot" or d % 2]
    df = spark.createDataFrame(data, "k string, slice int, i int, v long").withColumn("o", F.col("slice") * 10 + F.col("i"))
    out = slices.running(df, ["k"], "slice", ["o"], {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "l": ("min", F.col("v"))})
    before = slices.running(df, ["k"], "slice", ["o"], {"s": ("sum", F.col("v"))}, inclusive=False)
    lagged = slices.previous(df, ["k"], "slice", ["o"], {"p": "v"})
    for k in ("hot", "x"):
        vs = [d[3] for d in sorted(data) if d[0] == k]
        got = out.filter(F.col("k") == k).orderBy("o").collect()
        assert [r["s"] for r in got] == [sum(vs[: n + 1]) for n in range(len(vs))]
        assert [r["m"] for r in got] == [max(vs[: n + 1]) for n in range(len(vs))]
        assert [r["l"] for r in got] == [min(vs[: n + 1]) for n in range(len(vs))]
        assert [r["s"] for r in before.filter(F.col("k") == k).orderBy("o").collect()] == [sum(vs[:n]) for n in range(len(vs))]
        assert [r["p"] for r in lagged.filter(F.col("k") == k).orderBy("o").collect()] == [None, *vs[:-1]]
