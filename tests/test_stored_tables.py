"""Pages by range and by cursor, deltas that come twice, clean-up of stored partitions, error types of runs."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from marketebb.operators import boards, retention, tasks
from marketebb.sources import sinks
from tests.conftest import rows

NOW = datetime(2024, 1, 31, 12)


def test_a_far_page_reads_its_range_alone(spark):
    df = spark.range(5000).select("id", (F.col("id") % 7).alias("w"))
    order = [F.desc("w"), F.col("id")]
    want = sorted(((i % 7, i) for i in range(5000)), key=lambda r: (-r[0], r[1]))
    listed = boards.paged(df.repartition(4), order)
    for number, size in ((1, 20), (240, 20), (250, 20), (251, 20), (3, 2000)):
        got = [(r.w, r.id) for r in boards.page_of(listed, number, size).collect()]
        assert got == want[(number - 1) * size : number * size]
    page = boards.page_of(listed, 240, 20)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "Offset" not in plan and "__range" in plan.split("PartitionFilters")[1].split("]")[0]
    assert page.first().total == 5000
    assert boards.page(df.limit(0), order).count() == 0


def test_cursor_goes_through_a_list_with_nulls(spark):
    data = [(i, None if i % 5 == 0 else i % 3, None if i % 4 == 0 else -i) for i in range(100)]
    df = spark.createDataFrame(data, "id long, a int, b int")
    keys = [("a", True), ("b", False), ("id", False)]
    whole = [tuple(r) for r in df.orderBy(F.desc("a"), F.asc("b"), F.asc("id")).collect()]
    got, cursor = [], None
    while part := boards.page_after(df, keys, cursor, 9).collect():
        got += [tuple(r) for r in part]
        cursor = [part[-1][c] for c, _ in keys]
    assert got == whole


def test_deltas_may_come_twice(spark, tmp_path):
    path = str(tmp_path / "t")

    def add(df):
        return df.groupBy("p").agg(F.sum("v").alias("v")).select("v", "p")

    for batch, data in [(0, [(1, "a"), (2, "b")]), (1, [(5, "b"), (7, "c")]), (1, [(5, "b"), (7, "c")]), (0, [(1, "a"), (2, "b")])]:
        sinks.fold_deltas(spark.createDataFrame(data, "v long, p string"), path, ["p"], batch, add)
    assert rows(spark.read.parquet(f"{path}/table"), "v", "p") == [(1, "a"), (7, "b"), (7, "c")]


def test_clean_up_leaves_other_partitions_alone(spark, tmp_path):
    root = str(tmp_path)
    hours = spark.createDataFrame([(1, NOW - timedelta(days=d, hours=h)) for d in range(12) for h in (0, 5)], "ip_id long, hour_bucket timestamp_ntz")
    sinks.replace_buckets(hours, f"{root}/ip_stats_hourly", "hour_bucket")
    spent = NOW - timedelta(days=retention.SNAPSHOT_LAG_DAYS)
    items = [(1, "a", "sold", spent, spent, 0), (1, "b", "sold", NOW, NOW, 1), (2, "c", "on_sale", None, spent, 2), (2, "d", "on_sale", None, NOW, 2)]
    snap = spark.createDataFrame(items, "ip_id long, source_id string, status string, sold_at timestamp_ntz, updated_at timestamp_ntz, bucket int")
    sinks.overwrite_partitions(snap, f"{root}/item_snapshots", ["bucket"])
    before = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    for _ in range(2):
        retention.clean_stored(spark, root, NOW)
        after = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
        kept = [(1, t) for t in (NOW - timedelta(days=d, hours=h) for d in range(12) for h in (0, 5)) if t >= datetime(2024, 1, 24)]
        assert rows(spark.read.parquet(f"{root}/ip_stats_hourly"), "ip_id", "hour_bucket") == sorted(kept, key=str)
        assert rows(spark.read.parquet(f"{root}/item_snapshots"), "source_id") == [("b",), ("d",)]
        untouched = [p for p in before if "bucket=1" in str(p) or "day=2024-01-2" in str(p) and p in after]
        assert untouched and all(after[p] == before[p] for p in untouched)


def test_outcomes_by_error_type(spark):
    log = spark.createDataFrame([("m", "context canceled", 0), ("m", "Timeout", 3), ("m", None, 0), ("d", None, 2), ("d", "no such thing", 1)], "mode string, error_text string, items int")
    got = rows(tasks.outcome_by_error(log), "outcome", "mode", "error_type", "runs")
    assert got == sorted([("error", "m", "timeout", 2), ("empty_result", "m", None, 1), ("success", "d", None, 1), ("error", "d", "unknown", 1)], key=str)
