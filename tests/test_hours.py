from __future__ import annotations

import random
import statistics
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from marketebb.operators import boards, hourly, pricing, retention, rollup, snapshots
from marketebb.operators import transitions as T
from tests.conftest import rows


@pytest.mark.parametrize(
    ("prices", "expected"),
    [
        ([1000], (1000.0, 1000.0, 1000, 1000, None, 1)),
        ([1000, 2000, 3000], (2000.0, 2000.0, 1000, 3000, 816.4965809, 3)),
        ([500] * 4, (500.0, 500.0, 500, 500, None, 4)),
        ([1000, 2000, 0, 3000, -5], (2000.0, 2000.0, 1000, 3000, 816.4965809, 3)),
        ([1, 2, 3, 10], (4.0, 2.5, 1, 10, 3.5355339, 4)),
    ],
)
def test_price_stats(spark, prices, expected):
    df = spark.createDataFrame([(1, p, 1) for p in prices], "k int, price int, weight long")
    r = pricing.price_stats(df, ["k"]).first()
    got = (r["avg_price"], r["median_price"], r["min_price"], r["max_price"], r["price_stddev"], r["sample_count"])
    assert (got[4] is None) == (expected[4] is None)
    assert [v or 0 for v in got] == pytest.approx([v or 0 for v in expected], rel=1e-7)


def test_price_stats_without_rows(spark):
    assert pricing.price_stats(spark.createDataFrame([], "k int, price int, weight long"), ["k"]).count() == 0


def test_price_stats_against_plain_python(spark):
    rng = random.Random(5)
    data = [(rng.choice([0, 0, 0, 1, 2]), rng.randrange(1, 60), rng.randrange(1, 4)) for _ in range(400)]
    got = {r["k"]: r for r in pricing.price_stats(spark.createDataFrame(data, "k int, price int, weight long"), ["k"]).collect()}
    for k in (0, 1, 2):
        flat = [p for kk, p, w in data if kk == k for _ in range(w)]
        assert got[k]["median_price"] == statistics.median(flat)
        assert got[k]["avg_price"] == pytest.approx(statistics.fmean(flat))
        assert got[k]["price_stddev"] == pytest.approx(statistics.pstdev(flat))


def crawl_pair(observe):
    """Two crawls of one hour after a quiet first one; the sold prices are 100, 300 and then 50."""
    return observe(
        (1, "old", "available", 9, "02 00:00"),
        *[(1, f"n{i}", "available", 9, "02 10:05") for i in range(10)],
        (1, "s1", "sold", 100, "02 10:05"),
        (1, "s2", "sold", 300, "02 10:05"),
        *[(1, f"z{i}", "sold", 0, "02 10:05") for i in range(3)],
        (1, "s3", "sold", 50, "02 10:40"),
        (1, "n0", "sold", 0, "02 10:40"),
    )


@pytest.mark.parametrize(("mode", "avg", "sd"), [("last_crawl", 50.0, None), ("exact", 150.0, 108.0123450)])
def test_hour_merge(observe, mode, avg, sd):
    moved = T.transitions(crawl_pair(observe))
    hour = hourly.hourly(T.crawl_flow(moved), hourly.sold_sample(moved), mode).filter("hour_bucket > '2024-01-02 05:00:00'").first()
    assert (hour["inflow"], hour["outflow"], hour["liquidity_index"]) == (10, 7, 0.7)
    assert (hour["min_price"], hour["max_price"], hour["sample_count"]) == (50, 300, 3)
    assert (hour["min_item"]["source_id"], hour["max_item"]["source_id"]) == ("s3", "s2")
    assert hour["avg_price"] == avg
    assert hour["price_stddev"] == (None if sd is None else pytest.approx(sd))


def test_unknown_merge_mode(observe):
    with pytest.raises(ValueError):
        hourly.hourly(None, None, "other")


def test_merging_deltas_equals_one_pass(observe):
    moved = T.transitions(crawl_pair(observe))
    flow, sample = T.crawl_flow(moved), hourly.sold_sample(moved)
    whole = hourly.hourly(flow, sample)
    cut = "crawl_ts < '2024-01-02 10:30:00'"
    old = hourly.hourly(flow.filter(cut), sample.filter(cut))
    new = hourly.hourly(flow.filter(f"NOT {cut}"), sample.filter(f"NOT {cut}"))
    assert rows(hourly.merge_hours(old, new), *whole.columns) == rows(whole, *whole.columns)


def test_detail_of_items_is_kept(spark):
    df = spark.createDataFrame(
        [
            (1, "a", "available", 5, datetime(2024, 1, 2), 0, "A", "i", "u"),
            (1, "b", "sold", 8, datetime(2024, 1, 2, 6), 1, "B", "i", "u"),
        ],
        "ip_id long, source_id string, status string, price int, crawl_ts timestamp_ntz, pos long, "
        "title string, image_url string, item_url string",
    )
    moved = T.transitions(df)
    hour = hourly.hourly(T.crawl_flow(moved), hourly.sold_sample(moved)).filter("sample_count > 0").first()
    assert hour["min_item"].asDict() == {"source_id": "b", "price": 8, "title": "B", "image_url": "i", "item_url": "u"}


HOUR = "ip_id long, hour_bucket timestamp_ntz, inflow long, outflow long, liquidity_index double"


@pytest.fixture
def hours(spark):
    data = [(ip, datetime(2024, 1, 30, h), ip, h % 3, (h % 3) / ip) for ip in (1, 2) for h in range(24)]
    return spark.createDataFrame(data, HOUR)


def test_latest_and_last_hours(hours, spark):
    known = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    now = datetime(2024, 1, 30, 12, 30)
    latest = rows(hourly.latest_hour(hours, known, now), "ip_id", "hour_bucket", "inflow")
    assert latest == [(1, datetime(2024, 1, 30, 11), 1), (2, datetime(2024, 1, 30, 11), 2), (3, None, 0)]
    assert hourly.latest_hour(hours, known).filter("ip_id = 1").first()["hour_bucket"] == datetime(2024, 1, 30, 23)
    assert hourly.last_hours(hours, 5).groupBy("ip_id").count().filter("count = 5").count() == 2
    assert hourly.hours_between(hours, "2024-01-30 01:00:00", "2024-01-30 03:00:00").count() == 6
    assert hourly.hours_between(hours, "2024-01-30 01:00:00", "2024-01-30 03:00:00", closed=False).count() == 4
    assert hourly.hours_between(hours).count() == 48


DAY = (
    "ip_id long, date_bucket date, total_inflow long, total_outflow long, avg_liquidity double, max_sold_price int, "
    "min_sold_price int, median_sold_price double, avg_sold_price double, min_price_item struct<source_id: string>, "
    "max_price_item struct<source_id: string>, sample_count long, hourly_records long"
)


def day_row(on, price, n, source):
    priced = (price, price, None if price is None else float(price), None if price is None else float(price))
    item = None if price is None else (source,)
    return (1, on, 10, 4, 0.5, *priced, item, item, n, 24)


def test_week_roll_up(spark):
    days = spark.createDataFrame(
        [
            day_row(date(2024, 1, 1), 100, 1, "a"),
            day_row(date(2024, 1, 2), 200, 1, "b"),
            day_row(date(2024, 1, 3), 400, 2, "c"),
            day_row(date(2024, 1, 4), None, 0, None),
            day_row(date(2024, 1, 5), 400, 0, "d"),
        ],
        DAY,
    )
    r = rollup.weekly(days.filter("date_bucket < '2024-01-05'")).first()
    assert (r["total_inflow"], r["total_outflow"], r["sample_count"], r["daily_records"]) == (40, 16, 4, 4)
    assert (r["median_sold_price"], r["avg_sold_price"]) == (200.0, 275.0)
    assert (r["min_price_item"]["source_id"], r["max_price_item"]["source_id"]) == ("a", "c")
    # of equal maxima the earlier day wins, and a day without samples has no weight
    both = rollup.weekly(days).first()
    assert (both["max_price_item"]["source_id"], both["avg_sold_price"]) == ("c", 275.0)
    assert rollup.weekly(days, date(2024, 1, 10)).count() == 0


def test_month_goes_by_the_monday(spark):
    days = spark.createDataFrame([day_row(date(2026, 1, 31), 10, 1, "a"), day_row(date(2026, 2, 3), 10, 1, "b")], DAY)
    months = rollup.monthly(rollup.weekly(days))
    assert rows(months, "month_start", "weekly_records") == [(date(2026, 1, 1), 1), (date(2026, 2, 1), 1)]
    assert rollup.monthly(rollup.weekly(days), date(2026, 2, 14)).count() == 1


def test_day_roll_up_conserves_flow_and_skips_entities_without_hours(hours, spark):
    sold = spark.createDataFrame(
        [
            (1, "a", 30, datetime(2024, 1, 30, 5)),
            (1, "b", 10, datetime(2024, 1, 30, 6)),
            (1, "c", 0, datetime(2024, 1, 30, 7)),
            (1, "d", 99, datetime(2024, 1, 31)),
            (9, "e", 5, datetime(2024, 1, 30)),
            (2, "f", 5, None),
        ],
        "ip_id long, source_id string, price int, sold_at timestamp_ntz",
    )
    days = rollup.daily(hours, sold, date(2024, 1, 30))
    got = rows(days, "ip_id", "total_inflow", "hourly_records", "sample_count", "median_sold_price", "min_sold_price")
    assert got == [(1, 24, 24, 3, 10.0, 0), (2, 48, 24, 0, None, None)]
    assert hours.agg(F.sum("inflow")).first()[0] == days.agg(F.sum("total_inflow")).first()[0]


SNAP = (
    "ip_id long, source_id string, price int, status string, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, "
    "sold_at timestamp_ntz, price_changed boolean, updated_at timestamp_ntz"
)


@pytest.mark.parametrize(
    ("mode", "sold"), [("first_insert", [("a", None), ("b", "02")]), ("transition", [("a", "03"), ("b", "02")])]
)
def test_snapshots_in_instalments(observe, mode, sold):
    first = observe((1, "a", "available", 5, "02 00:00"), (1, "b", "sold", 7, "02 00:00"))
    second = observe((1, "a", "sold", 6, "03 00:00"), (1, "b", "available", 7, "03 00:00"))
    merged = snapshots.upsert_snapshots(snapshots.snapshot_delta(first, mode), snapshots.snapshot_delta(second, mode), mode)
    days = [(s, None if d is None else d.strftime("%d")) for s, d in rows(merged, "source_id", "sold_at")]
    assert days == sold
    got = rows(merged, "source_id", "price", "status", "price_changed")
    assert got == [("a", 6, "sold", True), ("b", 7, "on_sale", False)]
    at_once = snapshots.snapshot_delta(first.unionAll(second.withColumn("pos", F.col("pos") + 10)), mode)
    assert rows(at_once, *merged.columns) == rows(merged, *merged.columns)


def test_snapshot_filters(spark):
    data = [
        (1, "a", 5, "on_sale", None, datetime(2024, 1, 2), None, False, datetime(2024, 1, 2)),
        (1, "b", 0, "sold", None, datetime(2024, 1, 3), datetime(2024, 1, 3), False, datetime(2024, 1, 3)),
        (1, "c", 7, "sold", None, datetime(2024, 1, 4), datetime(2024, 1, 4), False, datetime(2024, 1, 4)),
        (1, "d", 7, "sold", None, datetime(2024, 1, 4), None, False, datetime(2024, 1, 4)),
        (2, "e", 7, "on_sale", None, datetime(2024, 1, 4), None, False, datetime(2024, 1, 4, 23, 59, 59)),
    ]
    snap = spark.createDataFrame(data, SNAP)
    assert rows(snapshots.active_items(snap, 1), "source_id") == [("a",)]
    assert rows(snapshots.recently_sold(snap, 1, "2024-01-03 00:00:00", 1), "source_id") == [("c",)]
    assert snapshots.positive_prices(snap).count() == 4
    marked = snapshots.mark_sold(snap, snap.filter("source_id = 'a'"), "2024-01-09 00:00:00")
    assert rows(marked.filter("source_id = 'a'"), "status", "sold_at") == [("sold", datetime(2024, 1, 9))]
    # sold on the day, or unsold and last updated on it; sold without a time stays
    assert rows(retention.keep_snapshots(snap, date(2024, 1, 4)), "source_id") == [("a",), ("b",), ("d",)]


def test_retention_edges(spark):
    now = datetime(2024, 2, 10, 15)
    hour = spark.createDataFrame([(datetime(2024, 2, 3),), (datetime(2024, 2, 2, 23, 59, 59),)], "hour_bucket timestamp_ntz")
    assert rows(retention.keep_hours(hour, now), "hour_bucket") == [(datetime(2024, 2, 3),)]
    day = spark.createDataFrame([(date(2023, 11, 12),), (date(2023, 11, 11),)], "date_bucket date")
    assert rows(retention.keep_days(day, now), "date_bucket") == [(date(2023, 11, 12),)]
    week = spark.createDataFrame([(date(2023, 2, 6),), (date(2023, 1, 30),)], "week_start date")
    assert rows(retention.keep_weeks(week, now), "week_start") == [(date(2023, 2, 6),)]
    snap = spark.createDataFrame([], SNAP)
    assert retention.clean_up(hour, day, week, snap, now)["snapshots"].count() == 0


META = "id long, name string, name_en string, status string"


@pytest.fixture
def meta(spark):
    return spark.createDataFrame([(1, "one", "One", "active"), (2, "two", "Two", "active")], META)


@pytest.mark.parametrize(
    ("asked", "used"), [(0, 24), (-3, 24), (1, 1), (23, 23), (24, 24), (30, 24), (167, 24), (168, 168), (500, 168)]
)
def test_board_window(asked, used):
    assert boards.normalise_request(hours=asked).hours == used


def test_boards_choose_their_source(meta, hours, spark):
    now = datetime(2024, 1, 31, 0, 20)
    days = spark.createDataFrame(
        [(1, date(2024, 1, 30), 3, 9), (2, date(2024, 1, 30), 0, 0), (1, date(2024, 1, 29), 99, 99)],
        "ip_id long, date_bucket date, total_inflow long, total_outflow long",
    )
    weeks = spark.createDataFrame(
        [(7, date(2024, 1, 22), 3, 9), (1, date(2024, 1, 29), 99, 99)],
        "ip_id long, week_start date, total_inflow long, total_outflow long",
    )
    for asked in (0, 24, 30, 167):
        got = boards.leaderboard("hot", boards.normalise_request(hours=asked).hours, 10, now, meta, hours, days, weeks)
        assert rows(got, "rank", "ip_id", "inflow", "ip_name") == [(1, 1, 3, "one")]
    assert boards.leaderboard("other", 24, 10, now, meta, hours, days, weeks).first()["score"] > 2
    week = boards.leaderboard("inflow", 168, 10, now, meta, hours, days, weeks)
    assert rows(week, "ip_id", "score", "ip_name", "ip_name_en") == [(7, 3.0, "", "")]
    # the running hour stays out: at 00:20 the last two hours are 22 and 23
    two = boards.leaderboard("outflow", 2, 10, now, meta, hours, days, weeks)
    assert rows(two, "rank", "ip_id", "outflow") == [(1, 1, 3), (2, 2, 3)]


def test_board_limits_and_ties(spark):
    data = spark.createDataFrame([(i, 1, 1) for i in range(150)], "ip_id long, inflow long, outflow long")
    assert rows(boards.top_k(data, "hot", 3), "ip_id", "rank") == [(0, 1), (1, 2), (2, 3)]
    assert boards.top_k(data, "hot", 5000).count() == data.count()
    with pytest.raises(ValueError, match="positive"):
        boards.top_k(data, "hot", 0)
    assert boards.normalise_request(limit=0, size=0, page=0, last=0) == (24, 10, 1, 20, 24)
    assert boards.normalise_request(500, 5000, 7, 1000, 999) == (168, 100, 7, 100, 168)
    with pytest.raises(ValueError):
        boards.top_k(data, "cold")


def test_dashboard_totals(spark):
    make = lambda *v: spark.createDataFrame([(x, 0) for x in v], "inflow long, outflow long")
    r = boards.dashboard_totals(make(1, 2), make(2, 3), make(10)).first()
    assert (r["median_volume"], r["total_ops"]) == (2.0, 3)
    empty = boards.dashboard_totals(make(1).limit(0), make(1).limit(0), make(1).limit(0)).first()
    assert (empty["median_volume"], empty["total_ops"]) == (0.0, 0)


def test_page(spark):
    df = spark.range(45)
    got = boards.page(df, [F.desc("id")], 3, 20).collect()
    assert [r["id"] for r in got] == [4, 3, 2, 1, 0] and {r["total"] for r in got} == {45}
    assert boards.page(spark.range(300), [F.col("id")], 1, 1000).count() == 300
    with pytest.raises(ValueError, match="positive"):
        boards.page(df, [F.col("id")], 0, 20)
