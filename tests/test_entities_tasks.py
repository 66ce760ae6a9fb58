from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from marketebb.operators import entities, listing_pages, reports, tasks
from tests.conftest import rows

META = "id long, name string, name_en string, name_cn string, category string, weight double, status string"


@pytest.fixture
def meta(spark):
    return spark.createDataFrame(
        [
            (1, "初音ミク", "Hatsune Miku", "初音未来", "music", 1.0, "active"),
            (2, "Pokémon", "Pokemon", None, "game", 2.0, "paused"),
            (3, "Old", "Old", "旧", "game", 1.0, "deleted"),
        ],
        META,
    )


def test_entity_list(meta):
    assert rows(entities.entity_list(meta), "id") == [(1,), (2,)]
    assert rows(entities.entity_list(meta, status="deleted"), "id") == [(3,)]
    assert rows(entities.entity_list(meta, category="game"), "id") == [(2,)]
    assert rows(entities.entity_list(meta, keyword="POKEMON"), "id") == [(2,)]
    assert rows(entities.entity_list(meta, keyword="未来"), "id") == [(1,)]
    assert entities.entity_list(meta, keyword="zzz").count() == 0
    assert rows(entities.market_filter(meta, "All", "MIKU"), "id") == [(1,)]
    assert rows(entities.market_filter(meta, "game"), "id") == [(2,), (3,)]
    assert [r["category"] for r in entities.categories(meta).collect()] == ["game", "music"]


ENTRY = "pos long, name string, category string, weight double, tags array<string>"


@pytest.mark.parametrize(
    ("given", "expected"),
    [
        ([(0, "New", "x", 1.5, None)], (1, 0, 0, 0)),
        ([(0, "Pokémon", "card", 1.5, None)], (0, 1, 0, 0)),
        ([(i, f"N{i}", "x", 1.0, None) for i in range(3)], (3, 0, 0, 0)),
        ([(0, "", "x", 1.0, None), (1, None, "x", 1.0, None)], (0, 0, 0, 2)),
        ([(0, "New", "x", 1.0, None), (1, "New", "y", 1.0, None)], (1, 1, 0, 0)),
    ],
)
def test_import_outcomes(spark, meta, given, expected):
    entries = spark.createDataFrame(given, ENTRY)
    s = entities.import_summary(entities.import_plan(meta, entries), entries).first()
    assert (s["created"], s["updated"], s["skipped"], s["failed"]) == expected


def test_import_values(spark, meta):
    entries = spark.createDataFrame(
        [(0, "Pokémon", "card", -1.0, ["a"]), (1, "B", "x", None, None), (2, "A", "y", 3.0, None), (3, "A", "z", 3.0, None)],
        ENTRY,
    )
    plan = entities.import_plan(meta, entries)
    assert rows(plan, "name", "weight", "tags", "status", "outcome") == [
        ("A", 3.0, [], "active", "created"),
        ("B", 1.0, [], "active", "created"),
        ("Pokémon", 1.0, ["a"], "active", "updated"),
    ]
    after = entities.apply_import(meta, plan)
    assert rows(after, "id", "name", "category", "status") == [
        (1, "初音ミク", "music", "active"),
        (2, "Pokémon", "card", "paused"),
        (3, "Old", "game", "deleted"),
        (4, "A", "z", "active"),
        (5, "B", "x", "active"),
    ]
    only_new = entities.import_plan(meta, entries, upsert=False)
    assert rows(only_new, "name", "category", "outcome", "skipped") == [
        ("A", "y", "created", 1),
        ("B", "x", "created", 0),
        ("Pokémon", "card", "skipped", 1),
    ]
    untouched = entities.apply_import(meta, only_new, upsert=False)
    assert rows(untouched.filter("id = 2"), "category") == [("game",)]


def test_update_delete_touch(spark, meta):
    changes = spark.createDataFrame([(1, None, 5.0), (2, "toy", None)], "id long, category string, weight double")
    got = rows(entities.partial_update(meta, changes), "id", "category", "weight")
    assert got == [(1, "music", 5.0), (2, "toy", 2.0), (3, "game", 1.0)]
    with pytest.raises(ValueError):
        entities.partial_update(meta, changes.select("id"))
    gone = entities.soft_delete(meta, spark.createDataFrame([(1,), (1,)], "id long"))
    assert rows(gone, "id", "status") == [(1, "deleted"), (2, "paused"), (3, "deleted")]
    crawls = spark.createDataFrame([(1, datetime(2024, 1, 2)), (1, datetime(2024, 1, 5))], "ip_id long, crawl_ts timestamp_ntz")
    touched = entities.touch_crawled(meta, crawls)
    assert rows(touched, "id", "last_crawled_at") == [(1, datetime(2024, 1, 5)), (2, None), (3, None)]
    earlier = crawls.filter("crawl_ts < '2024-01-03'")
    assert rows(entities.touch_crawled(touched, earlier).filter("id = 1"), "last_crawled_at") == [(datetime(2024, 1, 5),)]


T0 = datetime(2024, 1, 2, 10)
EVENT = "task_id string, ip_id long, event string, ts timestamp_ntz, retry_count int, seq long"


def events(spark, *given):
    return spark.createDataFrame(
        [(t, ip, e, T0 + timedelta(minutes=m), r, i) for i, (t, ip, e, m, r) in enumerate(given)], EVENT
    )


def test_stuck_tasks(spark):
    df = events(
        spark,
        ("fresh", 1, "pushed", 0, 0), ("fresh", 1, "started", 50, 0),
        ("late", 2, "pushed", 0, 0), ("late", 2, "started", 10, 0),
        ("worn", 3, "pushed", 0, 3), ("worn", 3, "started", 5, 3),
        ("done", 4, "started", 1, 0), ("done", 4, "acked", 2, 0),
        ("edge", 5, "started", 30, 2),
        ("queued", 6, "pushed", 0, 0),
    )
    got = rows(tasks.stuck_tasks(df, T0 + timedelta(minutes=60)), "task_id", "retry_count", "outcome")
    assert got == [("late", 1, "retry"), ("worn", 4, "dead")]
    depth = dict(rows(tasks.queue_depths(df), "state", "tasks"))
    assert depth == {"processing": 4, "processed": 1, "waiting": 1}


def test_one_open_task_per_entity(spark):
    df = events(
        spark,
        ("a", 1, "pushed", 0, 0), ("b", 1, "pushed", 1, 0), ("a", 1, "started", 2, 0), ("c", 1, "pushed", 3, 0),
        ("a", 1, "acked", 4, 0), ("d", 1, "pushed", 5, 0), ("d", 1, "dead", 6, 0), ("e", 1, "pushed", 60 * 30, 0),
        ("x", 2, "pushed", 1, 0), ("y", 2, "pushed", 60 * 50, 0),
    )
    got = dict(rows(tasks.accepted_pushes(df), "task_id", "accepted"))
    assert got == {"a": True, "b": False, "c": False, "d": True, "e": True, "x": True, "y": False}


def test_dedup_and_processed(spark):
    df = events(spark, ("a", 1, "pushed", 0, 0), ("a", 2, "pushed", 1, 5), ("b", 3, "pushed", 2, 0))
    assert rows(tasks.first_of_each_task(df), "task_id", "ip_id", "dropped") == [("a", 1, 1), ("b", 3, 0)]
    done = events(spark, ("a", 1, "acked", 0, 0), ("b", 1, "acked", -60 * 24, 0))
    remembered = tasks.processed_within(done, T0)
    assert rows(remembered, "task_id") == [("a",)]
    assert rows(tasks.unprocessed(df, remembered), "task_id") == [("b",)]


LOG = "task_id long, node string, ts timestamp_ntz, outcome string, mode string, duration_s double"


def log(spark, *given):
    return spark.createDataFrame(
        [(i, n, T0 + timedelta(minutes=m), o, "direct", d) for i, (n, m, o, d) in enumerate(given)], LOG
    )


def test_block_streaks(spark):
    b, s = "403_forbidden", "success"
    df = log(
        spark,
        ("n1", 0, b, 1.0), ("n1", 1, b, 1.0), ("n1", 2, s, 1.0), ("n1", 3, b, 1.0), ("n1", 4, b, 1.0), ("n1", 5, b, 1.0),
        ("n1", 6, b, 1.0), ("n1", 30, b, 1.0), ("n2", 4, b, 1.0), ("n2", 5, "error", 1.0), ("n2", 6, b, 1.0),
        ("n3", 60 * 14 - 1, b, 1.0), ("n3", 60 * 14, b, 1.0), ("n3", 60 * 14 + 1, b, 1.0),
    )
    got = rows(tasks.block_streaks(df), "node", "task_id", "streak", "cooldown")
    assert got == sorted(
        [
            ("n1", 0, 1, False), ("n1", 1, 2, False), ("n1", 3, 1, False), ("n1", 4, 2, False), ("n1", 5, 3, True),
            ("n1", 6, 4, False), ("n1", 7, 1, False), ("n2", 8, 1, False), ("n2", 10, 2, False),
            ("n3", 11, 1, False), ("n3", 12, 2, False), ("n3", 13, 3, True),  # over midnight
        ],
        key=str,
    )


def test_counters_and_histograms(spark):
    df = log(spark, ("n", 0, "success", 0.05), ("n", 1, "success", 3.0), ("n", 2, "error", 400.0), ("n", 3, "empty_result", 1.0))
    c = tasks.run_counters(df).first()
    assert (c["processed"], c["failed"], c["skipped"]) == (2, 1, 1)
    assert (c["avg_duration_s"], c["success_rate"]) == (pytest.approx(1.525), pytest.approx(2 / 3))
    empty = tasks.run_counters(df.limit(0)).first()
    assert (empty["processed"], empty["avg_duration_s"], empty["success_rate"]) == (0, 0.0, 1.0)
    assert rows(tasks.duration_histogram(df), "le", "runs") == [(0.1, 1), (1.0, 1), (5.0, 1), (None, 1)]
    q = tasks.latency_quantiles(df).first()
    # rank 2 of 4 ends bucket (0.5, 1]; rank 3.8 lies in the open bucket, which gives the last bound
    assert (q["runs"], q["p50"], q["p95"]) == (4, 1.0, 300.0)
    assert tasks.latency_sketch(df).first()["quantiles"][0] == 1.0


def test_rates(spark):
    df = events(spark, *[(f"t{i}", i, "pushed", 0, 0) for i in range(10)], ("t0", 0, "acked", 2, 0))
    got = {r["window_start"]: (r["pushed_per_min"], r["processed_per_min"]) for r in tasks.rates(df).collect()}
    assert got[T0] == (2.0, 0.2) and got[T0 - timedelta(minutes=4)] == (2.0, 0.0) and got[T0 + timedelta(minutes=2)] == (0.0, 0.2)


def test_operation_alerts(spark):
    pushes = [(f"t{i}", i, "pushed", 0, 0) for i in range(101)]
    held = events(spark, *pushes, ("q", 1, "pushed", 3, 0), ("q2", 2, "pushed", 6, 0), *[(f"t{i}", i, "started", 7, 0) for i in range(50)])
    brief = events(spark, *pushes, *[(f"t{i}", i, "started", 2, 0) for i in range(50)])
    runs = log(spark, *[("n", 0, "403_forbidden", 100.0)] * 6, *[("n", i, "ok", 100.0) for i in range(1, 6)])
    calm = log(spark, *[("n", 0, "403_forbidden", 1.0)] * 5)
    assert rows(tasks.operation_alerts(held, runs), "rule") == [("collector_blocked",), ("high_latency",), ("queue_backlog",)]
    assert tasks.operation_alerts(brief, calm).count() == 0
    dead = events(spark, ("a", 1, "dead", 0, 0), ("b", 1, "pushed", 2, 0))
    assert rows(tasks.operation_alerts(dead, calm), "rule", "value") == [("dead_letters", 1.0)]


GRID = """<html><head><title>t</title><script>var x='<li data-testid="item-cell">';</script></head><body><ul>
<!-- <li data-testid="item-cell"><a href="/item/m0"></a></li> -->
<li data-testid="item-cell"><div><a href="/item/m1"><img alt="Cup &amp; saucerのサムネイル" src="x.jpg">
 <span class="merPrice big"><span class="currency">¥</span><span class="number__a">1,200</span></span></a></div></li>
<li data-testid="item-cell"><a href="https://jp.mercari.com/item/m2"><div data-testid="thumbnail-sticker" aria-label="売り切れ"></div>
 <span data-testid="thumbnail-item-name">A <b>fine</b> cup &amp; more</span><div data-testid='price'>¥ 300</div></a></li>
<li data-testid="item-cell"><a href="/shops/product/abc"><img src="shop.webp" alt="S"><span class="merPriceX">55</span></a></li>
<li data-testid="item-cell"><a href="/item/m4">no price</a></li>
<li data-testid="item-cell"><a href="/item/m1"><span class="merPrice">¥9</span></a></li>
<li data-testid="item-cell"><a href="/item/z5"><span class="merPrice">¥9</span></a></li>
<li data-testid="item-cell"><span class="merPrice">¥9</span></li>
<li data-testid="item-cell"><a href="/item/m6" title="a > b"><span class="number">7</span></a></li>
</ul><a href="/item/m9"><span class="merPrice">¥9</span></a></body></html>"""


def test_items_of_a_page(spark):
    pages = spark.createDataFrame([(1, "u", GRID), (2, "u", "<p>none</p>"), (3, "u", None)], "page_id long, url string, html string")
    got = rows(listing_pages.items(pages), "source_id", "title", "price", "status", "image_url", "item_url")
    image = "https://static.mercdn.net/thumb/item/webp/%s_1.jpg"
    assert got == [
        ("m1", "Cup & saucer", 1200, "on_sale", image % "m1", "https://jp.mercari.com/item/m1"),
        ("m2", "A fine cup & more", 300, "sold", image % "m2", "https://jp.mercari.com/item/m2"),
        ("shops_abc", "S", 55, "on_sale", "shop.webp", "https://jp.mercari.com/shops/product/abc"),
    ]
    assert rows(listing_pages.items(pages, 2), "source_id") == [("m1",), ("m2",)]


def test_page_checks(spark):
    data = [
        (1, "http://x", "<html><title>Shop</title><body>" + "fine goods " * 20 + "</body></html>"),
        (2, "http://x", "<html><title>Shop</title><body>short</body></html>"),
        (3, "http://x", "<html><title>Just a moment...</title><body>" + "wait " * 30 + "</body></html>"),
        (4, "about:blank", "<html></html>"),
        (5, "http://x", "<title>S</title><body>" + "x " * 40 + "該当する商品はありません</body>"),
        (6, "http://x", "<title>S</title><body><script>captcha()</script>" + "fine goods " * 20 + "</body>"),
    ]
    got = listing_pages.page_checks(spark.createDataFrame(data, "page_id long, url string, html string"))
    assert rows(got, "page_id", "is_blocked", "is_no_items") == [
        (1, False, False), (2, True, False), (3, True, False), (4, True, False), (5, False, True), (6, False, False),
    ]
    assert dict(rows(got, "page_id", "block_type"))[6] == "captcha"


def test_used_pages_and_merge(spark):
    df = spark.createDataFrame(
        [("t", "on_sale", 0, 5), ("t", "on_sale", 1, None), ("t", "on_sale", 2, 0), ("t", "on_sale", 3, 9), ("t", "sold", 3, 9)],
        "task_id string, status string, page int, items int",
    )
    assert rows(listing_pages.used_pages(df), "status", "page") == [("on_sale", 0), ("on_sale", 2), ("sold", 3)]
    one = spark.createDataFrame([("a", "sold")], "source_id string, status string")
    assert rows(listing_pages.merge_status_pages(one, one), "status") == [("on_sale",), ("sold",)]


def test_crawl_plan(spark, meta):
    plan = listing_pages.crawl_plan(meta, 2, 1)
    assert rows(plan, "ip_id", "status", "page") == [(1, "on_sale", 0), (1, "on_sale", 1), (1, "sold", 0)]
    assert listing_pages.crawl_plan(meta, 0, 0).count() == 10


def test_reports(spark, meta):
    now = datetime(2024, 1, 3, 0, 30)
    hours = spark.createDataFrame(
        [(1, datetime(2024, 1, 2, 23), 3, 2, 0.6666), (2, datetime(2024, 1, 2, 23), 1, 1, 1.0), (9, datetime(2024, 1, 2, 23), 1, 1, 1.0), (1, datetime(2024, 1, 1), 1, 1, 1.0)],
        "ip_id long, hour_bucket timestamp_ntz, inflow long, outflow long, liquidity_index double",
    )
    assert rows(reports.hour_report(hours, meta, now), "ip_id", "hour", "liquidity") == [(1, "01-02 23:00", 0.67), (2, "01-02 23:00", 1.0)]
    assert rows(reports.active_hour_board(hours, meta, now), "ip_id") == [(1,)]
    snaps = spark.createDataFrame(
        [(1, f"s{i}", i, "on_sale" if i % 2 else "sold", datetime(2024, 1, 2)) for i in range(20)],
        "ip_id long, source_id string, price int, status string, last_seen_at timestamp_ntz",
    )
    detail = reports.entity_detail(meta, hours, snaps, now).filter("ip_id = 1").first()
    assert len(detail["hours"]) == 2 and len(detail["items"]) == 16 and detail["liquidity_index"] == 0.6666
    assert rows(reports.snapshot_summary(snaps, meta), "total_items", "on_sale", "sold", "avg_price") == [(20, 10, 10, 10.0)]
    board = reports.active_hour_board(hours, meta, now)
    assert rows(reports.entities_with_board(meta, board), "id", "rank") == [(1, 1), (2, None), (3, None)]
    assert rows(reports.display_board(board), "ip_name", "score") == [("初音ミク", 0.82)]
    assert rows(reports.table_counts({"a": snaps, "b": meta}), "table_name", "row_count") == [("a", 20), ("b", 3)]
    open_alerts = spark.createDataFrame([(False,), (True,)], "acknowledged boolean")
    s = reports.system_counts(meta, open_alerts, snaps).first()
    assert (s["active_entities"], s["open_alerts"], s["items_on_sale"]) == (1, 1, 10)
