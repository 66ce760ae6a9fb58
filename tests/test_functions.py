from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from marketebb.functions import measures, text, times
from tests.conftest import value


def ts(spark, fn, stamp):
    return str(value(spark, fn(times.ntz(stamp))))


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Tokyo"])
def test_buckets_do_not_depend_on_the_session_zone(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        # 02:30 on that day does not exist in New York
        stamp = "2024-03-10 02:35:22.123"
        assert ts(spark, times.hour_floor, stamp) == "2024-03-10 02:00:00"
        assert ts(spark, lambda c: times.from_micros(times.micros(c)), stamp) == "2024-03-10 02:35:22.123000"
        assert ts(spark, lambda c: times.align_up(c, 15), stamp) == "2024-03-10 02:45:00"
        assert ts(spark, lambda c: times.minutes_floor(c, 20), stamp) == "2024-03-10 02:20:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize(
    ("stamp", "expected"),
    [
        ("2026-01-18 14:35:22.123", "14:00:00"),
        ("2026-01-18 00:00:00", "00:00:00"),
        ("2026-01-18 23:59:59.999", "23:00:00"),
    ],
)
def test_hour(spark, stamp, expected):
    assert ts(spark, times.hour_floor, stamp).endswith(expected)


@pytest.mark.parametrize(
    ("stamp", "expected"), [("12:00", "12:00"), ("12:17", "12:30"), ("12:31", "12:45"), ("12:45", "12:45"), ("12:59", "13:00")]
)
def test_slot(spark, stamp, expected):
    assert ts(spark, lambda c: times.align_up(c, 15), f"2026-01-18 {stamp}:00") == f"2026-01-18 {expected}:00"


def test_weeks_and_months(spark):
    assert value(spark, times.monday_of(times.day("2026-01-18"))) == date(2026, 1, 12)
    assert value(spark, times.monday_of(times.day("2026-01-19"))) == date(2026, 1, 19)
    assert value(spark, times.month_start(times.day("2026-02-28"))) == date(2026, 2, 1)
    now = datetime(2026, 1, 18, 9, 30)
    assert times.last_full_week(now) == date(2026, 1, 5)
    assert times.yesterday(now) == date(2026, 1, 17)
    assert times.last_month(now) == date(2025, 12, 1)
    assert times.next_month(date(2025, 12, 1)) == date(2026, 1, 1)
    assert times.current_hour(now) == datetime(2026, 1, 18, 9)
    assert value(spark, times.same_day(times.ntz("2026-01-18 01:00:00"), times.ntz("2026-01-18 23:00:00")))


def test_epoch_and_format(spark):
    local = times.from_epoch(F.lit(1705311000).cast("long"))
    assert str(value(spark, local)) == "2024-01-15 18:30:00"
    assert value(spark, times.format_rfc3339(local)) == "2024-01-15T18:30:00+09:00"
    assert value(spark, times.format_rfc3339(times.ntz("2024-01-15 00:00:00"), "UTC")) == "2024-01-15T00:00:00Z"


@pytest.mark.parametrize(
    ("given", "ok"),
    [
        ("2024-01-15T10:30:00Z", True),
        ("2024-01-15T10:30:00+09:00", True),
        ("2024-01-15", True),
        ("2024-01-15 10:30:00", True),
        ("not-a-date", False),
        ("", False),
        ("2024-01", False),
        ("2024-13-45", False),
    ],
)
def test_parse_time(spark, given, ok):
    parsed = value(spark, times.parse_time(F.lit(given)))
    assert (parsed is not None) == ok


def test_parse_time_reads_offsets(spark):
    same = times.parse_time(F.lit("2024-01-15T10:30:00+09:00")) == times.parse_time(F.lit("2024-01-15 01:30:00"))
    assert value(spark, same)


@pytest.mark.parametrize(("i", "o", "expected"), [(355, 28, 0.274302), (0, 0, 0.0), (0, 1, 1.386294), (355, 128, 1.760999)])
def test_hot_score(spark, i, o, expected):
    assert value(spark, measures.hot_score(F.lit(i), F.lit(o))) == pytest.approx(expected, abs=1e-6)


@pytest.mark.parametrize(("i", "o", "expected"), [(0, 5, None), (10, 5, 0.5), (5, 10, 2.0), (5, 0, 0.0), (5, 5, 1.0)])
def test_liquidity(spark, i, o, expected):
    assert value(spark, measures.liquidity(F.lit(i), F.lit(o))) == expected


@pytest.mark.parametrize(
    ("w", "minutes"), [(1.0, 60), (2.0, 30), (10.0, 15), (0.1, 240), (0.0, 60), (-1.0, 60), (0.5, 120), (None, 60)]
)
def test_interval(spark, w, minutes):
    weight = F.lit(w).cast("double")
    assert value(spark, measures.interval_us(weight, 3600, 900, 14400)) == minutes * 60_000_000


def test_weight_round_trip(spark):
    assert value(spark, measures.weight_to_minutes(F.lit(1.14), 120)) == 105
    assert value(spark, measures.minutes_to_weight(F.lit(105), 120)) == pytest.approx(120 / 105)
    assert value(spark, measures.minutes_to_weight(F.lit(0), 120)) == 1.0


@pytest.mark.parametrize(
    ("given", "expected"),
    [
        ("¥ 1,200", 1200),
        ("￥300", 300),
        ("1,999", 1999),
        ("12 x 345", 345),
        ("12 or 34", 34),
        ("007 or 12", 7),
        ("abc", None),
        ("", None),
        ("id 99999999999999999999 price 5", 5),
        ("was 9999 now ¥500", 500),
    ],
)
def test_price_value(spark, given, expected):
    assert value(spark, text.price_value(F.lit(given))) == expected


def test_links(spark):
    assert value(spark, text.listing_id(F.lit("https://x/item/m123"))) == "m123"
    assert value(spark, text.listing_id(F.lit("/item/z123"))) == ""
    assert value(spark, text.listing_id(F.lit("/shops/product/ab9"))) == "shops_ab9"
    assert value(spark, text.listing_id(F.lit("/search"))) == ""
    for given, expected in [
        ("", ""),
        ("http://a/b", "http://a/b"),
        ("//a/b", "https://a/b"),
        ("/item/m1", text.SITE + "/item/m1"),
    ]:
        assert value(spark, text.absolute_url(F.lit(given))) == expected


def test_search_url(spark):
    url = value(spark, text.search_url(F.lit("a b*~+&"), F.lit("sold"), F.lit(2)))
    assert url == text.SEARCH_URL + (
        "?keyword=a%20b%2A~%2B%26&order=desc&sort=created_time&status=sold_out%7Ctrading&page_token=v1:2"
    )
    first = value(spark, text.search_url(F.lit("初音"), F.lit("on_sale"), F.lit(0)))
    assert first.endswith("?keyword=%E5%88%9D%E9%9F%B3&order=desc&sort=created_time&status=on_sale")
    assert value(spark, text.param_status(F.lit("sold_out|trading"))) == "sold"
    assert value(spark, text.param_status(F.lit("on_sale"))) == "on_sale"


@pytest.mark.parametrize(
    ("title", "html", "expected"),
    [
        ("Just a moment...", "<html><body>x</body></html>", "cloudflare_challenge"),
        ("ok", "<iframe src=CLOUDFLARE>", "cloudflare_challenge"),
        ("ok", "<div>reCAPTCHA</div>", "captcha"),
        ("Access Denied", "<body>x</body>", "403_forbidden"),
        ("ok", "<body>リクエストが多すぎます</body>", "429_rate_limited"),
        ("ok", "<div class='merErrorPage'></div>", "mercari_error_page"),
        ("", "<html></html>", "blank_page"),
        ("about:blank", "<body>" + "x" * 200 + "</body>", "empty_title"),
        ("ok", "<body>net::ERR_PROXY</body>", "connection_error"),
        ("ok", "<p>tiny</p>", "suspicious_minimal_page"),
        ("ok", "<body>tiny</body>", "unknown"),
    ],
)
def test_block_type(spark, title, html, expected):
    t, h = F.lit(title), F.lit(html)
    assert value(spark, text.block_type(t, h, F.lower(t), F.lower(h))) == expected


@pytest.mark.parametrize(
    ("message", "expected"),
    [
        ("context deadline exceeded", "timeout"),
        ("blocked_page: timeout", "blocked"),
        ("HTTP 403", "blocked"),
        ("page timeout while navigate", "timeout"),
        ("net::ERR_FAILED", "network_error"),
        ("extract items", "parse_error"),
        ("odd", "unknown"),
    ],
)
def test_error_class(spark, message, expected):
    assert value(spark, text.error_class(F.lower(F.lit(message)))) == expected


def test_outcomes(spark):
    none = F.lit(None).cast("string")
    assert value(spark, text.run_outcome(none, F.lit(3))) == "success"
    assert value(spark, text.run_outcome(none, F.lit(0))) == "empty_result"
    assert value(spark, text.run_outcome(F.lit("blocked"), F.lit(0))) == "403_forbidden"
    assert value(spark, text.run_outcome(F.lit("timeout"), F.lit(0))) == "error"
    assert value(spark, text.proxy_worthy(F.lit("timeout"))) and not value(spark, text.proxy_worthy(F.lit("unknown")))
