"""Explicit schemas (DDL) of the stored tables and of the messages; nothing is ever inferred."""

from __future__ import annotations

PRICE_ITEM = "struct<source_id: string, title: string, price: int, image_url: string, item_url: string>"

ENTITIES = (
    "id bigint, name string, name_en string, name_cn string, category string, tags array<string>, "
    "image_url string, external_id string, notes string, weight decimal(5,2), status string, "
    "last_crawled_at timestamp_ntz, created_at timestamp_ntz, updated_at timestamp_ntz, deleted_at timestamp_ntz"
)

HOURS = (
    "ip_id bigint, hour_bucket timestamp_ntz, inflow bigint, outflow bigint, liquidity_index decimal(8,4), "
    "active_count int, avg_price decimal(10,2), median_price decimal(10,2), min_price decimal(10,2), "
    f"max_price decimal(10,2), min_item {PRICE_ITEM}, max_item {PRICE_ITEM}, price_stddev decimal(10,2), "
    "sample_count bigint, created_at timestamp_ntz"
)


def _rolled(bucket: str, records: str) -> str:
    return (
        f"ip_id bigint, {bucket} date, total_inflow bigint, total_outflow bigint, avg_liquidity decimal(8,4), "
        "max_sold_price decimal(10,2), min_sold_price decimal(10,2), median_sold_price decimal(10,2), "
        f"avg_sold_price decimal(10,2), min_price_item {PRICE_ITEM}, max_price_item {PRICE_ITEM}, "
        f"sample_count bigint, {records} bigint, created_at timestamp_ntz"
    )


DAYS = _rolled("date_bucket", "hourly_records")
WEEKS = _rolled("week_start", "daily_records")
MONTHS = _rolled("month_start", "weekly_records")

SNAPSHOTS = (
    "ip_id bigint, source_id string, title string, price int, status string, image_url string, item_url string, "
    "first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, sold_at timestamp_ntz, price_changed boolean, "
    "created_at timestamp_ntz, updated_at timestamp_ntz"
)

ALERTS = (
    "ip_id bigint, alert_type string, severity string, message string, metric_value decimal(10,4), "
    "threshold_value decimal(10,4), hour_bucket timestamp_ntz, acknowledged boolean, "
    "acknowledged_at timestamp_ntz, created_at timestamp_ntz"
)

SCHEDULE = "ip_id bigint, next_at timestamp_ntz"

TABLES = {
    "ip_metadata": ENTITIES,
    "ip_stats_hourly": HOURS,
    "ip_stats_daily": DAYS,
    "ip_stats_weekly": WEEKS,
    "ip_stats_monthly": MONTHS,
    "item_snapshots": SNAPSHOTS,
    "ip_alerts": ALERTS,
    "schedule": SCHEDULE,
}

# Messages: 64-bit numbers come as strings, fields with a zero value may be missing.
MESSAGE_ITEMS = (
    "array<struct<sourceId: string, title: string, price: int, imageUrl: string, itemUrl: string, status: string>>"
)
CRAWL_RESULT = (
    "ipId string, taskId string, crawledAt string, errorMessage string, totalFound int, pagesCrawled int, "
    f"retryCount int, items {MESSAGE_ITEMS}"
)
TASK = (
    "ipId string, keyword string, taskId string, createdAt string, retryCount int, pagesOnSale int, pagesSold int, "
    "event string, at string"
)
SEED_FILE = (
    "ips array<struct<name: string, name_en: string, name_cn: string, category: string, tags: array<string>, "
    "image_url: string, external_id: string, weight: double, notes: string>>"
)
PAGES = "page_id bigint, url string, html string"
