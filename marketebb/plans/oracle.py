"""SQL building blocks for the comparison queries: each is a list of named sub-selects."""

from __future__ import annotations

NOW = "TIMESTAMP '2024-01-31 00:00:00'"

OBS = """
obs AS (
  SELECT user_id AS ip_id,
         'm' || CAST(CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) % 20 AS VARCHAR) AS source_id,
         CASE WHEN event_type = 'purchase' THEN 'sold' ELSE 'available' END AS status,
         CAST(round(value * 100) AS INTEGER) AS price,
         time_bucket(INTERVAL 6 HOUR, ts) AS crawl_ts,
         event_id AS pos
  FROM events)"""

BUSY = """
obs AS (
  SELECT user_id % 8 AS ip_id,
         'm' || CAST(CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) AS VARCHAR) AS source_id,
         CASE WHEN event_type IN ('purchase', 'click') THEN 'sold' ELSE 'available' END AS status,
         CAST(round(value * 100) AS INTEGER) AS price,
         time_bucket(INTERVAL {minutes} MINUTE, ts) AS crawl_ts,
         event_id AS pos
  FROM events)"""

TRANS = """
seen AS (
  SELECT ip_id, source_id, crawl_ts, status, price, count(*) AS copies, max(pos) AS last_pos
  FROM obs WHERE length(source_id) > 0 GROUP BY ip_id, source_id, crawl_ts, status, price),
closes AS (
  SELECT ip_id, source_id, crawl_ts, arg_max(status, last_pos) AS status, arg_max(price, last_pos) AS price,
         max(last_pos) AS last_pos
  FROM seen GROUP BY ip_id, source_id, crawl_ts),
chain AS (
  SELECT *, lag(status) OVER w AS ps, lag(price) OVER w AS pp, lag(crawl_ts) OVER w AS pt, lead(crawl_ts) OVER w AS nt
  FROM closes WINDOW w AS (PARTITION BY ip_id, source_id ORDER BY crawl_ts)),
life AS (
  SELECT ip_id, source_id, crawl_ts, status, price AS close_price, last_pos AS close_pos,
         CASE WHEN pt + CASE WHEN ps = 'sold' THEN INTERVAL 48 HOUR ELSE INTERVAL 24 HOUR END > crawl_ts
              THEN ps END AS prev_status,
         CASE WHEN pt + CASE WHEN ps = 'sold' THEN INTERVAL 48 HOUR ELSE INTERVAL 24 HOUR END > crawl_ts
              THEN pp END AS prev_price,
         least(crawl_ts + CASE WHEN status = 'sold' THEN INTERVAL 48 HOUR ELSE INTERVAL 24 HOUR END
               - INTERVAL 1 MICROSECOND, nt) AS live_until
  FROM chain),
trans AS (
  SELECT s.ip_id, s.source_id, s.crawl_ts, s.status, s.price, s.copies, s.last_pos, l.close_price,
         l.prev_status, l.prev_price, s.last_pos = l.close_pos AS is_close,
         CASE WHEN l.prev_status IS NULL THEN CASE WHEN s.status = 'sold' THEN 'new_sold' ELSE 'new_listing' END
              WHEN l.prev_status = 'available' AND s.status = 'sold' THEN 'sold'
              WHEN l.prev_status = 'sold' AND s.status = 'available' THEN 'relisted'
              WHEN l.prev_status = 'available' AND s.status = 'available' AND l.prev_price <> s.price
              THEN 'price_change' END AS kind
  FROM seen s JOIN life l USING (ip_id, source_id, crawl_ts))"""

FLOW = """
counts AS (
  SELECT ip_id, crawl_ts, sum(copies) AS observed,
         coalesce(sum(copies) FILTER (WHERE kind = 'new_listing'), 0) AS new_listings,
         coalesce(sum(copies) FILTER (WHERE kind IN ('sold', 'new_sold')), 0) AS sold,
         coalesce(sum(copies) FILTER (WHERE kind = 'price_change'), 0) AS price_changes,
         coalesce(sum(copies) FILTER (WHERE kind = 'relisted'), 0) AS relisted
  FROM trans GROUP BY ip_id, crawl_ts),
until_ AS (SELECT ip_id, crawl_ts, max(live_until) AS u FROM life GROUP BY ip_id, crawl_ts),
known AS (
  SELECT ip_id, crawl_ts, max(u) OVER (PARTITION BY ip_id ORDER BY crawl_ts
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS alive
  FROM until_),
flow AS (
  SELECT c.ip_id, c.crawl_ts, CAST(observed AS BIGINT) AS observed, CAST(new_listings AS BIGINT) AS new_listings,
         CAST(sold AS BIGINT) AS sold, CAST(price_changes AS BIGINT) AS price_changes,
         CAST(relisted AS BIGINT) AS relisted, (alive IS NULL OR alive < c.crawl_ts) AS first_crawl,
         CAST(CASE WHEN alive IS NULL OR alive < c.crawl_ts THEN 0 ELSE new_listings END AS BIGINT) AS inflow,
         CAST(CASE WHEN alive IS NULL OR alive < c.crawl_ts THEN 0 ELSE sold END AS BIGINT) AS outflow
  FROM counts c JOIN known k USING (ip_id, crawl_ts))"""

SAMPLE = """
sample AS (
  SELECT t.ip_id, t.crawl_ts, t.source_id, t.close_price AS price, t.last_pos, unnest(range(t.copies)) AS copy
  FROM trans t JOIN flow f ON f.ip_id = t.ip_id AND f.crawl_ts = t.crawl_ts
  WHERE t.kind IN ('sold', 'new_sold') AND NOT f.first_crawl AND t.close_price > 0)"""

_STATS = """avg(price) AS avg_price, quantile_cont(price, 0.5) AS median_price, min(price) AS min_price,
         max(price) AS max_price, stddev_pop(price) AS sd, count(*) AS n,
         first(source_id ORDER BY price, crawl_ts, last_pos, source_id) AS min_source,
         first(source_id ORDER BY price DESC, crawl_ts, last_pos, source_id) AS max_source"""

CRAWLS = f"""
crawl_prices AS (SELECT ip_id, crawl_ts, {_STATS} FROM sample GROUP BY ip_id, crawl_ts),
crawls AS (
  SELECT f.*, avg_price, median_price, min_price, max_price, nullif(sd, 0) AS sd, coalesce(n, 0) AS n,
         min_source, max_source
  FROM flow f LEFT JOIN crawl_prices p USING (ip_id, crawl_ts))"""

HOURS = """
hours AS (
  SELECT ip_id, date_trunc('hour', crawl_ts) AS hour_bucket, CAST(sum(inflow) AS BIGINT) AS inflow,
         CAST(sum(outflow) AS BIGINT) AS outflow,
         CASE WHEN sum(inflow) > 0 THEN CAST(sum(outflow) AS DOUBLE) / sum(inflow) END AS liquidity_index
  FROM flow GROUP BY 1, 2)"""

HOURS_LAST = """
ranked AS (
  SELECT *, date_trunc('hour', crawl_ts) AS hour_bucket,
         row_number() OVER (PARTITION BY ip_id, date_trunc('hour', crawl_ts) ORDER BY crawl_ts DESC) AS r
  FROM crawls),
hours_last AS (
  SELECT ip_id, hour_bucket, CAST(sum(inflow) AS BIGINT) AS inflow, CAST(sum(outflow) AS BIGINT) AS outflow,
         CASE WHEN sum(inflow) > 0 THEN CAST(sum(outflow) AS DOUBLE) / sum(inflow) END AS liquidity_index,
         max(avg_price) FILTER (WHERE r = 1) AS avg_price, max(median_price) FILTER (WHERE r = 1) AS median_price,
         min(min_price) AS min_price, max(max_price) AS max_price,
         max(sd) FILTER (WHERE r = 1) AS price_stddev, CAST(sum(n) AS BIGINT) AS sample_count,
         first(min_source ORDER BY min_price, crawl_ts) FILTER (WHERE min_price IS NOT NULL) AS min_source,
         first(max_source ORDER BY max_price DESC, crawl_ts) FILTER (WHERE max_price IS NOT NULL) AS max_source
  FROM ranked GROUP BY ip_id, hour_bucket)"""

HOURS_EXACT = f"""
hour_prices AS (
  SELECT ip_id, date_trunc('hour', crawl_ts) AS hour_bucket, {_STATS} FROM sample GROUP BY 1, 2),
hours_exact AS (
  SELECT h.*, avg_price, median_price, min_price, max_price, nullif(sd, 0) AS price_stddev,
         coalesce(n, 0) AS sample_count, min_source, max_source
  FROM hours h LEFT JOIN hour_prices USING (ip_id, hour_bucket))"""

SNAP = """
snap AS (
  SELECT ip_id, source_id, arg_max(price, pos) AS price,
         CASE WHEN arg_max(status, pos) = 'sold' THEN 'sold' ELSE 'on_sale' END AS status,
         min(crawl_ts) AS first_seen_at, max(crawl_ts) AS last_seen_at,
         CASE WHEN arg_min(status, pos) = 'sold' THEN min(crawl_ts) END AS sold_at,
         min(price) <> max(price) AS price_changed
  FROM obs WHERE length(source_id) > 0 GROUP BY ip_id, source_id)"""

ITEMS = """
snap AS (
  SELECT l_suppkey AS ip_id, CAST(l_orderkey AS VARCHAR) || '_' || CAST(l_linenumber AS VARCHAR) AS source_id,
         CAST(round(l_extendedprice) AS INTEGER) AS price,
         CASE WHEN l_linestatus = 'F' THEN 'sold' ELSE 'on_sale' END AS status,
         CASE WHEN l_linestatus = 'F' THEN l_shipdate END AS sold_at,
         l_shipdate AS last_seen_at, l_shipdate AS updated_at
  FROM lineitem)"""

SHIP_HOURS = """
hours AS (
  SELECT l_suppkey AS ip_id, date_trunc('hour', l_shipdate) AS hour_bucket,
         count(*) FILTER (WHERE l_linestatus = 'O') AS inflow, count(*) FILTER (WHERE l_linestatus = 'F') AS outflow,
         CASE WHEN count(*) FILTER (WHERE l_linestatus = 'O') > 0
              THEN CAST(count(*) FILTER (WHERE l_linestatus = 'F') AS DOUBLE)
                   / count(*) FILTER (WHERE l_linestatus = 'O') END AS liquidity_index
  FROM lineitem GROUP BY 1, 2)"""

DAYS = """
day_flow AS (
  SELECT ip_id, CAST(hour_bucket AS DATE) AS date_bucket, CAST(sum(inflow) AS BIGINT) AS total_inflow,
         CAST(sum(outflow) AS BIGINT) AS total_outflow, avg(liquidity_index) AS avg_liquidity,
         count(*) AS hourly_records
  FROM hours GROUP BY 1, 2),
day_sold AS (
  SELECT ip_id, CAST(sold_at AS DATE) AS date_bucket, max(price) AS max_sold_price, min(price) AS min_sold_price,
         quantile_cont(price, 0.5) AS median_sold_price, avg(price) AS avg_sold_price, count(*) AS n,
         first(source_id ORDER BY price, sold_at, source_id) AS min_source,
         first(source_id ORDER BY price DESC, sold_at, source_id) AS max_source
  FROM snap WHERE sold_at IS NOT NULL GROUP BY 1, 2),
days AS (
  SELECT f.*, max_sold_price, min_sold_price, median_sold_price, avg_sold_price, coalesce(n, 0) AS sample_count,
         min_source, max_source
  FROM day_flow f LEFT JOIN day_sold s USING (ip_id, date_bucket))"""


def _roll(name: str, source: str, bucket: str, target: str, to: str, records: str) -> str:
    return f"""
{name} AS (
  SELECT ip_id, CAST({to} AS DATE) AS {target}, CAST(sum(total_inflow) AS BIGINT) AS total_inflow,
         CAST(sum(total_outflow) AS BIGINT) AS total_outflow, avg(avg_liquidity) AS avg_liquidity,
         max(max_sold_price) AS max_sold_price, min(min_sold_price) AS min_sold_price,
         quantile_cont(median_sold_price, 0.5) AS median_sold_price,
         sum(avg_sold_price * sample_count) FILTER (WHERE avg_sold_price IS NOT NULL AND sample_count > 0)
         / sum(sample_count) FILTER (WHERE avg_sold_price IS NOT NULL AND sample_count > 0) AS avg_sold_price,
         CAST(sum(sample_count) AS BIGINT) AS sample_count, count(*) AS {records},
         first(min_source ORDER BY min_sold_price, {bucket}) FILTER (WHERE min_sold_price IS NOT NULL) AS min_source,
         first(max_source ORDER BY max_sold_price DESC, {bucket})
           FILTER (WHERE max_sold_price IS NOT NULL) AS max_source
  FROM {source} GROUP BY 1, 2)"""


WEEKS = _roll("weeks", "days", "date_bucket", "week_start", "date_trunc('week', date_bucket)", "daily_records")
MONTHS = _roll("months", "weeks", "week_start", "month_start", "date_trunc('month', week_start)", "weekly_records")

META = """
meta AS (
  SELECT c_custkey AS id, c_name AS name, 'en ' || c_name AS name_en, 'cn ' || c_name AS name_cn,
         c_mktsegment AS category, 1.0 + (c_custkey % 4) / 4.0 AS weight,
         CASE WHEN c_custkey % 10 = 0 THEN 'paused' WHEN c_custkey % 37 = 5 THEN 'deleted' ELSE 'active' END AS status
  FROM customer)"""

TASKS = """
tasks AS (
  SELECT 't_' || CAST(user_id AS VARCHAR) || '_' || CAST(event_id % 3 AS VARCHAR) AS task_id, user_id AS ip_id,
         CASE WHEN event_type IN ('signup', 'view') THEN 'pushed' WHEN event_type = 'click' THEN 'started'
              WHEN event_type = 'purchase' THEN 'acked' ELSE 'dead' END AS event,
         ts, CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) % 5 AS retry_count, event_id AS seq
  FROM events)"""

RUNS = """
kruns AS (SELECT *, CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) AS k FROM events),
runs AS (
  SELECT event_id AS task_id, 'n' || CAST(user_id % 16 AS VARCHAR) AS node, ts,
         CASE WHEN event_type <> 'error' THEN CASE WHEN k % 9 = 0 THEN 'empty_result' ELSE 'success' END
              WHEN k % 2 = 0 THEN '403_forbidden' ELSE 'error' END AS outcome,
         CASE WHEN k % 3 = 0 THEN 'proxy' ELSE 'direct' END AS mode, value AS duration_s
  FROM kruns)"""

ENTRIES = """
entries AS (
  SELECT c_custkey AS pos,
         CASE WHEN c_custkey % 50 = 7 THEN '' WHEN c_custkey % 3 = 0 THEN c_name
              ELSE 'New#' || CAST(c_custkey % 400 AS VARCHAR) END AS name,
         'x-' || c_mktsegment AS category, CAST(c_custkey % 5 - 1 AS DOUBLE) AS weight
  FROM customer)"""


def busy(minutes: int) -> str:
    return BUSY.format(minutes=minutes)


def score(inflow: str = "inflow", outflow: str = "outflow") -> str:
    return f"({outflow} + 1.0) / ({inflow} + 1.0) * ln({outflow} + 1.0)"


def board(source: str, kind: str, limit: int) -> str:
    """Ranked rows of (ip_id, inflow, outflow) with names."""
    value = {"hot": score(), "inflow": "CAST(inflow AS DOUBLE)", "outflow": "CAST(outflow AS DOUBLE)"}[kind]
    return f"""
SELECT b.ip_id, b.inflow, b.outflow, round(b.score, 6) AS score, b.rank, coalesce(m.name, '') AS ip_name,
       coalesce(m.name_en, '') AS ip_name_en
FROM (SELECT *, row_number() OVER (ORDER BY score DESC, ip_id) AS rank
      FROM (SELECT ip_id, inflow, outflow, {value} AS score FROM {source} WHERE inflow > 0 OR outflow > 0)) b
LEFT JOIN meta m ON m.id = b.ip_id WHERE b.rank <= {limit}"""


def select(body: str, *parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",".join(parts) + "\n" + body.strip()
