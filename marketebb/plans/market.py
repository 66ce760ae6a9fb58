"""Queries of the listing life cycle, hour rows, roll-ups, boards and alerts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketebb.functions import measures, times
from marketebb.operators import alerts as alert_rules
from marketebb.operators import boards, hourly, retention, rollup, snapshots, transitions
from marketebb.plans import oracle as o
from marketebb.plans.registry import query, rounded
from marketebb.session import scratch_dir, stage
from marketebb.sources import driver, sinks

NOW = datetime(2024, 1, 31)

BASE = (o.OBS, o.TRANS)
FLOW = (*BASE, o.FLOW)
HOURS = (*FLOW, o.HOURS)
DAYS = (*HOURS, o.SNAP, o.DAYS)
WEEKS = (*DAYS, o.WEEKS)
BUSY = (o.busy(20), o.TRANS, o.FLOW, o.SAMPLE, o.CRAWLS)


def trans(spark: SparkSession, sf: str) -> DataFrame:
    return transitions.transitions(driver.observations(spark, sf))


def staged_flow(spark: SparkSession, sf: str) -> DataFrame:
    """Crawl rows. The flow reads the transitions twice, so what it needs of them is written once."""
    moved = trans(spark, sf).select("ip_id", "crawl_ts", "kind", "copies", "live_until", "given")
    return transitions.crawl_flow(stage(moved, "transitions"))


def hours(spark: SparkSession, sf: str) -> DataFrame:
    return hourly.hour_totals(staged_flow(spark, sf))


def days(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.daily(hours(spark, sf), snapshots.snapshot_delta(driver.observations(spark, sf)))


def busy(spark: SparkSession, sf: str, minutes: int = 20) -> tuple[DataFrame, DataFrame]:
    """Flow and sold sample of the busy view."""
    moved = stage(transitions.transitions(driver.busy_observations(spark, sf, minutes)), "transitions")
    return stage(transitions.crawl_flow(moved), "flow"), hourly.sold_sample(moved)


def _sources(df: DataFrame, low: str = "min_item", high: str = "max_item") -> DataFrame:
    """Cheapest and dearest item by id only."""
    named = df.withColumn("min_source", F.col(low)["source_id"]).withColumn("max_source", F.col(high)["source_id"])
    return named.drop(low, high)


# --- life cycle ---------------------------------------------------------------------------------

TRANSITION_COLUMNS = ["ip_id", "source_id", "crawl_ts", "status", "price", "copies", "kind", "prev_status", "prev_price"]


@query(o.select(f"SELECT {', '.join(TRANSITION_COLUMNS)} FROM trans", *BASE), "transitions")
def transitions_query(spark, sf):
    return trans(spark, sf).select(*TRANSITION_COLUMNS)


@query(
    o.select(
        "SELECT ip_id, crawl_ts, observed, new_listings, sold, price_changes, relisted FROM flow",
        *FLOW,
    )
)
def transition_summary(spark, sf):
    return staged_flow(spark, sf).drop("first_crawl", "inflow", "outflow")


@query(o.select("SELECT ip_id, crawl_ts, first_crawl, inflow, outflow FROM flow", *FLOW))
def first_crawl(spark, sf):
    return staged_flow(spark, sf).select("ip_id", "crawl_ts", "first_crawl", "inflow", "outflow")


@query(
    o.select(
        """SELECT ip_id, source_id, crawl_ts, status, close_price AS price,
                  max(CASE WHEN prev_status IS NULL THEN crawl_ts END)
                    OVER (PARTITION BY ip_id, source_id ORDER BY crawl_ts) AS first_seen
           FROM life""",
        *BASE,
    )
)
def first_seen_life(spark, sf):
    return transitions.first_seen(stage(trans(spark, sf), "transitions"))


@query(
    o.select(
        """SELECT ip_id, count(*) AS live_items
           FROM (SELECT ip_id, source_id, arg_max(live_until, crawl_ts) AS u FROM life GROUP BY 1, 2)
           WHERE u + INTERVAL 1 MICROSECOND > TIMESTAMP '2024-01-30 00:00:00' GROUP BY ip_id""",
        *BASE,
    )
)
def live_items(spark, sf):
    return transitions.live_items(transitions.state_table(trans(spark, sf)), "2024-01-30 00:00:00")


@query(
    o.select(
        """SELECT ip_id, source_id, arg_max(status, crawl_ts) AS status, arg_max(close_price, crawl_ts) AS price,
                  max(CASE WHEN prev_status IS NULL THEN crawl_ts END) AS first_seen, max(crawl_ts) AS last_seen,
                  arg_max(live_until, crawl_ts) + INTERVAL 1 MICROSECOND AS expires_at
           FROM life WHERE ip_id % 7 <> 3 GROUP BY ip_id, source_id""",
        *BASE,
    )
)
def state_after_forget(spark, sf):
    """State look-up table after all listings of some entities were dropped."""
    state = transitions.state_table(trans(spark, sf))
    gone = driver.metadata(spark, sf).filter("id % 7 = 3").select(F.col("id").alias("ip_id"))
    return transitions.forget(state, gone)


@query(
    o.select(
        """SELECT t.ip_id, t.source_id, t.crawl_ts, t.status, t.price, t.last_pos AS pos, kind, prev_status, prev_price,
                  false AS late
           FROM (SELECT o.ip_id, o.source_id, o.crawl_ts, o.status, o.price, o.pos AS last_pos,
                        tr.kind, tr.prev_status, tr.prev_price
                 FROM obs o JOIN trans tr USING (ip_id, source_id, crawl_ts, status, price)) t""",
        *BASE,
    )
)
def stream_state_machine(spark, sf):
    """The life cycle as a stateful stream over the events file."""
    from marketebb.streaming.listing_state import transition_stream

    out = scratch_dir(spark, "stream-out")
    source = driver.observations_of(driver.stream_table(spark, sf, "events"))
    moved = transition_stream(source)
    running = (
        moved.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", scratch_dir(spark, "stream-checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    return spark.read.schema(moved.schema).parquet(out)


@query(
    o.select(
        """SELECT ip_id, source_id, arg_max(status, (crawl_ts, last_pos)) AS status, arg_max(price, (crawl_ts, last_pos)) AS price, max(crawl_ts) AS last_seen
           FROM trans GROUP BY ip_id, source_id""",
        *BASE,
    )
)
def stream_state_lookup(spark, sf):
    """What a stream remembers of each listing, read from its state store as a table."""
    from marketebb.streaming.listing_state import stored_state, transition_stream

    checkpoint = scratch_dir(spark, "lookup-checkpoint")
    moved = transition_stream(driver.observations_of(driver.stream_table(spark, sf, "events")))
    running = moved.writeStream.format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    running.awaitTermination()
    return stored_state(spark, checkpoint)


@query(
    o.select(
        "SELECT ip_id, hour_bucket, inflow, outflow, round(liquidity_index, 4) AS liquidity_index FROM hours",
        *HOURS,
    )
)
def stream_hours(spark, sf):
    """The whole write path as a stream; its hour table."""
    from marketebb.streaming import flow

    root = scratch_dir(spark, "flow")
    source = driver.observations_of(driver.stream_table(spark, sf, "events"))
    flow.start_on_observations(source, root, scratch_dir(spark, "flow-checkpoint")).awaitTermination()
    return flow.hours(spark, root).select("ip_id", "hour_bucket", "inflow", "outflow", F.col("liquidity_index").cast("double").alias("liquidity_index"))


# --- hour rows ----------------------------------------------------------------------------------


@query(
    o.select(
        "SELECT ip_id, hour_bucket, inflow, outflow, round(liquidity_index, 6) AS liquidity_index FROM hours", *HOURS
    )
)
def hourly_flow(spark, sf):
    return rounded(hours(spark, sf), "liquidity_index")


PRICE_SQL = """round(avg_price, 6) AS avg_price, round(median_price, 6) AS median_price, min_price, max_price,
  {sd} AS price_stddev, {n} AS sample_count, min_source, max_source"""
_LAST = PRICE_SQL.format(sd="round(price_stddev, 4)", n="sample_count")


@query(
    o.select(
        "SELECT ip_id, crawl_ts, inflow, outflow, "
        + PRICE_SQL.format(sd="round(sd, 4)", n="n")
        + " FROM crawls",
        *BUSY,
    )
)
def crawl_price_stats(spark, sf):
    """Price statistics of what each crawl found sold, in eight busy entities."""
    rows = _sources(hourly.crawl_stats(*busy(spark, sf))).drop(
        "observed", "new_listings", "sold", "price_changes", "relisted", "first_crawl"
    )
    return rounded(rounded(rows, "avg_price", "median_price"), "price_stddev", digits=4)


def _hour_prices(rows: DataFrame) -> DataFrame:
    rows = rounded(_sources(rows.drop("active_count")), "liquidity_index", "avg_price", "median_price")
    return rounded(rows, "price_stddev", digits=4)


_HOUR_SQL = "SELECT ip_id, hour_bucket, inflow, outflow, round(liquidity_index, 6) AS liquidity_index, "


@query(o.select(_HOUR_SQL + _LAST + " FROM hours_last", *BUSY, o.HOURS_LAST))
def hourly_merge_last_crawl(spark, sf):
    return _hour_prices(hourly.hourly(*busy(spark, sf), "last_crawl"))


@query(o.select(_HOUR_SQL + _LAST + " FROM hours_exact", *BUSY, o.HOURS, o.HOURS_EXACT))
def hourly_price_stats(spark, sf):
    return _hour_prices(hourly.hourly(*busy(spark, sf), "exact"))


@query(o.select(_HOUR_SQL + _LAST + " FROM hours_last", *BUSY, o.HOURS_LAST))
def hour_upsert(spark, sf):
    """Hour rows stored after the first twenty minutes, then the rest of each hour merged in."""
    crawls = stage(hourly.crawl_stats(*busy(spark, sf)), "crawls")
    early = F.minute("crawl_ts") < 20
    old = hourly.hours_from_crawls(crawls.filter(early))
    return _hour_prices(hourly.merge_hours(old, hourly.hours_from_crawls(crawls.filter(~early))))


@query(o.select(_HOUR_SQL + _LAST + " FROM hours_last", *BUSY, o.HOURS_LAST))
def hour_deltas(spark, sf):
    """Hour rows folded from the deltas of their days; each delta is applied twice, as after a failure."""
    crawls = stage(hourly.crawl_stats(*busy(spark, sf)).withColumn("day", F.col("crawl_ts").cast("date")), "crawls")
    path = scratch_dir(spark, "hour-deltas")

    def fold(rows: DataFrame) -> DataFrame:
        return hourly.hours_from_crawls(rows).withColumn("day", F.col("hour_bucket").cast("date"))

    for batch in (0, 1, 0, 1):
        sinks.fold_deltas(crawls.filter((F.minute("crawl_ts") >= 20).cast("int") == batch), path, ["day"], batch, fold)
    return _hour_prices(spark.read.parquet(f"{path}/table").drop("day"))


@query(
    o.select(
        f"""SELECT m.id AS ip_id, arg_max(hour_bucket, hour_bucket) AS hour_bucket,
                   coalesce(arg_max(inflow, hour_bucket), 0) AS inflow,
                   coalesce(arg_max(outflow, hour_bucket), 0) AS outflow,
                   round(max(CASE WHEN r = 1 THEN liquidity_index END), 6) AS liquidity_index
            FROM meta m LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY ip_id ORDER BY hour_bucket DESC) AS r
                                   FROM hours WHERE hour_bucket < {o.NOW}) h ON h.ip_id = m.id GROUP BY m.id""",
        *HOURS,
        o.META,
    )
)
def latest_hour_per_entity(spark, sf):
    return rounded(hourly.latest_hour(hours(spark, sf), driver.metadata(spark, sf), NOW), "liquidity_index")


@query(
    o.select(
        """SELECT ip_id, hour_bucket, inflow, outflow, strftime(hour_bucket, '%H:%M') AS clock,
                  row_number() OVER (PARTITION BY ip_id ORDER BY hour_bucket DESC) AS rn
           FROM hours QUALIFY rn <= 12""",
        *HOURS,
    )
)
def last_n_hours(spark, sf):
    from marketebb.operators.reports import display_hours

    rows = display_hours(hourly.last_hours(hours(spark, sf), 12)).drop("liquidity_index")
    return rows.withColumn("rn", F.col("rn").cast("long"))


@query(
    o.select(
        """SELECT ip_id, hour_bucket, inflow, outflow FROM hours
           WHERE hour_bucket >= TIMESTAMP '2024-01-10 06:00:00' AND hour_bucket <= TIMESTAMP '2024-01-12 06:00:00'
           ORDER BY hour_bucket DESC, ip_id LIMIT 100""",
        *HOURS,
    )
)
def hours_in_range(spark, sf):
    rows = hourly.hours_between(hours(spark, sf), "2024-01-10 06:00:00", "2024-01-12 06:00:00")
    return rows.orderBy(F.desc("hour_bucket"), "ip_id").limit(100).drop("liquidity_index")


# --- snapshots and roll-ups ---------------------------------------------------------------------

SNAP_COLUMNS = "ip_id, source_id, price, status, first_seen_at, last_seen_at, sold_at, price_changed"


@query(o.select(f"SELECT {SNAP_COLUMNS} FROM snap", o.OBS, o.SNAP))
def item_snapshots_upsert(spark, sf):
    """Snapshots built from two halves of the observations, the second merged into the first."""
    seen = driver.observations(spark, sf)
    cut = times.ntz("2024-01-15 00:00:00")
    first = snapshots.snapshot_delta(seen.filter(F.col("crawl_ts") < cut))
    second = snapshots.snapshot_delta(seen.filter(F.col("crawl_ts") >= cut))
    return snapshots.upsert_snapshots(first, second).drop("updated_at")


@query(
    o.select(
        """SELECT ip_id, source_id, min(crawl_ts) FILTER (WHERE status = 'sold') AS sold_at FROM obs
           WHERE length(source_id) > 0 GROUP BY ip_id, source_id""",
        o.OBS,
    )
)
def snapshots_sold_by_transition(spark, sf):
    """The other reading of sold_at: the first time a listing is seen sold."""
    delta = snapshots.snapshot_delta(driver.observations(spark, sf), "transition")
    return delta.select("ip_id", "source_id", "sold_at")


ROLL_SQL = """total_inflow, total_outflow, round(avg_liquidity, 6) AS avg_liquidity, max_sold_price, min_sold_price,
  round(median_sold_price, 6) AS median_sold_price, round(avg_sold_price, 6) AS avg_sold_price, sample_count,
  min_source, max_source"""


def _rolled(df: DataFrame) -> DataFrame:
    named = _sources(df, "min_price_item", "max_price_item")
    return rounded(named, "avg_liquidity", "median_sold_price", "avg_sold_price")


@query(o.select(f"SELECT ip_id, date_bucket, hourly_records, {ROLL_SQL} FROM days", *DAYS))
def daily_rollup(spark, sf):
    return _rolled(days(spark, sf))


@query(o.select(f"SELECT ip_id, week_start, daily_records, {ROLL_SQL} FROM weeks", *WEEKS))
def weekly_rollup(spark, sf):
    return _rolled(rollup.weekly(days(spark, sf)))


@query(o.select(f"SELECT ip_id, month_start, weekly_records, {ROLL_SQL} FROM months", *WEEKS, o.MONTHS))
def monthly_rollup(spark, sf):
    return _rolled(rollup.monthly(rollup.weekly(days(spark, sf))))


SHIP = (o.ITEMS, o.SHIP_HOURS, o.DAYS)


def ship_days(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.daily(driver.shipment_hours(spark, sf), driver.snapshots(spark, sf))


@query(o.select(f"SELECT ip_id, date_bucket, hourly_records, {ROLL_SQL} FROM days", *SHIP))
def daily_rollup_items(spark, sf):
    """The day roll-up over the large item table and several years."""
    return _rolled(ship_days(spark, sf))


@query(
    o.select(
        f"SELECT ip_id, month_start, weekly_records, {ROLL_SQL} FROM months", *SHIP, o.WEEKS, o.MONTHS
    )
)
def monthly_rollup_items(spark, sf):
    """The whole roll-up chain over the large item table and several years."""
    return _rolled(rollup.monthly(rollup.weekly(ship_days(spark, sf))))


@query(
    o.select(
        "SELECT ip_id, hour_bucket, inflow, outflow FROM hours WHERE hour_bucket >= TIMESTAMP '2024-01-24 00:00:00'",
        *HOURS,
    )
)
def clean_up(spark, sf):
    """A clean-up run over stored hour rows: whole days go."""
    root = scratch_dir(spark, "clean-up")
    sinks.replace_buckets(hours(spark, sf), f"{root}/ip_stats_hourly", "hour_bucket")
    retention.clean_stored(spark, root, NOW)
    return spark.read.parquet(f"{root}/ip_stats_hourly").select("ip_id", "hour_bucket", "inflow", "outflow")


@query(
    o.select(
        "SELECT ip_id, hour_bucket, inflow, outflow FROM hours WHERE hour_bucket >= TIMESTAMP '2024-01-24 00:00:00'",
        *HOURS,
    )
)
def retention_hourly(spark, sf):
    return retention.keep_hours(hours(spark, sf), NOW).drop("liquidity_index")


@query(
    o.select(
        """SELECT ip_id, source_id, price, status FROM snap
           WHERE NOT (coalesce(CAST(sold_at AS DATE) = DATE '1998-03-02', false)
                      OR (status <> 'sold' AND CAST(updated_at AS DATE) = DATE '1998-03-02'))""",
        o.ITEMS,
    )
)
def retention_snapshots(spark, sf):
    kept = retention.keep_snapshots(driver.snapshots(spark, sf), datetime(1998, 3, 2).date())
    return kept.select("ip_id", "source_id", "price", "status")


@query(
    o.select(
        """SELECT 'day' AS level, ip_id, date_bucket AS bucket, total_inflow, total_outflow FROM days
           WHERE date_bucket >= DATE '1998-03-03'
           UNION ALL
           SELECT 'week', ip_id, week_start, total_inflow, total_outflow FROM weeks WHERE week_start >= DATE '1997-05-26'""",
        *SHIP,
        o.WEEKS,
    )
)
def retention_days_weeks(spark, sf):
    """Day and week rows that are kept on 1 June 1998."""
    now = datetime(1998, 6, 1, 10)
    rows = stage(ship_days(spark, sf), "days")
    columns = ("ip_id", "bucket", "total_inflow", "total_outflow")
    kept_days = retention.keep_days(rows, now).withColumnRenamed("date_bucket", "bucket").select(F.lit("day").alias("level"), *columns)
    weeks = retention.keep_weeks(rollup.weekly(rows), now).withColumnRenamed("week_start", "bucket")
    return kept_days.unionByName(weeks.select(F.lit("week").alias("level"), *columns))


# --- boards -------------------------------------------------------------------------------------


@query(
    o.select(
        o.board("board_rows", "hot", 10),
        *HOURS,
        o.META,
        f"""board_rows AS (SELECT ip_id, CAST(sum(inflow) AS BIGINT) AS inflow, CAST(sum(outflow) AS BIGINT) AS outflow
            FROM hours WHERE hour_bucket >= {o.NOW} - INTERVAL 23 HOUR AND hour_bucket < {o.NOW} GROUP BY ip_id
            HAVING sum(inflow) > 0 OR sum(outflow) > 0)""",
    )
)
def board_hot_hours(spark, sf):
    board = boards.leaderboard("hot", 23, 10, NOW, driver.metadata(spark, sf), hour_rows=hours(spark, sf))
    return rounded(board, "score")


DAY_BOARD = """board_rows AS (SELECT ip_id, total_inflow AS inflow, total_outflow AS outflow FROM days
               WHERE date_bucket = DATE '2024-01-30')"""
WEEK_BOARD = """board_rows AS (SELECT ip_id, total_inflow AS inflow, total_outflow AS outflow FROM weeks
                WHERE week_start = DATE '2024-01-22')"""


@query(o.select(o.board("board_rows", "inflow", 20), *DAYS, o.META, DAY_BOARD))
def board_inflow_day(spark, sf):
    board = boards.leaderboard("inflow", 24, 20, NOW, driver.metadata(spark, sf), day_rows=days(spark, sf))
    return rounded(board, "score")


@query(o.select(o.board("board_rows", "outflow", 1000), *WEEKS, o.META, WEEK_BOARD))
def board_outflow_week(spark, sf):
    weeks = rollup.weekly(days(spark, sf))
    board = boards.leaderboard("outflow", 168, 1000, NOW, driver.metadata(spark, sf), week_rows=weeks)
    return rounded(board, "score")


@query(
    o.select(
        """SELECT coalesce(median(volume), 0) AS median_volume, CAST(coalesce(sum(ops), 0) AS BIGINT) AS total_ops
           FROM (SELECT inflow + outflow AS volume, inflow + outflow AS ops FROM hot
                 UNION ALL SELECT inflow + outflow, 0 FROM inn UNION ALL SELECT inflow + outflow, 0 FROM outt)""",
        *DAYS,
        DAY_BOARD,
        *[
            f"""{n} AS (SELECT * FROM board_rows WHERE inflow > 0 OR outflow > 0 ORDER BY {s} DESC, ip_id LIMIT 10)"""
            for n, s in (("hot", o.score()), ("inn", "inflow"), ("outt", "outflow"))
        ],
    )
)
def board_median(spark, sf):
    rows = stage(boards.bucket_board_rows(days(spark, sf), "date_bucket", times.yesterday(NOW)), "board")
    return boards.dashboard_totals(*[boards.top_k(rows, kind, 10) for kind in boards.KINDS])


@query(
    o.select(
        f"""SELECT ip_id, inflow, outflow, round({o.score()}, 6) AS hot_score,
                   round(CASE WHEN inflow > 0 THEN CAST(outflow AS DOUBLE) / inflow END, 6) AS liquidity
            FROM (SELECT ip_id, CAST(sum(inflow) AS BIGINT) AS inflow, CAST(sum(outflow) AS BIGINT) AS outflow
                  FROM flow GROUP BY ip_id)""",
        *FLOW,
    )
)
def hot_scores(spark, sf):
    """Hot score and liquidity of every entity over all crawls."""
    totals = staged_flow(spark, sf).groupBy("ip_id").agg(F.sum("inflow").alias("inflow"), F.sum("outflow").alias("outflow"))
    scored = totals.withColumn("hot_score", measures.hot_score(F.col("inflow"), F.col("outflow"))).withColumn(
        "liquidity", measures.liquidity(F.col("inflow"), F.col("outflow"))
    )
    return rounded(scored, "hot_score", "liquidity")


# --- alerts -------------------------------------------------------------------------------------

ALERT_PARTS = (o.busy(360), o.TRANS, o.FLOW)
ALERTS = """
alerts AS (
  SELECT ip_id, 'high_outflow' AS alert_type, 'warning' AS severity,
         printf('出货量达到 %d，超过阈值 %d', outflow, 5) AS message, CAST(outflow AS DOUBLE) AS metric_value,
         5.0 AS threshold_value, crawl_ts
  FROM flow WHERE outflow >= 5
  UNION ALL
  SELECT ip_id, 'low_liquidity', 'info',
         printf('流动性指数 %.4f，低于阈值 %.4f', round(CAST(outflow AS DOUBLE) / inflow, 4), CAST(0.3 AS DOUBLE)),
         CAST(outflow AS DOUBLE) / inflow, 0.3, crawl_ts
  FROM flow WHERE inflow > 0 AND outflow > 0 AND CAST(outflow AS DOUBLE) / inflow < 0.3
  UNION ALL
  SELECT ip_id, 'surge', 'critical',
         printf('流动性指数 %.4f，超过阈值 %.4f (供不应求)', round(CAST(outflow AS DOUBLE) / inflow, 4),
                CAST(2.0 AS DOUBLE)),
         CAST(outflow AS DOUBLE) / inflow, 2.0, crawl_ts
  FROM flow WHERE inflow > 0 AND outflow > 0 AND CAST(outflow AS DOUBLE) / inflow > 2.0)"""


def alert_rows(spark: SparkSession, sf: str) -> DataFrame:
    return alert_rules.alerts(busy(spark, sf, 360)[0], high_outflow=5)


@query(
    o.select(
        """SELECT ip_id, alert_type, severity, message, round(metric_value, 6) AS metric_value,
                  CAST(threshold_value AS DOUBLE) AS threshold_value, date_trunc('hour', crawl_ts) AS hour_bucket,
                  false AS acknowledged, crawl_ts AS created_at FROM alerts""",
        *ALERT_PARTS,
        ALERTS,
    )
)
def alerts(spark, sf):
    return rounded(alert_rows(spark, sf), "metric_value").drop("acknowledged_at")


@query(
    o.select(
        """SELECT a.ip_id, coalesce(m.name, '') AS ip_name, alert_type, severity, left(message, 50) AS message,
                  false AS acknowledged, crawl_ts AS created_at
           FROM (SELECT * FROM alerts ORDER BY crawl_ts DESC, ip_id, alert_type LIMIT 10) a
           LEFT JOIN meta m ON m.id = a.ip_id""",
        *ALERT_PARTS,
        ALERTS,
        o.META,
    )
)
def alerts_with_names(spark, sf):
    return alert_rules.recent(alert_rows(spark, sf), driver.metadata(spark, sf), 10)


@query(
    o.select(
        """SELECT ip_id, alert_type, crawl_ts AS created_at, true AS acknowledged,
                  TIMESTAMP '2024-01-31 00:00:00' AS acknowledged_at, 'acknowledged' AS outcome
           FROM alerts WHERE severity = 'critical'
           UNION ALL
           SELECT ip_id, alert_type, crawl_ts, false, NULL, 'untouched' FROM alerts WHERE severity <> 'critical'""",
        *ALERT_PARTS,
        ALERTS,
    )
)
def alert_acknowledge(spark, sf):
    """All critical alerts acknowledged."""
    rows = stage(alert_rows(spark, sf), "alerts")
    keys = alert_rules.alert_list(rows, severity="critical").select("ip_id", "alert_type", "created_at")
    done = alert_rules.acknowledge(rows, keys, NOW)
    return done.select("ip_id", "alert_type", "created_at", "acknowledged", "acknowledged_at", "outcome")


@query(
    o.select(
        """SELECT a.ip_id, alert_type, severity, crawl_ts AS created_at, coalesce(m.name, '') AS ip_name,
                  (SELECT count(*) FROM alerts WHERE severity <> 'info') AS total
           FROM (SELECT * FROM alerts WHERE severity <> 'info' ORDER BY crawl_ts DESC, ip_id, alert_type LIMIT 50 OFFSET 50) a
           LEFT JOIN meta m ON m.id = a.ip_id""",
        *ALERT_PARTS,
        ALERTS,
        o.META,
    )
)
def alert_page(spark, sf):
    """Second page of the open alerts above info level, newest first, with names."""
    rows = stage(alert_rule_page(spark, sf), "alerts")
    order = [F.desc("created_at"), F.col("ip_id"), F.col("alert_type")]
    named = alert_rules.with_entity_name(boards.page(rows, order, 2, 50), driver.metadata(spark, sf))
    return named.select("ip_id", "alert_type", "severity", "created_at", "ip_name", "total")


def alert_rule_page(spark: SparkSession, sf: str) -> DataFrame:
    return alert_rules.alert_list(alert_rows(spark, sf)).filter("severity <> 'info'")
