"""Queries of schedule, entities, reports, pages and collecting jobs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketebb.functions import text, times
from marketebb.operators import boards, entities, listing_pages, reports, schedule, snapshots, tasks, weights
from marketebb.plans import market
from marketebb.plans import oracle as o
from marketebb.plans.registry import ORACLES, query, rounded
from marketebb.session import scratch_dir, stage
from marketebb.sources import driver, readers
from marketebb.streaming import task_state

NOON = datetime(2024, 1, 30, 12)
TS_NOON = "TIMESTAMP '2024-01-30 12:00:00'"

# --- schedule -----------------------------------------------------------------------------------

PAUSE = "to_microseconds(CAST(floor(greatest(least(7200000000.0 / {w}, 7200000000.0), 3600000000.0)) AS BIGINT))"
CRAWLED = (
    o.OBS,
    o.META,
    """crawled AS (SELECT m.*, l.at AS last_crawled_at FROM meta m
       LEFT JOIN (SELECT ip_id, max(crawl_ts) AS at FROM obs GROUP BY 1) l ON l.ip_id = m.id)""",
    """act AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS position FROM crawled WHERE status = 'active')""",
    f"""sched AS (
       SELECT id AS ip_id, CASE WHEN last_crawled_at + {PAUSE.format(w='weight')} >= {TS_NOON}
         THEN date_trunc('second', last_crawled_at + {PAUSE.format(w='weight')})
         ELSE {TS_NOON} + position * 10 * INTERVAL 1 SECOND END AS next_at FROM act)""",
)


def crawled_entities(spark: SparkSession, sf: str) -> DataFrame:
    return entities.touch_crawled(driver.metadata(spark, sf), driver.observations(spark, sf))


def first_schedule(spark: SparkSession, sf: str) -> DataFrame:
    return schedule.initial(crawled_entities(spark, sf), NOON)


@query(o.select("SELECT ip_id, next_at FROM sched", *CRAWLED))
def schedule_initial(spark, sf):
    return first_schedule(spark, sf)


@query(
    o.select(
        f"""SELECT ip_id, crawl_ts, time_bucket(INTERVAL 15 MINUTE,
                  crawl_ts + {PAUSE.format(w='weight')}
                  + INTERVAL 15 MINUTE - INTERVAL 1 MICROSECOND) AS next_at
            FROM (SELECT DISTINCT ip_id, time_bucket(INTERVAL 20 MINUTE, ts) + INTERVAL 7 MINUTE AS crawl_ts
                  FROM (SELECT user_id AS ip_id, ts FROM events)) c JOIN meta ON id = ip_id""",
        o.META,
    )
)
def schedule_next(spark, sf):
    """Next time after each crawl, aligned to the quarter hour."""
    seen = driver.table(spark, sf, "events").select(
        F.col("user_id").alias("ip_id"),
        times.plus_seconds(times.minutes_floor(F.col("ts"), 20), F.lit(420)).alias("crawl_ts"),
    )
    w = driver.metadata(spark, sf).select(F.col("id").alias("ip_id"), F.col("weight").alias("new_weight"))
    return schedule.next_times(seen.distinct().join(w, "ip_id"))


@query(
    o.select(
        """SELECT ip_id, next_at, row_number() OVER (ORDER BY next_at, ip_id) AS position,
                  CAST(ceil(row_number() OVER (ORDER BY next_at, ip_id) / 50.0) AS BIGINT) AS batch
           FROM sched WHERE next_at <= TIMESTAMP '2024-01-30 14:00:00'""",
        *CRAWLED,
    )
)
def schedule_due(spark, sf):
    """Due entities in order, numbered into batches of fifty."""
    return schedule.due_batches(first_schedule(spark, sf), datetime(2024, 1, 30, 14))


@query(
    o.select(
        """SELECT ip_id, next_at, CASE WHEN ip_id % 5 = 0 THEN 'dropped' ELSE 'kept' END AS verdict
           FROM sched WHERE next_at <= TIMESTAMP '2024-01-30 14:00:00'""",
        *CRAWLED,
    )
)
def schedule_due_split(spark, sf):
    """Due entities that are still active, and those that go off the schedule (ids dividing by 5 were paused)."""
    paused = entities.partial_update(
        driver.metadata(spark, sf), driver.metadata(spark, sf).filter("id % 5 = 0").select("id", F.lit("paused").alias("status"))
    )
    kept, dropped = schedule.split_due(schedule.due(first_schedule(spark, sf), datetime(2024, 1, 30, 14)), paused)
    return kept.withColumn("verdict", F.lit("kept")).unionByName(dropped.withColumn("verdict", F.lit("dropped")))


HALF = "half AS (SELECT * FROM sched WHERE ip_id % 3 <> 0), other AS (SELECT * FROM meta WHERE id % 4 <> 1)"


def _half(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A schedule and a dimension that have drifted apart."""
    return first_schedule(spark, sf).filter("ip_id % 3 <> 0"), driver.metadata(spark, sf).filter("id % 4 <> 1")


@query(
    o.select(
        f"""SELECT id AS ip_id, {TS_NOON} AS next_at FROM other WHERE status = 'active'
            AND id NOT IN (SELECT ip_id FROM half)""",
        *CRAWLED,
        HALF,
    )
)
def schedule_refresh_add(spark, sf):
    return schedule.to_add(*_half(spark, sf), NOON)


@query(
    o.select(
        "SELECT * FROM half WHERE ip_id NOT IN (SELECT id FROM other WHERE status = 'active')", *CRAWLED, HALF
    )
)
def schedule_refresh_drop(spark, sf):
    return schedule.to_drop(*_half(spark, sf))


@query(
    o.select(
        f"""SELECT id AS ip_id, coalesce(next_at, {TS_NOON}) AS next_at FROM other LEFT JOIN half ON id = ip_id
            WHERE status = 'active'""",
        *CRAWLED,
        HALF,
    )
)
def schedule_refresh(spark, sf):
    return schedule.refresh(*_half(spark, sf), NOON)


@query(
    o.select(
        """SELECT count(*) AS total, count(*) FILTER (WHERE next_at < TIMESTAMP '2024-01-30 12:10:05') AS overdue,
                  coalesce(min(CASE WHEN next_at >= TIMESTAMP '2024-01-30 12:10:05'
                    THEN least(epoch(next_at - TIMESTAMP '2024-01-30 12:10:05'), 86400) END), 0) AS next_in_s FROM sched""",
        *CRAWLED,
    )
)
def schedule_stats(spark, sf):
    return schedule.stats(first_schedule(spark, sf), datetime(2024, 1, 30, 12, 10, 5))


@query(
    o.select(
        """SELECT ip_id, m.name AS ip_name, next_at, epoch(next_at - TIMESTAMP '2024-01-30 12:10:05') AS time_until_s,
                  next_at < TIMESTAMP '2024-01-30 12:10:05' AS is_overdue FROM sched JOIN meta m ON m.id = ip_id""",
        *CRAWLED,
    )
)
def schedule_status(spark, sf):
    return schedule.status(first_schedule(spark, sf), driver.metadata(spark, sf), datetime(2024, 1, 30, 12, 10, 5))


@query(
    o.select(
        f"""SELECT coalesce(s.ip_id, c.id) AS ip_id,
                   CASE WHEN c.id % 11 = 1 THEN date_trunc('second', {TS_NOON} + {PAUSE.format(w='(c.weight + 1)')})
                        WHEN c.id % 11 IN (2, 3) THEN {TS_NOON} ELSE next_at END AS next_at
            FROM sched s FULL JOIN (SELECT * FROM meta WHERE id % 11 IN (0, 1, 2, 3)) c ON c.id = s.ip_id
            WHERE c.id IS NULL OR c.id % 11 <> 0""",
        *CRAWLED,
    )
)
def schedule_changes(spark, sf):
    """A change set of all four actions applied."""
    action = (
        F.when(F.col("id") % 11 == 0, "remove")
        .when(F.col("id") % 11 == 1, "reweight")
        .when(F.col("id") % 11 == 2, "trigger")
        .when(F.col("id") % 11 == 3, "add")
    )
    changes = (
        driver.metadata(spark, sf)
        .select(F.col("id").alias("ip_id"), action.alias("action"), (F.col("weight") + 1).alias("weight"))
        .filter(F.col("action").isNotNull())
    )
    return schedule.apply_changes(first_schedule(spark, sf), changes, NOON)


RULES = weights.WeightRules(base=120, low=60, high=180, busy_per_page=2, quiet_in_per_page=1, quiet_out_per_page=1)


@query(
    o.select(
        """SELECT ip_id, crawl_ts, CASE WHEN new_m <> old_m THEN asked ELSE 'none' END AS adjustment,
                  old_m AS old_minutes, new_m AS new_minutes, round(w, 6) AS new_weight
           FROM fold WHERE n > 0""",
        o.busy(360),
        o.TRANS,
        o.FLOW,
        o.META,
        """asked AS (
             SELECT ip_id, crawl_ts, row_number() OVER (PARTITION BY ip_id ORDER BY crawl_ts) AS n,
                    CASE WHEN first_crawl THEN 'none' WHEN inflow > 10 OR sold > 10 THEN 'active'
                         WHEN inflow < 5 AND sold < 5 THEN 'cold' ELSE 'regress' END AS asked
             FROM flow)""",
        """fold AS (
             SELECT id AS ip_id, CAST(NULL AS TIMESTAMP) AS crawl_ts, CAST(0 AS BIGINT) AS n, 'none' AS asked,
                    CAST(round(120.0 / weight) AS INTEGER) AS old_m, CAST(round(120.0 / weight) AS INTEGER) AS new_m,
                    CAST(weight AS DOUBLE) AS w
             FROM meta WHERE id < 8
             UNION ALL
             SELECT ip_id, crawl_ts, n, asked, was, now, CASE WHEN now = was THEN w ELSE 120.0 / now END
             FROM (SELECT a.ip_id, a.crawl_ts, a.n, a.asked, CAST(round(120.0 / f.w) AS INTEGER) AS was, f.w,
                          CASE a.asked WHEN 'active' THEN greatest(f.new_m - 15, 60) WHEN 'cold' THEN least(f.new_m + 15, 180)
                            WHEN 'regress' THEN CASE WHEN f.new_m < 120 THEN least(f.new_m + 5, 120)
                                                     ELSE greatest(f.new_m - 5, 120) END
                            ELSE f.new_m END AS now
                   FROM fold f JOIN asked a ON a.ip_id = f.ip_id AND a.n = f.n + 1))""",
        recursive=True,
    )
)
def interval_adjust(spark, sf):
    """Interval and weight after each crawl of the eight busy entities."""
    flow, _ = market.busy(spark, sf, 360)
    return rounded(weights.adjust_over_time(flow, driver.metadata(spark, sf), RULES), "new_weight")


@query(
    o.select(
        """SELECT ip_id, crawl_ts, old_m AS old_minutes, new_m AS new_minutes,
                  CASE WHEN new_m <> old_m THEN asked ELSE 'none' END AS adjustment,
                  round(CASE WHEN new_m <> old_m THEN 120.0 / new_m ELSE weight END, 6) AS new_weight
           FROM (SELECT *, CASE asked WHEN 'active' THEN greatest(old_m - 15, 60) WHEN 'cold' THEN least(old_m + 15, 180)
                      WHEN 'regress' THEN CASE WHEN old_m < 120 THEN least(old_m + 5, 120)
                                               ELSE greatest(old_m - 5, 120) END ELSE old_m END AS new_m
                 FROM (SELECT f.*, weight, CAST(round(120.0 / weight) AS INTEGER) AS old_m,
                              CASE WHEN first_crawl THEN 'none' WHEN inflow > 10 OR sold > 10 THEN 'active'
                                   WHEN inflow < 5 AND sold < 5 THEN 'cold' ELSE 'regress' END AS asked
                       FROM flow f JOIN meta m ON m.id = f.ip_id))""",
        *market.FLOW,
        o.META,
    )
)
def interval_adjust_once(spark, sf):
    """One adjustment per crawl from the stored weight."""
    w = driver.metadata(spark, sf).select(F.col("id").alias("ip_id"), "weight")
    once = weights.adjust_once(market.staged_flow(spark, sf).join(w, "ip_id"), RULES)
    return rounded(
        once.select("ip_id", "crawl_ts", "old_minutes", "new_minutes", "adjustment", "new_weight"), "new_weight"
    )


@query(o.select("SELECT min(next_at) AS next_at FROM sched", *CRAWLED))
def schedule_earliest(spark, sf):
    return schedule.earliest(first_schedule(spark, sf))


@query(
    o.select(
        """SELECT coalesce(s.ip_id, w.ip_id) AS ip_id, coalesce(w.next_at, s.next_at) AS next_at
           FROM sched s FULL JOIN (SELECT user_id AS ip_id, max(date_trunc('second', ts)) + INTERVAL 1 HOUR AS next_at
                                   FROM events WHERE event_type = 'purchase' GROUP BY 1) w ON w.ip_id = s.ip_id""",
        *CRAWLED,
    )
)
def schedule_write(spark, sf):
    """The schedule after new times for the entities with a purchase; of several the last one's."""
    bought = driver.table(spark, sf, "events").filter(F.col("event_type") == "purchase")
    second = times.seconds_floor(F.col("ts"))
    given = bought.select(F.col("user_id").alias("ip_id"), F.col("ts").alias("crawl_ts"), times.plus_seconds(second, F.lit(3600)).alias("next_at"))
    return schedule.write_times(first_schedule(spark, sf), given)


# --- entities -----------------------------------------------------------------------------------


@query(
    o.select(
        """SELECT id, name, category, weight, status, count(*) OVER () AS total
           FROM meta WHERE status <> 'deleted' ORDER BY weight DESC, id LIMIT 20 OFFSET 40""",
        o.META,
    )
)
def entity_page(spark, sf):
    """Third page of the entity list, heaviest first."""
    rows = entities.entity_list(driver.metadata(spark, sf))
    return boards.page(rows, [F.desc("weight"), F.col("id")], 3, 20).drop("name_en", "name_cn")


@query(
    o.select(
        """SELECT id, name, category, weight, status, count(*) OVER () AS total
           FROM meta WHERE status <> 'deleted' ORDER BY weight DESC, id LIMIT 7 OFFSET 119""",
        o.META,
    )
)
def entity_page_far(spark, sf):
    """A page far down the entity list: only its range of the list is read."""
    listed = boards.paged(entities.entity_list(driver.metadata(spark, sf)), [F.desc("weight"), F.col("id")])
    return boards.page_of(listed, 18, 7).drop("name_en", "name_cn")


@query(
    o.select(
        "SELECT ip_id, source_id, price, last_seen_at FROM snap WHERE status = 'sold' ORDER BY last_seen_at DESC, ip_id, source_id LIMIT 25 OFFSET 50",
        o.ITEMS,
    )
)
def items_after_cursor(spark, sf):
    """The third page of all sold items, each asked for by the cursor of the one before."""
    rows = snapshots.items_page(driver.snapshots(spark, sf), None, "sold").select("ip_id", "source_id", "price", "last_seen_at")
    keys, cursor = [("last_seen_at", True), ("ip_id", False), ("source_id", False)], None
    for _ in range(2):
        last = boards.page_after(rows, keys, cursor, 25).collect()[-1]
        cursor = [last[c] for c, _ in keys]
    return boards.page_after(rows, keys, cursor, 25)


@query(
    o.select("SELECT ip_id, source_id, price, last_seen_at FROM snap WHERE ip_id = 7 AND status = 'on_sale'", o.ITEMS)
)
def active_items(spark, sf):
    """On-sale items of one entity."""
    return snapshots.active_items(driver.snapshots(spark, sf), 7).select("ip_id", "source_id", "price", "last_seen_at")


@query(
    o.select(
        """SELECT ip_id, source_id, CASE WHEN ip_id % 7 = 0 THEN 'sold' ELSE status END AS status,
                  CASE WHEN ip_id % 7 = 0 THEN TIMESTAMP '2024-01-31 12:00:00' ELSE sold_at END AS sold_at FROM snap""",
        o.ITEMS,
    )
)
def mark_sold(spark, sf):
    """Listings named as sold take status and time; the others stay."""
    items = driver.snapshots(spark, sf)
    return snapshots.mark_sold(items, items.filter(F.col("ip_id") % 7 == 0), datetime(2024, 1, 31, 12)).select("ip_id", "source_id", "status", "sold_at")


@query(
    o.select(
        """SELECT ip_id, source_id, price, status, last_seen_at, count(*) OVER () AS total
           FROM snap WHERE ip_id = 7 AND status = 'sold' ORDER BY last_seen_at DESC, source_id LIMIT 50""",
        o.ITEMS,
    )
)
def items_page(spark, sf):
    rows = snapshots.items_page(driver.snapshots(spark, sf), 7, "sold").select(
        "ip_id", "source_id", "price", "status", "last_seen_at"
    )
    return boards.page(rows, [F.desc("last_seen_at"), F.col("source_id")], 1, 50)


@query(
    o.select(
        """SELECT ip_id, source_id, price, sold_at FROM snap
           WHERE ip_id = 7 AND status = 'sold' AND sold_at >= TIMESTAMP '1998-01-01 00:00:00' AND price > 0""",
        o.ITEMS,
    )
)
def items_recently_sold(spark, sf):
    rows = snapshots.recently_sold(driver.snapshots(spark, sf), 7, "1998-01-01 00:00:00")
    return snapshots.positive_prices(rows).select("ip_id", "source_id", "price", "sold_at")


@query(
    o.select(
        """SELECT id, name, category, status FROM meta
           WHERE status <> 'deleted' AND category = 'BUILDING'
             AND (contains(lower(name), 'mer#0000001') OR contains(lower(name_en), 'mer#0000001')
                  OR contains(lower(name_cn), 'mer#0000001'))""",
        o.META,
    )
)
def keyword_search(spark, sf):
    """Search that ignores case and accents: 'MÉR#0000001' finds 'Customer#0000001..'."""
    rows = entities.entity_list(driver.metadata(spark, sf), category="BUILDING", keyword="MÉR#0000001")
    return rows.select("id", "name", "category", "status")


@query(
    o.select("SELECT id, name FROM meta WHERE contains(lower(name_en), 'en customer#00000010')", o.META)
)
def market_filter(spark, sf):
    return entities.market_filter(driver.metadata(spark, sf), "All", "EN Customer#00000010").select("id", "name")


@query(o.select("SELECT DISTINCT category FROM meta", o.META))
def categories(spark, sf):
    return entities.categories(driver.metadata(spark, sf))


PLAN = """plan AS (
  SELECT m.id, e.name, category_ AS category, CASE WHEN w > 0 THEN w ELSE 1.0 END AS weight, 'active' AS status,
         CASE WHEN m.id IS NULL THEN 'created' ELSE 'updated' END AS outcome,
         CAST(CASE WHEN m.id IS NULL THEN 1 ELSE 0 END AS BIGINT) AS created,
         n - CASE WHEN m.id IS NULL THEN 1 ELSE 0 END AS updated, CAST(0 AS BIGINT) AS skipped
  FROM (SELECT name, arg_max(category, pos) AS category_, arg_max(weight, pos) AS w, count(*) AS n
        FROM entries WHERE name <> '' GROUP BY name) e LEFT JOIN meta m ON m.name = e.name)"""


@query(o.select("SELECT * FROM plan", o.META, o.ENTRIES, PLAN))
def import_plan(spark, sf):
    return entities.import_plan(driver.metadata(spark, sf), driver.import_entries(spark, sf))


@query(
    o.select(
        """SELECT CAST(sum(created) AS BIGINT) AS created, CAST(sum(updated) AS BIGINT) AS updated,
                  CAST(0 AS BIGINT) AS skipped, (SELECT count(*) FROM entries WHERE name = '') AS failed FROM plan""",
        o.META,
        o.ENTRIES,
        PLAN,
    )
)
def import_summary(spark, sf):
    entries = driver.import_entries(spark, sf)
    return entities.import_summary(entities.import_plan(driver.metadata(spark, sf), entries), entries)


@query(
    o.select(
        """SELECT id, name, category, weight, status FROM (
             SELECT m.id, m.name, coalesce(p.category, m.category) AS category, coalesce(p.weight, m.weight) AS weight,
                    m.status FROM meta m LEFT JOIN plan p ON p.id = m.id
             UNION ALL
             SELECT (SELECT max(id) FROM meta) + row_number() OVER (ORDER BY name), name, category, weight, status
             FROM plan WHERE id IS NULL)""",
        o.META,
        o.ENTRIES,
        PLAN,
    )
)
def import_apply(spark, sf):
    """The dimension after an upserting import."""
    meta = driver.metadata(spark, sf)
    plan = entities.import_plan(meta, driver.import_entries(spark, sf))
    return entities.apply_import(meta, plan).drop("name_en", "name_cn")


@query(
    o.select(
        """SELECT id, CASE WHEN id % 6 = 1 THEN 'c2' ELSE category END AS category,
                  CASE WHEN id % 6 = 1 AND id % 4 = 1 THEN 9.0 ELSE weight END AS weight,
                  CASE WHEN id % 9 = 2 THEN 'deleted' ELSE status END AS status FROM meta""",
        o.META,
    )
)
def entity_update_delete(spark, sf):
    """A partial update of some rows, then a soft delete of others."""
    meta = driver.metadata(spark, sf)
    changes = meta.filter("id % 6 = 1").select(
        "id", F.lit("c2").alias("category"), F.when(F.col("id") % 4 == 1, 9.0).alias("weight")
    )
    gone = meta.filter("id % 9 = 2")
    return entities.soft_delete(entities.partial_update(meta, changes), gone).select("id", "category", "weight", "status")


@query(o.select("SELECT id, name, category, status FROM meta WHERE name = 'Customer#000000007'", o.META))
def entity_by_name(spark, sf):
    found = reports.lookup(driver.metadata(spark, sf), name="Customer#000000007")
    return found.select("id", "name", "category", "status")


# --- reports ------------------------------------------------------------------------------------


@query(
    o.select(
        """SELECT ip_id, m.name AS ip_name, count(*) AS total_items, count(*) FILTER (WHERE s.status = 'on_sale') AS on_sale,
                  count(*) FILTER (WHERE s.status = 'sold') AS sold, round(avg(price), 0) AS avg_price
           FROM snap s JOIN meta m ON m.id = s.ip_id GROUP BY ip_id, m.name""",
        o.ITEMS,
        o.META,
    )
)
def snapshot_summary(spark, sf):
    return reports.snapshot_summary(driver.snapshots(spark, sf), driver.metadata(spark, sf))


@query(o.select("SELECT ip_id, status, count(*) AS items FROM snap GROUP BY ip_id, status", o.ITEMS))
def status_counts(spark, sf):
    return reports.status_counts(driver.snapshots(spark, sf))


@query(
    o.select(
        f"""SELECT ip_id, m.name AS ip_name, strftime(hour_bucket, '%m-%d %H:00') AS hour, inflow, outflow,
                   round(liquidity_index, 2) AS liquidity
            FROM hours JOIN meta m ON m.id = ip_id WHERE hour_bucket >= {o.NOW} - INTERVAL 24 HOUR
            ORDER BY hour_bucket DESC, ip_id LIMIT 20""",
        *market.HOURS,
        o.META,
    )
)
def hour_report(spark, sf):
    return reports.hour_report(market.hours(spark, sf), driver.metadata(spark, sf), market.NOW)


@query(
    o.select(
        o.board("board_rows", "hot", 10),
        *market.HOURS,
        o.META,
        """board_rows AS (SELECT ip_id, inflow, outflow FROM hours WHERE hour_bucket = TIMESTAMP '2024-01-29 18:00:00'
           AND (inflow > 0 OR outflow > 0) AND ip_id IN (SELECT id FROM meta WHERE status = 'active'))""",
    )
)
def active_hour_board(spark, sf):
    board = reports.active_hour_board(
        market.hours(spark, sf), driver.metadata(spark, sf), datetime(2024, 1, 29, 19, 30)
    )
    return rounded(board, "score")


@query(
    o.select(
        """SELECT (SELECT count(*) FROM meta WHERE status = 'active') AS active_entities,
                  (SELECT count(*) FROM alerts) AS open_alerts,
                  (SELECT count(*) FROM (SELECT 1 FROM lineitem WHERE l_linestatus = 'O')) AS items_on_sale""",
        *market.ALERT_PARTS,
        market.ALERTS,
        o.META,
    )
)
def system_counts(spark, sf):
    return reports.system_counts(
        driver.metadata(spark, sf), market.alert_rows(spark, sf), driver.snapshots(spark, sf)
    )


@query(
    o.select(
        """SELECT 'ip_metadata' AS table_name, (SELECT count(*) FROM meta) AS row_count
           UNION ALL SELECT 'ip_stats_hourly', (SELECT count(*) FROM hours)
           UNION ALL SELECT 'item_snapshots', (SELECT count(*) FROM lineitem)""",
        *market.HOURS,
        o.META,
    )
)
def table_counts(spark, sf):
    return reports.table_counts(
        {
            "ip_metadata": driver.metadata(spark, sf),
            "ip_stats_hourly": stage(market.hours(spark, sf), "hours"),
            "item_snapshots": driver.snapshots(spark, sf),
        }
    )


@query(
    o.select(
        """SELECT m.id, m.name, m.category, b.rank, round(b.score, 6) AS score, b.inflow, b.outflow
           FROM meta m LEFT JOIN (SELECT *, row_number() OVER (ORDER BY score DESC, ip_id) AS rank FROM (
             SELECT *, """
        + o.score()
        + """ AS score FROM board_rows WHERE inflow > 0 OR outflow > 0 ORDER BY score DESC, ip_id LIMIT 100)) b
           ON b.ip_id = m.id""",
        *market.DAYS,
        o.META,
        market.DAY_BOARD,
    )
)
def entities_with_board(spark, sf):
    """Entity list with the hot board of yesterday."""
    meta = driver.metadata(spark, sf)
    board = boards.leaderboard("hot", 24, 100, market.NOW, meta, day_rows=market.days(spark, sf))
    return rounded(reports.entities_with_board(meta.select("id", "name", "category"), board), "score")


@query(
    o.select(
        f"""SELECT m.id AS ip_id, m.name, round(h.liq, 6) AS liquidity_index, coalesce(h.hours_txt, '') AS hours,
                   coalesce(i.items_txt, '') AS items
            FROM meta m
            LEFT JOIN (SELECT ip_id, arg_max(liq_box, hour_bucket).v AS liq,
                              string_agg(strftime(hour_bucket, '%d%H') || ':' || inflow || ':' || outflow, ',' ORDER BY hour_bucket) AS hours_txt
                       FROM (SELECT *, {{'v': liquidity_index}} AS liq_box,
                                    row_number() OVER (PARTITION BY ip_id ORDER BY hour_bucket DESC) AS r
                             FROM hours WHERE hour_bucket < {o.NOW}) WHERE r <= 12 GROUP BY ip_id) h ON h.ip_id = m.id
            LEFT JOIN (SELECT ip_id, string_agg(source_id || ':' || price, ',' ORDER BY r) AS items_txt
                       FROM (SELECT *, row_number() OVER (PARTITION BY ip_id ORDER BY last_seen_at DESC, source_id) AS r
                             FROM snap) WHERE r <= 16 GROUP BY ip_id) i ON i.ip_id = m.id""",
        *market.HOURS,
        o.SNAP,
        o.META,
    )
)
def entity_detail(spark, sf):
    """Detail view of every entity, the two lists as text."""
    snaps = snapshots.snapshot_delta(driver.observations(spark, sf))
    rows = reports.entity_detail(
        driver.metadata(spark, sf).select("id", "name"), stage(market.hours(spark, sf), "hours"), snaps, market.NOW
    )
    hour_text = F.transform(
        "hours", lambda h: F.concat_ws(":", F.date_format(h["hour_bucket"], "ddHH"), h["inflow"].cast("string"), h["outflow"].cast("string"))
    )
    item_text = F.transform("items", lambda i: F.concat_ws(":", i["source_id"], i["price"].cast("string")))
    rows = rows.withColumn("hours", F.coalesce(F.array_join(hour_text, ","), F.lit("")))
    return rounded(rows.withColumn("items", F.coalesce(F.array_join(item_text, ","), F.lit(""))), "liquidity_index")


# --- messages and functions ----------------------------------------------------------------------


@query(
    o.select(
        """SELECT user_id AS ip_id, CAST(event_id AS VARCHAR) AS task_id,
                  date_trunc('second', ts) + INTERVAL 9 HOUR AS crawl_ts, CAST(0 AS BIGINT) AS pos,
                  'm' || CAST(k AS VARCHAR) AS source_id, CASE WHEN event_type = 'purchase' THEN 'sold' ELSE 'available' END AS status,
                  CASE WHEN event_type = 'view' THEN 0 ELSE CAST(round(value * 100) AS INTEGER) END AS price
           FROM kruns WHERE event_type <> 'error' AND k <> 0""",
        o.RUNS,
    )
)
def message_observations(spark, sf):
    """Result messages written from the events, read back and taken apart.

    As in the wire form, long numbers are text and zero fields are missing; errors are failed crawls.
    """
    events = driver.table(spark, sf, "events").withColumn("k", driver.props_number())
    item = F.struct(
        F.when(F.col("k") != 0, F.concat(F.lit("m"), F.col("k").cast("string"))).alias("sourceId"),
        F.when(F.col("event_type") != "view", F.round(F.col("value") * 100).cast("int")).alias("price"),
        F.when(F.col("event_type") == "purchase", "ITEM_STATUS_SOLD").alias("status"),
    )
    seconds = F.floor(times.micros(F.col("ts")) / times.US_PER_SECOND).cast("string")
    message = F.struct(
        F.col("user_id").cast("string").alias("ipId"),
        F.col("event_id").cast("string").alias("taskId"),
        seconds.alias("crawledAt"),
        F.when(F.col("event_type") == "error", "net::ERR_FAILED").alias("errorMessage"),
        F.array(item).alias("items"),
    )
    results = readers.crawl_results_from_text(events.select(F.to_json(message).alias("value")))
    return readers.observations(results).drop("title", "image_url", "item_url")


@query(
    """SELECT event_id, date_trunc('hour', ts) AS hour, CAST(date_trunc('week', ts) AS DATE) AS monday,
              CAST(date_trunc('month', ts) AS DATE) AS month,
              time_bucket(INTERVAL 15 MINUTE, ts + INTERVAL 15 MINUTE - INTERVAL 1 MICROSECOND) AS slot,
              strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+09:00' AS rfc3339,
              CASE event_id % 3 WHEN 0 THEN date_trunc('second', ts) - INTERVAL 9 HOUR
                WHEN 1 THEN date_trunc('day', ts) END AS parsed,
              CAST(ts AS DATE) = CAST(ts + INTERVAL 6 HOUR AS DATE) AS same_day
       FROM events"""
)
def time_functions(spark, sf):
    """Calendar functions over the event times, and text forms of them read back."""
    ts = F.col("ts")
    written = (
        F.when(F.col("event_id") % 3 == 0, times.format_rfc3339(ts))
        .when(F.col("event_id") % 3 == 1, F.date_format(ts, "yyyy-MM-dd"))
        .otherwise(F.date_format(ts, "yyyy/MM/dd"))
    )
    utc = times.from_epoch(F.unix_seconds(times.parse_time(written)), "UTC")
    return driver.table(spark, sf, "events").select(
        "event_id",
        times.hour_floor(ts).alias("hour"),
        times.monday_of(ts).alias("monday"),
        times.month_start(ts).alias("month"),
        times.align_up(ts, 15).alias("slot"),
        times.format_rfc3339(ts).alias("rfc3339"),
        utc.alias("parsed"),
        times.same_day(ts, times.plus_seconds(ts, F.lit(6 * 3600))).alias("same_day"),
    )


@query(
    r"""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN lang || ',' || source WHEN 1 THEN NULL ELSE NULL END AS tags,
               doc_id % 3 = 2 AS bad, CASE WHEN doc_id % 3 = 0 THEN '["' || lang || '","' || source || '"]' ELSE '[]' END AS written,
               CASE WHEN doc_id % 2 = 0 THEN '{"source_id":"m' || doc_id || '","price":' || n_chars || '}' END AS item
        FROM documents"""
)
def json_columns(spark, sf):
    """Tags and price items written as JSON and read back; bad JSON is flagged."""
    docs = driver.table(spark, sf, "documents")
    stored = (
        F.when(F.col("doc_id") % 3 == 0, F.to_json(F.array("lang", "source")))
        .when(F.col("doc_id") % 3 == 2, F.concat(F.lit("{"), F.col("lang")))
    )
    source_id = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("m"), F.col("doc_id").cast("string"))).otherwise("")
    item = F.to_json(F.struct(source_id.alias("source_id"), F.col("n_chars").cast("int").alias("price")))
    read = docs.select("doc_id", stored.alias("stored"), readers.item_from_json(item).alias("item"))
    return read.select(
        "doc_id",
        F.array_join(readers.tags_from_json(F.col("stored")), ",").alias("tags"),
        readers.bad_tags(F.col("stored")).alias("bad"),
        readers.tags_to_json(readers.tags_from_json(F.col("stored"))).alias("written"),
        readers.item_to_json(F.col("item")).alias("item"),
    )


# --- pages and texts ----------------------------------------------------------------------------


def _any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def _either(words) -> str:
    return f"({_any('lh', words)} OR {_any('lt', words)})"


PAGES = r"""
p AS (
  SELECT page_id, url, html, lower(html) AS lh,
         trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title,
         trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)^.*?<body[^>]*>', ''),
           '(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>', ' ', 'g'),
           '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS body
  FROM pages),
pp AS (SELECT *, lower(title) AS lt FROM p)"""


@query(
    o.select(
        f"""SELECT page_id, title, CASE
              WHEN {_either(text.CLOUDFLARE)} OR (contains(lh, 'iframe') AND contains(lh, 'cloudflare')) THEN 'cloudflare_challenge'
              WHEN {_any('lh', text.CAPTCHA)} THEN 'captcha'
              WHEN {_either(text.FORBIDDEN)} THEN '403_forbidden'
              WHEN {_either(text.RATE_LIMITED)} THEN '429_rate_limited'
              WHEN {_either(text.SITE_ERROR)} THEN 'mercari_error_page'
              WHEN title IN ('', 'about:blank') AND (strlen(html) < 100 OR contains(html, '{text.EMPTY_DOCUMENT}')) THEN 'blank_page'
              WHEN title IN ('', 'about:blank') THEN 'empty_title'
              WHEN {_any('lh', text.CONNECTION)} THEN 'connection_error'
              WHEN strlen(html) > 0 AND strlen(html) < 200 AND NOT {_any('lh', text.NORMAL_MARKUP)} THEN 'suspicious_minimal_page'
              ELSE 'unknown' END AS block_type,
            (lt IN ('', 'about:blank') AND lower(url) IN ('', 'about:blank')) OR {_any('lt', text.BLOCKED_TITLE)}
              OR strlen(body) < 50 OR {_any('lower(body)', text.BLOCKED_TEXT)} AS is_blocked,
            contains(html, '{text.EMPTY_STATE}') OR {_any('body', text.NO_ITEMS)} AS is_no_items
            FROM pp""",
        PAGES,
    )
)
def block_type(spark, sf):
    """Page checks of every saved page."""
    return listing_pages.page_checks(driver.table(spark, sf, "pages"))


@query(
    """SELECT o_orderkey AS page_id, CAST(0 AS INTEGER) AS pos,
              CASE WHEN o_orderkey % 5 = 2 THEN 'shops_' ELSE 'm' END || o_orderkey AS source_id,
              'Part & ' || o_custkey AS title, CAST(round(o_totalprice) AS INTEGER) AS price,
              CASE WHEN o_orderkey % 5 = 2 THEN '/t.webp'
                   ELSE 'https://static.mercdn.net/thumb/item/webp/m' || o_orderkey || '_1.jpg' END AS image_url,
              'https://jp.mercari.com' || CASE WHEN o_orderkey % 5 = 2 THEN '/shops/product/' ELSE '/item/m' END
                   || o_orderkey AS item_url,
              CASE WHEN o_orderstatus = 'F' THEN 'sold' ELSE 'on_sale' END AS status
       FROM orders WHERE o_orderkey % 5 <> 4"""
)
def listing_page_items(spark, sf):
    """Items of result pages that Spark writes from the orders."""
    return listing_pages.items(driver.listing_pages(spark, sf))


@query(
    """SELECT page_id, CASE WHEN contains(url, '/item/') THEN CASE WHEN starts_with(url_tail, 'm') THEN url_tail ELSE '' END
                            WHEN contains(url, '/shops/product/') THEN 'shops_' || url_tail ELSE '' END AS listing,
              CASE WHEN path = '' OR starts_with(path, 'http://') OR starts_with(path, 'https://') THEN path
                   WHEN starts_with(path, '//') THEN 'https:' || path ELSE 'https://jp.mercari.com' || path END AS absolute
       FROM (SELECT page_id, url, split_part(url, '/', -1) AS url_tail,
                    CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN substr(url, strpos(url, '//'))
                         ELSE regexp_replace(url, '^https?://[^/]*', '') END AS path FROM pages)"""
)
def page_links(spark, sf):
    """Listing id and absolute form of the links."""
    url = F.col("url")
    path = (
        F.when(F.col("page_id") % 3 == 0, url)
        .when(F.col("page_id") % 3 == 1, F.substring(url, F.instr(url, "//"), F.length(url)))
        .otherwise(F.regexp_replace(url, "^https?://[^/]*", ""))
    )
    return driver.table(spark, sf, "pages").select(
        "page_id", text.listing_id(url).alias("listing"), text.absolute_url(path).alias("absolute")
    )


@query(
    r"""SELECT doc_id, coalesce(TRY_CAST(replace(regexp_extract(text, '[¥￥]\s*([0-9][0-9,]*)', 1), ',', '') AS BIGINT),
                 best.v) AS price
        FROM (SELECT doc_id, text, list_max([{'n': length(x), 'v': TRY_CAST(x AS BIGINT)}
                     FOR x IN regexp_extract_all(regexp_replace(text, '[¥￥,]', '', 'g'), '[0-9]+')
                     IF TRY_CAST(x AS BIGINT) IS NOT NULL]) AS best FROM documents)"""
)
def price_parse(spark, sf):
    """Price text rule over whole documents."""
    return driver.table(spark, sf, "documents").select("doc_id", text.price_value(F.col("text")).alias("price"))


@query(
    f"""SELECT doc_id, error_class, error_class IN ('blocked', 'timeout', 'network_error') AS proxy_worthy,
               CASE error_class WHEN 'blocked' THEN '403_forbidden' ELSE 'error' END AS outcome
        FROM (SELECT doc_id, CASE
                WHEN {_any('lower(text)', text.ERROR_CONTEXT)} THEN 'timeout'
                WHEN {_any('lower(text)', text.ERROR_BLOCKED)} THEN 'blocked'
                WHEN {_any('lower(text)', text.ERROR_TIMEOUT)} THEN 'timeout'
                WHEN {_any('lower(text)', text.ERROR_NETWORK)} THEN 'network_error'
                WHEN {_any('lower(text)', text.ERROR_PARSE)} THEN 'parse_error' ELSE 'unknown' END AS error_class
              FROM documents)"""
)
def error_class(spark, sf):
    """Error classification over whole documents read as messages."""
    low = driver.table(spark, sf, "documents").select("doc_id", F.lower("text").alias("low"))
    named = low.select("doc_id", text.error_class(F.col("low")).alias("error_class"))
    return named.select(
        "*",
        text.proxy_worthy(F.col("error_class")).alias("proxy_worthy"),
        text.run_outcome(F.col("error_class"), F.lit(0)).alias("outcome"),
    )


@query(
    o.select(
        """SELECT id AS ip_id, name AS keyword, s.status, CAST(pg AS INTEGER) AS page,
                  'https://jp.mercari.com/search?keyword=' || replace(name, '#', '%23') || '&order=desc&sort=created_time&status='
                  || CASE s.status WHEN 'sold' THEN 'sold_out%7Ctrading' ELSE 'on_sale' END
                  || CASE WHEN pg > 0 THEN '&page_token=v1:' || pg ELSE '' END AS url
           FROM meta, (VALUES ('on_sale'), ('sold')) s(status), range(5) r(pg) WHERE meta.status = 'active'""",
        o.META,
    )
)
def crawl_plan(spark, sf):
    return listing_pages.crawl_plan(driver.metadata(spark, sf))


COUNTS = r"""counts AS (
  SELECT user_id AS task_id, CASE WHEN event_id % 2 = 0 THEN 'on_sale' ELSE 'sold' END AS status,
         CAST(floor(event_id / 2) AS BIGINT) AS page,
         CASE WHEN event_type = 'error' THEN NULL WHEN CAST(regexp_extract(props, '(\d+)', 1) AS INTEGER) % 7 = 0 THEN 0
              ELSE CAST(regexp_extract(props, '(\d+)', 1) AS INTEGER) END AS items FROM events)"""


@query(
    o.select(
        """SELECT c.* FROM counts c LEFT JOIN (SELECT task_id, status, min(page) AS stop FROM counts WHERE items = 0
             GROUP BY 1, 2) s USING (task_id, status) WHERE items IS NOT NULL AND (stop IS NULL OR page <= stop)""",
        COUNTS,
    )
)
def empty_page_stop(spark, sf):
    return listing_pages.used_pages(driver.page_counts(spark, sf))


@query(
    o.select(
        """SELECT page_id, source_id, pos, rn FROM (
             SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos, source_id) AS rn FROM (
               SELECT ip_id AS page_id, source_id, min(pos) AS pos FROM obs GROUP BY 1, 2)) WHERE rn <= 12""",
        o.OBS,
    )
)
def page_item_dedup(spark, sf):
    """First sighting of each id per page, twelve per page; pages are the entities here."""
    found = driver.observations(spark, sf).select(F.col("ip_id").alias("page_id"), "source_id", "pos")
    kept = listing_pages.first_per_page(found, 12)
    ranked = kept.withColumn(
        "rn", F.row_number().over(Window.partitionBy("page_id").orderBy("pos", "source_id")).cast("long")
    )
    return ranked.select("page_id", "source_id", "pos", "rn")


# --- collecting jobs ----------------------------------------------------------------------------


@query(
    o.select(
        """SELECT CASE e WHEN 'pushed' THEN 'waiting' WHEN 'started' THEN 'processing' WHEN 'acked' THEN 'processed'
                         ELSE 'dead' END AS state, count(*) AS tasks
           FROM (SELECT task_id, arg_max(event, seq) AS e FROM tasks GROUP BY 1) GROUP BY 1""",
        o.TASKS,
    )
)
def queue_depths(spark, sf):
    return tasks.queue_depths(driver.task_events(spark, sf))


@query(
    o.select(
        """SELECT count(*) FILTER (WHERE e = 'pushed') AS waiting, count(*) FILTER (WHERE e = 'started') AS processing,
                  count(*) FILTER (WHERE e = 'dead') AS dead,
                  (SELECT count(*) FROM (SELECT ip_id, arg_max(event, seq) AS l FROM tasks WHERE event <> 'started' GROUP BY 1)
                   WHERE l = 'pushed') AS pending_entities,
                  (SELECT count(DISTINCT task_id) FROM tasks WHERE event = 'acked' AND ts > TIMESTAMP '2024-01-29 12:00:00') AS processed_ids
           FROM (SELECT task_id, arg_max(event, seq) AS e FROM tasks GROUP BY 1)""",
        o.TASKS,
    )
)
def queue_stats(spark, sf):
    return tasks.queue_stats(driver.task_events(spark, sf), NOON)


@query(
    o.select(
        """SELECT task_id, ip_id, CAST(r + 1 AS INTEGER) AS retry_count, CASE WHEN r + 1 > 3 THEN 'dead' ELSE 'retry' END AS outcome
           FROM (SELECT task_id, arg_max(ip_id, seq) AS ip_id, arg_max(event, seq) AS e, arg_max(retry_count, seq) AS r,
                        max(ts) FILTER (WHERE event = 'started') AS began FROM tasks GROUP BY 1)
           WHERE e = 'started' AND floor(epoch(TIMESTAMP '2024-01-29 12:00:00' - began)) > 1800""",
        o.TASKS,
    )
)
def stuck_tasks(spark, sf):
    return tasks.stuck_tasks(driver.task_events(spark, sf), datetime(2024, 1, 29, 12))


@query(
    o.select(
        """SELECT task_id, ip_id, ts, seq, before IS NULL OR before <> 'pushed' AS accepted
           FROM (SELECT *, lag(event) OVER (PARTITION BY ip_id ORDER BY ts, seq) AS before FROM tasks
                 WHERE event <> 'started') WHERE event = 'pushed'""",
        o.TASKS,
    )
)
def one_open_task(spark, sf):
    return tasks.accepted_pushes(driver.task_events(spark, sf))


def _streamed(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """Run a stream over all present data; its output as a table."""
    out = scratch_dir(spark, label)
    running = (
        df.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", scratch_dir(spark, f"{label}-checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


@query(ORACLES["one_open_task"])
def stream_push_gate(spark, sf):
    """The one-open-task rule as a stateful stream."""
    events = driver.task_events_of(driver.stream_table(spark, sf, "events"))
    return _streamed(spark, task_state.push_gate(events), "gate").where("NOT late").drop("late")


@query(
    o.select(
        """SELECT task_id, arg_min(event, seq) AS event, min(ts) AS ts, min(seq) AS seq, count(*) - 1 AS dropped
           FROM tasks GROUP BY task_id""",
        o.TASKS,
    )
)
def dedup_tasks(spark, sf):
    return tasks.first_of_each_task(driver.task_events(spark, sf)).select("task_id", "event", "ts", "seq", "dropped")


@query(
    o.select(
        """SELECT task_id, event, ts, seq FROM tasks WHERE event = 'pushed' AND task_id NOT IN (
             SELECT task_id FROM tasks WHERE event = 'acked' AND ts > TIMESTAMP '2024-01-29 12:00:00')""",
        o.TASKS,
    )
)
def processed_anti_join(spark, sf):
    """Pushed tasks that were not processed in the last 24 hours."""
    events = driver.task_events(spark, sf)
    done = tasks.processed_within(events.filter("event = 'acked'"), datetime(2024, 1, 30, 12))
    pushed = events.filter("event = 'pushed'").select("task_id", "event", "ts", "seq")
    return tasks.unprocessed(pushed, done)


@query(
    o.select(
        """SELECT node, task_id, ts, streak, streak = 3 AS cooldown FROM (
             SELECT *, sum(b) OVER (PARTITION BY node, g ORDER BY ts, task_id) AS streak FROM (
               SELECT *, sum(CASE WHEN b = 0 OR prev IS NULL OR ts - prev > INTERVAL 5 HOUR THEN 1 ELSE 0 END)
                         OVER (PARTITION BY node ORDER BY ts, task_id) AS g
               FROM (SELECT *, lag(ts) OVER (PARTITION BY node ORDER BY ts, task_id) AS prev
                     FROM (SELECT *, CASE WHEN outcome = '403_forbidden' THEN 1 ELSE 0 END AS b FROM runs
                           WHERE outcome <> 'error')))) WHERE b = 1""",
        o.RUNS,
    ).replace("SELECT node, task_id, ts, streak,", "SELECT node, task_id, ts, CAST(streak AS BIGINT) AS streak,")
)
def block_streaks(spark, sf):
    """Consecutive blocks per node; the log is thin, so a streak may pause for five hours."""
    return tasks.block_streaks(driver.run_log(spark, sf), ttl_s=5 * 3600)


@query(ORACLES["block_streaks"].replace("'n' || CAST(user_id % 16 AS VARCHAR) AS node", "'all' AS node"))
def block_streaks_all(spark, sf):
    """Consecutive blocks over all nodes together."""
    return tasks.block_streaks(driver.run_log(spark, sf), ttl_s=5 * 3600, scope="all")


@query(ORACLES["block_streaks"])
def stream_block_streaks(spark, sf):
    """Block streaks as a stateful stream."""
    log = driver.run_log_of(driver.stream_table(spark, sf, "events"))
    return _streamed(spark, task_state.block_streak_stream(log, ttl_s=5 * 3600), "streaks").where("NOT late").drop("late")


@query(
    o.select(
        """SELECT count(*) FILTER (WHERE outcome = 'success') AS processed,
                  count(*) FILTER (WHERE outcome IN ('403_forbidden', 'error')) AS failed,
                  count(*) FILTER (WHERE outcome = 'empty_result') AS skipped,
                  round(avg(duration_s) FILTER (WHERE outcome = 'success'), 6) AS avg_duration_s,
                  round(count(*) FILTER (WHERE outcome = 'success') * 1.0
                        / count(*) FILTER (WHERE outcome <> 'empty_result'), 6) AS success_rate
           FROM runs""",
        o.RUNS,
    )
)
def run_counters(spark, sf):
    return rounded(tasks.run_counters(driver.run_log(spark, sf)), "avg_duration_s", "success_rate")


@query(o.select("SELECT outcome, mode, count(*) AS runs FROM runs GROUP BY outcome, mode", o.RUNS))
def outcome_counts(spark, sf):
    return tasks.outcome_counts(driver.run_log(spark, sf))


_LE = "CASE " + " ".join(f"WHEN duration_s <= {b} THEN CAST({b} AS DOUBLE)" for b in tasks.DURATION_BOUNDS) + " END"


@query(o.select(f"SELECT {_LE} AS le, count(*) AS runs FROM runs GROUP BY 1", o.RUNS))
def latency_histogram(spark, sf):
    return tasks.duration_histogram(driver.run_log(spark, sf))


BUCKETS = ", ".join(
    f"({i}, CAST({'0' if i == 0 else tasks.DURATION_BOUNDS[i - 1]} AS DOUBLE), CAST({b} AS DOUBLE))"
    for i, b in enumerate(tasks.DURATION_BOUNDS)
)
LATENCY = f"""
bk(i, lo, hi) AS (VALUES {BUCKETS}),
w AS (SELECT time_bucket(INTERVAL {{minutes}} MINUTE, ts) AS window_start, duration_s FROM runs),
tot AS (SELECT window_start, count(*) AS runs FROM w GROUP BY 1),
cum AS (SELECT t.window_start, t.runs, i, lo, hi,
               (SELECT count(*) FROM w WHERE w.window_start = t.window_start AND duration_s <= hi) AS upto,
               (SELECT count(*) FROM w WHERE w.window_start = t.window_start AND duration_s <= lo AND i > 0) AS below
        FROM tot t, bk)"""


def _q(q: float) -> str:
    return f"""coalesce((SELECT lo + (hi - lo) * (t.runs * CAST({q} AS DOUBLE) - below) / (upto - below) FROM cum c
        WHERE c.window_start = t.window_start AND upto >= t.runs * CAST({q} AS DOUBLE) ORDER BY i LIMIT 1), 300.0)"""


@query(
    o.select(
        f"""SELECT window_start, runs, round({_q(0.5)}, 6) AS p50, round({_q(0.95)}, 6) AS p95,
                   round({_q(0.99)}, 6) AS p99 FROM tot t""",
        o.RUNS,
        LATENCY.format(minutes=360),
    )
)
def latency_quantiles(spark, sf):
    return rounded(tasks.latency_quantiles(driver.run_log(spark, sf), 360), "p50", "p95", "p99")


@query(
    o.select(
        """SELECT window_start, round(sum(pushed) / 5.0, 6) AS pushed_per_min, round(sum(acked) / 5.0, 6) AS processed_per_min,
                  round(sum(dead) / 5.0, 6) AS failed_per_min
           FROM (SELECT time_bucket(INTERVAL 1 MINUTE, ts) - unnest(range(5)) * INTERVAL 1 MINUTE AS window_start,
                        CASE WHEN event = 'pushed' THEN 1 ELSE 0 END AS pushed,
                        CASE WHEN event = 'acked' THEN 1 ELSE 0 END AS acked,
                        CASE WHEN event = 'dead' THEN 1 ELSE 0 END AS dead FROM tasks) GROUP BY 1""",
        o.TASKS,
    )
)
def rate_per_minute(spark, sf):
    rows = tasks.rates(driver.task_events(spark, sf))
    return rounded(rows, "pushed_per_min", "processed_per_min", "failed_per_min")


def _ops_sql(minutes: int) -> str:
    """The rules as written: increase over a sliding window, p95 of a sliding window held for five minutes."""
    cuts = tasks.DURATION_BOUNDS
    counts = ", ".join(f"count(*) FILTER (WHERE duration_s <= {b}) AS c{i}" for i, b in enumerate(cuts))
    cases = " ".join(
        f"WHEN c{i} >= r THEN {cuts[i - 1] if i else 0.0} + ({b} - {cuts[i - 1] if i else 0.0}) * (r - {f'c{i - 1}' if i else 0}) / (c{i} - {f'c{i - 1}' if i else 0})"
        for i, b in enumerate(cuts)
    )

    def runs_of(table: str) -> str:
        return f"""(SELECT min(t) AS since, max(t) AS until, CAST(max(v) AS DOUBLE) AS value FROM (
            SELECT *, t - row_number() OVER (ORDER BY t) * INTERVAL 1 MINUTE AS g FROM {table}) GROUP BY g)"""

    return o.select(
        f"""SELECT 'queue_backlog' AS rule, 'warning' AS severity, since, until, value FROM (
             SELECT min(m) FILTER (WHERE depth > 100) AS since, max(m) AS until, CAST(max(depth) AS DOUBLE) AS value
             FROM depth_runs GROUP BY g) WHERE since IS NOT NULL AND until - since >= INTERVAL 5 MINUTE
           UNION ALL
           SELECT 'dead_letters', 'critical', since, until, value FROM (
             SELECT min(m) FILTER (WHERE dead_total > 0) AS since, max(m) AS until, CAST(max(dead_total) AS DOUBLE) AS value
             FROM dead_runs GROUP BY g) WHERE since IS NOT NULL AND until - since >= INTERVAL 1 MINUTE
           UNION ALL
           SELECT 'collector_blocked', 'critical', since, until, value FROM {runs_of("blk")}
           UNION ALL
           SELECT 'high_latency', 'warning', since, until, round(value, 6) FROM {runs_of("lat")}
           WHERE until - since >= INTERVAL 5 MINUTE""",
        o.TASKS,
        o.RUNS,
        f"""ends AS (SELECT time_bucket(INTERVAL 1 MINUTE, ts) + k * INTERVAL 1 MINUTE AS t, outcome, duration_s
                     FROM runs, range({minutes}) AS x(k)),
           blk AS (SELECT t, count(*) AS v FROM ends WHERE outcome = '403_forbidden' GROUP BY t HAVING count(*) > 5),
           lat AS (SELECT * FROM (SELECT t, CASE {cases} ELSE {float(cuts[-1])} END AS v
                                  FROM (SELECT t, count(*) * CAST(0.95 AS DOUBLE) AS r, {counts} FROM ends GROUP BY t)) WHERE v > 60),
           mins AS (SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS m,
                    sum(CASE event WHEN 'pushed' THEN 1 WHEN 'started' THEN -1 ELSE 0 END) AS d,
                    sum(CASE WHEN event = 'dead' THEN 1 ELSE 0 END) AS dead FROM tasks GROUP BY 1),
           cumd AS (SELECT m, sum(d) OVER (ORDER BY m) AS depth, sum(dead) OVER (ORDER BY m) AS dead_total FROM mins),
           depth_runs AS (SELECT *, sum(CASE WHEN depth > 100 THEN 0 ELSE 1 END) OVER (ORDER BY m) AS g FROM cumd),
           dead_runs AS (SELECT *, sum(CASE WHEN dead_total > 0 THEN 0 ELSE 1 END) OVER (ORDER BY m) AS g FROM cumd)""",
    )


@query(_ops_sql(360))
def ops_alerts(spark, sf):
    """Operation rules; the thin log is judged per six hours."""
    rows = tasks.operation_alerts(driver.task_events(spark, sf), driver.run_log(spark, sf), minutes=360)
    return rounded(rows, "value")


@query(_ops_sql(5))
def ops_alerts_5m(spark, sf):
    """Operation rules over windows of five minutes."""
    return rounded(tasks.operation_alerts(driver.task_events(spark, sf), driver.run_log(spark, sf)), "value")


@query(
    o.select(
        """SELECT task_id, ip_id, event, date_trunc('second', ts) AS ts, retry_count,
                  CAST(retry_count * 4 + CASE event WHEN 'pushed' THEN 0 WHEN 'started' THEN 1 ELSE 2 END AS BIGINT) AS seq
           FROM tasks""",
        o.TASKS,
    )
)
def task_event_messages(spark, sf):
    """Task events written as JSON messages (whole seconds) and read back in a stable order."""
    folder = scratch_dir(spark, "task-messages")
    seconds = (times.micros(F.col("ts")) / times.US_PER_SECOND).cast("long").cast("string")
    driver.task_events(spark, sf).select(
        F.col("ip_id").cast("string").alias("ipId"), F.col("task_id").alias("taskId"), "event", seconds.alias("at"), F.col("retry_count").alias("retryCount")
    ).write.json(folder)
    return readers.task_events(spark, folder, zone="UTC")


@query(
    o.select(
        """SELECT id, name, category, weight, status FROM (
             SELECT id, name, category, weight, status FROM meta
             UNION ALL
             SELECT (SELECT max(id) FROM meta) + row_number() OVER (ORDER BY name), name, category, weight, status
             FROM plan WHERE id IS NULL)""",
        o.META,
        o.ENTRIES,
        PLAN,
    )
)
def import_insert_only(spark, sf):
    """The dimension after an import that changes no known entity."""
    meta = driver.metadata(spark, sf)
    plan = entities.import_plan(meta, driver.import_entries(spark, sf))
    return entities.apply_import(meta, plan, upsert=False).drop("name_en", "name_cn")


@query(
    f"""SELECT outcome, lang AS mode, error_class AS error_type, count(*) AS runs
        FROM ({ORACLES["error_class"]}) JOIN documents USING (doc_id) WHERE text IS NOT NULL GROUP BY 1, 2, 3
        UNION ALL SELECT 'empty_result', lang, NULL, count(*) FROM documents WHERE text IS NULL GROUP BY lang"""
)
def outcome_by_error(spark, sf):
    """Runs by outcome, mode and error type, whole documents read as error messages."""
    log = driver.table(spark, sf, "documents").select(F.col("lang").alias("mode"), F.col("text").alias("error_text"), F.lit(0).alias("items"))
    return tasks.outcome_by_error(log)


@query(
    """SELECT CAST(c_custkey AS INTEGER) AS pos, c_name AS name, c_mktsegment AS category, CASE WHEN c_custkey % 3 <> 0 THEN CAST(c_custkey % 5 AS DOUBLE) END AS weight,
              CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 0 END AS tags FROM customer"""
)
def seed_file_entries(spark, sf):
    """Entries of a seed file written from the customers and read back; fields that are missing are NULL."""
    key = F.col("c_custkey")
    entry = F.struct(
        F.col("c_name").alias("name"), F.col("c_mktsegment").alias("category"), F.when(key % 2 == 0, F.array(F.lit("a"), F.lit("b"))).alias("tags"),
        F.when(key % 3 != 0, (key % 5).cast("double")).alias("weight"), F.format_string("%d", key).alias("external_id"),
    )
    folder = scratch_dir(spark, "seed")
    rows = driver.table(spark, sf, "customer").select(F.format_string('{"ips": [%s]}', F.to_json(entry)).alias("value"))
    rows.write.text(folder)
    back = readers.seed_entries(spark, folder, lines=True)
    return back.select(F.col("external_id").cast("int").alias("pos"), "name", "category", "weight", F.coalesce(F.size("tags"), F.lit(0)).alias("tags"))


@query(
    """SELECT o_orderkey AS page_id, 'm' || o_orderkey AS source_id, CASE WHEN o_orderkey % 2 = 0 THEN 'on_sale' ELSE 'sold' END AS status, CAST(round(o_totalprice) AS INTEGER) AS price
       FROM orders WHERE o_orderkey % 5 NOT IN (2, 4)"""
)
def merged_status_pages(spark, sf):
    """Items of on-sale and of sold pages together; the kind of page decides the status."""
    found = listing_pages.items(driver.listing_pages(spark, sf)).filter(F.startswith("source_id", F.lit("m")))
    even = F.col("page_id") % 2 == 0
    merged = listing_pages.merge_status_pages(found.filter(even), found.filter(~even))
    return merged.select("page_id", "source_id", "status", "price")


@query(
    o.select("SELECT id FROM (SELECT id, row_number() OVER (ORDER BY weight DESC, id) AS r FROM meta WHERE status <> 'deleted') WHERE r BETWEEN 101 AND 200", o.META)
)
def bounded_request_page(spark, sf):
    """A page asked for with a size beyond the public bound: the request rules cut it to 100 rows."""
    asked = boards.normalise_request(page=2, size=1000)
    return boards.page(entities.entity_list(driver.metadata(spark, sf)), [F.desc("weight"), F.col("id")], asked.page, asked.size).select("id")
