"""Views of the test tables in the shape of the market domain.

The tables hold no listings; these projections read them as if they did. Each is a plain
projection, so column pruning and filters still reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketebb.functions import times
from marketebb.functions.measures import liquidity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same table as a file stream. The pattern lets the path be one file or a folder."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def props_number() -> Column:
    """The number in the props text."""
    return F.regexp_extract("props", r"(\d+)", 1).cast("int")


def observations_of(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").alias("ip_id"),
        F.concat(F.lit("m"), (props_number() % 20).cast("string")).alias("source_id"),
        F.when(F.col("event_type") == "purchase", "sold").otherwise("available").alias("status"),
        F.round(F.col("value") * 100).cast("int").alias("price"),
        times.hours_floor(F.col("ts"), 6).alias("crawl_ts"),
        F.col("event_id").alias("pos"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ip_id, source_id, status, price, crawl_ts, pos) from ``events``."""
    return observations_of(table(spark, sf_dir, "events"))


def busy_observations(spark: SparkSession, sf_dir: str, minutes: int = 20) -> DataFrame:
    """The same events read as eight busy entities with several crawls an hour."""
    k = props_number()
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 8).alias("ip_id"),
        F.concat(F.lit("m"), k.cast("string")).alias("source_id"),
        F.when(F.col("event_type").isin("purchase", "click"), "sold").otherwise("available").alias("status"),
        F.round(F.col("value") * 100).cast("int").alias("price"),
        times.minutes_floor(F.col("ts"), minutes).alias("crawl_ts"),
        F.col("event_id").alias("pos"),
    )


def crawl_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result messages (arrival, value) of the busy events, one for each crawl of an entity, as JSON text.

    They arrive in four lots. By entity and number of the crawl some come a lot late, some twice, some tell of a failed crawl and
    some of a time 40 days ahead.
    """
    seen = busy_observations(spark, sf_dir, 360)
    item = F.struct(
        "pos", F.col("source_id").alias("sourceId"), "price", F.when(F.col("status") == "sold", "ITEM_STATUS_SOLD").alias("status")
    )
    crawls = seen.groupBy("ip_id", "crawl_ts").agg(F.sort_array(F.collect_list(item)).alias("items"))
    seconds = F.floor(times.micros(F.col("crawl_ts")) / times.US_PER_SECOND)
    n = F.floor(seconds / 21600) + F.col("ip_id")
    lot = F.least(F.floor((F.dayofmonth("crawl_ts") - 1) / 8) + (n % 11 == 3).cast("int"), F.lit(3))
    told = seconds + F.when((n + F.col("ip_id")) % 97 == 7, 40 * 86400).otherwise(0)
    message = F.struct(
        F.col("ip_id").cast("string").alias("ipId"),
        F.concat_ws("-", F.lit("t"), F.col("ip_id").cast("string"), seconds.cast("string")).alias("taskId"),
        told.cast("string").alias("crawledAt"),
        F.when(n % 13 == 5, "net::ERR_FAILED").alias("errorMessage"),
        F.transform("items", lambda i: i.dropFields("pos")).alias("items"),
    )
    lots = F.when(n % 5 == 0, F.array_distinct(F.array(lot, F.least(lot + 1, F.lit(3))))).otherwise(F.array(lot))
    return crawls.select(F.explode(lots.cast("array<int>")).alias("arrival"), F.to_json(message).alias("value"))


def import_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An import list from ``customer``: known, new, repeated and nameless entries."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("pos"),
        F.when(key % 50 == 7, "")
        .when(key % 3 == 0, F.col("c_name"))
        .otherwise(F.concat(F.lit("New#"), (key % 400).cast("string")))
        .alias("name"),
        F.concat(F.lit("x-"), F.col("c_mktsegment")).alias("category"),
        (F.col("c_custkey") % 5 - 1).cast("double").alias("weight"),
    )


def page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items per result page of a task, from ``events``."""
    k = props_number()
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("task_id"),
        F.when(F.col("event_id") % 2 == 0, "on_sale").otherwise("sold").alias("status"),
        F.floor(F.col("event_id") / 2).cast("long").alias("page"),
        F.when(F.col("event_type") == "error", F.lit(None).cast("int"))
        .when(k % 7 == 0, 0)
        .otherwise(k)
        .alias("items"),
    )


def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One result page per order, written as listing markup.

    By order key modulo five: shop listings (2), prices without a currency sign (3), place holders
    without a price (4). Each page repeats its cell with another price, as overlapping scrolls do.
    """
    kind = F.col("o_orderkey") % 5
    key = F.col("o_orderkey").cast("string")
    yen = F.round("o_totalprice").cast("int")
    href = F.when(kind == 2, F.concat(F.lit("/shops/product/"), key)).otherwise(F.concat(F.lit("/item/m"), key))
    sticker = F.when(
        F.col("o_orderstatus") == "F", '<div data-testid="thumbnail-sticker" aria-label="売り切れ"></div>'
    ).otherwise("")

    def cell(amount: Column) -> Column:
        digits = F.format_number(amount, 0)
        plain = F.concat(F.lit('<span class="merPrice">'), digits, F.lit("</span>"))
        signed = F.concat(
            F.lit('<span class="merPrice"><span class="currency">¥</span><span class="number__x">'),
            digits,
            F.lit("</span></span>"),
        )
        return F.concat(
            F.lit('<li data-testid="item-cell"><a href="'),
            href,
            F.lit('"><img alt="Part &amp; '),
            F.col("o_custkey").cast("string"),
            F.lit('のサムネイル" src="/t.webp">'),
            sticker,
            F.when(kind == 4, "").when(kind == 3, plain).otherwise(signed),
            F.lit("</a></li>"),
        )

    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("page_id"),
        F.concat(F.lit("<html><body><ul>"), cell(yen), cell(yen + 1), F.lit("</ul></body></html>")).alias("html"),
    )


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity dimension from ``customer``."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("id"),
        F.col("c_name").alias("name"),
        F.concat(F.lit("en "), F.col("c_name")).alias("name_en"),
        F.concat(F.lit("cn "), F.col("c_name")).alias("name_cn"),
        F.col("c_mktsegment").alias("category"),
        (F.lit(1.0) + (key % 4) / 4).alias("weight"),
        F.when(key % 10 == 0, "paused").when(key % 37 == 5, "deleted").otherwise("active").alias("status"),
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item snapshots from ``lineitem``: the large table."""
    sold = F.col("l_linestatus") == "F"
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("ip_id"),
        F.concat_ws("_", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("source_id"),
        F.round("l_extendedprice").cast("int").alias("price"),
        F.when(sold, "sold").otherwise("on_sale").alias("status"),
        F.when(sold, F.col("l_shipdate")).alias("sold_at"),
        F.col("l_shipdate").alias("first_seen_at"),
        F.col("l_shipdate").alias("last_seen_at"),
        F.col("l_shipdate").alias("updated_at"),
    )


def shipment_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hour rows over several years from ``lineitem``, for the roll-up chain."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("ip_id"), times.hour_floor(F.col("l_shipdate")).alias("hour_bucket"))
        .agg(
            F.count_if(F.col("l_linestatus") == "O").alias("inflow"),
            F.count_if(F.col("l_linestatus") == "F").alias("outflow"),
        )
        .withColumn("liquidity_index", liquidity(F.col("inflow"), F.col("outflow")))
    )


def task_events_of(events: DataFrame) -> DataFrame:
    return events.select(
        F.concat_ws("_", F.lit("t"), F.col("user_id").cast("string"), (F.col("event_id") % 3).cast("string")).alias(
            "task_id"
        ),
        F.col("user_id").alias("ip_id"),
        F.when(F.col("event_type").isin("signup", "view"), "pushed")
        .when(F.col("event_type") == "click", "started")
        .when(F.col("event_type") == "purchase", "acked")
        .otherwise("dead")
        .alias("event"),
        F.col("ts"),
        (props_number() % 5).alias("retry_count"),
        F.col("event_id").alias("seq"),
    )


def task_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return task_events_of(table(spark, sf_dir, "events"))


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collector log from ``events``: errors split into blocks and other failures."""
    return run_log_of(table(spark, sf_dir, "events"))


def run_log_of(events: DataFrame) -> DataFrame:
    k = props_number()
    return events.select(
        F.col("event_id").alias("task_id"),
        F.concat(F.lit("n"), (F.col("user_id") % 16).cast("string")).alias("node"),
        F.col("ts"),
        F.when(F.col("event_type") != "error", F.when(k % 9 == 0, "empty_result").otherwise("success"))
        .when(k % 2 == 0, "403_forbidden")
        .otherwise("error")
        .alias("outcome"),
        F.when(k % 3 == 0, "proxy").otherwise("direct").alias("mode"),
        F.col("value").alias("duration_s"),
    )
