"""Sources: message files or streams, seed files, stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marketebb import schemas
from marketebb.functions import times


def _reader(spark: SparkSession, streaming: bool, max_files: int | None):
    if not streaming:
        return spark.read
    reader = spark.readStream
    return reader.option("maxFilesPerTrigger", max_files) if max_files else reader


def crawl_results(
    spark: SparkSession, path: str, streaming: bool = False, max_files: int | None = None, zone: str = times.MARKET_ZONE
) -> DataFrame:
    """Result messages from JSON lines files."""
    raw = _reader(spark, streaming, max_files).schema(schemas.CRAWL_RESULT).json(path)
    return _results(raw, zone)


def crawl_results_from_text(messages: DataFrame, column: str = "value", zone: str = times.MARKET_ZONE) -> DataFrame:
    """Result messages from a text column, as a message bus delivers them."""
    parsed = messages.select(F.from_json(F.col(column).cast("string"), schemas.CRAWL_RESULT).alias("m")).select("m.*")
    return _results(parsed, zone)


def _results(raw: DataFrame, zone: str) -> DataFrame:
    return raw.select(
        F.col("ipId").cast("long").alias("ip_id"),
        F.coalesce("taskId", F.lit("")).alias("task_id"),
        times.from_epoch(F.col("crawledAt").cast("long"), zone).alias("crawl_ts"),
        F.coalesce("errorMessage", F.lit("")).alias("error_message"),
        F.coalesce("pagesCrawled", F.lit(0)).alias("pages_crawled"),
        F.coalesce("retryCount", F.lit(0)).alias("retry_count"),
        F.coalesce("items", F.array().cast(schemas.MESSAGE_ITEMS)).alias("items"),
    )


def usable(results: DataFrame) -> DataFrame:
    """Results without an error; "no_items" is a finding, not an error."""
    return results.filter(F.col("error_message").isin("", "no_items"))


def status_of(proto_status: Column) -> Column:
    """Message status to state status; a missing status means on sale."""
    return F.when(proto_status == "ITEM_STATUS_SOLD", "sold").otherwise("available")


def observations(results: DataFrame) -> DataFrame:
    """One row per item of each usable result; items without an id drop out."""
    return (
        usable(results)
        .select("ip_id", "task_id", "crawl_ts", F.posexplode("items").alias("pos", "i"))
        .select(
            "ip_id",
            "task_id",
            "crawl_ts",
            F.col("pos").cast("long").alias("pos"),
            F.col("i.sourceId").alias("source_id"),
            status_of(F.col("i.status")).alias("status"),
            F.coalesce("i.price", F.lit(0)).alias("price"),
            F.coalesce("i.title", F.lit("")).alias("title"),
            F.coalesce("i.imageUrl", F.lit("")).alias("image_url"),
            F.coalesce("i.itemUrl", F.lit("")).alias("item_url"),
        )
        .filter(F.length("source_id") > 0)
    )


def task_events(
    spark: SparkSession, path: str, streaming: bool = False, max_files: int | None = None, zone: str = times.MARKET_ZONE
) -> DataFrame:
    """Task events (pushed, started, acked, dead) from JSON lines files.

    Times are whole seconds, so ``seq`` orders events of one second: by try, then pushed, started, ended.
    """
    rank = F.when(F.col("event") == "pushed", 0).when(F.col("event") == "started", 1).otherwise(2)
    raw = _reader(spark, streaming, max_files).schema(schemas.TASK).json(path)
    raw = raw.withColumn("event", F.coalesce("event", F.lit("pushed")))
    return raw.select(
        F.col("taskId").alias("task_id"),
        F.col("ipId").cast("long").alias("ip_id"),
        "event",
        times.from_epoch(F.coalesce("at", "createdAt").cast("long"), zone).alias("ts"),
        F.coalesce("retryCount", F.lit(0)).alias("retry_count"),
        (F.coalesce("retryCount", F.lit(0)) * 4 + rank).cast("long").alias("seq"),
    )


def seed_entries(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Entries of a seed file ``{"ips": [...]}`` with their position in it; with ``lines`` each line is such a document."""
    doc = spark.read.schema(schemas.SEED_FILE).option("multiLine", not lines).json(path)
    return doc.select(F.posexplode("ips").alias("pos", "e")).select("pos", "e.*")


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A stored Parquet table with its fixed schema, whatever columns it is partitioned by."""
    stored = spark.read.schema(schemas.TABLES[name]).parquet(f"{root}/{name}")
    return stored.select(StructType.fromDDL(schemas.TABLES[name]).fieldNames())


def jdbc_table(
    spark: SparkSession, url: str, name: str, key: str = "id", parts: int = 1, bounds: tuple[int, int] | None = None, **options: str
) -> DataFrame:
    """A table of a live database; with bounds the read is split over ``parts`` tasks by key."""
    if name not in schemas.TABLES:
        raise ValueError(f"unknown table {name!r}")
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options)
    if bounds:
        reader = reader.options(
            partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts
        )
    return reader.load()


def pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PAGES).parquet(path)


def tags_from_json(text: Column) -> Column:
    """JSON array of text; NULL for NULL or bad JSON."""
    return F.from_json(text, "array<string>")


def tags_to_json(tags: Column) -> Column:
    return F.to_json(F.coalesce(tags, F.array().cast("array<string>")))


def bad_tags(text: Column) -> Column:
    """Whether a text is present but is no JSON array; such rows go to a reject list."""
    return text.isNotNull() & tags_from_json(text).isNull()


def item_from_json(text: Column) -> Column:
    return F.from_json(text, schemas.PRICE_ITEM)


def item_to_json(item: Column) -> Column:
    """JSON of a price item; NULL when it has no id."""
    return F.when(F.length(item["source_id"]) > 0, F.to_json(item))
