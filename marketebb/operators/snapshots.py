"""Item snapshots: the latest known form of each listing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketebb.functions import times
from marketebb.operators.transitions import DETAIL, LISTING


def snapshot_delta(observations: DataFrame, sold_at: str = "first_insert") -> DataFrame:
    """Snapshots of a set of observations, one row per listing.

    ``sold_at="first_insert"`` sets the time only when the very first sighting is already sold;
    ``"transition"`` takes the first time the listing is seen sold. Only mergeable extremes are
    used, so copies of a listing are combined before the shuffle.
    """
    if sold_at not in ("first_insert", "transition"):
        raise ValueError(f"unknown sold_at {sold_at!r}")
    seen = observations.filter(F.length("source_id") > 0)
    order = F.struct("crawl_ts", "pos")
    detail = [c for c in DETAIL if c in observations.columns]
    sold = F.col("status") == "sold"
    born_sold = F.when(F.col("first.status") == "sold", F.col("first.crawl_ts"))
    sold_time = born_sold if sold_at == "first_insert" else F.col("first_sold")
    return (
        seen.groupBy(*LISTING)
        .agg(
            F.max_by(F.struct("price", "status", *detail), order).alias("last"),
            F.min_by(F.struct("crawl_ts", "status"), order).alias("first"),
            F.min(F.when(sold, F.col("crawl_ts"))).alias("first_sold"),
            F.max("crawl_ts").alias("last_seen_at"),
            (F.min("price") != F.max("price")).alias("price_changed"),
        )
        .select(
            *LISTING,
            *[F.col(f"last.{c}").alias(c) for c in detail],
            F.col("last.price").alias("price"),
            F.when(F.col("last.status") == "sold", "sold").otherwise("on_sale").alias("status"),
            F.col("first.crawl_ts").alias("first_seen_at"),
            "last_seen_at",
            sold_time.alias("sold_at"),
            "price_changed",
            F.col("last_seen_at").alias("updated_at"),
        )
    )


def merge_snapshots(rows: DataFrame, gen: str, sold_at: str = "first_insert") -> DataFrame:
    """Several generations of snapshots merged, ``gen`` telling older from newer.

    first_seen_at is that of the oldest generation; so is sold_at, unless it follows transitions.
    """
    plain = [c for c in rows.columns if c != gen]
    newest = [c for c in plain if c not in (*LISTING, "first_seen_at", "sold_at", "price_changed")]
    # wrapped in a struct, so a NULL of the oldest generation counts as its value
    kept = F.min_by(F.struct("sold_at"), F.col(gen))["sold_at"] if sold_at == "first_insert" else F.min("sold_at")
    return (
        rows.groupBy(*LISTING)
        .agg(
            F.max_by(F.struct(*newest), F.col(gen)).alias("n"),
            F.min_by("first_seen_at", F.col(gen)).alias("first_seen_at"),
            kept.alias("sold_at"),
            (F.bool_or("price_changed") | (F.min("price") != F.max("price"))).alias("price_changed"),
        )
        .select(*LISTING, "n.*", "first_seen_at", "sold_at", "price_changed")
        .select(*plain)
    )


def upsert_snapshots(old: DataFrame, delta: DataFrame, sold_at: str = "first_insert") -> DataFrame:
    """Merge of stored and new snapshots; first_seen_at and a stored sold_at are kept."""
    rows = old.withColumn("gen", F.lit(0)).unionByName(delta.withColumn("gen", F.lit(1)))
    return merge_snapshots(rows, "gen", sold_at).select(*old.columns)


def mark_sold(snapshots: DataFrame, sold: DataFrame, at) -> DataFrame:
    """Set status and time of the listings named in ``sold`` (ip_id, source_id)."""
    hit = sold.select(*LISTING).distinct().withColumn("__hit", F.lit(True))
    joined = snapshots.join(hit, LISTING, "left")
    return (
        joined.withColumn("status", F.when(F.col("__hit"), "sold").otherwise(F.col("status")))
        .withColumn("sold_at", F.when(F.col("__hit"), times.ntz(at)).otherwise(F.col("sold_at")))
        .select(*snapshots.columns)
    )


def items_page(snapshots: DataFrame, ip_id: int | None = None, status: str | None = None) -> DataFrame:
    """Item list filter of one entity, optionally of one status."""
    if ip_id is not None:
        snapshots = snapshots.filter(F.col("ip_id") == ip_id)
    if status:
        snapshots = snapshots.filter(F.col("status") == status)
    return snapshots


def active_items(snapshots: DataFrame, ip_id: int, limit: int = 0) -> DataFrame:
    """On-sale items, newest first; limit 0 means all."""
    rows = items_page(snapshots, ip_id, "on_sale").orderBy(F.desc("last_seen_at"), "source_id")
    return rows.limit(limit) if limit > 0 else rows


def recently_sold(snapshots: DataFrame, ip_id: int, since, limit: int = 0) -> DataFrame:
    """Items sold since a time, newest first; limit 0 means all."""
    rows = (
        items_page(snapshots, ip_id, "sold")
        .filter(F.col("sold_at") >= times.ntz(since))
        .orderBy(F.desc("sold_at"), "source_id")
    )
    return rows.limit(limit) if limit > 0 else rows


def positive_prices(snapshots: DataFrame) -> DataFrame:
    return snapshots.filter(F.col("price") > 0)
