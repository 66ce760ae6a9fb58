"""Listing life cycle: from repeated sightings to state transitions.

A listing is remembered for a time-to-live that depends on its last status. Each crawl is compared
with the state *before* the crawl, so two sightings of one listing in one crawl are both judged
against the same earlier state; the later one (by ``pos``) becomes the new state.

Input rows: ``ip_id, source_id, status ('available'|'sold'), price, crawl_ts, pos``, and optionally
``title, image_url, item_url``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketebb.functions import times
from marketebb.operators import slices

HOUR_US = 3600 * times.US_PER_SECOND
TTL_AVAILABLE_HOURS = 24
TTL_SOLD_HOURS = 48
LISTING = ["ip_id", "source_id"]
DETAIL = ["title", "image_url", "item_url"]
SOLD_KINDS = ["sold", "new_sold"]


def ttl_us(status: Column, available_hours: int = TTL_AVAILABLE_HOURS, sold_hours: int = TTL_SOLD_HOURS) -> Column:
    return F.when(status == "sold", F.lit(sold_hours * HOUR_US)).otherwise(F.lit(available_hours * HOUR_US))


def kind_of(status: Column, price: Column, prev_status: Column, prev_price: Column) -> Column:
    """Transition name, NULL for no transition; a NULL previous status means unknown or expired."""
    return (
        F.when(prev_status.isNull(), F.when(status == "sold", "new_sold").otherwise("new_listing"))
        .when((prev_status == "available") & (status == "sold"), "sold")
        .when((prev_status == "sold") & (status == "available"), "relisted")
        .when((prev_status == "available") & (status == "available") & (prev_price != price), "price_change")
    )


def sightings(observations: DataFrame) -> DataFrame:
    """Identical sightings of one crawl folded into one row with a count.

    The fold is combined before the shuffle, so copies of one listing never meet as rows.
    """
    detail = [c for c in DETAIL if c in observations.columns]
    extra = [F.max_by(F.struct(*detail), "pos").alias("detail")] if detail else []
    return (
        observations.filter(F.length("source_id") > 0)
        .groupBy(*LISTING, "crawl_ts", "status", "price")
        .agg(F.count(F.lit(1)).alias("copies"), F.max("pos").alias("last_pos"), *extra)
        .withColumn("t", times.micros(F.col("crawl_ts")))
        .withColumn("slice", F.col("crawl_ts").cast("date"))
    )


def transitions(
    observations: DataFrame,
    state: DataFrame | None = None,
    available_hours: int = TTL_AVAILABLE_HOURS,
    sold_hours: int = TTL_SOLD_HOURS,
) -> DataFrame:
    """One row per distinct sighting with its transition (``kind`` NULL when nothing changed).

    ``copies`` counts identical sightings of the crawl; sums over transitions weight by it.
    ``is_close`` marks the sighting that becomes the state, ``live_until`` is the last microsecond
    for which that state holds.

    ``state`` (ip_id, source_id, status, price, first_seen, last_seen, as from :func:`state_table`)
    is an optional starting state for work in instalments; sightings must be newer than it. Its rows
    come back too, marked ``given`` and counted zero times, so that what follows knows what was alive.
    """
    seen = sightings(observations).withColumn("given", F.lit(False))
    since = F.lit(None).cast("timestamp_ntz")
    if state is not None:
        known = state.select(
            *LISTING,
            F.col("last_seen").alias("crawl_ts"),
            "status",
            "price",
            F.lit(0).cast("long").alias("copies"),
            F.lit(-1).cast("long").alias("last_pos"),
            times.micros(F.col("last_seen")).alias("t"),
            F.col("last_seen").cast("date").alias("slice"),
            F.lit(True).alias("given"),
            F.col("first_seen").alias("since"),
        )
        seen = seen.withColumn("since", since).unionByName(known, allowMissingColumns=True)
        since = F.col("since")

    # The struct names every column of a sighting, so both users of the fold above ask for the same
    # columns and Spark reuses its shuffle instead of scanning the observations twice.
    close = F.struct("t", "last_pos", "status", "price", "copies", *[c for c in ("detail",) if c in seen.columns])
    seen = slices.carry(
        seen,
        LISTING,
        "slice",
        {"__close": F.max(close), "__open": F.min("t")},
        lambda w: {"__before": F.lag("__close").over(w), "__after": F.lead("__open").over(w)},
    )

    in_slice = Window.partitionBy(*LISTING, "slice")
    in_order = in_slice.orderBy("t", "last_pos")
    earlier_crawls = in_slice.orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
    same_crawl = Window.partitionBy(*LISTING, "slice", "t")
    seen = (
        seen.withColumn("__next_row", F.lead("t").over(in_order))
        .withColumn("__here", F.max(close).over(earlier_crawls))
        .withColumn("__last", F.max(F.struct("last_pos", "price")).over(same_crawl))
    )
    before = F.coalesce(F.col("__here"), F.col("__before"))
    alive = before["t"] + ttl_us(before["status"], available_hours, sold_hours) > F.col("t")
    prev_status = F.when(alive, before["status"])
    prev_price = F.when(alive, before["price"])
    next_t = F.coalesce(F.col("__next_row"), F.col("__after"))
    end = F.col("t") + ttl_us(F.col("status"), available_hours, sold_hours) - 1

    columns = [
        *LISTING,
        "crawl_ts",
        "status",
        "price",
        "copies",
        "last_pos",
        F.when(
            ~F.col("given"), kind_of(F.col("status"), F.col("price"), F.col("prev_status"), F.col("prev_price"))
        ).alias("kind"),
        "prev_status",
        "prev_price",
        F.col("__last")["price"].alias("close_price"),
        "is_close",
        "live_until",
        "t",
        "slice",
        "given",
        since.alias("since"),
    ]
    if "detail" in seen.columns:
        columns.append("detail")
    return (
        seen.withColumn("prev_status", prev_status)
        .withColumn("prev_price", prev_price)
        .withColumn("is_close", next_t.isNull() | (next_t > F.col("t")))
        .withColumn("live_until", F.when(F.col("is_close"), F.least(end, next_t)))
        .select(*columns)
    )


def crawl_flow(trans: DataFrame, crawls: DataFrame | None = None) -> DataFrame:
    """Per entity and crawl: counts, and the flow after first-crawl suppression.

    A crawl is a first crawl when no listing of the entity is alive just before it; its new and
    sold listings are history, not flow. ``crawls`` (ip_id, crawl_ts) adds crawls that saw nothing.
    """

    def total(*kinds: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("kind").isin(*kinds), F.col("copies"))), F.lit(0))

    per_crawl = trans.groupBy("ip_id", "crawl_ts").agg(
        F.sum("copies").alias("observed"),
        total("new_listing").alias("new_listings"),
        total(*SOLD_KINDS).alias("sold"),
        total("price_change").alias("price_changes"),
        total("relisted").alias("relisted"),
        F.max("live_until").alias("__until"),
        F.bool_and("given").alias("__given"),
    )
    if crawls is not None:
        per_crawl = crawls.select("ip_id", "crawl_ts").distinct().join(per_crawl, ["ip_id", "crawl_ts"], "full")
        per_crawl = per_crawl.fillna(0, ["observed", "new_listings", "sold", "price_changes", "relisted"])
    per_crawl = per_crawl.withColumn("t", times.micros(F.col("crawl_ts"))).withColumn(
        "slice", F.col("crawl_ts").cast("date")
    )
    known = slices.running(
        per_crawl, ["ip_id"], "slice", ["t"], {"__alive": ("max", F.col("__until"))}, inclusive=False
    )
    first = F.col("__alive").isNull() | (F.col("__alive") < F.col("t"))
    return (
        known.filter(~F.coalesce("__given", F.lit(False)))
        .withColumn("first_crawl", first)
        .withColumn("inflow", F.when(first, F.lit(0)).otherwise(F.col("new_listings")))
        .withColumn("outflow", F.when(first, F.lit(0)).otherwise(F.col("sold")))
        .drop("__alive", "__until", "__given", "t", "slice")
    )


def first_seen(trans: DataFrame) -> DataFrame:
    """First sighting of the current life of each listing at each crawl; it restarts after expiry."""
    closes = trans.filter("is_close").withColumn(
        "__birth", F.when(F.col("prev_status").isNull(), F.col("t"))
    )
    lived = slices.running(closes, LISTING, "slice", ["t"], {"__first": ("max", F.col("__birth"))})
    return lived.select(
        *LISTING, "crawl_ts", "status", "price", times.from_micros(F.col("__first")).alias("first_seen")
    )


def state_table(trans: DataFrame) -> DataFrame:
    """Latest state of each listing, expired or not: the look-up form of the state."""
    latest = F.max_by(F.struct("status", "price", "crawl_ts", "live_until"), F.col("t"))
    born = F.max(F.coalesce("since", F.when(F.col("prev_status").isNull(), F.col("crawl_ts"))))
    return (
        trans.filter("is_close")
        .groupBy(*LISTING)
        .agg(latest.alias("s"), born.alias("first_seen"))
        .select(
            *LISTING,
            F.col("s.status").alias("status"),
            F.col("s.price").alias("price"),
            "first_seen",
            F.col("s.crawl_ts").alias("last_seen"),
            times.from_micros(F.col("s.live_until") + 1).alias("expires_at"),
        )
    )


def live_items(state: DataFrame, now) -> DataFrame:
    """Listings per entity whose state has not expired at ``now``."""
    return (
        state.filter(F.col("expires_at") > times.ntz(now))
        .groupBy("ip_id")
        .agg(F.count(F.lit(1)).alias("live_items"))
    )


def forget(state: DataFrame, ip_ids: DataFrame | None = None, listings: DataFrame | None = None) -> DataFrame:
    """State without the given listings or without all listings of the given entities."""
    if listings is not None:
        state = state.join(listings.select(*LISTING), LISTING, "left_anti")
    if ip_ids is not None:
        state = state.join(ip_ids.select("ip_id"), "ip_id", "left_anti")
    return state
