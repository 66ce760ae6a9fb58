"""The listing life cycle as a stateful stream, one small record per listing.

Lowest latency form of :mod:`marketebb.operators.transitions`: each sighting comes out with its
transition as soon as its micro-batch is done. Listings are dealt over ``BUCKETS`` buckets by the hash of
(ip_id, source_id), so a hot entity is spread over all tasks. A bucket is the key of the state and holds the records of its
listings; a timer removes records at their TTL. What a key costs beyond its rows (a call, reads and writes of the state, an
Arrow batch of results) is paid for each bucket that a micro-batch touches, not for each listing; the records of a touched
bucket are written whole. The number of buckets must stay as it is for a checkpoint.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from marketebb.functions import times
from marketebb.operators.transitions import HOUR_US, LISTING, TTL_AVAILABLE_HOURS, TTL_SOLD_HOURS
from marketebb.streaming import with_rocksdb

OUTPUT = (
    "ip_id long, source_id string, t long, status string, price int, pos long, "
    "kind string, prev_status string, prev_price int, late boolean"
)
# The record before the current crawl is kept beside the current one: sightings of one crawl are all
# judged against the state before it, even when they arrive in different micro-batches.
STATE = (
    "listings array<struct<ip_id long, source_id string, t long, pos long, status string, price int, "
    "before_status string, before_price int, ms long>>"
)
BUCKETS = 16_384


class ListingLife(StatefulProcessor):
    out = Row("ip_id", "source_id", "t", "status", "price", "pos", "kind", "prev_status", "prev_price", "late")

    def __init__(self, available_hours: int = TTL_AVAILABLE_HOURS, sold_hours: int = TTL_SOLD_HOURS, forget: bool = False):
        self.forget = forget
        self.ttl = {"available": available_hours * HOUR_US, "sold": sold_hours * HOUR_US}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        arrived = defaultdict(list)
        for r in rows:
            arrived[r.ip_id, r.source_id].append(r)
        now = timerValues.getCurrentProcessingTimeInMs() if self.forget else None
        records, timers = self._records(), set()
        for listing, seen in arrived.items():
            kept, out = self._step(listing, seen, records.get(listing), now)
            records[listing] = kept
            timers.add(kept[6])
            yield from out
        self._store(records)
        if self.forget:
            for expiry in timers.difference(self.handle.listTimers()):
                self.handle.registerTimer(expiry)

    def _records(self) -> dict[tuple, tuple]:
        held = self.last.get()
        return {tuple(r[:2]): tuple(r[2:]) for r in held[0]} if held else {}

    def _store(self, records: dict[tuple, tuple]) -> None:
        self.last.update(([(*listing, *record) for listing, record in records.items()],))

    def _step(self, listing, rows, kept, now) -> tuple[tuple, list[Row]]:
        """The record of a listing after these rows, and what comes out for them."""
        out = []
        t, pos, status, price, before_status, before_price = kept[:6] if kept else (None,) * 6
        for r in sorted(rows, key=lambda row: (row.t, row.pos)):
            if t is not None and r.t < t:
                out.append(self.out(*listing, r.t, r.status, r.price, r.pos, None, None, None, True))
                continue
            if t is None or r.t > t:
                alive = t is not None and r.t < t + self.ttl[status]
                before_status, before_price = (status, price) if alive else (None, None)
                t, pos = r.t, -1
            if r.pos >= pos:
                pos, status, price = r.pos, r.status, r.price
            kind = self._kind(r.status, r.price, before_status, before_price)
            out.append(self.out(*listing, r.t, r.status, r.price, r.pos, kind, before_status, before_price, False))
        expiry = now + self.ttl[status] // 1000 if self.forget else None
        return (t, pos, status, price, before_status, before_price, expiry), out

    @staticmethod
    def _kind(status, price, before_status, before_price):
        if before_status is None:
            return "new_sold" if status == "sold" else "new_listing"
        if before_status == "available":
            if status == "sold":
                return "sold"
            return "price_change" if price != before_price else None
        return "relisted" if status == "available" else None

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # a listing seen since has a later time of its own
        over = expiredTimerInfo.getExpiryTimeInMs()
        left = {listing: record for listing, record in self._records().items() if record[6] > over}
        if left:
            self._store(left)
        else:
            self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def transition_stream(
    observations: DataFrame,
    available_hours: int = TTL_AVAILABLE_HOURS,
    sold_hours: int = TTL_SOLD_HOURS,
    forget: bool = False,
) -> DataFrame:
    """Streaming observations to one row per sighting with its transition.

    ``late`` marks sightings older than what is already known of the listing; they change nothing. No watermark stands
    before the state, which would drop them unseen. With ``forget`` a listing's record goes when its time to live has passed
    by the clock since its last row; that needs a trigger that keeps running (with available-now it would never end).
    """
    keyed = (
        with_rocksdb(observations)
        .filter(F.length("source_id") > 0)
        .select(
            *LISTING,
            "status",
            F.col("price").cast("int").alias("price"),
            F.col("pos").cast("long").alias("pos"),
            times.micros(F.col("crawl_ts")).alias("t"),
        )
    )
    bucket = F.pmod(F.xxhash64(*LISTING), F.lit(BUCKETS)).cast("int")
    moved = keyed.withColumn("bucket", bucket).groupBy("bucket").transformWithState(
        ListingLife(available_hours, sold_hours, forget), OUTPUT, "Append", "ProcessingTime" if forget else "None"
    )
    return moved.withColumn("crawl_ts", times.from_micros(F.col("t"))).drop("t")


def stored_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The listing state a stream has stored, as a table (one row per remembered listing)."""
    raw = spark.read.format("statestore").option("stateVarName", "last").load(checkpoint)
    held = raw.select(F.explode("value.listings").alias("r"))
    return held.select("r.ip_id", "r.source_id", "r.status", "r.price", times.from_micros(F.col("r.t")).alias("last_seen"))
