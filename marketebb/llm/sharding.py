"""Shards of near equal bytes over fixed virtual slots, with DataFrame functions alone.

A record belongs for ever to one of ``SLOTS`` virtual slots, by the hash of its doc_id. The bytes of each slot are summed,
and a versioned map says which shard holds which slot. A new map puts the largest slots first, each into the lightest shard.
When data or shards change, the stored map is edited: only as many slots move as are needed, and the edit is a new version. Records
are placed by what is read back from the store. A slot with more than ``HEAVY`` of a shard's share holds a doc_id that very many rows have (or none):
its records are dealt to all slots by doc_id and row number. The map has ``SLOTS`` rows whatever the data, so it is computed in one row with ``aggregate`` and joined (Catalyst may
broadcast it, its size is fixed).

Law: bytes. A record's size is the UTF-8 bytes of its text (null: none) plus 8.

The place of a record in its shard counts from 0 without gaps: rows are numbered within (slot, input partition), the start
of such a run is the sum of the runs before it. Runs number at most slots times ``RUNS`` for each shard, so no window ever
holds a shard, and copies of one record are spread over the runs.

Nulls: a null doc_id is a key like others. Equal rows get places of their own. Texts count whole; where a single record has more
bytes than a shard's share, no assignment is near equal, and its slot stands alone. Of slots of equal bytes the lower number comes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketebb.llm.shared import scratch_dir, stage
from marketebb.sources.sinks import exists

SLOTS, SHARDS, OVERHEAD, RUNS, TOLERANCE, HEAVY = 4096, 24, 8, 64, 0.01, 0.25


def virtual_slot(key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot and the run (by input partition) of every record, written once."""
    text = F.col("text").cast("binary")
    out = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + OVERHEAD).alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        virtual_slot(F.col("doc_id"), slots).alias("virtual_slot"),
        F.pmod(F.spark_partition_id(), F.lit(RUNS)).alias("run"),
        F.monotonically_increasing_id().alias("row"),
    )
    return stage(out, "records")


def slot_bytes(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(virtual_slot, bytes) of all slots, empty ones with 0."""
    used = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"))
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(used, "virtual_slot", "left").select("virtual_slot", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"))


def spread(rows: DataFrame, shards: int, slots: int = SLOTS) -> DataFrame:
    """The records of slots that are large beside a shard get slots of their own; at most ``shards / HEAVY`` slots are."""
    sums = slot_bytes(rows, slots)
    limit = sums.agg(F.sum("bytes")).first()[0] / shards * HEAVY
    heavy = [r.virtual_slot for r in sums.where(F.col("bytes") > max(limit, 1)).collect()]
    own = F.pmod(F.xxhash64("doc_id", "row"), F.lit(slots)).cast("int")
    return rows.withColumn("virtual_slot", F.when(F.col("virtual_slot").isin(heavy), own).otherwise(F.col("virtual_slot"))) if heavy else rows


def _lightest(loads: Column) -> Column:
    return F.array_position(loads, F.array_min(loads)).cast("int") - 1


def _with(array: Column, at: Column, value: Column) -> Column:
    return F.transform(array, lambda x, i: F.when(i == at, value).otherwise(x))


def new_map(slots: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Version 1: (version, virtual_slot, bytes, shard), largest slot first into the lightest shard.

    Empty slots are dealt in turn.
    """
    ordered = slots.agg(F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("b"), "virtual_slot"))).alias("s"))
    none = F.array_repeat(F.lit(0).cast("long"), shards)

    def step(acc: Column, x: Column) -> Column:
        to = F.when(x["b"] == 0, F.pmod(x["virtual_slot"], F.lit(shards))).otherwise(_lightest(acc["loads"]))
        return F.struct(_with(acc["loads"], to, F.element_at(acc["loads"], to + 1) - x["b"]).alias("loads"), F.concat(acc["to"], F.array(to)).alias("to"))

    dealt = F.aggregate("s", F.struct(none.alias("loads"), F.array().cast("array<int>").alias("to")), step, lambda acc: acc["to"])
    pairs = ordered.select(F.explode(F.arrays_zip(F.col("s"), dealt.alias("to"))).alias("z"))
    return pairs.select(F.lit(1).alias("version"), F.col("z.s.virtual_slot").alias("virtual_slot"), (-F.col("z.s.b")).alias("bytes"), F.col("z.to").alias("shard"))


def edited_map(old: DataFrame, slots: DataFrame, shards: int, tolerance: float = TOLERANCE) -> DataFrame:
    """The next version for new slot sizes or more shards.

    From the largest slot down, a slot moves to the lightest shard if that is under the mean, its own keeps at least the mean
    and that one gets no more than the mean, all up to the tolerance. All other slots stay.
    """
    rows = old.select("version", "virtual_slot", "shard").join(slots, "virtual_slot")
    one = rows.agg(
        F.max("version").alias("version"),
        F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("b"), "virtual_slot", "shard"))).alias("s"),
        (F.sum("bytes") / shards).alias("mean"),
    )
    start = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda k: F.aggregate(F.filter("s", lambda x: x["shard"] == k), F.lit(0).cast("long"), lambda a, x: a - x["b"]))

    def step(acc: Column, x: Column) -> Column:
        own, to = F.element_at(acc["loads"], x["shard"] + 1), _lightest(acc["loads"])
        least = F.array_min(acc["loads"])
        move = (own + x["b"] >= F.col("mean") * (1 - tolerance)) & (least - x["b"] <= F.col("mean") * (1 + tolerance)) & (x["b"] < 0) & (least < F.col("mean") * (1 - tolerance))
        loads = F.when(move, _with(_with(acc["loads"], x["shard"], own + x["b"]), to, least - x["b"])).otherwise(acc["loads"])
        return F.struct(loads.alias("loads"), F.concat(acc["to"], F.array(F.when(move, to).otherwise(x["shard"]))).alias("to"))

    dealt = F.aggregate("s", F.struct(start.alias("loads"), F.array().cast("array<int>").alias("to")), step, lambda acc: acc["to"])
    pairs = one.select("version", F.explode(F.arrays_zip(F.col("s"), dealt.alias("to"))).alias("z"))
    return pairs.select((F.col("version") + 1).alias("version"), F.col("z.s.virtual_slot").alias("virtual_slot"), (-F.col("z.s.b")).alias("bytes"), F.col("z.to").alias("shard"))


def save_map(slot_map: DataFrame, path: str) -> None:
    """Versions lie side by side, one folder each; an older version stays readable."""
    slot_map.write.partitionBy("version").mode("append").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version, the newest by default."""
    every = spark.read.parquet(path)
    chosen = F.lit(version) if version is not None else every.agg(F.max("version")).first()[0]
    return every.where(F.col("version") == chosen).select("version", "virtual_slot", "bytes", "shard")


def placed(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """With shard, map_version and slot, the place of the row in its shard (from 0, no gaps)."""
    runs = rows.groupBy("virtual_slot", "run").agg(F.count("*").alias("n")).join(slot_map.select("version", "virtual_slot", "shard"), "virtual_slot")
    begin = F.sum("n").over(Window.partitionBy("shard").orderBy("virtual_slot", "run")) - F.col("n")
    runs = runs.select("virtual_slot", "run", "shard", F.col("version").alias("map_version"), begin.alias("begin"))
    nth = F.row_number().over(Window.partitionBy("virtual_slot", "run").orderBy("doc_id", "row")) - 1
    return rows.withColumn("nth", nth).join(runs, ["virtual_slot", "run"]).withColumn("slot", F.col("begin") + F.col("nth"))


def next_map(rows: DataFrame, store: str, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """The map for these records, as read back from the store: an edit of the newest version there, or version 1."""
    spark, sums = rows.sparkSession, slot_bytes(rows, slots)
    new = stage(edited_map(load_map(spark, store), sums, shards) if exists(spark, store) else new_map(sums, shards), "slot-map")
    save_map(new, store)
    return load_map(spark, store)


def shard(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, store: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version of every document.

    ``store`` is the folder of the map's versions; without one a new store is begun.
    """
    rows = spread(records(docs, slots), shards, slots)
    slot_map = next_map(rows, store or scratch_dir(docs.sparkSession, "slot-maps"), shards, slots)
    return placed(rows, slot_map).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version",
    )
