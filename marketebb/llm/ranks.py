"""Places of rows within groups, for groups of any size, and CRC-32 in SQL for the comparison queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketebb.llm.shared import discard, stage

_PLACES = (1 << 33) - 1


def same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def ranked(rows: DataFrame, group: Sequence[str], order: Sequence[str], label: str) -> tuple[DataFrame, DataFrame]:
    """(rows with ``_part`` and ``_pos``, runs): what it takes to number the rows of each group from 0, nulls first.

    The rows are range-partitioned by group and order and written, so a large group lies in many partitions. A run is the
    part of a group in one partition: ``_part``, the group, ``_first`` (least ``_pos``), ``_n`` rows, ``_start`` (rows of the group in earlier
    partitions) and ``_total`` (rows of the group). A group has at most as many runs as there are partitions. Equal rows are
    spread by a row number, which leaves open only which of them comes first.
    """
    rows = stage(rows.withColumn("_row", F.monotonically_increasing_id()), label)
    by = [F.col(c).asc_nulls_first() for c in (*group, *order, "_row")]
    cut = rows.repartitionByRange(*by).sortWithinPartitions(*by).drop("_row").withColumn("_id", F.monotonically_increasing_id())
    cut = cut.withColumn("_part", F.shiftright("_id", 33).cast("int")).withColumn("_pos", F.col("_id").bitwiseAND(F.lit(_PLACES))).drop("_id")
    placed = stage(cut, label)
    discard(rows)
    runs = placed.groupBy("_part", *group).agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n"))
    own = Window.partitionBy(*group)
    before = F.sum("_n").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("_start", F.coalesce(before, F.lit(0))).withColumn("_total", F.sum("_n").over(own))
    return placed, runs


def with_runs(placed: DataFrame, runs: DataFrame, group: Sequence[str]) -> DataFrame:
    """Rows with ``idx`` (from 0) and further columns of their run. A key of this join is at most one partition's rows."""
    runs = runs.select(F.col("_part").alias("_p"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], *[c for c in runs.columns if c not in ("_part", *group)])
    on = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        on = on & same(F.col(g), F.col(f"_g{i}"))
    out = placed.join(runs, on).withColumn("idx", F.col("_pos") - F.col("_first") + F.col("_start"))
    return out.drop("_p", *[f"_g{i}" for i in range(len(group))])


def crc32_sql(text: str) -> str:
    """DuckDB expression: unsigned CRC-32 of a short ASCII text, from the reflected polynomial."""
    table = "list_reduce(list_prepend({0}, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    step = table.format("xor(c, ascii(substr(" + text + ", CAST(k AS INTEGER), 1)))")
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, range(1, length({text}) + 1)), lambda c, k: {step}), 4294967295::BIGINT)"
