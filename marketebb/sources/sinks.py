"""Sinks on plain Parquet. Every write that names its batch can be repeated without changing the result.

A table that grows by deltas stores them under their batch id; writing a batch again replaces its
own partition. Buckets are replaced by dynamic partition overwrite.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegerType, LongType, StructField, StructType

from marketebb.session import stage


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """Columns of the stored schema in order, cast to its types; missing ones, and missing fields of structs, are NULL."""

    def typed(column: Column, have: DataType | None, want: DataType) -> Column:
        if not isinstance(want, StructType) or not isinstance(have, StructType):
            return (F.lit(None) if have is None else column).cast(want)
        kinds = {f.name: f.dataType for f in have.fields}
        fields = [typed(column[f.name], kinds.get(f.name), f.dataType).alias(f.name) for f in want.fields]
        return F.when(column.isNotNull(), F.struct(*fields))

    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*[typed(F.col(f.name), kinds.get(f.name), f.dataType).alias(f.name) for f in StructType.fromDDL(ddl).fields])


def overwrite_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Replace exactly the partitions that occur in ``df``."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Store the delta of one batch; the same batch written twice stands once."""
    overwrite_partitions(df.withColumn("batch_id", F.lit(batch_id).cast("long")), path, ["batch_id"])


def before_batch(stored: DataFrame, batch_id: int) -> DataFrame:
    """Rows of a table kept by :func:`upsert_buckets` as they were before a batch.

    A row that the batch has changed already carries what it was, so a batch that runs again starts from the same rows.
    """
    fields = stored.schema["before"].dataType.fieldNames()
    mine = F.col("changed_in") >= batch_id
    there = stored.filter(~mine | F.col("before").isNotNull())
    others = [c for c in stored.columns if c not in (*fields, "changed_in", "before")]
    return there.select(
        *others,
        *[F.when(mine, F.col("before")[c]).otherwise(F.col(c)).alias(c) for c in fields],
        F.least("changed_in", F.lit(batch_id - 1)).cast("long").alias("changed_in"),
    )


def upsert_buckets(updates: DataFrame, path: str, keys: Sequence[str], batch_id: int, keep: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Put one row for each key into its ``bucket``; only buckets with an update are read and written.

    Each row says in which batch it changed and what it was before (:func:`before_batch`), so a batch may run again, and a
    run that stopped between two buckets is completed by the next. ``keep`` filters the rows that are written.
    """
    spark = updates.sparkSession
    fields = [c for c in updates.columns if c not in (*keys, "bucket")]
    if not exists(spark, path):
        before = bucketed(spark, path, updates.schema, keys).schema["before"].dataType
        first = updates.select("bucket", *keys, *fields, F.lit(batch_id).cast("long").alias("changed_in"), F.lit(None).cast(before).alias("before"))
        overwrite_partitions((keep(first) if keep else first).repartition("bucket"), path, ["bucket"])
        return
    buckets = [r.bucket for r in updates.select("bucket").distinct().collect()]  # as many as the layout has, at most
    if not buckets:
        return
    old = before_batch(bucketed(spark, path, updates.schema, keys).filter(F.col("bucket").isin(buckets)), batch_id)
    old = old.select("bucket", *keys, F.struct(*fields).alias("old"), F.col("changed_in").alias("old_in"))
    both = updates.select("bucket", *keys, F.struct(*fields).alias("new")).join(old, ["bucket", *keys], "full")
    changed = F.col("new").isNotNull()
    now = both.select(
        "bucket", *keys, *[F.when(changed, F.col("new")[c]).otherwise(F.col("old")[c]).alias(c) for c in fields],
        F.when(changed, F.lit(batch_id)).otherwise(F.col("old_in")).cast("long").alias("changed_in"), F.when(changed, F.col("old")).alias("before"),
    )
    now = stage(keep(now) if keep else now, "buckets")
    overwrite_partitions(now.repartition("bucket"), path, ["bucket"])


def bucketed(spark: SparkSession, path: str, row: StructType, keys: Sequence[str]) -> DataFrame:
    """A table of :func:`upsert_buckets` whose updates have this schema; empty before its first batch."""
    own = [f for f in row.fields if f.name != "bucket"]
    before = StructType([f for f in own if f.name not in keys])
    schema = StructType([*own, StructField("changed_in", LongType()), StructField("before", before), StructField("bucket", IntegerType())])
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def append(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """Plain append: done twice, the rows stand twice. Where a batch may run again, use :func:`write_batch`."""
    df.write.mode("append").partitionBy(*by).parquet(path)


def replace_buckets(df: DataFrame, path: str, bucket: str) -> None:
    """Replace whole time buckets, with the bucket's day as partition."""
    overwrite_partitions(df.withColumn("day", F.col(bucket).cast("date")), path, ["day"])


def exists(spark: SparkSession, path: str) -> bool:
    """Whether anything is stored under a path, on whatever file system it names."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def drop_partitions(spark: SparkSession, path: str, column: str, below: int | date) -> None:
    """Remove the partition folders of an integer or date column below a value; the rows of others are not read."""
    if not exists(spark, path):
        return
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for entry in fs.listStatus(folder):
        name, _, text = entry.getPath().getName().partition("=")
        if name != column:
            continue
        try:
            value = date.fromisoformat(text) if isinstance(below, date) else int(text)
        except ValueError:  # the partition of nulls
            continue
        if value < below:
            fs.delete(entry.getPath(), True)


def drop_partition(spark: SparkSession, path: str, folder: str) -> None:
    part = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{folder}")
    part.getFileSystem(spark._jsc.hadoopConfiguration()).delete(part, True)


def fold_deltas(delta: DataFrame, path: str, by: Sequence[str], batch_id: int, fold: Callable[[DataFrame], DataFrame]) -> None:
    """Add a delta to a table whose rows are a fold over all deltas of their partition.

    Deltas stay beside the table, by partition and batch; the partitions that this one touches are folded anew from theirs.
    So a delta may be applied again, and one that stopped half way is completed by the next try.
    """
    spark, deltas = delta.sparkSession, f"{path}/deltas"
    delta = stage(delta, "delta")
    overwrite_partitions(delta.withColumn("batch_id", F.lit(batch_id).cast("long")), deltas, [*by, "batch_id"])
    if exists(spark, deltas):
        stored = spark.read.schema(delta.schema).parquet(deltas)
        overwrite_partitions(fold(touched(stored, delta, by)), f"{path}/table", by)


def touched(stored: DataFrame, delta: DataFrame, by: Sequence[str]) -> DataFrame:
    """Stored rows of the partitions that occur in a delta.

    The bounds are known before the scan starts, so partitions outside them are not read.
    """
    for c in by:
        low, high = (delta.agg(f(c)).scalar() for f in (F.min, F.max))
        stored = stored.filter(F.col(c).between(low, high))
    return stored.join(delta.select(*by).distinct(), list(by), "left_semi")


def merge_partitions(delta: DataFrame, path: str, by: Sequence[str], merge) -> None:
    """Merge a delta into the partitions it touches: ``merge(old, delta) -> new``.

    Only the touched partitions are read and written. The caller must not apply one delta twice unless ``merge`` allows it;
    :func:`fold_deltas` is for those that may come again. The merged rows are staged first, so the partitions are not read while
    they are replaced.
    """
    spark = delta.sparkSession
    if not exists(spark, path):
        overwrite_partitions(delta, path, by)
        return
    old = touched(spark.read.parquet(path), delta, by)
    overwrite_partitions(stage(merge(old.select(*delta.columns), delta), "merge"), path, by)
