"""Streaming forms of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_rocksdb(df: DataFrame) -> DataFrame:
    """The same stream, its session set to the state store that stateful processors need."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return df
