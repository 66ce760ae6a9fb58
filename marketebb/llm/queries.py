"""The named queries of this subpackage and their comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marketebb.llm import decontaminate, extract, idfile, language, licences, merkle, near_dedup, packing, pii, quality, sharding, trie, warc
from marketebb.llm.shared import documents, table


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii(documents(spark, sf_dir))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licences(documents(spark, sf_dir))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idfile.round_trip(documents(spark, sf_dir), vocabulary())


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), vocabulary())


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language(documents(spark, sf_dir))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(documents(spark, sf_dir))


def op11_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(table(spark, sf_dir, "conversations"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.merkle(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_quality, op2_pii, op3_decontaminate, op4_licences, op5_sharding, op6_warc, op7_token_ids, op8_packing, op9_language, op10_near_dedup,
        op11_extract, op12_trie, op13_merkle,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    own = {"op3_decontaminate": decontaminate, "op6_warc": warc, "op11_extract": extract, "op12_trie": trie, "op13_merkle": merkle}
    return {name: module.SQL for name, module in own.items()}
