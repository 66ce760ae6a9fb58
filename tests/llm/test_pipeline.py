"""The pipeline stage by stage against the verdicts of brute force, and the comparison SQL of the queries."""

from __future__ import annotations

import duckdb
import pytest

import check
import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from marketebb.llm import pii, quality
from marketebb.llm import queries as corpus
from tests.conftest import SF
from tests.llm.conftest import words
from tests.llm.test_matching import brute_classes, brute_hits


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, now = docs.columns, docs
    got = {}
    for name, step in corpus_pipeline.STAGES:
        before = now.collect() if name != "quality" else docs.collect()
        now = corpus_pipeline.stage(step(spark, now, SF), name)
        got[name] = (before, now.collect())
        if name != "pack":
            assert now.columns == columns

    before, after = got["quality"]
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = {r.doc_id for r in quality.annotate(docs.select("doc_id", "text"), model, "v").where("v.kept").collect()}
    assert sorted(after) == sorted(r for r in before if r.doc_id in kept)

    before, after = got["near_dedup"]
    groups = {}
    for r, c in zip(before, brute_classes([r.text for r in before]), strict=True):
        groups.setdefault(c if words(r.text) else ("alone", r.doc_id), []).append(r)
    assert sorted(after) == sorted(min(g, key=lambda r: r.doc_id) for g in groups.values())

    before, after = got["decontaminate"]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    dirty = {h[0] for h in brute_hits([(r.doc_id, r.text) for r in before], items) if h[-1]}
    assert sorted(after) == sorted(r for r in before if r.doc_id not in dirty)
    assert dirty

    before, after = got["personal_data"]
    after = {r.doc_id: r for r in after}
    assert len(after) == len(before)
    for r in before:
        spans = pii.base_spans(r.text)
        assert all(r.text[s:e] not in after[r.doc_id].text for s, _, e in spans)
        if not pii.tokens_of(r.text):
            assert after[r.doc_id] == r
        assert after[r.doc_id].n_chars == (len(after[r.doc_id].text) if after[r.doc_id].text != r.text else r.n_chars)

    before, after = got["pack"]
    assert {r.doc_id for r in after} == {r.doc_id for r in before}
    fill = {}
    for r in after:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 2048
    assert len(fill) <= -(-sum(fill.values()) // 2048) + 1


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert corpus_pipeline.ORACLE_SQL is None
    assert {"pipeline", *(f.split("_")[0] for f in corpus.queries())} == {"pipeline", *(f"op{n}" for n in range(1, 11))}
    assert set(corpus.queries()) <= set(queries())


@pytest.mark.parametrize("name", sorted(corpus.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries()[name](spark, SF)
    res = con.execute(oracle_sql()[name])
    assert check.normal(df.columns, [tuple(r) for r in df.collect()]) == check.normal([c[0] for c in res.description], res.fetchall())
