"""Every named query against DuckDB on the small tables."""

from __future__ import annotations

import duckdb
import pytest

import check
from __spark_entry__ import entry, oracle_sql, queries
from tests.conftest import SF


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, db, name):
    df = queries()[name](spark, SF)
    columns, mine = check.normal(df.columns, [tuple(r) for r in df.collect()])
    if name not in oracle_sql():
        return
    res = db.execute(oracle_sql()[name])
    names, theirs = check.normal([c[0] for c in res.description], res.fetchall())
    assert columns == names
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs, strict=True):
        assert all(map(check._same, a, b)), (columns, a, b)


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
