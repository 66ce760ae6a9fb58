from __future__ import annotations

import os
import sys
from datetime import datetime

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

from marketebb.session import build_session  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g"}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def at(text: str) -> datetime:
    """'02 06:00' on January 2024, or a full timestamp."""
    return datetime.fromisoformat(text if text[4:5] == "-" else f"2024-01-{text}")


OBS = "ip_id long, source_id string, status string, price int, crawl_ts timestamp_ntz, pos long"


@pytest.fixture
def observe(spark):
    """Observations from (ip_id, source_id, status, price, time) in order of position."""

    def make(*rows):
        data = [(r[0], r[1], r[2], r[3], at(r[4]), i) for i, r in enumerate(rows)]
        return spark.createDataFrame(data, OBS)

    return make


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]
