from __future__ import annotations

import re

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, row int, quality_verdict string, H double"

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def words(text):
    return WORD.findall(lower(text))


def prose(seed, n, salt="w"):
    return " ".join(f"{salt}{(seed * 7919 + i * i * 31 + i * 17) % 9973}x" for i in range(n))


def rows(texts):
    """Documents with further columns, some of them named like the operators' own."""
    return [(i, t, "en", "s", None if t is None else len(t), f"k{i}", 1, "q", 0.5) for i, t in texts]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and word-less texts, one long text, exact and near copies, equal rows, repeated and missing ids."""
    base = prose(1, 120)
    near = base.split(" ")
    near[60] = "other"
    long_ = prose(3, 30_000) + "\n" + "x" * 300_000
    texts = [
        (1, base), (2, " ".join(near)), (3, base), (3, base), (3, base), (None, base), (None, None), (None, ""), (4, None), (5, ""),
        (6, " \n\t ,;! "), (7, long_), (8, "two words"), (9, "Two WORDS"), (10, prose(5, 9)), (11, prose(5, 9) + " more"), (12, "one"), (12, "one"),
        (13, "É" + prose(8, 80) + " mail bob.1@mail7.example.com ip 10.2.3.4 +1 (455) 555-8597 card 4961199590345293"), (14, prose(9, 200) + " " + prose(9, 200)),
    ]
    return spark.createDataFrame(rows(texts), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
