"""Hash trees against a plain recursion over all leaves, and the layout of blocks."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest

from marketebb.llm import merkle
from tests.llm.conftest import SCHEMA


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, text=None):
    values = [r.doc_id, r.source, r.lang, r.n_chars, r.text if text is None else text]
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(level):
    """Levels of a tree up to its root."""
    out = [level]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def siblings(levels, i):
    out = []
    for level in levels[:-1]:
        a = i // 16 * 16
        out.append((level[a:i], level[i + 1 : a + 16]))
        i //= 16
    return out


def brute(docs):
    groups = {}
    for r in docs:
        groups.setdefault(r.source, []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        own = sorted(groups[s], key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r)))
        trees[s] = own, climb([leaf(r) for r in own])
    top = climb([trees[s][1][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        own, levels = trees[s]
        for i, r in enumerate(own):
            steps = siblings(levels, i) + siblings(top, k)
            value = leaf(r)
            if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.text is not None:
                value = leaf(r, r.text.translate({c: c + 32 for c in range(65, 91)}))
            for a, b in steps:
                value = H(*a, value, *b)
            out.append((r.doc_id, leaf(r), levels[-1][0], top[-1][0], H(*[x for a, b in steps for x in (*a, *b)]), value, value == top[-1][0]))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def many(spark, odd):
    rows = [tuple(r) for r in odd.collect()]
    rows += [(100 + i, f"Text {i}" if i % 3 else f"text {i}", "en", "big", 6, "k", 0, "q", 0.0) for i in range(600)]
    rows += [(i, "A", None, f"s{i}", None, "k", 0, "q", 0.0) for i in range(40)]
    rows += [(5, "Same", "en", None, 4, "k", 0, "q", 0.0)] * 20 + [(None, None, None, "é", None, "k", 0, "q", 0.0)] * 3
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.mark.parametrize("height", [1, 2, 3])
def test_merkle(many, height):
    got = [tuple(r) for r in merkle.merkle(many, height).collect()]
    assert sorted(got, key=str) == brute(many.collect())
    assert {v for *_, v in got} == {True, False}


def test_one_source_and_one_row(spark):
    docs = spark.createDataFrame([(1, "T", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    (r,) = merkle.merkle(docs).collect()
    assert r.leaf == r.subroot == r.root == r.folded_root and r.proof_sha256 == H("") and r.verified


def test_merkle_empty(empty):
    assert merkle.merkle(empty).count() == 0


@pytest.mark.parametrize("height", range(5))
@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 257, 4095])
def test_addresses_fill_a_block(height, n):
    n = min(n, 16**height)
    places = np.concatenate([merkle.address(level, np.arange(-(-n // 16**level)), height, n) for level in range(height + 1)])
    assert sorted(places) == list(range(merkle.size(n, height)))
    assert merkle.address(height, np.arange(1), height, n)[0] == 0


def test_layout_halves_the_height():
    full = lambda h: merkle.size(16**h, h)
    upper = [merkle.address(level, np.arange(16 ** (3 - level)), 3, 16**3) for level in (3, 2)]
    assert sorted(np.concatenate(upper)) == list(range(full(1)))
    for k in (0, 7, 255):
        lower = [merkle.address(1, np.array([k]), 3, 16**3), merkle.address(0, np.arange(16 * k, 16 * k + 16), 3, 16**3)]
        assert sorted(np.concatenate(lower)) == list(range(full(1) * (k + 1), full(1) * (k + 2)))


def test_construct_is_the_plain_tree():
    leaves = [H(str(i)) for i in range(300)]
    nodes = merkle.construct(np.frombuffer(bytes.fromhex("".join(leaves)), np.uint8).reshape(-1, 32), 3)
    levels = climb(leaves)
    assert merkle.hexes(nodes, 0, 3, 300) == leaves and merkle.hexes(nodes, 3, 3, 300) == levels[3]
