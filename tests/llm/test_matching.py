"""Decontamination and near-duplicate classes against brute force."""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
import pytest

from marketebb.llm import decontaminate, near_dedup
from marketebb.llm import words as W
from tests.llm.conftest import SCHEMA, lower, prose, rows, words


def test_words_and_shingles_do_not_depend_on_the_slice():
    texts = ["One two, three", None, "", "ÉCOLE école 42a", "x" * 70, "one TWO three four"]
    got = list(W.each(pa.array(texts)))
    ws = got[0][1]
    assert [ws.text(i, i + 1) for i in range(len(ws.row))] == [w for t in texts for w in words(t)]
    by = {w: h for w, h in zip((ws.text(i, i + 1) for i in range(len(ws.row))), ws.hash.tolist(), strict=True)}
    assert len(set(by.values())) == len(by)
    for t in texts:
        data, offsets = W.buffers(pa.array([t]))
        one = W.split(data, offsets)
        assert [by[one.text(i, i + 1)] for i in range(len(one.row))] == one.hash.tolist()
    assert len(ws.shingles(3)[0]) == 1 + 1 + 2
    assert lower("ÉA") == "Éa"


def brute_hits(docs, items):
    wins = {}
    for i, t in items:
        ws = words(t)
        for a in range(max(len(ws) - 9, 1) if ws else 0):
            wins.setdefault(tuple(ws[a : a + 10]), set()).add(str(i))
    out = []
    for d, t in docs:
        ws, hit, found = words(t), set(), set()
        for m in {len(w) for w in wins}:
            for a in range(len(ws) - m + 1):
                if (w := tuple(ws[a : a + m])) in wins:
                    hit |= {*range(a, a + m)}
                    found |= wins[w]
        out.append((d, len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_decontaminate(spark, odd):
    items = [(1, prose(1, 15)), (2, "Two, words"), (3, None), (4, ""), (5, prose(9, 200)), (6, "one"), (16, prose(5, 9)), (7, prose(5, 9)), (8, "absent words here")]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in decontaminate.decontaminate(odd, table).collect()), key=str)
    assert got == brute_hits([(r.doc_id, r.text) for r in odd.collect()], items)
    kept = decontaminate.keep_clean(odd, table)
    assert kept.columns == odd.columns
    assert kept.count() == sum(not r[-1] for r in got)


def test_decontaminate_empty(spark, odd, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(empty, none).count() == 0
    assert decontaminate.decontaminate(odd, none).where("contaminated").count() == 0


@pytest.mark.parametrize(("a", "b"), [(1.0, 1.0), (1.0, 1.25), (0.3, 2.6)])
def test_darts_agree_with_weighted_jaccard(a, b):
    h = np.random.default_rng(0).integers(0, 2**63, 300).astype(np.uint64)
    row = np.repeat([0, 1], 250)
    weight = np.repeat([a, b], 250)
    values = near_dedup.dart_minhash(row, np.concatenate([h[:250], h[50:]]), weight, 2, 8000)
    similar = min(a, b) * 200 / (max(a, b) * 200 + 50 * (a + b))
    assert abs((values[0] == values[1]).mean() - similar) < 0.02


def test_darts_fill_every_coordinate_of_small_and_large_sets():
    for n in (1, 3, 40_000):
        h = np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64)
        assert (near_dedup.dart_minhash(np.zeros(n, int), h, np.ones(n), 1, 252) != 0).all()


def brute_classes(texts):
    sets = []
    for t in texts:
        ws = words(t)
        sets.append({tuple(ws[j : j + 5]) for j in range(max(1, len(ws) - 4))} if ws else set())
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        x, y = sets[i], sets[j]
        if x and y and len(x & y) >= 0.8 * len(x | y):
            parent[root(j)] = root(i)
    return [root(i) for i in range(len(texts))]


def test_near_dedup_of_odd_rows(odd):
    got = near_dedup.classes(odd).collect()
    texts = {bytes(r.key) if r.key is not None else None: None for r in got}
    assert len(got) == odd.count()
    by_text = {hashlib.md5(r.text.encode()).digest(): r.text for r in odd.collect() if r.text is not None}
    assert set(texts) - {None} == set(by_text)
    worded = [r for r in got if r.class_key is not None]
    assert {bytes(r.key) for r in worded} == {k for k, t in by_text.items() if words(t)}
    want = brute_classes([by_text[bytes(r.key)] for r in worded])
    pairs = {(w, bytes(r.class_key)) for w, r in zip(want, worded, strict=True)}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
    for r in worded:
        ids = [q.doc_id for q in worded if q.class_key == r.class_key and q.doc_id is not None]
        assert r.class_id == (min(ids) if ids else None)


def test_keep_one(odd):
    kept = near_dedup.keep_one(odd)
    assert kept.columns == odd.columns
    left = kept.collect()
    all_ = odd.collect()
    assert sum(not words(r.text) for r in left) == sum(not words(r.text) for r in all_)
    worded = [r for r in all_ if words(r.text)]
    assert sum(bool(words(r.text)) for r in left) == len(set(brute_classes([r.text for r in worded])))
    assert [r.doc_id for r in left if (r.text or "").startswith(prose(1, 50))] == [1]


def test_large_groups_of_copies(spark):
    """A group of near copies of one original, mostly not similar to each other, beside exact copies."""
    rng = np.random.default_rng(4)
    base = prose(77, 150).split(" ")
    texts = [" ".join(base)] * 150
    for i in range(250):
        own = list(base)
        for at in rng.choice(150, int(rng.integers(1, 7)), replace=False):
            own[at] = f"edit{i}n{at}"
        texts.append(" ".join(own))
    texts += [prose(200 + i, 150) for i in range(60)]
    docs = spark.createDataFrame(rows([*enumerate(texts)]), SCHEMA).repartition(4)
    got = {r.doc_id: r.class_id for r in near_dedup.near_dedup(docs).collect()}
    want = brute_classes(texts)
    least = {}
    for i, c in enumerate(want):
        least[c] = min(least.get(c, i), i)
    assert got == {i: least[c] for i, c in enumerate(want)}


@pytest.mark.parametrize("leader_rounds", [0, 3])
def test_content_once_against_twice(spark, leader_rounds):
    """200 words twice, and once with four of them changed: 176 common shingles of 220, exactly 0.8."""
    texts = []
    for i in range(150):
        once = prose(i, 200, f"q{i}q").split(" ")
        texts.append(" ".join(once + once))
        for at in (20, 60, 100, 140):
            once[at] = f"edit{i}n{at}"
        texts.append(" ".join(once))
    docs = spark.createDataFrame(rows([*enumerate(texts)]), SCHEMA).repartition(4)
    got = {r.doc_id: r.class_id for r in near_dedup.near_dedup(docs, leader_rounds=leader_rounds).collect()}
    assert got == {i: i - i % 2 for i in range(300)}


def test_near_dedup_empty(empty):
    assert near_dedup.near_dedup(empty).count() == 0
    assert near_dedup.keep_one(empty).columns == empty.columns


def test_repeated_ids_of_different_texts(spark):
    texts = [(1, prose(1, 60)), (1, prose(2, 60)), (2, prose(1, 60)), (3, prose(2, 60)), (None, prose(3, 60)), (None, prose(4, 60))]
    got = near_dedup.near_dedup(spark.createDataFrame(rows(texts), SCHEMA)).collect()
    assert len({r.class_key for r in got}) == 4
    assert sorted(r.doc_id or -1 for r in got) == [-1, -1, 1, 1, 2, 3]
    by = {}
    for r in got:
        by.setdefault(r.class_key, []).append(r.doc_id)
    assert sorted((sorted(v, key=str) for v in by.values()), key=str) == [[1, 2], [1, 3], [None], [None]]


def test_a_class_beside_a_stranger_makes_no_pairs_within(spark):
    """One bucket of 400 texts of one class and one of another: as many pairs as members, not their square."""
    key = lambda i: hashlib.md5(str(i).encode()).digest()
    schema = "h long, key binary, share double, label binary"
    now = spark.createDataFrame([(5, key(i), 1.0, key(0) if i else key(999)) for i in range(401)], schema)
    shingles = np.arange(100, dtype=np.uint64).tobytes()
    sets = spark.createDataFrame([(key(i), shingles) for i in range(401)], "key binary, shingles binary")
    texts = spark.createDataFrame([(key(i), [5]) for i in range(401)], "key binary, bands array<long>")
    mixed = spark.createDataFrame([(5,)], "h long")
    assert near_dedup._rest_pairs(now, mixed, sets, texts, 0.8).count() == 400
