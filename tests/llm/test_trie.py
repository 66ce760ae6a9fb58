"""Prefix trie against a plain dictionary of prefixes, and the count-min screen."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pytest

from marketebb.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, d1 string"


def brute(rows):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    whole = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = own.get(c - int(np.fmod(c, 20)), [])[:h] + ts[h:]
    members = {}
    for c, ts in whole.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    children, under = {}, {}
    for p in members:
        if p:
            children[p[:-1]] = children.get(p[:-1], 0) + 1
    for p, cs in members.items():
        saved = (len(cs) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0)
        for d in range(len(p) + 1):
            s = under.setdefault(p[:d], [0, 0])
            s[0] += saved
            s[1] += p not in children
    out = []
    for p, cs in members.items():
        ends = ",".join(map(str, sorted(c for c in cs if whole[c] == list(p))))
        up = min(members[p[:-1]]) if p else None
        out.append((min(cs), len(p), up, len(cs), children.get(p, 0), under[p][1], under[p][0], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(*convs):
    """Conversations (id, texts); the speaker changes."""
    return [(c, i, "user" if i % 2 else "bot", t, 1, "x") for c, texts in convs for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def talks():
    same = ["hello there", "hi  you", "how are\tyou"]
    data = rows_of(*[(c, same) for c in range(0, 60, 3)], *[(c, [*same, f"end {c % 4}", "bye"]) for c in range(1, 60, 3)])
    data += rows_of(*[(c, [f"own {c} {i}" for i in range(c % 7)]) for c in range(200, 260)], (-7, ["a", "b", "c", "d"]), (-27, ["a", "b", "c", "d"]), (-20, ["x", "y"]))
    data += rows_of((400, [f"w{i % 5} long" for i in range(700)]), (440, [f"w{i % 5} long" for i in range(700)]), (460, [f"w{i % 5} long" for i in range(650)] + ["other"]))
    data += [(500, None, None, None, 1, "x"), (500, 1, "bot", "", 1, "x"), (500, 1, "bot", "", 1, "x"), (None, 1, "bot", "no", 1, "x"), (501, 5, "bot", "t " * 50_000, 1, "x"), (519, 0, "a", "b", 1, "x")]
    return data


@pytest.mark.parametrize("bits", [24, 9, 3])
def test_trie(spark, talks, bits):
    """Whatever the size of the sketch: a small one calls many prefixes perhaps shared."""
    got = [tuple(r) for r in trie.trie(spark.createDataFrame(talks, SCHEMA).repartition(5), bits).collect()]
    assert sorted(got, key=str) == brute(talks)


def test_trie_pieces_of_ids(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE_CHARS", 100)
    data = rows_of(*[(20 * c, ["one", "two"]) for c in range(300)])
    got = [tuple(r) for r in trie.trie(spark.createDataFrame(data, SCHEMA).repartition(3)).collect()]
    assert sorted(got, key=str) == brute(data)


def test_trie_empty(spark):
    assert trie.trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert trie.trie(spark.createDataFrame([(None, 1, "a", "b", 1, "x")], SCHEMA)).count() == 0


def test_counters_never_call_a_shared_digest_single():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 2**64, (400, 2), dtype=np.uint64)
    seen = np.concatenate([keys, keys[:150], keys[:20]])
    parts = [trie.Counters(10) for _ in range(6)]
    for i, p in enumerate(parts):
        p.add(seen[i::6, 0], seen[i::6, 1])
    total = trie.Counters(10)
    total.merge(*(np.concatenate(x) for x in zip(*[(b["word"].to_numpy(), trie._unsigned(b["ones"]), trie._unsigned(b["twos"])) for b in (p.batch() for p in parts)])))
    counts = [np.zeros(1 << 10, int) for _ in range(trie.SKETCH_ROWS)]
    for j, at in enumerate(trie.cells(seen[:, 0], seen[:, 1], 10)):
        np.add.at(counts[j], at, 1)
    for j in range(trie.SKETCH_ROWS):
        bits = np.unpackbits(total.twos[j].view(np.uint8), bitorder="little")
        assert (bits.astype(bool) == (counts[j] >= 2)).all()
