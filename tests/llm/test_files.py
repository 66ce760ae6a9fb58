"""Token ids, packing, id files, archives, shards: exact round trips and invariants."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marketebb.llm import files, idfile, packing, sharding, tokens, warc
from marketebb.session import scratch_dir, stage
from tests.llm.conftest import prose

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_encoder_gives_the_ids_of_whole_texts(library):
    use = tokens.Encoder(PATH)
    assert use.direct
    rng = random.Random(3)
    signs = "aAzéÉßİıŁǅªͅΣσς.,!'’ \n\t\x1c\x85 ́̇56٣漢🙂<|>"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 24))) for _ in range(1500)]
    texts += ["Hi <|endoftext|> x<|startoftext|>y don't I'LL 12ab", "WORD. word, Élan! ÑANDÚ; don't.", "", "\r\n"]
    got = use.encode([t.encode() for t in texts])
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == want


def test_encoder_forgets_without_error(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 5)
    use = tokens.Encoder(PATH)
    texts = [prose(i, 10).encode() for i in range(8)]
    assert [use.encode([t])[0] for t in texts] == use.encode(texts)


def test_best_fit():
    sizes = np.array([6, 5, 4, 3, 2, 10, 1])
    of = packing.best_fit(sizes, 10)
    assert [sizes[of == b].sum() for b in sorted(set(of))] == [10, 10, 10, 1] or np.bincount(of, sizes).max() <= 10
    assert len(set(of)) == 4
    assert len(packing.best_fit(np.zeros(0, int), 10)) == 0


def check_packing(rows, want, capacity=2048):
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    got = sorted((k if k is not None else -1, r.piece, r.start, r.length, r.ids_crc32) for k, v in by.items() for r in v)
    pieces = []
    for k, ids in want:
        for p, a in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[a : a + capacity], "<u4")
            pieces.append((k if k is not None else -1, p, a, len(part), zlib.crc32(part.tobytes())))
    assert got == sorted(pieces)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing(odd, library):
    rows = packing.pack(odd, PATH).collect()
    want = [(r.doc_id, [*library.encode(r.text or "", add_special_tokens=False).ids, 0]) for r in odd.collect()]
    n = check_packing(rows, want)
    total = sum(len(i) for _, i in want)
    assert n <= -(-total // 2048) + 1


def test_packing_rounds_stop_when_nothing_fits(spark, library, monkeypatch):
    monkeypatch.setattr(packing, "FIRST_GROUP", 10)
    docs = spark.createDataFrame([(i, "word " * 1100) for i in range(40)], "doc_id long, text string").repartition(4)
    assert check_packing(packing.pack(docs, PATH).collect(), [(i, [*library.encode("word " * 1100, add_special_tokens=False).ids, 0]) for i in range(40)]) == 40


def test_packing_merges_over_partitions(spark, library):
    docs = spark.createDataFrame([(i, "word " * (300 if i % 2 else 700)) for i in range(64)], "doc_id long, text string").repartition(32)
    want = [(i, [*library.encode("word " * (300 if i % 2 else 700), add_special_tokens=False).ids, 0]) for i in range(64)]
    assert check_packing(packing.pack(docs, PATH).collect(), want) <= 17


def test_packing_empty(empty):
    assert packing.pack(empty, PATH).count() == 0


@pytest.mark.parametrize("bits", [8, 1])
def test_planes(bits):
    ids = np.random.default_rng(1).integers(0, 2**32, 1001, dtype=np.uint32)
    assert (idfile.from_planes(idfile.to_planes(ids, bits), len(ids), bits) == ids).all()
    out = pa.BufferOutputStream()
    w = idfile.Writer(out, bits, block=64)
    parts = [ids[:0], ids[:63], ids[63:64], ids[64:700], ids[700:]]
    for i, p in enumerate(parts):
        w.add(None if i == 2 else i, p.tobytes())
    w.close()
    r = idfile.Reader(pa.BufferReader(out.getvalue()))
    assert (r.block(3) == ids[192:256]).all()
    rows = list(r.documents())
    assert rows == [(None if i == 2 else i, sum(map(len, parts[:i])), len(p), zlib.crc32(p.tobytes())) for i, p in enumerate(parts)]


@pytest.mark.parametrize("bits", [8, 1])
def test_id_files(odd, library, bits):
    got = sorted(idfile.round_trip(odd, PATH, bits=bits).collect(), key=lambda r: r.start)
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids)
    want = sorted((-1 if r.doc_id is None else r.doc_id, zlib.crc32(np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4").tobytes())) for r in odd.collect())
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.ids_crc32) for r in got) == want
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens


def test_id_files_empty(empty):
    assert idfile.round_trip(empty, PATH).count() == 0


PAGES = [(5, "http://a/1", "<p>é</p>"), (2, "http://a/2\r\nX: y", "<p>é</p>"), (9, None, "<p>é</p>"), (2, "http://b", "<p>é</p>"), (3, "u", None), (4, "u", ""), (None, "n", "<p>é</p>"), (None, "n", "only"), (7, "l", "x\r\n\r\n" * 70_000), (8, "m", "\r\n\r\nWARC/1.1\r\n")]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(*p, "extra") for p in PAGES], "page_id long, url string, html string, record string").repartition(2)
    got = sorted((tuple(r) for r in warc.round_trip(pages, archive_bytes=1000).collect()), key=str)
    least = {}
    for i, _, h in PAGES:
        if i is not None:
            least[h or ""] = min(i, least.get(h or "", i))
    want = []
    for i, _, h in PAGES:
        data, first = (h or "").encode(), least.get(h or "")
        again = first is not None and first != i
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first if again else None))
    assert got == sorted(want, key=str)


def test_warc_members_stand_alone(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    folder = scratch_dir(spark, "warc-test")
    index = warc.normalise(warc.write(pages, folder), folder).collect()
    assert len(index) == len(PAGES)
    for r in index:
        with files.open_file(folder, r.file) as f:
            f.seek(r.offset)
            data = gzip.GzipFile(fileobj=io.BytesIO(f.read(r.length))).read()
        assert data.startswith(b"WARC/1.1\r\n") and data.endswith(b"\r\n\r\n")
    big = warc.typed(pages, least=5).where("refers_to is not null").count()
    assert big == 3  # the copies of the page of more than five bytes that have another id, or none


def test_warc_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_sharding(spark, odd):
    many = odd.select("doc_id", "text").unionByName(spark.range(100, 4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("é"), (F.col("id") % 50).cast("int")).alias("text")))
    rows = sharding.shard(many.where("coalesce(doc_id, 0) <> 7"), slots=512).collect()
    sizes = {}
    for r in rows:
        sizes.setdefault(r.shard, []).append(r)
    assert set(sizes) <= set(range(24))
    for own in sizes.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    totals = [sum(r.size for r in own) for own in sizes.values()]
    assert max(totals) <= 1.05 * sum(totals) / 24
    texts = {r.doc_id: r.text for r in many.collect()}
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        if r.doc_id is not None and r.doc_id > 20:
            assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "bytes", None)
    assert len({(r.virtual_slot, r.shard) for r in rows}) == len({r.virtual_slot for r in rows})


def test_slot_map_versions(spark, odd):
    rows = sharding.records(spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("abc").alias("text")))
    slots = sharding.slot_bytes(rows)
    path = scratch_dir(spark, "slot-map-test")
    first = sharding.new_map(slots)
    sharding.save_map(first, path)
    sharding.save_map(sharding.edited_map(sharding.load_map(spark, path), slots, 25), path)
    old = {r.virtual_slot: r.shard for r in sharding.load_map(spark, path, 1).collect()}
    new = {r.virtual_slot: (r.shard, r.bytes) for r in sharding.load_map(spark, path).collect()}
    assert sharding.load_map(spark, path).first().version == 2
    moved = [s for s in new if new[s][0] != old[s]]
    assert {new[s][0] for s in moved} == {24}
    total = sum(b for _, b in new.values())
    assert sum(new[s][1] for s in moved) <= 0.05 * total
    loads = {k: sum(b for s, b in new.values() if s == k) for k in range(25)}
    assert max(loads.values()) <= 1.05 * total / 25


def test_sharding_empty(empty):
    assert sharding.shard(empty).count() == 0


def test_packing_goes_on_while_bins_fit(spark, library, monkeypatch):
    """Mostly bins that nothing fits, and a few small ones that fit each other: they all come together."""
    monkeypatch.setattr(packing, "FIRST_GROUP", 40)
    monkeypatch.setattr(packing, "GROUP", 60)
    sizes = [1900] * 300 + [200] * 20
    docs = spark.createDataFrame([(i, "word " * (n - 1)) for i, n in enumerate(sizes)], "doc_id long, text string").repartition(32)
    want = [(i, [*library.encode("word " * (n - 1), add_special_tokens=False).ids, 0]) for i, n in enumerate(sizes)]
    small = sum(len(ids) for _, ids in want[300:])
    assert check_packing(packing.pack(docs, PATH).collect(), want) <= 300 + -(-small // 2000)


def test_equal_rows_spread_over_groups(spark):
    one = [{"doc_id": None, "piece": 0, "start": 0, "length": 1201, "ids_crc32": 1, "offset": 0}]
    bins = spark.range(0, 5000, 1, 4).select(F.lit(1201).cast("long").alias("fill"), F.array(F.struct(*[F.lit(v).cast(t).alias(k) for (k, v), t in zip(one[0].items(), ("long", "int", "long", "long", "long", "long"), strict=True)])).alias("pieces"))
    bins = stage(bins.withColumn("nth", F.monotonically_increasing_id()), "equal-bins")
    groups = bins.groupBy(F.pmod(F.xxhash64("nth"), F.lit(8))).count().collect()
    assert len(groups) == 8 and max(r["count"] for r in groups) < 800
    assert packing.merge(bins, 8).count() == 5000


def greedy(sizes, shards):
    """Slot -> shard: the largest slot first into the lightest shard, empty slots in turn."""
    loads, out = [0] * shards, {}
    for slot in sorted(sizes, key=lambda s: (-sizes[s], s)):
        k = slot % shards if not sizes[slot] else loads.index(min(loads))
        loads[k] += sizes[slot]
        out[slot] = k
    return out


def test_stored_map_is_the_greedy_one(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") * 37 % 101).cast("int")).alias("text"))
    store = scratch_dir(spark, "slot-maps-test")
    rows = sharding.shard(docs, slots=256, store=store).collect()
    sizes = dict.fromkeys(range(256), 0)
    for r in rows:
        sizes[r.virtual_slot] += r.size
    want = greedy(sizes, 24)
    assert {r.virtual_slot: r.shard for r in sharding.load_map(spark, store).collect()} == want
    assert all(r.shard == want[r.virtual_slot] and r.map_version == 1 for r in rows)
    again = sharding.shard(docs, shards=25, slots=256, store=store).collect()
    assert {r.map_version for r in again} == {2}
    moved = {r.virtual_slot: r.shard for r in again if r.shard != want[r.virtual_slot]}
    assert set(moved.values()) == {24}


def test_many_rows_of_one_id_do_not_fill_a_shard(spark):
    docs = spark.range(0, 6000, 1, 4).select(F.when(F.col("id") % 3 == 0, F.col("id")).alias("doc_id"), F.lit("same text").alias("text"))
    rows = sharding.shard(docs).collect()
    totals = [0] * 24
    for r in rows:
        totals[r.shard] += r.size
    assert max(totals) <= 1.05 * sum(totals) / 24
    assert len(rows) == 6000 and all(sorted(r.slot for r in rows if r.shard == k) == list(range(totals[k] // 17)) for k in range(24))
