"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is a set of windows of ``window`` consecutive words (an item of fewer words is one window), a window a set
of word shingles. Shingles are ordered by how rare they are in all documents. A document window contains an item window
only if it has all its shingles, so the prefix that must be joined is its rarest shingle alone. Candidates are bounded by
length and position (the window must fit into the document around the shingle) and then compared word by word.

Two passes over the documents: one counts the item shingles, one finds the places of prefix shingles. Between the
documents and the joins stands a Bloom filter of fixed size, so only places that can match are shuffled, and benchmarks
of any size work. Prefix shingles are the rare ones, so their join has no hot keys of its own; where a benchmark passage
is itself frequent, AQE splits the skewed partition (an inner join).

Nulls: a null text has no words; a null doc_id or item_id is kept as it is (a null item_id has no string and adds
nothing to ``items_sha256``). Equal rows each get their row. An empty benchmark hits nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketebb.llm import words as W
from marketebb.llm.shared import fresh, stage

WINDOW, SHINGLE = 10, 3
_A_Z, _a_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, words, m): the distinct windows of each item as blank-joined words and their number."""
    ws = F.expr(f"regexp_extract_all(translate(text, '{_A_Z}', '{_a_z}'), '{W.WORD}', 0)".replace("\\", "\\\\"))
    split = items.select("item_id", ws.alias("ws")).where("size(ws) > 0")
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.size("ws") - window, F.lit(0))))
    cut = split.select("item_id", "ws", at.alias("i")).select("item_id", F.slice("ws", F.col("i") + 1, window).alias("w"))
    return cut.select("item_id", F.array_join("w", " ").alias("words"), F.size("w").alias("m")).distinct()


def window_shingles(windows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(words, m, k, at, h): every shingle of the distinct windows with its width, place and hash."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, m = b.column("words"), b.column("m").to_numpy(zero_copy_only=False)
            for first, ws in W.each(text):
                begin = np.concatenate([[0], np.cumsum(ws.counts())])
                for k in range(1, shingle + 1):
                    at, h = ws.shingles(k)
                    own = np.minimum(m[first + ws.row[at]], shingle) == k
                    at, h = at[own], h[own]
                    rows = first + ws.row[at]
                    yield pa.RecordBatch.from_arrays(
                        [text.take(pa.array(rows)), pa.array(m[rows], pa.int32()), pa.array(np.full(len(at), k), pa.int32()),
                         pa.array(at - begin[ws.row[at]], pa.int32()), pa.array(h.view(np.int64))],
                        ["words", "m", "k", "at", "h"],
                    )

    return windows.select("words", "m").distinct().mapInArrow(hashes, "words string, m int, k int, at int, h long")


def shingle_counts(docs: DataFrame, wanted: np.ndarray, widths: list[int]) -> DataFrame:
    """(h, n): how often each shingle that may be wanted occurs in all documents."""
    spark = docs.sparkSession
    wanted = spark.sparkContext.broadcast(wanted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, ws in W.each(b.column(0)):
                for k in widths:
                    h = ws.shingles(k)[1]
                    h, n = np.unique(h[W.passes(wanted.value, h)], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    return docs.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def prefixes(shingles: DataFrame, counts: DataFrame) -> DataFrame:
    """(words, m, at, h): the rarest shingle of each window; windows with a shingle that no document has are gone."""
    ranked = shingles.join(counts, "h", "left").groupBy("words", "m").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "at", "h", "k")).alias("p")
    )
    return ranked.where("p.n > 0").select("words", "m", "p.at", "p.h", "p.k")


def places(docs: DataFrame, wanted: np.ndarray, widths: list[int], window: int) -> DataFrame:
    """One row per document: row (unique), doc_id, n_words and ``found``, the places where a prefix shingle may stand.

    A place is its word position, the hash, how many of the words before it are in ``ctx``, and ``ctx`` itself: as many
    words around it as a window can cover.
    """
    spark = docs.sparkSession
    wanted = spark.sparkContext.broadcast(wanted)
    found = pa.list_(pa.struct([("pos", pa.int64()), ("h", pa.int64()), ("left", pa.int32()), ("ctx", pa.string())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 40
        for b in batches:
            for first, ws in W.each(b.column("text")):
                n = ws.counts()
                begin = np.concatenate([[0], np.cumsum(n)])
                out: list[list] = [[] for _ in range(ws.n_rows)]
                for k in widths:
                    at, h = ws.shingles(k)
                    hit = np.flatnonzero(W.passes(wanted.value, h))
                    for i, x in zip(at[hit].tolist(), h[hit].view(np.int64).tolist(), strict=True):
                        r = int(ws.row[i])
                        low, high = max(int(begin[r]), i - (window - k)), min(int(begin[r + 1]), i + window)
                        out[r].append({"pos": i - int(begin[r]), "h": x, "left": i - low, "ctx": ws.text(low, high)})
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(serial, serial + ws.n_rows)), b.column("doc_id").slice(first, ws.n_rows), pa.array(n, pa.int64()), pa.array(out, found)],
                    ["row", "doc_id", "n_words", "found"],
                )
                serial += ws.n_rows

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {kind}, n_words long, found array<struct<pos: long, h: long, left: int, ctx: string>>"
    return docs.select("doc_id", "text").mapInArrow(find, schema)


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, bits: int = 24) -> DataFrame:
    """Per document: row, doc_id, n_words, hits (array of first word and length of each found window), items (sorted ids)."""
    windows = stage(item_windows(items, window), "windows")
    shingles = stage(window_shingles(windows, shingle), "shingles")
    widths = sorted(r.k for r in shingles.select("k").distinct().collect())
    counts = shingle_counts(docs, W.filter_bits(shingles, "h", bits), widths)
    first = stage(prefixes(shingles, counts), "prefixes")
    rows = stage(places(docs, W.filter_bits(first, "h", bits), widths, window), "places")
    c = rows.select("row", F.explode("found").alias("c")).select("row", "c.*")
    c = c.join(first, "h").where("at <= left").withColumn("ws", F.split("ctx", " "))
    c = c.where("left - at + m <= size(ws)").where(F.expr("array_join(slice(ws, greatest(1, left - at + 1), m), ' ') = words"))
    found = c.select("row", (F.col("pos") - F.col("at")).alias("start"), "m", "words").distinct()
    per = (
        found.join(windows.select("words", F.col("item_id").cast("string").alias("item")), "words")
        .groupBy("row")
        .agg(F.sort_array(F.collect_set(F.struct("start", "m"))).alias("hits"), F.sort_array(F.collect_set("item")).alias("items"))
    )
    return rows.drop("found").join(per, "row", "left")


def decontaminate(docs: DataFrame, items: DataFrame, **how: int) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    union = F.expr(
        "aggregate(coalesce(hits, array()), struct(0L as n, 0L as upto),"
        " (a, x) -> struct(a.n + greatest(0L, x.start + x.m - greatest(a.upto, x.start)) as n, greatest(a.upto, x.start + x.m) as upto), a -> a.n)"
    )
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    out = hits(docs, items, **how).select(
        "doc_id", "n_words", union.alias("n_hit"), F.size(items_).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_, ","), 256).alias("items_sha256"),
    )
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def keep_clean(docs: DataFrame, items: DataFrame, bits: int = 24, **how: int) -> DataFrame:
    """The documents in which no item window occurs, with all their columns.

    What goes is named by text, since the verdict depends on the text alone. All other rows pass a filter of fixed size over
    those names; only what it holds back is shuffled, for an exact anti join.
    """
    key, some = fresh(docs, "text_digest", "held_back")
    found = hits(docs.select(F.sha2("text", 256).alias("doc_id"), "text"), items, **how).where("hits is not null")
    found = stage(found.select(F.col("doc_id").alias(key)).distinct(), "contaminated")
    named = docs.withColumn(key, F.sha2("text", 256))
    chosen = W.filter_bits(found.select(F.xxhash64(key).alias("x")), "x", bits)
    named = named.withColumn(some, W.may_be_in(chosen, F.xxhash64(key)))
    held = named.where(F.col(some)).join(found, key, "left_anti")
    return named.where(~F.col(some)).select(docs.columns).unionByName(held.select(docs.columns))


SQL = """
WITH dw AS (
  SELECT doc_id, ws, len(ws) AS n FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents)
), iw AS (
  SELECT item_id, ws, len(ws) AS n FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark)
  WHERE len(ws) > 0
), win AS (
  SELECT DISTINCT item_id, least(n, 10) AS m, array_to_string(ws[i + 1 : i + 10], ' ') AS w
  FROM (SELECT *, unnest(range(0, greatest(n - 10, 0) + 1)) AS i FROM iw)
), sizes AS (SELECT DISTINCT m FROM win), pos AS (
  SELECT doc_id, i, m, array_to_string(ws[i + 1 : i + m], ' ') AS w
  FROM (SELECT doc_id, ws, m, unnest(range(0, n - m + 1)) AS i FROM dw, sizes WHERE n >= m)
), hit AS (SELECT DISTINCT p.doc_id, p.i, p.m, win.item_id FROM pos p JOIN win ON p.w = win.w AND p.m = win.m),
words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS j FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id
)
SELECT dw.doc_id, CAST(dw.n AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
