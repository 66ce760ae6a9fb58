"""Near-duplicate classes: DartMinHash signatures, banded joining, exact verification, components.

A document is the set of its shingles of five words (a document of fewer words is one shingle; one without words has no
copies). Two documents are linked when the Jaccard similarity of their sets is at least 0.8; a class is a component of links.

Signature. Every shingle throws darts: points of a Poisson process over (weight, rank) that a hash of the shingle and of a
cell of that plane determines. Darts within the shingle's weight count; each lands on one of ``k`` coordinates, and the
dart of least rank there is the document's value. Two documents agree at a coordinate with the probability of their
weighted Jaccard similarity. Cells are thrown from low ranks up until about k ln k + 2k darts have fallen, so the cost is
that of the words plus a constant, not words times k. Coordinates that stay empty get another layer. All shingles weigh 1, as
in the similarity that is verified: a text that holds its content twice meets a single copy of it like any other.

Joining. Copies of one text are folded into one node first (digest of the text). Nodes that share a band of ``ROWS``
coordinates form a bucket. Nodes that have too few shingles in common with any other node to be similar to one go at
once. Buckets are not expanded into pairs: in each of ``LEADER_ROUNDS`` rounds a node is compared with one leader of its
buckets whose class it is not in, which collapses groups of copies with a linear number of comparisons. What then still stands in a bucket in different classes is compared pair by pair, but for pairs that cannot
reach the similarity: the shingles that only one of these texts has bound every intersection (exact). A pair at 0.8 shares no
band with a probability of 3 in a million. Every link is verified on the full shingle sets.

Nulls and ties: null and word-less texts form classes of their own row group (equal texts stay apart unless they have
words); rows with equal doc_id are rows like others; ``class_id`` is the least doc_id of a class (null if it has none), which two classes may
have in common where ids repeat; ``class_key``, a digest, names one class alone (null for rows without words).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketebb.llm import words as W
from marketebb.llm.components import components
from marketebb.llm.shared import discard, fresh, stage

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS, LEADER_ROUNDS = 42, 6, 3
#: Size of the filter of shared shingles, as a power of two of bits; raise it with the corpus.
FILTER_BITS = 26
#: The lowest layer of ranks ends at 2**LOWEST, each further one at the next half power of two.
LOWEST = -10.0


def _throw(h: np.ndarray, x0: float, width: float, low: float, high: float, layer: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Darts of elements in weights [x0, x0 + width) and one layer of ranks: element, rank, hash.

    The layer is cut into cells of at most one expected dart; the number in a cell follows from the cell's hash.
    """
    cells = max(1, int(np.ceil(width * (high - low))))
    mean = width * (high - low) / cells
    steps, p, total = [], math.exp(-mean), 0.0
    for n in range(1, 12):
        total += p
        steps.append(np.uint64(min(int(total * 2.0**64), (1 << 64) - 1)))
        p *= mean / n
    elements, ranks, darts = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, np.uint64)]
    at_once = max(1, 100_000 // max(len(h), 1))
    for first in range(0, cells, at_once):
        c = np.arange(first, min(first + at_once, cells), dtype=np.uint64)
        keys = (np.uint64((layer << 48) + int(x0 * 4)) + (c << np.uint64(16))) * np.uint64(0x9E3779B97F4A7C15)
        cell = W.mix((h[:, None] ^ keys).reshape(-1))
        own = np.flatnonzero(cell >= steps[0])
        for d in range(1, 12):
            if not len(own):
                break
            dart = W.mix(cell[own] + np.uint64(d * 0xD1B54A32D192ED03 % (1 << 64)))
            elements.append(own // len(c))
            ranks.append(low + (high - low) * (first + own % len(c) + (dart >> np.uint64(24)) * 2.0**-40) / cells)
            darts.append(dart)
            own = own[cell[own] >= steps[d]] if d < 11 else own[:0]
    return np.concatenate(elements), np.concatenate(ranks), np.concatenate(darts)


def dart_minhash(row: np.ndarray, h: np.ndarray, weight: np.ndarray, n_rows: int, k: int) -> np.ndarray:
    """(n_rows, k) values for rows of weighted elements (row ascending, hash, weight above 0). Rows without any are 0."""
    out, best = np.zeros(n_rows * k, np.uint64), np.full(n_rows * k, np.inf)
    norm = np.bincount(row, weight, n_rows)
    want = np.divide(k * np.log(k) + 2 * k, norm, out=np.zeros(n_rows), where=norm > 0)
    open_, layer, low, heaviest = norm > 0, 0, 0.0, float(weight.max(initial=0))
    while open_.any():
        high = 2.0 ** (LOWEST + layer / 2)
        use = np.flatnonzero(open_[row])
        x0, width = 0.0, 1.0
        while x0 < heaviest:  # cells of weight: [0, 1), then [1, 1.25), [1.25, 1.75), [1.75, 2.75) and so on
            deep = use if x0 == 0 else use[weight[use] > x0]
            own, y, dart = _throw(h[deep], x0, width, low, high, layer)
            own = deep[own]
            part = np.flatnonzero(weight[own] < x0 + width)
            if len(part):  # of a cell that the weight reaches into, only darts below it count
                x = x0 + width * (W.mix(dart[part]) >> np.uint64(11)) * 2.0**-53
                keep = np.ones(len(own), bool)
                keep[part[x >= weight[own[part]]]] = False
                own, y, dart = own[keep], y[keep], dart[keep]
            spot = row[own] * k + (((dart & np.uint64(0xFFFFFF)) * np.uint64(k)) >> np.uint64(24)).astype(np.int64)
            np.minimum.at(best, spot, y)
            won = y == best[spot]
            out[spot[won]] = dart[won]
            x0, width = x0 + width, 0.25 if x0 == 0 else 2 * width
        low, layer = high, layer + 1
        late = np.flatnonzero(open_ & (want <= high))
        open_[late] = np.isinf(best.reshape(n_rows, k)[late]).any(axis=1)
    return out.reshape(n_rows, k)


def elements(ws: W.Words, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of every row: row (ascending), hash (ascending in a row), number of occurrences."""
    n = ws.counts()
    at, h = ws.shingles(shingle)
    rows, hashes = [ws.row[at]], [h]
    for k in range(1, shingle):
        at, h = ws.shingles(k)
        own = n[ws.row[at]] == k
        rows.append(ws.row[at][own])
        hashes.append(h[own])
    row, h = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])]))[: len(h)]
    return row[first], h[first], np.diff(np.concatenate([first, [len(h)]]))


def digest() -> Column:
    """The digest of the text; it stands for all copies of the text."""
    return F.unhex(F.md5(F.col("text").cast("binary")))


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, key and the band hashes of every document (null without words)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, ws in W.each(b.column("text")):
                row, h, _ = elements(ws)
                values = dart_minhash(row, h, np.ones(len(h)), ws.n_rows, bands * rows).reshape(-1, bands, rows)
                band = np.broadcast_to(np.arange(bands, dtype=np.uint64), (ws.n_rows, bands))
                for i in range(rows):
                    band = W.mix((band ^ values[:, :, i]) * np.uint64(0x9FB21C651E98DF25))
                empty = ws.counts() == 0
                flat = pa.FixedSizeListArray.from_arrays(pa.array(band.view(np.int64).reshape(-1)), bands).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(first, ws.n_rows), b.column("key").slice(first, ws.n_rows),
                     pa.compute.if_else(pa.array(empty), pa.nulls(ws.n_rows, flat.type), flat)],
                    ["doc_id", "key", "bands"],
                )

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key binary, bands array<long>"
    return docs.select("doc_id", digest().alias("key"), "text").mapInArrow(sign, schema)


def shingle_sets(docs: DataFrame, wanted: DataFrame, bits: int = 24) -> DataFrame:
    """(key, shingles) for the texts of ``wanted`` (key, doc_id): sorted 64-bit hashes.

    A fixed-size filter on (key, doc_id) keeps all other texts out of the shuffle; the join settles what it lets through.
    """
    spark = docs.sparkSession
    wanted = wanted.withColumn("x", F.xxhash64("key", "doc_id"))
    chosen = spark.sparkContext.broadcast(W.filter_bits(wanted, "x", bits))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x").to_numpy()
            b = b.filter(pa.array(W.passes(chosen.value, x.view(np.uint64))))
            for first, ws in W.each(b.column("text")):
                row, h, _ = elements(ws)
                ends = np.searchsorted(row, np.arange(ws.n_rows + 1))
                own = [h[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("key").slice(first, ws.n_rows), b.column("x").slice(first, ws.n_rows), pa.array(own, pa.binary())], ["key", "x", "shingles"])

    found = docs.select("doc_id", digest().alias("key"), "text").select("key", F.xxhash64("key", "doc_id").alias("x"), "text").mapInArrow(sets, "key binary, x long, shingles binary")
    return found.join(wanted.select("key", "x"), ["key", "x"]).drop("x").dropDuplicates(["key"])


def verified(pairs: DataFrame, sets: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Those of the pairs (a, b) whose shingle sets have at least this Jaccard similarity."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("sa"), b.column("sb"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                if min(len(x), len(y)) < similar * max(len(x), len(y)):
                    keep.append(False)
                    continue
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common > 0 and common >= similar * (len(x) + len(y) - common) - 1e-9)
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("sa")), "a")
    both = both.join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(check, "a binary, b binary")


def _hashes(column: str, schema: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Every shingle as a row ``s``, with the key if the schema has it."""

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, own in enumerate(b.column(column)):
                h = pa.array(np.frombuffer(own.as_py(), np.int64))
                if "key" in schema:
                    yield pa.RecordBatch.from_arrays([pa.DictionaryArray.from_arrays(np.zeros(len(h), np.int32), b.column("key").slice(i, 1)).cast(pa.binary()), h], ["key", "s"])
                else:
                    yield pa.RecordBatch.from_arrays([h], ["s"])

    return flat


def promising(sets: DataFrame, similar: float, bits: int) -> DataFrame:
    """(key, n, common) of the texts that can have a link: n shingles, of which another text has ``common`` at most.

    No intersection is larger than the lesser ``common`` of its texts, so a link needs ``common >= similar * n`` in both. The
    shared shingles stand in a filter of fixed size; what it lets through by chance only raises ``common``.
    """
    shared = sets.select("shingles").mapInArrow(_hashes("shingles", "s long"), "s long").groupBy("s").agg(F.count("*").alias("df")).where("df > 1")
    known = sets.sparkSession.sparkContext.broadcast(W.filter_bits(shared, "s", bits))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [np.frombuffer(x.as_py(), np.uint64) for x in b.column("shingles")]
            common = [int(W.passes(known.value, h).sum()) for h in own]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([len(h) for h in own], pa.int64()), pa.array(common, pa.int64())], ["key", "n", "common"])

    rows = sets.select("key", "shingles").mapInArrow(count, "key binary, n long, common long")
    return rows.where(F.col("common") >= similar * F.col("n") - 1e-6)


def linkable(sets: DataFrame, keys: DataFrame, similar: float) -> DataFrame:
    """As ``promising``, exactly and among the given texts alone."""
    own = stage(sets.join(keys, "key").select("key", "shingles"), "own")
    each = own.mapInArrow(_hashes("shingles", "key s"), "key binary, s long")
    seen = each.groupBy("s").agg(F.count("*").alias("df")).where("df > 1").select("s")
    common = each.join(seen, "s").groupBy("key").agg(F.count("*").alias("common"))
    return own.select("key", F.expr("octet_length(shingles) div 8").alias("n")).join(common, "key").where(F.col("common") >= similar * F.col("n") - 1e-6)


def _join_classes(have: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label) after links (a, b) between labels."""
    merged = components(links)
    old = have.join(merged.select(F.col("node").alias("label"), F.col("label").alias("new")), "label", "left")
    return stage(old.select("node", F.coalesce("new", "label").alias("label")), "classes")


def _leader_pairs(now: DataFrame, mixed: DataFrame, turn: int) -> DataFrame:
    """(a, b, la, lb): each text of a mixed bucket with one leader, the one it meets in most of its buckets.

    The first leader of a bucket is the text that has most of its shingles in common with others, the likely original of a
    group of copies; later ones are random.
    """
    order = F.struct(-F.col("share") if turn == 0 else F.xxhash64(F.lit(turn), "label"), F.struct("label", "key").alias("v"))
    lead = now.join(mixed, "h").groupBy("h").agg(F.min(order.alias("o")).alias("lead")).select("h", F.col("lead.v.key").alias("b"), F.col("lead.v.label").alias("lb"))
    met = now.join(lead, "h").where("label <> lb").groupBy("key", "b").agg(F.count("*").alias("n"), F.first("label").alias("la"), F.first("lb").alias("lb"))
    return met.groupBy("key").agg(F.max(F.struct("n", "b", "la", "lb")).alias("p")).select(F.col("key").alias("a"), "p.b", "p.la", "p.lb")


def _rest_pairs(now: DataFrame, mixed: DataFrame, sets: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    """(a, b, la, lb): the pairs of different classes in a bucket that can be links.

    All that rules a pair out is a condition of one join, so what is written is only what must be compared. (To let the classes of a
    bucket meet first, then their members, writes more: a pair stands there once for each band that it shares.)
    """
    rest = stage(now.join(mixed, "h").select("h", "key", "label"), "rest")
    bound = stage(linkable(sets, rest.select("key").distinct(), similar).join(texts.select("key", "bands"), "key"), "bound")
    rest = rest.join(bound, "key")
    one, two = (rest.select("h", *(F.col(c).alias(f"{c}_{k}") for c in ("key", "label", "bands", "n", "common"))) for k in "ab")
    meet = (F.col("label_a") != F.col("label_b")) & (F.col("key_a") < F.col("key_b"))
    meet &= F.least("common_a", "common_b") * (1 + similar) >= (F.col("n_a") + F.col("n_b")) * similar - 1e-6
    # of the buckets that a pair shares, the least one stands for it
    meet &= F.array_min(F.array_intersect("bands_a", "bands_b")) == F.col("h")
    return one.join(two, "h").where(meet).select(*(F.col(c).alias(n) for c, n in (("key_a", "a"), ("key_b", "b"), ("label_a", "la"), ("label_b", "lb")))).distinct()


def classes(
    docs: DataFrame, similar: float = SIMILAR, bands: int = BANDS, rows: int = ROWS, leader_rounds: int = LEADER_ROUNDS, bits: int = FILTER_BITS
) -> DataFrame:
    """One row per document: doc_id, key, class_id, class_key (null for a row without words)."""
    signed = stage(signatures(docs, bands, rows), "signatures")
    texts = stage(signed.where("bands is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands")), "texts")
    buckets = texts.select("key", F.explode("bands").alias("h"))
    full = buckets.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    met = stage(buckets.join(full, "h"), "buckets")
    sets = stage(shingle_sets(docs, texts.join(met.select("key").distinct(), "key").select("key", "doc_id")), "sets")
    nodes = stage(promising(sets, similar, bits).select("key", (F.col("common") / F.col("n")).alias("share")), "nodes")
    members = stage(met.join(nodes, "key"), "members")
    discard(met)
    have = stage(nodes.select(F.col("key").alias("node"), F.col("key").alias("label")), "classes")
    for turn in range(leader_rounds + 1):
        now = stage(members.join(have, members.key == have.node).select("h", "key", "share", "label"), "now")
        # written, so that joins with it deal the rows anew and large buckets can be split
        mixed = stage(now.groupBy("h").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("h"), "mixed")
        found_pairs = _leader_pairs(now, mixed, turn) if turn < leader_rounds else _rest_pairs(now, mixed, sets, texts, similar)
        pairs = stage(found_pairs, "pairs")
        members_left = stage(now.join(mixed, "h").select("h", "key", "share"), "members")
        links = verified(pairs.select("a", "b"), sets, similar).join(pairs, ["a", "b"]).select(F.col("la").alias("a"), F.col("lb").alias("b"))
        links = stage(links.distinct(), "links")
        discard(now, mixed, pairs, members)
        members = members_left
        if not links.isEmpty():
            old, have = have, _join_classes(have, links)
            discard(old)
        discard(links)
    name = texts.select("key", "doc_id").join(have.select(F.col("node").alias("key"), "label"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    first = name.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    named = stage(name.select("key", "label").join(first, "label"), "names")
    discard(sets, members, have, nodes, texts)
    worded = signed.where("bands is not null").select("doc_id", "key").join(named, "key").select("doc_id", "key", "class_id", F.col("label").alias("class_key"))
    alone = signed.where("bands is null").select("doc_id", "key", F.col("doc_id").alias("class_id"), F.lit(None).cast("binary").alias("class_key"))
    return worded.unionByName(alone)


def near_dedup(docs: DataFrame, **how: float) -> DataFrame:
    """doc_id, class_id, class_key (hex) of every document."""
    return classes(docs, **how).select("doc_id", "class_id", F.lower(F.hex("class_key")).alias("class_key"))


def keep_one(docs: DataFrame, bits: int = 24, **how: float) -> DataFrame:
    """The documents without near copies: of each class one row stays, that of the least doc_id (any one of equal rows).

    Rows without words stay all. Rows of classes of one pass a filter of fixed size over the others' names; only what it
    holds back is shuffled, to be joined with those names.
    """
    worded = stage(classes(docs, **how).where("class_key is not null"), "member")
    size = worded.groupBy("class_key").agg(F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("stay"))
    touched = worded.join(stage(size.where("n > 1"), "sizes"), "class_key").select("doc_id", "key", F.expr("stay.key = key and stay.doc_id <=> doc_id").alias("stays")).distinct()
    key, t_key, t_id, x, some, stays, nth = fresh(docs, "text_key", "touched_key", "touched_id", "name_hash", "held_back", "stays", "nth")
    touched = stage(touched.select(F.col("key").alias(t_key), F.col("doc_id").alias(t_id), F.xxhash64("key", "doc_id").alias(x), F.col("stays").alias(stays)), "touched")
    named = docs.withColumn(key, digest())
    named = named.withColumn(some, W.may_be_in(W.filter_bits(touched, x, bits), F.xxhash64(key, "doc_id")))
    same = F.col(key).eqNullSafe(F.col(t_key)) & F.col("doc_id").eqNullSafe(F.col(t_id))
    held = named.where(F.col(some)).join(touched.drop(x), same, "left").where(F.coalesce(F.col(stays), F.lit(True)))
    # rows that are equal in id and text meet here: one of them stays, unless none of them was in a class of several
    held = held.withColumn(nth, F.row_number().over(Window.partitionBy(key, "doc_id").orderBy(F.lit(0)))).where((F.col(nth) == 1) | F.col(stays).isNull())
    return named.where(~F.col(some)).select(docs.columns).unionByName(held.select(docs.columns))
