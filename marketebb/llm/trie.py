"""Prefix trie of conversations: nodes are distinct sequences of first turns, found with a count-min screen.

Every turn of a conversation ends a prefix, whose digest (128 bits) is a sum over its turns of a hash of (depth, role, text). As a sum it is
computed in pieces, so one conversation may hold any share of the rows. A count-min sketch of all prefix digests, of fixed
size and with counters that stop at two, is merged over the tasks and sent to all. An estimate of one proves a singleton: only one
conversation has this prefix, so the node, and all below it, is emitted where it is read. Only prefixes that are perhaps
shared are shuffled and grouped exactly; a full sketch costs shuffle, never rightness.

Sums over subtrees need no walk over the tree. A node is owned by its least conversation, and what a conversation owns is a
suffix of its turns. So the distinct words under a node are the sum of its members' words from the depth at which they own, the
leaves under it are its members that own a childless node, and the tokens saved are all words of its members from its
depth on less the distinct ones: all are sums by digest that are combined before the shuffle.

The digest of the conversations that end in a node runs over their sorted list: the list is cut into pieces of bounded size,
and the pieces of a node are hashed one after the other as a stream.

Nulls: turn sorts first, role and text are empty; rows without conv_id belong to no conversation. Turns of equal number are ordered by a
hash of role and text, so equal rows are turns of their own. Texts of any length are hashed where they are read and never
shuffled. An empty table has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketebb.llm.ranks import crc32_sql, ranked, with_runs
from marketebb.llm.shared import discard, stage
from marketebb.llm.words import mix

FAMILY, HEADS = 20, 4
#: The sketch: rows of counters, and counters in a row as a power of two (three rows of 2 ** 24 bits are sent to the tasks).
SKETCH_ROWS, SKETCH_BITS = 3, 24
PIECE_CHARS = 1 << 16
WORD = "[^\\x20\\x09-\\x0D]+"
_LANES, _MASK = ("l1", "l2", "l3", "l4"), (1 << 32) - 1
_NODE = ("d1", "d2")


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, two hashes of role and text, words of the text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return conversations.where("conv_id IS NOT NULL").select(
        "conv_id", "turn", F.xxhash64(F.lit(1), role, text).alias("a"), F.xxhash64(F.lit(2), role, text).alias("b"),
        F.regexp_count(text, F.lit(WORD)).alias("words"),
    )


def base(conv_id: Column) -> Column:
    return conv_id - conv_id % FAMILY


def borrowed(conv_id: Column) -> Column:
    """Number of turns that a conversation takes from the first of its family."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % HEADS).cast("int")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns: conv_id, _part, depth, a, b, words; conv_ids): each conversation begins with turns of the first of its family."""
    placed, runs = ranked(turns(conversations), ["conv_id"], ["turn", "a", "b"], "turns")
    runs = stage(runs, "runs")
    convs = runs.where("_start = 0").select("conv_id", F.col("_total").alias("n"))
    first = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    other = convs.select("conv_id", base(F.col("conv_id")).alias("base")).where("conv_id <> base").join(first, "base", "left")
    other = other.select("conv_id", "base", borrowed(F.col("conv_id")).alias("skip"), F.least(borrowed(F.col("conv_id")), F.coalesce("n_base", F.lit(0))).alias("taken"))
    runs = runs.join(other.drop("base"), "conv_id", "left").fillna(0, ["skip", "taken"])
    rows = stage(with_runs(placed, runs, ["conv_id"]).select("conv_id", "_part", "idx", "skip", "taken", "a", "b", "words"), "rows")
    discard(placed)
    own = rows.where("idx >= skip").select("conv_id", "_part", (F.col("idx") - F.col("skip") + F.col("taken") + 1).alias("depth"), "a", "b", "words")
    heads = rows.where(f"idx < {HEADS - 1} AND conv_id % {FAMILY} = 0").select(F.col("conv_id").alias("base"), "idx", "a", "b", "words")
    heads = other.where("taken > 0").join(heads, "base").where("idx < taken")
    heads = heads.select("conv_id", F.lit(-1).alias("_part"), (F.col("idx") + 1).alias("depth"), "a", "b", "words")
    return own.unionByName(heads), convs.select("conv_id")


def prefixes(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(prefixes: conv_id, depth, digest d1 d2, the parent's p1 p2, words of the last turn, suffix (words from it on), last; roots).

    Sums run within a part of a conversation; the parts' totals are then carried on.
    """
    rows, convs = rebuilt(conversations)
    x1, x2 = F.xxhash64(F.lit(3), "depth", "a", "b"), F.xxhash64(F.lit(4), "depth", "a", "b")
    halves = (lambda x: x.bitwiseAND(F.lit(_MASK)), lambda x: F.shiftrightunsigned(x, 32))
    rows = rows.select("conv_id", "_part", "depth", "words", x1.alias("x1"), x2.alias("x2"))
    lanes = [half(F.col(x)) for x in ("x1", "x2") for half in halves]
    local = Window.partitionBy("conv_id", "_part").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = [F.sum(v).over(local).alias(n) for n, v in zip((*_LANES, "said"), (*lanes, F.col("words")), strict=True)]
    rows = stage(rows.select("*", *sums), "sums")
    parts = rows.groupBy("conv_id", "_part").agg(*[F.max(n).alias(n) for n in (*_LANES, "said")], F.max("depth").alias("depth"))
    every = Window.partitionBy("conv_id")
    before = every.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        "conv_id", "_part", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"o_{n}") for n in (*_LANES, "said")],
        F.sum("said").over(every).alias("total"), F.max("depth").over(every).alias("length"),
    )
    parts = stage(parts, "parts")
    roots = convs.join(parts.groupBy("conv_id").agg(F.max("total").alias("suffix"), F.max("length").alias("length")), "conv_id", "left")
    roots = roots.select("conv_id", F.coalesce("suffix", F.lit(0)).cast("long").alias("suffix"), F.col("length").isNull().alias("last"))
    full = {n: (F.col(n) + F.col(f"o_{n}")).bitwiseAND(F.lit(_MASK)) for n in _LANES}
    less = {n: (F.col(n) + F.col(f"o_{n}") - v).bitwiseAND(F.lit(_MASK)) for n, v in zip(_LANES, lanes, strict=True)}
    joined = lambda of, low, high: F.shiftleft(of[high], 32).bitwiseOR(of[low])
    rows = rows.join(parts, ["conv_id", "_part"]).select(
        "conv_id", F.col("depth").cast("long").alias("depth"), joined(full, "l1", "l2").alias("d1"), joined(full, "l3", "l4").alias("d2"),
        joined(less, "l1", "l2").alias("p1"), joined(less, "l3", "l4").alias("p2"), F.col("words").cast("long").alias("words"),
        (F.col("total") - F.col("said") - F.col("o_said") + F.col("words")).cast("long").alias("suffix"), (F.col("depth") == F.col("length")).alias("last"),
    )
    return rows, roots


# The screen


def cells(d1: np.ndarray, d2: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Counter of each digest in every row of the sketch."""
    for j in range(SKETCH_ROWS):
        yield (mix(d1 + np.uint64(j + 1) * (d2 | np.uint64(1))) >> np.uint64(64 - bits)).astype(np.int64)


def _marks(places: np.ndarray, words: int) -> np.ndarray:
    out = np.zeros(words, np.uint64)
    np.bitwise_or.at(out, places >> 6, np.uint64(1) << (places & 63).astype(np.uint64))
    return out


class Counters:
    """Count-min counters that stop at two, as two bitmaps for each row: at least one, at least two."""

    def __init__(self, bits: int) -> None:
        self.bits, self.words = bits, 1 << max(bits - 6, 0)
        self.ones = np.zeros((SKETCH_ROWS, self.words), np.uint64)
        self.twos = np.zeros_like(self.ones)

    def add(self, d1: np.ndarray, d2: np.ndarray) -> None:
        for j, at in enumerate(cells(d1, d2, self.bits)):
            at, n = np.unique(at, return_counts=True)
            new = _marks(at, self.words)
            self.twos[j] |= (self.ones[j] & new) | _marks(at[n > 1], self.words)
            self.ones[j] |= new

    def merge(self, word: np.ndarray, ones: np.ndarray, twos: np.ndarray) -> None:
        """Add words of other sketches; a word may come many times."""
        flat1, flat2 = self.ones.reshape(-1), self.twos.reshape(-1)
        order = np.argsort(word, kind="stable")
        word, ones, twos = word[order], ones[order], twos[order]
        nth = np.arange(len(word)) - np.searchsorted(word, word)
        for k in range(int(nth.max(initial=-1)) + 1):  # the k-th of equal words: all different
            i = nth == k
            w = word[i]
            flat2[w] |= twos[i] | (flat1[w] & ones[i])
            flat1[w] |= ones[i]

    def batch(self) -> pa.RecordBatch:
        flat1, flat2 = self.ones.reshape(-1), self.twos.reshape(-1)
        word = np.flatnonzero(flat1)
        return pa.RecordBatch.from_arrays([pa.array(word), pa.array(flat1[word].view(np.int64)), pa.array(flat2[word].view(np.int64))], ["word", "ones", "twos"])


def _unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).view(np.uint64)


def screen(rows: DataFrame, bits: int = SKETCH_BITS) -> np.ndarray:
    """The sketch's bitmaps of counters at two or more. A task holds one sketch; what reaches the driver has its fixed size."""
    schema = "word long, ones long, twos long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Counters(bits)
        for b in batches:
            own.add(_unsigned(b["d1"]), _unsigned(b["d2"]))
        yield own.batch()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Counters(bits)
        for b in batches:
            own.merge(b["word"].to_numpy(), _unsigned(b["ones"]), _unsigned(b["twos"]))
        yield own.batch()

    partial = rows.select("d1", "d2").mapInArrow(count, schema)
    merged = partial.withColumn("chunk", F.shiftright("word", 8)).repartition("chunk").select("word", "ones", "twos").mapInArrow(meet, schema)
    out = np.zeros(SKETCH_ROWS << max(bits - 6, 0), np.uint64)
    words = merged.where("twos <> 0").select("word", "twos").toArrow()
    out[words["word"].to_numpy()] = words["twos"].to_numpy().view(np.uint64)
    return out.reshape(SKETCH_ROWS, -1)


def proves_single(spark: SparkSession, twos: np.ndarray, bits: int, d1: Column, d2: Column) -> Column:
    """Whether a digest's estimate is one: some row of the sketch counts it alone."""
    known = spark.sparkContext.broadcast(twos)

    @F.pandas_udf("boolean")
    def test(a: pd.Series, b: pd.Series) -> pd.Series:
        alone = np.zeros(len(a), bool)
        for j, at in enumerate(cells(a.to_numpy().view(np.uint64), b.to_numpy().view(np.uint64), bits)):
            alone |= (known.value[j][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 0
        return pd.Series(alone)

    return test(d1, d2)


# The nodes


def ends_digest(ends: DataFrame) -> DataFrame:
    """(d1, d2, ends_sha256) of (d1, d2, conv_id): SHA-256 of the sorted, comma-joined ids of each node."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d1, d2, ids = (b[c].to_numpy() for c in ("d1", "d2", "conv_id"))
            cut = np.flatnonzero((np.diff(d1) != 0) | (np.diff(d2) != 0)) + 1 if len(ids) else []
            out = []
            for a, z in zip([0, *cut], [*cut, len(ids)], strict=True):
                for i in range(a, z, PIECE_CHARS // 20):
                    k = min(z, i + PIECE_CHARS // 20)
                    out.append((d1[i], d2[i], ids[i], ",".join(map(str, ids[i:k].tolist()))))
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())], ["d1", "d2", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for b in batches:
            done = []
            for d1, d2, ids in zip(*(b[c].to_pylist() for c in ("d1", "d2", "ids")), strict=True):
                if (d1, d2) == node:
                    state.update(b"," + ids.encode())
                    continue
                if node:
                    done.append((*node, state.hexdigest()))
                node, state = (d1, d2), hashlib.sha256(ids.encode())
            yield _digests(done)
        if node:
            yield _digests([(*node, state.hexdigest())])

    order = [*_NODE, "conv_id"]
    cut = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pieces, "d1 long, d2 long, first long, ids string")
    return cut.repartition(*_NODE).sortWithinPartitions(*_NODE, "first").mapInArrow(hashed, "d1 long, d2 long, ends_sha256 string")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], [*_NODE, "ends_sha256"])


def trie(conversations: DataFrame, bits: int = SKETCH_BITS) -> DataFrame:
    """Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    rows, roots = prefixes(conversations)
    rows, roots = stage(rows, "prefixes"), stage(roots, "roots")
    twos = screen(rows, bits)
    alone = proves_single(spark, twos, bits, F.col("d1"), F.col("d2"))
    parent_alone = (F.col("depth") > 1) & proves_single(spark, twos, bits, F.col("p1"), F.col("p2"))
    rows = rows.withColumn("alone", alone).withColumn("below", parent_alone)
    top = roots.select("conv_id", F.lit(0).cast("long").alias("depth"), *[F.lit(0).cast("long").alias(c) for c in ("d1", "d2", "p1", "p2", "words")], "suffix", "last")
    shared = stage(rows.where("NOT alone").drop("alone", "below").unionByName(top), "shared")
    border = stage(rows.where("alone AND NOT below").select("conv_id", "depth", "p1", "p2", "suffix", "last"), "border")

    nodes = shared.groupBy(*_NODE).agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("p1").alias("p1"), F.min("p2").alias("p2"),
        F.count(F.lit(1)).alias("n_convs"), F.min_by("suffix", "conv_id").alias("suffix"),
    )
    nodes = stage(nodes, "nodes")
    kids = nodes.where("depth > 0").select("p1", "p2").unionByName(border.select("p1", "p2"))
    kids = kids.groupBy(F.col("p1").alias("d1"), F.col("p2").alias("d2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = stage(nodes.join(kids, [*_NODE], "left").fillna(0, ["n_children"]), "nodes")

    owned = nodes.select("conv_id", "depth", "suffix", (F.col("n_children") == 0).cast("long").alias("leaf"))
    owned = owned.unionByName(border.select("conv_id", "depth", "suffix", F.lit(1).cast("long").alias("leaf")))
    owned = owned.groupBy("conv_id").agg(F.min("depth").alias("from"), F.min_by("suffix", "depth").alias("own"), F.max("leaf").alias("leaf"))
    sums = shared.select("conv_id", "depth", *_NODE, "suffix").join(owned, "conv_id", "left").groupBy(*_NODE).agg(
        F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"),
        F.sum(F.when(F.col("from").isNull(), F.col("suffix")).when(F.col("depth") < F.col("from"), F.col("suffix") - F.col("own")).otherwise(0)).alias("saved_tokens"),
    )

    root = nodes.where("depth = 0").first()
    names = nodes.select(F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("conv_id").alias("parent"))

    def with_parent(df: DataFrame) -> DataFrame:
        """The parent's conversation; a parent that is not among the shared nodes belongs to the same one."""
        near = df.where("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(root["conv_id"] if root else None).cast("long")))
        far = df.where("depth > 1").join(names, ["p1", "p2"], "left").withColumn("parent_conv_id", F.coalesce("parent", "conv_id")).drop("parent")
        return near.unionByName(far)

    none, self_ends = F.sha2(F.lit(""), 256), F.sha2(F.col("conv_id").cast("string"), 256)
    ends = ends_digest(shared.where("last"))
    many = with_parent(nodes.join(sums, [*_NODE]).join(ends, [*_NODE], "left"))
    many = many.select(*_columns("n_convs", "n_children", "n_leaves", "saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256"))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")

    def single(df: DataFrame) -> DataFrame:
        on = F.when(F.col("last"), zero).otherwise(one)
        return df.select(*_columns(one, on, one, zero), F.when(F.col("last"), self_ends).otherwise(none).alias("ends_sha256"))

    tails = rows.where("alone AND below").withColumn("parent_conv_id", F.col("conv_id"))
    return many.unionByName(single(with_parent(border))).unionByName(single(tails))


def _columns(*counts: str | Column) -> list[Column]:
    named = zip(("n_convs", "n_children", "n_leaves", "saved_tokens"), counts, strict=True)
    return [F.col(c).cast("long").alias(c) for c in ("conv_id", "depth", "parent_conv_id")] + [(F.col(v) if isinstance(v, str) else v).cast("long").alias(n) for n, v in named]


SQL = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS i FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {crc32_sql("CAST(conv_id AS VARCHAR)")} % {HEADS} AS h, conv_id - conv_id % {FAMILY} AS b FROM (SELECT DISTINCT conv_id FROM t)),
u AS (SELECT c.conv_id, 0 AS s, t.i, t.r, t.x FROM c JOIN t ON t.conv_id = c.b AND t.i < c.h UNION ALL SELECT c.conv_id, 1, t.i, t.r, t.x FROM c JOIN t ON t.conv_id = c.conv_id AND t.i >= c.h),
q AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY s, i) AS d, length(r) || ':' || r || length(x) || ':' || x AS k, length(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) AS w FROM u),
p AS (SELECT conv_id, d, string_agg(k, '' ORDER BY d) OVER (PARTITION BY conv_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS path, w FROM q UNION ALL SELECT conv_id, 0, '', 0 FROM c),
m AS (SELECT *, lag(path) OVER (PARTITION BY conv_id ORDER BY d) AS up, max(d) OVER (PARTITION BY conv_id) AS n FROM p),
v AS (SELECT d, path, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(w) AS w, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE d = n), '') AS ends FROM m GROUP BY d, path),
k AS (SELECT up, count(*) AS n FROM v WHERE d > 0 GROUP BY up),
b AS (SELECT DISTINCT a.path, z.path AS under FROM m a JOIN m z ON z.conv_id = a.conv_id AND z.d >= a.d),
s AS (SELECT b.path, sum((v.n_convs - 1) * v.w) AS saved, count(*) FILTER (WHERE k.n IS NULL) AS leaves FROM b JOIN v ON v.path = b.under LEFT JOIN k ON k.up = v.path GROUP BY b.path)
SELECT v.conv_id, CAST(v.d AS BIGINT) AS depth, y.conv_id AS parent_conv_id, v.n_convs, CAST(coalesce(k.n, 0) AS BIGINT) AS n_children, CAST(s.leaves AS BIGINT) AS n_leaves,
       CAST(s.saved AS BIGINT) AS saved_tokens, sha256(v.ends) AS ends_sha256
FROM v JOIN s ON s.path = v.path LEFT JOIN k ON k.up = v.path LEFT JOIN v y ON v.d > 0 AND y.path = v.up AND y.d = v.d - 1
"""
