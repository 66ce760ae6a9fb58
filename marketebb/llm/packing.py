"""Best-fit packing of token sequences by hierarchical residual packing.

Each partition packs its own pieces best-fit (decreasing) and emits the bins that are nearly full. The underfull bins become
the items of the next round: they are dealt to groups of about ``FIRST_GROUP`` bins, in later rounds to ``FAN_IN`` times fewer
groups, and packed best-fit again, with their pieces. A bin that the least of all has no room in is done as well. Rounds go on until no two bins
that are left fit together, or one group has held all of them. A group gets about ``GROUP`` bins at most, whatever their number: bins are dealt
by a hash of their row number in the written table, so equal ones spread too. A corpus whose leftovers do not fit together does not end in one task.

Texts are encoded where they are read and never shuffled; what moves is underfull bins, a few numbers for each piece.

Nulls: a null text is an empty one, a piece of the end id alone; a null doc_id stays null. Equal rows are packed each. Texts of any
length are encoded whole and cut into pieces; the pieces of one text need not follow each other. Of bins with equal room any one is taken.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketebb.llm import tokens
from marketebb.llm.shared import stage

CAPACITY, END = 2048, 0
SLACK, WINDOW_ITEMS, FIRST_GROUP, GROUP, FAN_IN = 16, 100_000, 2_000, 20_000, 8


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each item: largest first, each into the open bin with the least room that holds it."""
    out = np.zeros(len(sizes), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    some, bins = 0, 0  # bit r of some: an open bin has room for exactly r
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        if fits := some >> size:
            r = size + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                some ^= 1 << r
        else:
            r, b, bins = capacity, bins, bins + 1
        out[i] = b
        if r > size:
            room[r - size].append(b)
            some |= 1 << (r - size)
    return out


def piece_type(doc_id: pa.DataType) -> pa.DataType:
    return pa.struct([("doc_id", doc_id), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())])


def _bins(pieces: pa.StructArray, of: np.ndarray) -> pa.RecordBatch:
    """One row for each bin: its fill and its pieces, with their places."""
    order = np.argsort(of, kind="stable")
    begin = np.flatnonzero(np.concatenate([[True], np.diff(of[order]) > 0]))[: len(order)]
    pieces = pieces.take(pa.array(order))
    fields = {f.name: pieces.field(i) for i, f in enumerate(pieces.type)}
    length = fields["length"].to_numpy(zero_copy_only=False)
    before = np.cumsum(length) - length
    sizes = np.diff(np.concatenate([begin, [len(order)]]))
    fields["offset"] = pa.array(before - np.repeat(before[begin], sizes))
    fill = np.add.reduceat(length, begin) if len(begin) else np.zeros(0, np.int64)
    ends = np.concatenate([begin, [len(order)]]).astype(np.int32)
    rows = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(list(fields.values()), list(fields)))
    return pa.RecordBatch.from_arrays([pa.array(fill, pa.int64()), rows], ["fill", "pieces"])


def local_bins(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(fill, pieces): the bins of each partition, packed in windows of ``WINDOW_ITEMS`` pieces."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.StructArray] = []

        def packed() -> Iterator[pa.RecordBatch]:
            pieces = pa.concat_arrays(held)
            held.clear()
            yield _bins(pieces, best_fit(pieces.field("length").to_numpy(zero_copy_only=False), capacity))

        for b in batches:
            for first, ids in tokens.encoded(b.column("text"), tokenizer, end):
                row, piece, start, length, crc = [], [], [], [], []
                for r, x in enumerate(ids):
                    n = len(x) // 4
                    for p, at in enumerate(range(0, n, capacity)):
                        part = x[4 * at : 4 * (at + capacity)]
                        row.append(first + r), piece.append(p), start.append(at), length.append(len(part) // 4), crc.append(zlib.crc32(part))
                held.append(
                    pa.StructArray.from_arrays(
                        [b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.zeros(len(row), np.int64))],
                        fields=list(piece_type(b.column("doc_id").type)),
                    )
                )
                if sum(map(len, held)) >= WINDOW_ITEMS:
                    yield from packed()
        if held:
            yield from packed()

    return docs.select("doc_id", "text").mapInArrow(pack, _schema(docs))


def _schema(docs: DataFrame) -> str:
    kind = docs.schema["doc_id"].dataType.simpleString()
    return f"fill long, pieces array<struct<doc_id:{kind},piece:int,start:long,length:long,ids_crc32:long,offset:long>>"


def merge(bins: DataFrame, groups: int, capacity: int = CAPACITY) -> DataFrame:
    """The bins, put into each other best-fit within groups that a hash of their row numbers makes."""

    def pack(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        lists, fill = table.column("pieces").combine_chunks(), table.column("fill").to_numpy()
        if isinstance(lists, pa.ChunkedArray):
            lists = pa.concat_arrays(lists.chunks)
        flat = lists.flatten()
        if isinstance(flat, pa.ChunkedArray):
            flat = pa.concat_arrays(flat.chunks)
        sizes = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
        return pa.Table.from_batches([_bins(flat, np.repeat(best_fit(fill, capacity), sizes))])

    dealt = bins.select("fill", "pieces", F.pmod(F.xxhash64("nth"), F.lit(groups)).alias("g"))
    return dealt.groupBy("g").applyInArrow(lambda t: pack(t.select(["fill", "pieces"])), bins.select("fill", "pieces").schema)


def bins_of(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(fill, pieces) of all final bins, as written tables."""

    def numbered(bins: DataFrame) -> DataFrame:
        return stage(bins.withColumn("nth", F.monotonically_increasing_id()), "bins")

    now, done, groups = numbered(local_bins(docs, tokenizer, capacity, end)), [], 0
    while True:
        most = capacity - SLACK
        least = now.where(F.col("fill") <= most).agg(F.min("fill")).first()[0]
        most = min(most, capacity - (least or capacity))  # no bin fuller than this takes another in
        n = now.where(F.col("fill") <= most).count()
        if n < 2 or groups == 1:
            break
        done.append(now.where(F.col("fill") > most))
        groups = max(-(-n // GROUP), groups // FAN_IN, 1) if groups else max(-(-n // FIRST_GROUP), 1)
        now = numbered(merge(now.where(F.col("fill") <= most), groups, capacity))
    return reduce(DataFrame.unionByName, [*done, now]).drop("nth")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    bins = bins_of(docs, tokenizer, capacity, end).withColumn("sequence_id", F.monotonically_increasing_id())
    return bins.select("sequence_id", F.explode("pieces").alias("p")).select("p.doc_id", "p.piece", "p.start", "p.length", "p.ids_crc32", "sequence_id", "p.offset")
