"""Words and word shingles of whole Arrow batches in numpy, and the fixed-size filters that keep shuffles small.

Texts are taken from the UTF-8 buffer of an Arrow column, in slices of a bounded number of bytes, so a task holds one
slice (or one longer text) of temporaries whatever the batch size. Hashes depend on the text only: the same on every
executor and in every run.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 19
#: Words of near-duplicate and decontamination operators: runs of ASCII letters (lower-cased), digits and non-ASCII characters.
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

_BASE = 0x9E3779B97F4A7C15


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker, across its tasks."""
    return sys.modules.setdefault("marketebb_worker_cache", types.ModuleType("marketebb_worker_cache")).__dict__


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``size`` bytes each; a longer row is a range of its own."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, on an array of unsigned 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    cache = worker_cache()
    have = cache.get("powers")
    if have is None or len(have[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        have = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]), dtype=np.uint64) for b in (_BASE, inverse))
        if n <= SLICE_BYTES + 1:
            cache["powers"] = have
    return have


@dataclass
class Words:
    """The words of the rows ``first``.. of a batch: row of each word (from 0), byte range, hash."""

    data: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    n_rows: int

    def counts(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.n_rows)

    def text(self, i: int, j: int) -> str:
        """The words i..j-1 (of one row), lower-cased, joined by a blank."""
        return " ".join(bytes(self.data[a:b]).decode("utf-8", "replace") for a, b in zip(self.start[i:j], self.end[i:j], strict=True))

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word and hash of every run of k words within a row."""
        n = len(self.row) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        first = np.flatnonzero(self.row[:n] == self.row[k - 1 :])
        h = np.full(len(first), k, np.uint64)
        for i in range(k):
            h = (h ^ self.hash[first + i]) * np.uint64(0x9FB21C651E98DF25)
            h ^= h >> np.uint64(29)
        return first, mix(h)


def lowered(data: np.ndarray) -> np.ndarray:
    upper = (data >= 65) & (data <= 90)
    return data + (upper.astype(np.uint8) << 5)


def split(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of the rows between the offsets, lower-cased in A-Z."""
    base, n_rows = int(offsets[0]), len(offsets) - 1
    data = lowered(data[base : int(offsets[-1])])
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, none, none, none, np.zeros(0, np.uint64), n_rows)
    inside = (data >= 128) | ((data >= 48) & (data <= 57)) | ((data >= 97) & (data <= 122))
    borders = np.unique(offsets[:-1] - base)
    borders = borders[borders < len(data)]
    before = np.concatenate([[False], inside[:-1]])
    before[borders] = False
    after = np.concatenate([inside[1:], [False]])
    after[borders[borders > 0] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    row = np.searchsorted(offsets - base, start, "right") - 1
    up, down = _powers(len(data) + 1)
    total = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])
    left = np.where(start > 0, total[start - 1], np.uint64(0))
    h = mix((total[end - 1] - left) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    return Words(data, row, start, end, h, n_rows)


def each(column: pa.Array) -> Iterator[tuple[int, Words]]:
    """(first row, words) of the slices of a text column."""
    data, offsets = buffers(column)
    for a, b in slices(offsets):
        yield a, split(data, offsets[a : b + 1])


# A filter of fixed size: no false negatives, so what passes it is a superset, and the join that follows is exact.


def filter_bits(hashes: DataFrame, column: str, bits: int = 24) -> np.ndarray:
    """Bloom filter with 2**bits places and two probes over a column of well-mixed longs.

    At most 2**bits / 64 rows reach the driver, whatever the input.
    """
    low, mask = F.col(column), (1 << bits) - 1
    places = F.explode(F.array(low.bitwiseAND(F.lit(mask)), F.shiftrightunsigned(low, 64 - bits)))
    rows = (
        hashes.select(places.alias("p"))
        .groupBy(F.shiftright("p", 6).cast("int").alias("w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b"))
        .toArrow()
    )
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[rows["w"].to_numpy()] = rows["b"].to_numpy().view(np.uint64)
    return out


def may_be_in(filter_: np.ndarray, hashes: Column) -> Column:
    """Condition on a column of longs; only that column goes to Python, the rest of the row stays in the JVM."""
    known = SparkSession.active().sparkContext.broadcast(filter_)

    @F.pandas_udf("boolean")
    def test(h: pd.Series) -> pd.Series:
        return pd.Series(passes(known.value, h.to_numpy().view(np.uint64)))

    return test(hashes)


def passes(filter_: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the unsigned hashes may be in the filter."""
    bits = (len(filter_) * 64).bit_length() - 1

    def probe(p: np.ndarray) -> np.ndarray:
        return (filter_[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1)

    found = probe(h & np.uint64((1 << bits) - 1)).astype(bool)
    at = np.flatnonzero(found)
    found[at] = probe(h[at] >> np.uint64(64 - bits)).astype(bool)
    return found
