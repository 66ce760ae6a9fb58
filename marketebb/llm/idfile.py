"""Token ids in files of shuffled planes.

Format of a file: magic; blocks of ``BLOCK`` ids (the last may be shorter), each transposed into byte planes (plane k holds
byte k of every id) or bit planes (bit k of every id), each plane compressed by itself with zstandard, a plane of zeros
stored as nothing; the document table (doc_id, null flag, number of ids; zstandard); the chunk index, a row for each block:
first id, number of ids, place in the file, size of each plane; last a fixed tail that tells where table and index are. A
block can be read alone by the index.

Files follow the order of doc_id (null first, equal ids by text hash): file i holds the ids of one range, so the place of a
document is the number of ids in earlier files, one number for each file, plus its place in its own. Texts are shuffled once,
to their range. A task holds one block.

Nulls: a null text is an empty one; its ids are the end id alone.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketebb.llm import files, tokens
from marketebb.llm.shared import scratch_dir, stage

MAGIC, BLOCK, LEVEL = b"IDPLANE1", 65_536, 3
TAIL = "<QQQQB7x8s"  # table at, table size, index at, blocks, bits per plane, magic


def to_planes(ids: np.ndarray, bits: int) -> list[bytes]:
    """32 bit planes or 4 byte planes of unsigned 32-bit ids."""
    by = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if bits == 8:
        return [np.ascontiguousarray(by[:, k]).tobytes() for k in range(4)]
    flags = np.unpackbits(by, axis=1, bitorder="little")
    return [np.packbits(flags[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int, bits: int) -> np.ndarray:
    if bits == 8:
        out = np.zeros((n, 4), np.uint8)
        for k, p in enumerate(planes):
            if p:
                out[:, k] = np.frombuffer(p, np.uint8)
        return out.reshape(-1).view("<u4")
    flags = np.zeros((n, 32), np.uint8)
    for k, p in enumerate(planes):
        if p:
            flags[:, k] = np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little")
    return np.packbits(flags, axis=1, bitorder="little").reshape(-1).view("<u4")


class Writer:
    """Takes documents in order; ``close`` writes what is left and the indexes."""

    def __init__(self, out: pa.NativeFile, bits: int = 8, block: int = BLOCK) -> None:
        import zstandard

        self.press = zstandard.ZstdCompressor(level=LEVEL).compress
        self.out, self.bits, self.block = out, bits, block
        self.at, self.n_ids, self.held, self.n_held = len(MAGIC), 0, [], 0
        self.index: list[tuple[int, ...]] = []
        self.docs: list[tuple[int, bool, int]] = []
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id or 0, doc_id is None, len(ids) // 4))
        self.held.append(ids)
        self.n_held += len(ids) // 4
        if self.n_held >= self.block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.held), "<u4")
        upto = len(ids) if last else len(ids) - len(ids) % self.block
        for a in range(0, upto, self.block):
            part = ids[a : min(a + self.block, upto)]
            planes = [self.press(p) if any(p) else b"" for p in to_planes(part, self.bits)]
            self.index.append((self.n_ids, len(part), self.at, *map(len, planes)))
            for p in planes:
                self.out.write(p)
            self.at += sum(map(len, planes))
            self.n_ids += len(part)
        self.held = [ids[upto:].tobytes()]
        self.n_held = len(ids) - upto

    def close(self) -> None:
        self._flush(True)
        kinds = np.dtype([("doc_id", "<i8"), ("null", "?"), ("n", "<i8")])
        table = self.press(np.array(self.docs, kinds).tobytes())
        index = np.array(self.index, "<u8").tobytes()
        self.out.write(table)
        self.out.write(index)
        self.out.write(struct.pack(TAIL, self.at, len(table), self.at + len(table), len(self.index), self.bits, MAGIC))


class Reader:
    def __init__(self, source: pa.NativeFile) -> None:
        import zstandard

        self.source, self.unpress = source, zstandard.ZstdDecompressor().decompress
        size = source.size()
        table, n_table, index, blocks, self.bits, magic = struct.unpack(TAIL, self._read(size - struct.calcsize(TAIL), struct.calcsize(TAIL)))
        if magic != MAGIC:
            raise ValueError("not a file of id planes")
        kinds = np.dtype([("doc_id", "<i8"), ("null", "?"), ("n", "<i8")])
        self.docs = np.frombuffer(self.unpress(self._read(table, n_table)), kinds)
        planes = 32 // self.bits
        self.index = np.frombuffer(self._read(index, 8 * blocks * (3 + planes)), "<u8").reshape(blocks, 3 + planes).astype(np.int64)

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def block(self, i: int) -> np.ndarray:
        _, n, at, *sizes = self.index[i].tolist()
        data, planes = self._read(at, sum(sizes)), []
        for s in sizes:
            planes.append(self.unpress(data[:s]) if s else b"")
            data = data[s:]
        return from_planes(planes, n, self.bits)

    def documents(self) -> Iterator[tuple[int | None, int, int, int]]:
        """(doc_id, start, n, crc32 of the ids) in order, one block at a time."""
        block, held, start = 0, np.zeros(0, "<u4"), 0
        for doc_id, null, n in self.docs.tolist():
            crc, need = 0, n
            while need:
                if not len(held):
                    held, block = self.block(block), block + 1
                crc = zlib.crc32(held[:need].tobytes(), crc)
                held, need = held[need:], need - min(need, len(held))
            yield None if null else doc_id, start, n, crc
            start += n


def write(docs: DataFrame, tokenizer: str, folder: str, end: int = 1, bits: int = 8) -> DataFrame:
    """Encode the texts and write the files; a row for each: part (their order), file, n_docs, n_ids, n_bytes."""

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        with files.create(folder, f"part-{part:06d}", ".ids") as (name, out):
            w = Writer(out, bits)
            for b in batches:
                for first, ids in tokens.encoded(b.column("text"), tokenizer, end):
                    for doc_id, x in zip(b.column("doc_id").slice(first, len(ids)).to_pylist(), ids, strict=True):
                        w.add(doc_id, x)
            w.close()
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "file": [name], "n_docs": [len(w.docs)], "n_ids": [w.n_ids], "n_bytes": [out.tell()]}
            )

    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("h", F.xxhash64("text"))
    ranged = ranged.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").drop("h")
    return stage(ranged.mapInArrow(save, "part int, file string, n_docs long, n_ids long, n_bytes long"), "id-files")


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, base in zip(b.column("file").to_pylist(), b.column("base").to_pylist(), strict=True):
                with files.open_file(folder, name) as source:
                    rows = list(Reader(source).documents())
                doc_id, start, n, crc = zip(*rows, strict=True) if rows else ((), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_id, pa.int64()), pa.array(np.array(start, np.int64) + base), pa.array(n, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    # one row for each file meets here
    base = F.sum("n_ids").over(Window.orderBy("part")) - F.col("n_ids")
    dealt = manifest.where("n_docs > 0").select("part", "file", base.alias("base")).repartition(max(1, manifest.count()), "part")
    return dealt.select("file", "base").mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end: int = 1, bits: int = 8) -> DataFrame:
    """Write all documents and read the files back."""
    folder = scratch_dir(docs.sparkSession, "ids")
    return read(write(docs, tokenizer, folder, end, bits), folder)
