"""WARC archives of web pages, and a normaliser for archives that are one whole-file gzip stream.

``write`` packs pages into archives compressed as one stream, the form that many tools produce and that cannot be read
from the middle. ``normalise`` inflates each such file once, front to back, rewrites every record as a gzip member of its
own and writes a sidecar index beside the archive (offset, length, type, id of each record). ``read`` then reads records by
offset, a bounded number of bytes at a time.

Among records of equal payload (at least ``least`` bytes) that of the least page_id is a response, others are revisits of
it; the digest meets only (digest, page_id), not the payloads. Archives are cut at about ``archive_bytes``, so a file is work
for one task and never larger than that plus a record.

Nulls: a null html is an empty payload; a null url is an empty target; a null page_id sorts after all numbers (records of
equal payload that all have none are responses). Rows of equal page_id and payload are all responses.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketebb.llm import files
from marketebb.llm.shared import scratch_dir, stage

ARCHIVE_BYTES, CHUNK = 64 << 20, 1 << 20
DATE = "2024-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(text: object) -> str:
    """A header value of one line."""
    return "" if text is None else "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in str(text)).strip()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response with its payload, or a revisit with the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_line(url)}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head[2:2] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def typed(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html, refers_to (null for responses)."""
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    pages = pages.withColumn("d", F.sha1(F.col("html").cast("binary")))
    first = pages.groupBy("d").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = pages.join(first, "d", "left")
    again = (F.octet_length("html") >= least) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "html", F.when(again, F.col("first")).alias("refers_to"))


def write(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, least: int = 0) -> DataFrame:
    """Write archives, each one gzip stream; a row (file, n_records, n_bytes) for each."""

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows = TaskContext.get().partitionId(), _rows(batches)
        row = next(rows, None)
        while row is not None:
            with files.create(folder, f"pages-{part:05d}", ".warc.gz") as (name, out):
                press, n, size = zlib.compressobj(6, zlib.DEFLATED, 31), 0, 0
                while row is not None and size < archive_bytes:
                    data = record(row[0], row[1], row[2].encode("utf-8", "surrogatepass"), row[3])
                    out.write(press.compress(data))
                    n, size, row = n + 1, size + len(data), next(rows, None)
                out.write(press.flush())
                yield pa.RecordBatch.from_pydict({"file": [name], "n_records": [n], "n_bytes": [out.tell()]})

    return stage(typed(pages, least).mapInArrow(save, "file string, n_records long, n_bytes long"), "archives")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        columns = [b.column(c) for c in ("page_id", "url", "html", "refers_to")]
        for i in range(b.num_rows):
            yield tuple(c[i].as_py() for c in columns)


class Inflated:
    """Front-to-back reader of a gzip stream (of one member or more) that holds one chunk."""

    def __init__(self, source: pa.NativeFile) -> None:
        self.source, self.unpress, self.held, self.raw = source, zlib.decompressobj(31), b"", b""

    def _more(self) -> bool:
        while True:
            if self.unpress.eof:
                self.raw, self.unpress = self.unpress.unused_data + self.raw, zlib.decompressobj(31)
            self.raw = self.raw or self.source.read(CHUNK)
            if not self.raw:
                return False
            data = self.unpress.decompress(self.raw, CHUNK)
            self.raw = self.unpress.unconsumed_tail
            if data:
                self.held += data
                return True

    def until(self, mark: bytes) -> bytes:
        """Bytes up to and with the mark; what is left if there is none."""
        at = 0
        while (found := self.held.find(mark, at)) < 0:
            at = max(0, len(self.held) - len(mark) + 1)
            if not self._more():
                out, self.held = self.held, b""
                return out
        out, self.held = self.held[: found + len(mark)], self.held[found + len(mark) :]
        return out

    def pieces(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.held and not self._more():
                raise ValueError("the archive ends within a record")
            out, self.held = self.held[:n], self.held[n:]
            n -= len(out)
            yield out


def headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines) if k}


def members(source: pa.NativeFile, out: pa.NativeFile) -> Iterator[dict]:
    """Copy every record into a member of its own; an index row for each, once it is written."""
    stream = Inflated(source)
    while (head := stream.until(b"\r\n\r\n")).strip():
        h, begin = headers(head), out.tell()
        press = zlib.compressobj(6, zlib.DEFLATED, 31)
        out.write(press.compress(head))
        for piece in stream.pieces(int(h["content-length"]) + 4):
            out.write(press.compress(piece))
        out.write(press.flush())
        yield {"offset": begin, "length": out.tell() - begin, "type": h["warc-type"], "id": h["warc-record-id"]}


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite the archives named in ``file``; the index of all records (file, offset, length) as a written table.

    Beside each archive lies its index as JSON lines, for readers outside Spark.
    """

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column("file").to_pylist():
                with files.open_file(folder, name) as source, files.create(folder, name.partition(".")[0] + "-m", ".warc.gz") as (new, out), files.create(folder, new.partition(".")[0], ".index.jsonl") as (_, side):
                    rows = []
                    for row in members(source, out):
                        side.write(json.dumps(row).encode() + b"\n")
                        rows.append(row)
                        if len(rows) == 10_000:
                            yield _index(new, rows)
                            rows = []
                    yield _index(new, rows)

    n = max(1, archives.count())
    index = archives.select("file").repartition(n, "file").mapInArrow(rewrite, "file string, offset long, length long")
    return stage(index, "archive-index")


def _index(name: str, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {"file": pa.array([name] * len(rows), pa.string()), "offset": pa.array([r["offset"] for r in rows], pa.int64()), "length": pa.array([r["length"] for r in rows], pa.int64())}
    )


def read(index: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url of every record, each read by its offset.

    The payload of a response is measured and hashed anew; a revisit has the length and digest of its headers.
    """

    def number(urn: str | None) -> int | None:
        text = (urn or "").strip("<>").rpartition(":")[2]
        return int(text) if text else None

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = None, None
        for b in batches:
            rows = []
            for file, offset, length in zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                if file != name:
                    name, source = file, files.open_file(folder, file)
                source.seek(offset)
                head, _, block = zlib.decompress(source.read(length), 31).partition(b"\r\n\r\n")
                h = headers(head)
                http, _, payload = block[: int(h["content-length"])].partition(b"\r\n\r\n")
                known = h["warc-payload-digest"].partition(":")[2]
                if h["warc-type"] == "response":
                    n, sha = len(payload), digest(payload)
                    if sha != known:
                        raise ValueError(f"{file} at {offset}: payload does not have its digest")
                else:
                    n, sha = int(headers(http)["content-length"]), known
                rows.append((number(h["warc-record-id"]), n, sha, h["warc-type"], number(h.get("warc-refers-to")), h["warc-target-uri"]))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
    return index.sortWithinPartitions("file", "offset").mapInArrow(load, schema)


def round_trip(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES, least: int = 0) -> DataFrame:
    """Write all pages, normalise the archives, read the records back."""
    folder = scratch_dir(pages.sparkSession, "warc")
    whole = write(pages, folder, archive_bytes, least)
    return read(normalise(whole, folder), folder).drop("url")


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS hex FROM p),
b AS (
  SELECT page_id, n, hex, array_to_string([
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((
      (CAST(('0x' || substr(hex, 1 + 2 * (i * 5 // 8), 2)) AS BIGINT) * 256
       + CAST(('0x' || coalesce(nullif(substr(hex, 3 + 2 * (i * 5 // 8), 2), ''), '00')) AS BIGINT)) >> CAST(11 - i * 5 % 8 AS BIGINT)) & 31 AS BIGINT), 1) FOR i IN range(0, 32)], '') AS sha
  FROM d
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha AS payload_digest,
       CASE WHEN page_id = min(page_id) OVER (PARTITION BY hex) THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> min(page_id) OVER (PARTITION BY hex) THEN min(page_id) OVER (PARTITION BY hex) END AS refers_to
FROM b
"""
