"""WARC archives: a writer with one gzip member per record, and a sequential reader.

The reader inflates a file as it reads it, so it holds one record at a time; a record's end follows from its content length,
and payload digests are verified. Pages with equal payloads are stored once: one is a response, the others revisit it.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from wavegrid.llm import storage
from wavegrid.llm.common import shared_dir, stored

_DATE = "2000-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    """Base32 of the SHA-1, upper case."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


@dataclass
class Record:
    headers: dict[str, str]  # names in lower case
    block: bytes

    @property
    def payload(self) -> bytes:
        """Of an HTTP response, what follows its headers."""
        if self.headers.get("content-type", "").startswith("application/http"):
            return self.block.partition(b"\r\n\r\n")[2]
        return self.block


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))]) + "\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head.encode() + block + b"\r\n\r\n") + z.flush()


def _name(page: int | None) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def _page(name: str | None) -> int | None:
    text = name.removeprefix("<urn:page:").removesuffix(">") if name else ""
    return int(text) if text else None


def page_record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, length: int, sha1: str) -> bytes:
    """A gzip member: a response with its payload, or with refers_to a revisit without."""
    target = "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "about:blank")
    common = [("WARC-Record-ID", _name(page)), ("WARC-Target-URI", target), ("WARC-Date", _DATE), ("WARC-Payload-Digest", f"sha1:{sha1}"), ("WARC-Payload-Length", str(length))]
    if refers_to is not None:
        return _member([("WARC-Type", "revisit"), *common, ("WARC-Refers-To", _name(refers_to)), ("WARC-Profile", _PROFILE)], b"")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    return _member([("WARC-Type", "response"), *common, ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Type", "application/http; msgtype=response")], block)


class Reader:
    """Records of a stream of gzip members, in order. Raises ValueError for what isn't a whole record with right digests."""

    def __init__(self, stream, chunk: int = 1 << 18):
        self.stream, self.chunk = stream, chunk
        self.raw = b""  # read and not yet inflated
        self.inflater = None

    def _inflated(self) -> bytes | None:
        """More bytes of the member, or None at its end."""
        while True:
            if not self.raw:
                self.raw = self.stream.read(self.chunk)
                if not self.raw:
                    raise ValueError("the archive ends within a record")
            data = self.inflater.decompress(self.raw, self.chunk)
            self.raw = self.inflater.unconsumed_tail
            if self.inflater.eof:
                self.raw = self.inflater.unused_data
                self.inflater = None if not data else self.inflater
            if data:
                return data
            if self.inflater is None:
                return None

    def __iter__(self) -> Iterator[Record]:
        while True:
            if not self.raw:
                self.raw = self.stream.read(self.chunk)
            if not self.raw:
                return
            yield self._record()

    def _record(self) -> Record:
        self.inflater = zlib.decompressobj(31)
        held = bytearray()

        def fill(size: int | None) -> bool:
            """Up to size bytes, or one more piece; False if the member ended."""
            while size is None or len(held) < size:
                if self.inflater is None or self.inflater.eof:
                    return False
                try:
                    data = self._inflated()
                except zlib.error as e:
                    raise ValueError(f"the archive has a damaged member: {e}") from e
                if data is None:
                    return False
                held.extend(data)
                if size is None:
                    return True
            return True

        at = 0
        while (end := held.find(b"\r\n\r\n", max(0, at - 3))) < 0:
            at = len(held)
            if not fill(None):
                raise ValueError("a record has no end of its headers")
        lines = held[:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/1."):
            raise ValueError(f"a record begins with {lines[0][:20]!r}")
        headers = {}
        for line in lines[1:]:
            name, colon, value = line.partition(":")
            if not colon:
                raise ValueError(f"a header has no colon: {line[:40]!r}")
            headers[name.strip().lower()] = value.strip()
        length = headers.get("content-length", "")
        if not length.isdigit():
            raise ValueError("a record has no content length")
        size = end + 4 + int(length)
        fill(size + 4)
        fill(size + 5)  # nothing may follow
        if bytes(held[size:]) != b"\r\n\r\n":
            raise ValueError("a record's content length is wrong")
        self.inflater = None
        record = Record(headers, bytes(held[end + 4 : size]))
        self._verify(record)
        return record

    @staticmethod
    def _verify(record: Record) -> None:
        of = {"warc-block-digest": lambda: record.block}
        if record.headers.get("warc-type") != "revisit":
            of["warc-payload-digest"] = lambda: record.payload
        for name, what in of.items():
            algorithm, _, value = record.headers.get(name, "").partition(":")
            if value and algorithm.lower() == "sha1" and value.upper() != digest(what()):
                raise ValueError(f"{name} doesn't match")


def write(pages: DataFrame, uri: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_from: int = 0, archive_bytes: int = 64 << 20) -> DataFrame:
    """Writes a record for each row into archives of about archive_bytes; returns (uri, records), stored.

    Of rows with equal payloads of at least revisit_from bytes, that with the largest id is the response. Null payloads are
    empty. A null id is smaller than others; rows that all have null ids, and rows that share the largest id, are all responses.
    Payloads are compared by SHA-1 and length; a hot payload's ids are reduced before they are shuffled. Payloads that over a thousandth of
    all copies have, so a thousand at most, are broadcast: their copies lose the payload before any shuffle, and go to any task. Other
    columns aren't read. A row of any length is one record. Without rows there is no archive.
    """
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page"), F.col(f"`{url_col}`").alias("url"), payload.alias("payload"))
    rows = rows.select("page", "url", "payload", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("length"))
    first = rows.groupBy("sha1", "length").agg(F.max("page").alias("first"), F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("length") >= revisit_from))
    first = stored(first, "warc-copies")
    hot = F.col("n") * 1000 > (first.agg(F.sum("n")).first()[0] or 0)
    often = first.where(hot).select("sha1", "length", F.col("first").alias("often"))  # 1,000 rows at most, as their shares add up to one
    typed = rows.join(F.broadcast(often), ["sha1", "length"], "left")
    later = lambda first: F.when(F.col(first).isNotNull() & (F.col("page").isNull() | (F.col("page") < F.col(first))), F.col(first))
    typed = typed.withColumn("payload", F.when(later("often").isNull(), F.col("payload")))
    typed = typed.withColumn("salt", F.when(F.col("often").isNotNull(), F.pmod(F.xxhash64("page"), F.lit(1000))).otherwise(0))
    typed = typed.join(first.where(~hot).select("sha1", "length", "first", F.lit(0).alias("salt")), ["sha1", "length", "salt"], "left")
    refers = F.coalesce(later("often"), later("first"))
    typed = typed.select("page", "url", F.when(refers.isNull(), F.col("payload")).alias("payload"), "sha1", "length", refers.alias("refers_to"))

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        rest = ((row, batch) for batch in batches for row in range(batch.num_rows))
        now, number = next(rest, None), 0
        while now:
            name, records, size = f"{uri}/part-{context.partitionId():06d}-{context.taskAttemptId()}-{number:04d}.warc.gz", 0, 0
            with storage.creating(name) as out:
                while now and size < archive_bytes:
                    row, batch = now
                    page, url, body, sha1, length, to = (batch.column(i)[row].as_py() for i in range(6))
                    data = page_record(page, url, body or b"", to, length, base64.b32encode(bytes.fromhex(sha1)).decode())
                    out.write(data)
                    size, records, now = size + len(data), records + 1, next(rest, None)
            number += 1
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records], pa.int64())], ["uri", "records"])

    return stored(typed.mapInArrow(save, "uri string, records long"), "warc-archives")


def read(archives: DataFrame, *, with_payload: bool = True) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to) of the archives' records.

    A revisit's payload is null; its length and digest are those of the full payload. A damaged archive raises.
    """
    schema = "page_id long, url string" + ", payload binary" * with_payload + ", payload_bytes long, payload_digest string, record_type string, refers_to long"

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [s.split()[0] for s in schema.split(", ")]
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows: list[tuple] = []
                size = 0
                with storage.reading(name) as stream:
                    for r in Reader(stream):
                        h, revisit = r.headers, r.headers["warc-type"] == "revisit"
                        payload = None if revisit else r.payload
                        rows.append((_page(h["warc-record-id"]), h["warc-target-uri"], *[payload] * with_payload, int(h["warc-payload-length"]) if revisit else len(payload), h["warc-payload-digest"].partition(":")[2], h["warc-type"], _page(h.get("warc-refers-to"))))
                        size += len(r.block) if with_payload else 0
                        if len(rows) >= 5000 or size > 8 << 20:
                            yield _rows(rows, names)
                            rows, size = [], 0
                if rows:
                    yield _rows(rows, names)

    count = archives.count()  # a row a file
    return archives.select("uri").repartition(max(1, count), "uri").mapInArrow(load, schema)


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"page_id": pa.int64(), "payload": pa.binary(), "payload_bytes": pa.int64(), "refers_to": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), shared_dir(spark, "warc"))
    return read(archives, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _base32() -> str:
    """SQL for base32 of 40 hex digits: five of them are four characters."""
    parts = []
    for g in range(8):
        v = f"CAST('0x' || substr(h, {5 * g + 1}, 5) AS BIGINT)"
        parts += [f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(({v} >> {s}) & 31 AS INTEGER) + 1, 1)" for s in (15, 10, 5, 0)]
    return " || ".join(parts)


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT t, max(page_id) AS first FROM p GROUP BY t)
SELECT page_id, CAST(strlen(p.t) AS BIGINT) AS payload_bytes, {_base32()} AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f ON p.t = f.t
"""
