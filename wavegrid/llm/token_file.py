"""Token ids in files of directly addressable codes.

An id is split into chunks of eight bits. Level 0 holds the lowest chunk of every id; a bitmap says which ids go on, and the
next level holds their next chunks. A rank directory over each bitmap gives the place of an id's next chunk, so any token is
read with one byte and one rank a level, without decoding others.

File: magic, length of the header, header (JSON: counts and where each section stands), then for each level its chunks, its
bitmap (words of 64 bits) and the directory (set bits before each word, 32 bits after a 64-bit base for every 2^16 words), and
the documents' ids, first tokens and null marks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from wavegrid.llm import storage
from wavegrid.llm.bpe import encoder, vocabulary_path
from wavegrid.llm.common import chunks_of, shared_dir, small_batches, stored, trimmed, utf8

MAGIC = b"WGDAC001"
_GROUP = 1 << 16
#: Ranges of ids, each a task's. Spark samples 300 rows a range, some 100 bytes each, on the driver, so they are bounded; segments aren't.
MOST_RANGES = 8_192


class Writer:
    """Collects the documents of one segment in order, then writes them."""

    def __init__(self):
        self.ids: list[np.ndarray] = []
        self.docs: list[int | None] = []

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc)
        self.ids.append(ids)

    def write(self, uri: str) -> None:
        sections: dict[str, tuple[int, int]] = {}
        blobs: list[bytes] = []
        at = 0

        def put(name: str, data: bytes) -> None:
            nonlocal at
            sections[name] = (at, len(data))
            blobs.append(data)
            at += len(data)

        counts = np.array([len(i) for i in self.ids], np.int64)
        rest, level = np.concatenate([*self.ids, np.zeros(0, np.uint16)]), 0
        while level == 0 or len(rest):
            more = rest > 0xFF
            put(f"chunks{level}", (rest & 0xFF).astype(np.uint8).tobytes())
            words = np.packbits(np.concatenate((more, np.zeros(-len(more) % 64, bool))), bitorder="little").view("<u8")
            put(f"bitmap{level}", words.tobytes())
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))[: len(words)]
            bases = before[::_GROUP]
            put(f"base{level}", bases.astype("<i8").tobytes())
            put(f"rank{level}", (before - np.repeat(bases, _GROUP)[: len(before)]).astype("<u4").tobytes())
            rest, level = rest[more] >> 8, level + 1
        put("docs", np.array([0 if d is None else d for d in self.docs], "<i8").tobytes())
        put("nulls", np.array([d is None for d in self.docs], np.uint8).tobytes())
        put("first", np.concatenate(([0], np.cumsum(counts))).astype("<i8").tobytes())
        head = json.dumps({"tokens": int(counts.sum()), "docs": len(self.docs), "levels": level, "sections": sections}).encode()
        with storage.creating(uri) as out:
            out.write(MAGIC + len(head).to_bytes(8, "little") + head)
            for b in blobs:
                out.write(b)


class TokenFile:
    """Random access by token and by document; reads only the bytes that it needs."""

    def __init__(self, uri: str):
        self.file = storage.seekable(uri)
        if self.file.read(8) != MAGIC:
            raise ValueError(f"{uri} is no token file")
        n = int.from_bytes(self.file.read(8), "little")
        self.head = json.loads(self.file.read(n))
        self.start = 16 + n
        self.tokens, self.levels = self.head["tokens"], self.head["levels"]

    def close(self) -> None:
        self.file.close()

    def section(self, name: str, at: int = 0, size: int | None = None) -> bytes:
        begin, length = self.head["sections"][name]
        self.file.seek(self.start + begin + at)
        return self.file.read(length - at if size is None else size)

    def _numbers(self, name: str, kind: str, at: int, count: int) -> np.ndarray:
        width = np.dtype(kind).itemsize
        return np.frombuffer(self.section(name, at * width, count * width), kind)

    def rank(self, level: int, at: int) -> int:
        """How many ids of the level before this one go on."""
        if at == 0:
            return 0
        word, bit = divmod(at, 64)
        if word * 64 >= self.length(level):
            word, bit = word - 1, bit + 64
        base = int(self._numbers(f"base{level}", "<i8", word // _GROUP, 1)[0]) + int(self._numbers(f"rank{level}", "<u4", word, 1)[0])
        return base + (int(self._numbers(f"bitmap{level}", "<u8", word, 1)[0]) & ((1 << bit) - 1)).bit_count()

    def length(self, level: int) -> int:
        return self.head["sections"][f"chunks{level}"][1]

    def token(self, i: int) -> int:
        if not 0 <= i < self.tokens:
            raise IndexError(i)
        return int(self.slice(i, i + 1)[0])

    def slice(self, begin: int, end: int) -> np.ndarray:
        """The ids of tokens [begin, end)."""
        ids = np.zeros(end - begin, np.uint32)
        which, low, high = np.arange(end - begin), begin, end
        for level in range(self.levels):
            if high <= low:
                break
            ids[which] |= np.frombuffer(self.section(f"chunks{level}", low, high - low), np.uint8).astype(np.uint32) << np.uint32(8 * level)
            first = low // 64
            words = self._numbers(f"bitmap{level}", "<u8", first, -(-high // 64) - first)
            more = np.unpackbits(words.view(np.uint8), bitorder="little")[low - 64 * first : high - 64 * first].astype(bool)
            which = which[more]
            low = self.rank(level, low)
            high = low + len(which)
        return ids

    def docs(self) -> tuple[list[int | None], np.ndarray]:
        """The documents' ids, and for each its first token, then the count of all."""
        ids = np.frombuffer(self.section("docs"), "<i8").tolist()
        nulls = np.frombuffer(self.section("nulls"), np.uint8).tolist()
        return [None if n else d for d, n in zip(ids, nulls, strict=True)], np.frombuffer(self.section("first"), "<i8")


def write(docs: DataFrame, uri: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, path: str | None = None, segment_bytes: int = 24 << 20) -> DataFrame:
    """Writes the texts' ids, each with end_id after it, as segment files in ascending order of ids; returns (segment, uri, docs, tokens), stored.

    Rows are dealt by ranges of ids, sorted, and encoded in that order; a segment ends when it has segment_bytes of text or its range
    does, whatever the ranges turn out to be. Null texts are empty. Rows with a null id come last, and rows with equal ids in the order of their texts, so the ids
    of all segments in a row don't depend on how docs is partitioned. Other columns aren't read. Without rows there is no segment.
    """
    path = path or vocabulary_path()
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, min(MOST_RANGES, -(-2 * size // segment_bytes)))

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, part = encoder(path, memo=300_000), TaskContext.get().partitionId()
        writer, size, number = Writer(), 0, 0

        def done() -> pa.RecordBatch:
            name = f"{uri}/segment-{part:08d}-{number:05d}.dac"
            writer.write(name)
            return pa.RecordBatch.from_arrays([pa.array([part << 20 | number], pa.int64()), pa.array([name]), pa.array([len(writer.docs)], pa.int64()), pa.array([sum(map(len, writer.ids))], pa.int64())], ["segment", "uri", "docs", "tokens"])

        for table in chunks_of(batches, "text", min(4 << 20, segment_bytes)):
            if size and size + table.nbytes > segment_bytes:
                yield done()
                writer, size, number = Writer(), 0, number + 1
            flat, begins = e.encode(utf8(table.column("text")))
            flat = np.insert(flat, begins[1:], end_id)
            flat = flat.astype("<u2" if flat.max(initial=0) < 1 << 16 else "<u4")
            begins = begins + np.arange(len(begins))
            for doc, a, b in zip(table.column("doc").to_pylist(), begins[:-1].tolist(), begins[1:].tolist(), strict=True):
                writer.add(doc, flat[a:b])
            size += table.nbytes
        if writer.docs:
            yield done()

    doc = F.col("doc").asc_nulls_last()
    rows = rows.repartitionByRange(n, doc, F.left("text", F.lit(24)).asc_nulls_first()).sortWithinPartitions(doc, F.col("text").asc_nulls_first())
    return stored(rows.mapInArrow(trimmed(save, "bpe"), "segment long, uri string, docs long, tokens long"), "token-segments")


def _before(segments: DataFrame) -> DataFrame:
    """segments with base: the tokens of all segments before. Sums of groups of 1,024 ranges first, then within each group."""
    rows = segments.withColumn("group", F.shiftright("segment", 30))
    groups = rows.groupBy("group").agg(F.sum("tokens").alias("all"))
    groups = groups.select("group", (F.sum("all").over(Window.orderBy("group")) - F.col("all")).alias("first"))
    within = F.sum("tokens").over(Window.partitionBy("group").orderBy("segment")) - F.col("tokens")
    return rows.withColumn("within", within).join(groups, "group").select("segment", "uri", (F.col("first") + F.col("within")).alias("base"))


def read(segments: DataFrame, *, as_binary: bool = False) -> DataFrame:
    """(doc_id, start, ids) of the documents in the segments' files, in their order; start counts the ids of all documents before.

    ids is an array of int, or with as_binary the ids as little-endian unsigned 32-bit integers. Without segments there are no rows.
    """
    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                f = TokenFile(name)
                docs, first = f.docs()
                begin = 0
                while begin < len(docs):
                    end = max(begin + 1, int(np.searchsorted(first, first[begin] + (1 << 19))) - 1)
                    ids = f.slice(int(first[begin]), int(first[end]))
                    offsets = (first[begin : end + 1] - first[begin]).astype(np.int32)
                    if as_binary:
                        column = pa.Array.from_buffers(pa.binary(), end - begin, [None, pa.py_buffer(offsets * np.int32(4)), pa.py_buffer(ids.astype("<u4"))])
                    else:
                        column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([pa.array(docs[begin:end], pa.int64()), pa.array(first[begin:end] + base), column], ["doc_id", "start", "ids"])
                    begin = end
                f.close()

    kind = "binary" if as_binary else "array<int>"
    return _before(segments).repartition(max(1, segments.count()), "segment").mapInArrow(trimmed(load), f"doc_id long, start long, ids {kind}")


def op2_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    tokens = read(write(docs, shared_dir(spark, "tokens")), as_binary=True)
    return tokens.select("doc_id", "start", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
