"""Media columns: what bytes are, by signature, and what media they hold inside.

One Aho-Corasick pass finds every magic number of every format. A format's validator then walks its structure from there
(chunks, pages, segments, checksums) and gives the length; a magic number without that structure is nothing. What begins at
the first byte corrects the declared type, and what is found further in can be carved.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from wavegrid.llm.common import extended, schema_with, small_batches, stored, trimmed, utf8, without


def _wav(b: memoryview) -> int | None:
    """RIFF/WAVE: a fmt chunk and then data, all within the stated size."""
    if len(b) < 44 or bytes(b[8:12]) != b"WAVE":
        return None
    end = 8 + struct.unpack_from("<I", b, 4)[0]
    at, seen = 12, []
    while at + 8 <= end <= len(b):
        name, size = bytes(b[at : at + 4]), struct.unpack_from("<I", b, at + 4)[0]
        if at + 8 + size > end or (name == b"fmt " and size < 16) or (name == b"data" and b"fmt " not in seen):
            return None
        seen.append(name)
        at += 8 + size + size % 2
    return end if end <= len(b) and b"data" in seen and at in (end, end + 1) else None


def _png(b: memoryview) -> int | None:
    """Chunks with right checksums, from IHDR to IEND."""
    at = 8
    while at + 12 <= len(b):
        size, name = struct.unpack_from(">I4s", b, at)
        if at + 12 + size > len(b) or (at == 8) != (name == b"IHDR") or zlib.crc32(b[at + 4 : at + 8 + size]) != struct.unpack_from(">I", b, at + 8 + size)[0]:
            return None
        at += 12 + size
        if name == b"IEND":
            return at
    return None


def _gif(b: memoryview) -> int | None:
    """Colour tables and blocks up to the trailer; one image at least."""

    def blocks(at: int) -> int:
        while at < len(b) and b[at]:
            at += 1 + b[at]
        return at + 1

    if len(b) < 14:
        return None
    at, images = 13 + (3 << (b[10] & 7) + 1 if b[10] & 0x80 else 0), 0
    while at < len(b):
        if b[at] == 0x3B:
            return at + 1 if images else None
        if b[at] == 0x21:
            at = blocks(at + 2)
        elif b[at] == 0x2C and at + 10 < len(b):
            images += 1
            at = blocks(at + 11 + (3 << (b[at + 9] & 7) + 1 if b[at + 9] & 0x80 else 0))
        else:
            return None
    return None


def _jpeg(b: memoryview) -> int | None:
    """Segments by their lengths, scans up to the next marker, and an end marker; one frame and one scan at least."""
    at, frame, scan = 2, False, False
    while at + 4 <= len(b):
        if b[at] != 0xFF:
            return None
        kind = b[at + 1]
        if kind == 0xD9:
            return at + 2 if frame and scan else None
        if kind == 0xFF:
            at += 1
            continue
        if kind == 1 or 0xD0 <= kind <= 0xD8:
            return None
        frame |= 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC)
        at += 2 + struct.unpack_from(">H", b, at + 2)[0]
        if kind == 0xDA:
            scan, data = True, b.obj
            before = len(data) - len(b)  # b is the end of data, which isn't copied
            i = data.find(b"\xff", before + at)
            while i >= 0 and i + 1 < len(data) and (data[i + 1] == 0 or 0xD0 <= data[i + 1] <= 0xD7):
                i = data.find(b"\xff", i + 2)
            if i < 0:
                return None
            at = i - before
    return at + 2 if frame and scan and at + 2 == len(b) and bytes(b[at:]) == b"\xff\xd9" else None


def _bmp(b: memoryview) -> int | None:
    """A header of a known size, pixels within the stated size."""
    if len(b) < 26:
        return None
    size, zero, pixels, header = struct.unpack_from("<IIII", b, 2)
    if zero or header not in (12, 40, 52, 56, 64, 108, 124) or not 14 + header <= pixels < size <= len(b):
        return None
    return size


def _gzip(b: memoryview) -> int | None:
    """A whole member with right checksum and length."""
    z, at = zlib.decompressobj(31), 0
    try:
        while at < len(b) and not z.eof:
            piece = z.unconsumed_tail or bytes(b[at : at + 65536])
            at += 0 if z.unconsumed_tail else len(piece)
            z.decompress(piece, 1 << 20)
    except zlib.error:
        return None
    return at - len(z.unused_data) if z.eof else None


class _Marks:
    """Places in some bytes that media end by, each found once however many media may begin before them."""

    def __init__(self, data: bytes):
        self.data = data
        self.found: dict[bytes, list[int]] = {}

    def places(self, mark: bytes) -> list[int]:
        if mark not in self.found:
            places, at = [], self.data.find(mark)
            while at >= 0:
                places.append(at)
                at = self.data.find(mark, at + 1)
            self.found[mark] = places
        return self.found[mark]

    def next(self, mark: bytes, at: int) -> int | None:
        places = self.places(mark)
        i = bisect_left(places, at)
        return places[i] if i < len(places) else None

    @cached_property
    def archives(self) -> dict[int, int]:
        """Where archives begin, by the first end record that says so and whose central directory begins with an entry, and where they end."""
        found: dict[int, int] = {}
        for at in self.places(b"PK\5\6"):
            if at + 22 <= len(self.data):
                size, start, comment = struct.unpack_from("<IIH", self.data, at + 12)
                begin = at - size - start
                if begin >= 0 and self.data[begin + start : begin + start + 4] == b"PK\1\2" and at + 22 + comment <= len(self.data):
                    found.setdefault(begin, at + 22 + comment)
        return found


def _zip(marks: _Marks, at: int) -> int | None:
    """The first end record whose central directory stands where it says and begins with an entry."""
    end = marks.archives.get(at)
    return None if end is None else end - at


def _ogg(b: memoryview) -> int | None:
    """Pages of one stream, from its first to its last."""
    at, serial = 0, None
    while at + 27 <= len(b) and bytes(b[at : at + 5]) == b"OggS\0":
        flags, number, segments = b[at + 5], struct.unpack_from("<I", b, at + 14)[0], b[at + 26]
        if (serial is None) != bool(flags & 2) or serial not in (None, number) or at + 27 + segments > len(b):
            return None
        serial = number
        at += 27 + segments + sum(b[at + 27 : at + 27 + segments])
        if at > len(b):
            return None
        if flags & 4:
            return at
    return None


def _aiff(b: memoryview) -> int | None:
    """FORM/AIFF or AIFC: chunks that fill the stated size; COMM and SSND are there."""
    if len(b) < 12 or bytes(b[8:12]) not in (b"AIFF", b"AIFC"):
        return None
    end, at, seen = 8 + struct.unpack_from(">I", b, 4)[0], 12, set()
    while at + 8 <= end <= len(b):
        name, size = struct.unpack_from(">4sI", b, at)
        seen.add(name)
        at += 8 + size + size % 2
    return end if end <= len(b) and at in (end, end + 1) and {b"COMM", b"SSND"} <= seen else None


def _pdf(marks: _Marks, at: int) -> int | None:
    """A version, a cross-reference's place (of 64 bytes at most) and the end mark after it."""
    place = marks.next(b"startxref", at)
    end = None if place is None else marks.next(b"%%EOF", place)
    if end is None or end - place > 9 + 64 or not marks.data[at + 5 : at + 6].isdigit() or not marks.data[place + 9 : end].strip().isdigit():
        return None
    return end + 5 - at


#: Fixed values of the formats: magic number, type, validator. Longer magic numbers come first at one place.
SIGNATURES: list[tuple[bytes, str, Callable]] = [
    (b"RIFF", "audio/wav", _wav), (b"\x89PNG\r\n\x1a\n", "image/png", _png), (b"GIF87a", "image/gif", _gif), (b"GIF89a", "image/gif", _gif),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg), (b"BM", "image/bmp", _bmp), (b"\x1f\x8b\x08", "application/gzip", _gzip), (b"PK\3\4", "application/zip", _zip),
    (b"OggS", "audio/ogg", _ogg), (b"FORM", "audio/aiff", _aiff), (b"%PDF-", "application/pdf", _pdf),
]
#: Validators that look for an end; the others walk over what they are given.
_BY_END = (_zip, _pdf)
_AUTOMATON = None


def _automaton():
    global _AUTOMATON
    if _AUTOMATON is None:
        import ahocorasick

        _AUTOMATON = ahocorasick.Automaton()
        for i, (magic, _, _) in enumerate(SIGNATURES):
            _AUTOMATON.add_word(magic.decode("latin-1"), i)
        _AUTOMATON.make_automaton()
    return _AUTOMATON


def sniff(data: bytes) -> tuple[str | None, int, list[tuple[int, int, str]]]:
    """The type of what begins at the first byte and its length, and (offset, length, type) of outermost media further in.

    Without a type the length is 0. Media inside carved media aren't listed; those inside the whole are.
    """
    view, marks = memoryview(data), _Marks(data)
    kind, length, inside, after = None, 0, [], 0
    for last, i in _automaton().iter(data.decode("latin-1")):
        magic, name, validate = SIGNATURES[i]
        at = last - len(magic) + 1
        if at and at < after:
            continue
        if n := validate(marks, at) if validate in _BY_END else validate(view[at:]):
            if at:
                inside.append((at, n, name))
                after = at + n
            else:
                kind, length = name, n
    return kind, length, inside


def sniffed(df: DataFrame, *, media_col: str = "media", declared_col: str = "declared") -> DataFrame:
    """df with detected (type or null), media_length, corrected (detected differs from declared) and embedded (offset, length, type).

    A null or empty value is of no type; a null declared type is corrected by any. Columns named like a result are replaced.
    """
    names = ["detected", "media_length", "corrected", "embedded"]
    df = without(df, names)
    found = pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                table = pa.Table.from_batches([batch.slice(begin, 500)])
                rows = [sniff(x or b"") for x in utf8(table.column(media_col))]
                declared = table.column(declared_col).to_pylist()
                yield from extended(table, {
                    "detected": pa.array([r[0] for r in rows], pa.string()), "media_length": pa.array([r[1] for r in rows], pa.int64()),
                    "corrected": pa.array([r[0] is not None and r[0] != d for r, d in zip(rows, declared, strict=True)], pa.bool_()),
                    "embedded": pa.array([[dict(zip(("offset", "length", "type"), e, strict=True)) for e in r[2]] for r in rows], pa.list_(found)),
                })

    entry = T.StructType([T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()), T.StructField("type", T.StringType())])
    kinds = [T.StringType(), T.LongType(), T.BooleanType(), T.ArrayType(entry)]
    return df.mapInArrow(trimmed(run), schema_with(df, [T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]))


def carved(df: DataFrame, *, media_col: str = "media") -> DataFrame:
    """A row for each embedded medium of a sniffed df: df's other columns, and carved_type and carved (its bytes)."""
    e = F.explode("embedded").alias("e")
    rows = df.select("*", e)
    return rows.select(
        *[F.col(f"`{c}`") for c in df.columns if c not in (media_col, "embedded")], F.col("e.type").alias("carved_type"),
        F.substring(F.col(f"`{media_col}`"), (F.col("e.offset") + 1).cast("int"), F.col("e.length").cast("int")).alias("carved"),
    )


def wav(payload: bytes, rate: int = 8000) -> bytes:
    """Payload as one channel of unsigned 8-bit samples; of an even number of bytes."""
    return b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload


def wav_payload(data: bytes) -> bytes:
    """The data chunk of what _wav accepts."""
    at = 12
    while True:
        name, size = struct.unpack_from("<4sI", data, at)
        if name == b"data":
            return data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2


def stored_media(docs: DataFrame, *, text_col: str = "text", unit: int = 64) -> DataFrame:
    """docs' other columns with n_bytes, declared and media, written to the shared folder: each whole text (null: empty) as UTF-8 with
    bytes 0 up to a positive multiple of unit, in a WAV file that is declared as plain bytes."""
    small_batches(docs.sparkSession)
    docs = without(docs, ["n_bytes", "declared", "media"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                table = pa.Table.from_batches([batch.slice(begin, 500)])
                texts = [t or b"" for t in utf8(table.column(text_col))]
                media = [wav(t + bytes(-len(t) % unit or (0 if t else unit))) for t in texts]
                more = {"n_bytes": pa.array([len(t) for t in texts], pa.int64()), "declared": pa.array(["application/octet-stream"] * len(texts)), "media": pa.array(media, pa.binary())}
                yield from extended(table.drop_columns([text_col]), more)

    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("declared", T.StringType()), T.StructField("media", T.BinaryType())]
    return stored(docs.mapInArrow(trimmed(run), schema_with(without(docs, [text_col]), fields)), "media")


def features(df: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Of sniffed stored_media(): the id, payload and stored digests, the last 64 samples' checksum, and a line of features; other columns are left out.

    Every row of stored_media() has a payload, so there are no nulls but in the id. Repeated rows have a row each. Anything but one WAV file raises.
    """
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [T.LongType(), T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType(), T.StringType()]
    held = ["n_bytes", "declared", "detected", "media_length", "corrected", "embedded", "media"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in (dict(zip(held, x, strict=True)) for x in zip(*(batch.column(1 + i).to_pylist() for i in range(len(held))), strict=True)):
                media = r["media"]
                if r["detected"] != "audio/wav" or r["media_length"] != len(media):
                    raise ValueError("what was stored isn't one WAV file")
                payload = wav_payload(media)
                samples = np.frombuffer(payload, np.uint8)
                line = {"type": r["detected"], "declared": r["declared"], "corrected": r["corrected"], "samples": len(samples), "low": int(samples.min()), "high": int(samples.max()), "sum": int(samples.sum(dtype=np.int64)), "crossings": int(np.count_nonzero(np.diff((samples >= 128).astype(np.int8)))), "embedded": [[e["offset"], e["length"], e["type"]] for e in r["embedded"]]}
                rows.append((r["n_bytes"], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), json.dumps(line)))
            arrow = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(arrow))], [id_col, *names])

    schema = T.StructType([df.schema[id_col], *(T.StructField(n, k) for n, k in zip(names, kinds, strict=True))])
    return df.select(F.col(f"`{id_col}`"), *held).mapInArrow(trimmed(run), schema)


def op4_media_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return features(sniffed(stored_media(docs)))
