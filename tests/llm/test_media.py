import gzip
import hashlib
import io
import json
import struct
import time
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from wavegrid.llm import media

from .conftest import SCHEMA


def png():
    chunk = lambda n, b: struct.pack(">I", len(b)) + n + b + struct.pack(">I", zlib.crc32(n + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def zipped():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a", "b" * 30)
    return out.getvalue()


GIF = b"GIF89a\1\0\1\0\x80\0\0\0\0\0\xff\xff\xff!\xf9\4\0\0\0\0\0,\0\0\0\0\1\0\1\0\0\2\2D\1\0;"
JPEG = b"\xff\xd8\xff\xe0\0\4ab\xff\xc0\0\3\1\xff\xda\0\3\1\x12\xff\x00\x34\xff\xd9"
BMP = b"BM" + struct.pack("<IIIIII", 58, 0, 54, 40, 1, 1) + bytes(32)
OGG = b"OggS\0\2" + bytes(8) + b"abcd" + bytes(8) + b"\1\3xyz" + b"OggS\0\4" + bytes(8) + b"abcd" + bytes(8) + b"\1\2xy"
AIFF = b"FORM" + struct.pack(">I", 4 + 26 + 16) + b"AIFFCOMM" + struct.pack(">I", 18) + bytes(18) + b"SSND" + struct.pack(">I", 8) + bytes(8)
PDF = b"%PDF-1.4\n1 0 obj\nstartxref\n9\n%%EOF"
GOOD = [("audio/wav", media.wav(b"ab" * 32)), ("image/png", png()), ("image/gif", GIF), ("image/jpeg", JPEG), ("image/bmp", BMP), ("application/gzip", gzip.compress(b"x" * 99)), ("application/zip", zipped()), ("audio/ogg", OGG), ("audio/aiff", AIFF), ("application/pdf", PDF)]


@pytest.mark.parametrize("kind,data", GOOD)
def test_each_format(kind, data):
    assert media.sniff(data)[:2] == (kind, len(data))
    assert media.sniff(b"text " + data + b" more")[2] == [(5, len(data), kind)]
    assert media.sniff(data[: len(data) // 2])[0] is None
    assert media.sniff(data[:4] + b"nothing of the kind") == (None, 0, [])


def test_outermost_only():
    inner = media.wav(png() + bytes(len(png()) % 2))
    assert [e[2] for e in media.sniff(b"-" + inner + GIF)[2]] == ["audio/wav", "image/gif"]
    assert [e[2] for e in media.sniff(inner)[2]] == ["image/png"]


def test_columns(spark):
    rows = [(1, "image/png", b"junk" + png()), (2, "image/gif", png()), (3, None, GIF), (4, "image/gif", GIF), (5, "x", None), (6, "x", b"")]
    df = spark.createDataFrame(rows, "id int, declared string, media binary").selectExpr("*", "id as detected")
    out = media.sniffed(df)
    assert {r.id: (r.detected, r.corrected) for r in out.collect()} == {1: (None, False), 2: ("image/png", True), 3: ("image/gif", True), 4: ("image/gif", False), 5: (None, False), 6: (None, False)}
    (r,) = media.carved(out).collect()
    assert (r.id, r.carved_type, bytes(r.carved)) == (1, "image/png", png())


def test_documents(spark, docs, rows, empty):
    out = media.features(media.sniffed(media.stored_media(docs.select("doc_id", "text")))).collect()
    want = []
    for d, t, *_ in rows:
        b = (t or "").encode()
        p = b + bytes((-len(b)) % 64 if b else 64)
        w = media.wav(p)
        want.append((str(d), len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(w), hashlib.sha256(w).hexdigest()))
    assert sorted(want) == sorted((str(r.doc_id), *r[1:7]) for r in out)
    assert all(json.loads(r.feature)["type"] == "audio/wav" for r in out)
    assert media.wav_payload(media.wav(b"xy")) == b"xy"
    assert media.features(media.sniffed(media.stored_media(spark.createDataFrame([], SCHEMA).select("doc_id", "text")))).count() == 0


def test_the_query(spark, rows, tmp_path):
    """All columns, the line of features included."""
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for d, t, *_ in rows:
        b = (t or "").encode()
        p = b + bytes((-len(b)) % 64 if b else 64)
        w = media.wav(p)
        high = [x >= 128 for x in p]
        line = {"type": "audio/wav", "declared": "application/octet-stream", "corrected": True, "samples": len(p), "low": min(p), "high": max(p), "sum": sum(p), "crossings": sum(x != y for x, y in zip(high, high[1:])), "embedded": []}
        want.append(str((d, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(w), hashlib.sha256(w).hexdigest(), json.dumps(line))))
    assert sorted(want) == sorted(str(tuple(r)) for r in media.op4_media_sniff(spark, str(tmp_path)).collect())


def test_many_beginnings_without_an_end():
    """Time grows with the text, not with its square."""
    for part in (b"%PDF-1.4 ", b"PK\3\4 PK\5\6" + bytes(18), b"\xff\xd8\xff\xda\0\2ab", b"%PDF-1 startxref x "):
        began = time.perf_counter()
        assert media.sniff(b"-" + part * 60_000) == (None, 0, [])
        assert time.perf_counter() - began < 5
    two = b"-" + PDF + b"--" + PDF + zipped() + zipped()
    assert [e[1:] for e in media.sniff(two)[2]] == [(len(PDF), "application/pdf")] * 2 + [(len(zipped()), "application/zip")] * 2


def test_other_columns_and_ids(spark):
    rows = [("x", "text", "1"), ("y", None, "2"), (None, "", "3")]
    df = spark.createDataFrame(rows, "name string, text string, doc_id string").withColumn("media", F.lit("a")).withColumn("Declared", F.lit("b"))
    out = media.features(media.sniffed(media.stored_media(df)), id_col="name")
    assert out.columns[0] == "name" and sorted(str((r.name, r.n_bytes)) for r in out.select(F.col("name"), "n_bytes").collect()) == sorted(str((n, len(t or ""))) for n, t, _ in rows)
