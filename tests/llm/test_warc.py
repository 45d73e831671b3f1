import base64
import gzip
import hashlib
import io

import pytest

from wavegrid.llm.warc import Reader, digest, op3_warc, page_record, read, write

PAGES = [(1, "http://a/é", "<p>x</p>"), (2, "http://b", "<p>x</p>"), (3, None, ""), (4, "u", None), (5, "u", "Ωmega" * 9000), (6, "u", "one"), (7, "u", "WARC/1.1\r\n\r\n"), (7, "u", "WARC/1.1\r\n\r\n"), (None, "u", "one"), (None, "u", "alone")]
SCHEMA = "page_id long, url string, html string"


@pytest.mark.parametrize("least,size", [(0, 64 << 20), (4, 300)])
def test_round_trip(spark, tmp_path, least, size):
    pages = spark.createDataFrame(PAGES, SCHEMA).repartition(2)
    archives = write(pages, f"file://{tmp_path}/w", revisit_from=least, archive_bytes=size)
    out = read(archives).collect()
    groups = {}
    for p, _, h in PAGES:
        groups.setdefault((h or "").encode(), []).append(p)
    want = []
    for p, _, h in PAGES:
        b = (h or "").encode()
        top = max((x for x in groups[b] if x is not None), default=None)
        revisits = len(b) >= least and len(groups[b]) > 1 and top is not None and p != top
        want.append((str(p), len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisits else "response", str(top if revisits else None), None if revisits else b))
    assert sorted(map(str, want)) == sorted(str((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to), None if r.payload is None else bytes(r.payload))) for r in out)
    assert archives.agg({"records": "sum"}).first()[0] == len(PAGES)


def test_each_record_is_a_member():
    data = page_record(1, "u", b"abc", None, 3, digest(b"abc")) + page_record(2, "u", b"", 1, 3, digest(b"abc"))
    text = gzip.decompress(data)
    assert text.count(b"WARC/1.1") == 2 and b"WARC-Refers-To: <urn:page:1>" in text
    for chunk in (1, 7, 1 << 18):
        assert [r.payload for r in Reader(io.BytesIO(data), chunk)] == [b"abc", b""]


def test_damage_is_found():
    good = page_record(1, "u", b"abc" * 50, None, 150, digest(b"abc" * 50))
    wrong = page_record(1, "u", b"abd" * 50, None, 150, digest(b"abc" * 50))
    text = gzip.decompress(good)
    short = gzip.compress(text.replace(b"Content-Length: 2", b"Content-Length: 1", 1))
    headless = gzip.compress(b"WARC/1.1\r\nContent-Length: 0\r\n")
    for bad in (good[:-9], wrong, short, headless, gzip.compress(b"hello\r\n\r\n"), good[:20] + b"\0\0\0\0" + good[24:]):
        with pytest.raises(ValueError):
            list(Reader(io.BytesIO(bad)))


def test_empty(spark, tmp_path):
    assert read(write(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/w")).count() == 0
    assert read(write(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/x"), with_payload=False).count() == 0


def test_hot_payloads_long_ones_and_other_columns(spark, tmp_path):
    """Copies by the hundred beside few, a payload of megabytes, and columns named like those that are used inside."""
    hot = "<p>hot</p>" * 50
    rows = [(k, f"http://h/{k}", hot if k % 3 else f"page {k // 6}") for k in range(1500)] + [(2000, "u", "long " * 700_000), (2001, "u", "long " * 700_000)]
    pages = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for name in ("sha1", "first", "salt", "page", "often", "payload_digest"):
        pages = pages.withColumn(name, pages.url)
    out = {r.page_id: r for r in read(write(pages, f"file://{tmp_path}/w"), with_payload=False).collect()}
    top = {}
    for p, _, h in rows:
        top[h] = max(p, top.get(h, p))
    assert len(out) == len(rows)
    for p, _, h in rows:
        r = out[p]
        assert (r.record_type, r.refers_to, r.payload_bytes) == (("response", None, len(h)) if p == top[h] else ("revisit", top[h], len(h)))
        assert r.payload_digest == digest(h.encode())


def test_the_query(spark, tmp_path):
    rows = [r for r in PAGES if r[0] not in (7, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/pages.parquet")
    out = sorted(map(tuple, op3_warc(spark, str(tmp_path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()))
    top = {}
    for p, _, h in rows:
        top[h or ""] = max(p, top.get(h or "", p))
    want = [(p, len((h or "").encode()), digest((h or "").encode()), "response" if top[h or ""] == p else "revisit", None if top[h or ""] == p else top[h or ""]) for p, _, h in rows]
    assert out == sorted(want)
