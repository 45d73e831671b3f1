import hashlib
import random
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wavegrid.llm import token_file
from wavegrid.llm.bpe import Decoder, Encoder, decode, encode, op8_bpe, vocabulary_path

from .conftest import SCHEMA, prose

PARTS = ["a", "the", "ing", "'s", "'re", "'", "!", "--", "é", "é", "ß", "İ", "Σ", "日本", "1", "23", "<|endoftext|>", "<|startoftext|>", "<|end", "😀", " ", " ", "\x1c", "́", "ation", "QU", "'ll", "...", "٣", "̸", "<", "zz", "​"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary_path())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def random_texts(n, seed=5):
    r = random.Random(seed)
    for _ in range(n):
        some = r.sample(PARTS, r.randint(1, 9))
        yield "".join(r.choice(some) for _ in range(r.randint(0, 120)))


def test_tree_concatenation_equals_the_library(library):
    e, d = Encoder(vocabulary_path(), leaf=16, memo=300), Decoder(vocabulary_path())
    for text in random_texts(1500):
        want = ids_of(library, text)
        assert e.tree(text).ids == want
        flat, begins = e.encode([None, text.encode(), b"", text.encode()])
        assert flat.tolist() == want * 2 and begins.tolist() == [0, 0, len(want), len(want), 2 * len(want)]
        assert d.decoded(pa.array([want, None, []], pa.list_(pa.int32()))).to_pylist() == [library.decode(want, skip_special_tokens=False), "", ""]


def test_long_unsplit_text(library):
    text = "unbelievable" * 700
    assert Encoder(vocabulary_path(), leaf=64).encode([text.encode()])[0].tolist() == ids_of(library, text)


@pytest.mark.parametrize("piece", [1 << 16, 50])
def test_documents(spark, docs, rows, library, piece):
    out = decode(encode(docs.withColumn("IDS", docs.doc_id), piece=piece)).collect()
    assert len(out) == len(rows)
    want = sorted((str(d), str(lang), ids_of(library, t)) for d, t, lang, *_ in rows)
    assert sorted((str(r.doc_id), str(r.lang), list(r.ids)) for r in out) == want
    for r in out:
        assert r.decoded == library.decode(list(r.ids), skip_special_tokens=False)


def test_empty(empty):
    assert decode(encode(empty)).count() == 0


@pytest.mark.parametrize("size", [24 << 20, 900])
def test_token_files(spark, docs, rows, library, tmp_path, size):
    segments = token_file.write(docs, f"file://{tmp_path}", segment_bytes=size)
    assert (segments.count() <= 2 or size == 900) and segments.agg({"docs": "sum"}).first()[0] == len(rows)
    want = sorted(((d is None, d or 0, ids_of(library, t) + [1]) for d, t, *_ in rows), key=lambda r: (r[0], r[1], b"".join(i.to_bytes(2, "little") for i in r[2])))
    every = [i for *_, ids in want for i in ids]
    start, expected = 0, []
    for none, d, ids in want:
        expected.append((str(None if none else d), start, ids))
        start += len(ids)
    out = token_file.read(segments).collect()
    key = lambda r: (r[1], r[0])
    assert sorted(((str(r.doc_id), r.start, list(r["ids"])) for r in out), key=key) == sorted(expected, key=key)
    raw = token_file.read(segments, as_binary=True).collect()
    assert sum(zlib.crc32(bytes(r["ids"])) for r in raw) == sum(zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)) for *_, ids in want)
    base = 0
    for s in segments.orderBy("segment").collect():
        f = token_file.TokenFile(s.uri)
        for i in random.Random(1).sample(range(s.tokens), min(60, s.tokens)):
            assert f.token(i) == every[base + i]
        assert f.slice(0, s.tokens).tolist() == every[base : base + s.tokens]
        with pytest.raises(IndexError):
            f.token(s.tokens)
        base += s.tokens


def test_levels_of_large_ids(tmp_path):
    w = token_file.Writer()
    import numpy as np

    ids = np.array([0, 255, 256, 65535, 65536, 2**24 + 3, 7] * 50, np.uint32)
    w.add(1, ids)
    w.add(None, np.zeros(0, np.uint32))
    w.write(f"file://{tmp_path}/x.dac")
    f = token_file.TokenFile(f"file://{tmp_path}/x.dac")
    assert f.slice(0, len(ids)).tolist() == ids.tolist() and [f.token(i) for i in range(40, 90)] == ids[40:90].tolist()
    assert f.levels == 4 and f.docs()[0] == [1, None]


def test_empty_table(spark, tmp_path):
    segments = token_file.write(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}")
    assert segments.count() == 0
    assert token_file.read(segments).count() == 0 and token_file.read(segments, as_binary=True).count() == 0


def _documents(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_the_token_file_query(spark, rows, library, tmp_path):
    rows = [r for r in rows if r[0] is not None and r[0] != 4]
    start, want = 0, []
    for d, t, *_ in sorted(rows, key=lambda r: r[0]):
        ids = ids_of(library, t) + [1]
        want.append((d, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    assert sorted(map(tuple, token_file.op2_token_file(spark, _documents(spark, rows, tmp_path)).select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == want


def test_a_hot_id_in_small_segments(spark, library, tmp_path):
    rows = [(7 if k % 3 else k, f"text {k % 5} " * (k % 9), "en", "s", 1) for k in range(120)]
    segments = token_file.write(spark.createDataFrame(rows, SCHEMA).repartition(5), f"file://{tmp_path}/t", segment_bytes=400)
    out = [(r.doc_id, r.start, list(r["ids"])) for r in token_file.read(segments).orderBy("start").collect()]
    want, start = [], 0
    for d, t, *_ in sorted(rows, key=lambda r: (r[0], r[1].encode())):
        want.append((d, start, ids_of(library, t) + [1]))
        start += len(want[-1][2])
    assert out == want and segments.count() > 4


def test_the_bpe_query(spark, rows, library, tmp_path):
    out = op8_bpe(spark, _documents(spark, rows, tmp_path)).collect()
    want = []
    for d, t, *_ in rows:
        ids = ids_of(library, t)
        text = library.decode(ids, skip_special_tokens=False)
        want.append(str((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())))
    assert sorted(want) == sorted(str((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256)) for r in out)


def test_long_texts_beside_clashing_names(spark, library):
    rows = [(k, prose(k, 300) + "x" * 500, "a", "b", k) for k in range(3)] + [(9, None, None, None, 1), (10, "short", "a", "b", 2)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("wg_row", F.col("n_chars")).withColumn("wg_row_note", F.col("lang")).withColumn("WG_part", F.col("doc_id")).withColumn("IDS", F.col("lang"))
    out = encode(docs, piece=700)
    assert out.columns == [c for c in docs.columns if c != "IDS"] + ["ids"]
    for r in out.collect():
        (want,) = [x for x in rows if x[0] == r.doc_id]
        assert (r.text, r.wg_row, r.wg_row_note, r.WG_part) == (want[1], want[4], want[2], want[0]) and list(r["ids"] or []) == ids_of(library, want[1])
