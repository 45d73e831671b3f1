import hashlib

import pytest

from wavegrid.llm.common import pack, unpack
from wavegrid.llm.substring_dedup import Index, dedup_substrings, op7_substring_dedup

import numpy as np

from .conftest import SCHEMA, SHARED, prose


def brute(rows, window=13):
    """Kept words by row; a row's place stands for it."""
    split = [(d, (t or "").encode().split()) for d, t, *_ in rows]
    first = {}
    for d, w in split:
        if d is not None:
            for i in range(len(w) - window + 1):
                k = tuple(w[i : i + window])
                first[k] = min(d, first.get(k, d))
    out = []
    for d, w in split:
        gone = set()
        if d is not None:
            for i in range(len(w) - window + 1):
                if first[tuple(w[i : i + window])] < d:
                    gone.update(range(i, i + window))
        out.append((str(d), len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out)


def result(df):
    return sorted((str(r.doc_id), r.n_words, r.n_removed, " ".join((r.clean_text or "").split())) for r in df.collect())


@pytest.mark.parametrize("options", [{}, {"batches": 1, "block_bytes": 2000, "bucket_bytes": 3000}, {"batches": 4, "block_bytes": 1500, "bucket_bytes": 20000, "hash_bits": 12}])
def test_brute_force(docs, rows, options):
    """The last one makes most hashes collide."""
    assert result(dedup_substrings(docs, **options)) == brute(rows)


def test_next_calls_see_earlier_ones(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    for k in range(5):
        rows = [(100 - k, prose(k, 30) + " " + SHARED, "en", "s", 1)]
        (r,) = dedup_substrings(spark.createDataFrame(rows, SCHEMA), index_path=path, batches=1).collect()
        assert (r.n_removed > 50) == (k > 0) and r.clean_text.startswith(prose(k, 10))
    index = Index.opened(path)
    sizes = [n for _, n in index.runs]
    assert len(sizes) < 5 and all(a > 2 * b for a, b in zip(sizes, sizes[1:]))


@pytest.mark.parametrize("options", [{}, {"hash_bits": 6}])
def test_an_index_that_grows(spark, tmp_path, options):
    """Batch by batch: buckets are split, colliding texts of earlier batches are remembered, and a lost file raises."""
    path = f"file://{tmp_path}/index"
    seen = []
    for k in range(4):
        rows = [(1000 * (3 - k) + d, prose((7 * k + d) % 19, 40) + " " + prose(200 + d % 2, 30), "en", "s", 1) for d in range(6 if k else 2)]
        found = dedup_substrings(spark.createDataFrame(rows, SCHEMA), index_path=path, batches=1 + k % 2, block_bytes=500, bucket_bytes=1200, **options)
        # earlier calls' documents come first, whatever their ids
        moved = [(d + 10_000 * (k + 1), *r) for d, *r in rows]
        want = [(str(int(d) - 10_000 * (k + 1)), *r) for d, *r in brute(seen + moved) if int(d) >= 10_000 * (k + 1)]
        assert result(found) == sorted(want)
        seen += moved
    index = Index.opened(path)
    entries = sum(n for _, n in index.runs)
    assert entries <= index.buckets * 300 and (index.buckets > 3 or options)
    assert bool(index.collisions) == bool(options)
    last = f"{index.buckets - 1:08d}"
    (tmp_path / "index/runs" / index.runs[0][0] / last).unlink()
    with pytest.raises(Exception, match=last):
        dedup_substrings(spark.createDataFrame(rows, SCHEMA), index_path=path).count()


def test_one_document_with_two_texts_of_one_hash(spark):
    """The least document's other text is no copy, and later copies of it are found."""
    rows = [(1, prose(1, 300), "en", "s", 1), (1, prose(2, 300), "en", "s", 1), (2, prose(2, 300), "en", "s", 1), (3, prose(3, 40), "en", "s", 1)]
    assert result(dedup_substrings(spark.createDataFrame(rows, SCHEMA), hash_bits=4, block_bytes=1000)) == brute(rows)


def test_the_query(spark, tmp_path, rows):
    spark.createDataFrame([r for r in rows if r[0] is not None and r[0] != 4], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    out = op7_substring_dedup(spark, str(tmp_path)).collect()
    want = [(d, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for d, n, gone, kept in brute([r for r in rows if r[0] is not None and r[0] != 4])]
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in out) == sorted(want)


def test_empty_and_clashing(docs, empty):
    assert dedup_substrings(empty).count() == 0
    out = dedup_substrings(docs.withColumn("clean_text", docs.lang).withColumn("N_WORDS", docs.n_chars))
    assert out.count() == docs.count() and len({c.lower() for c in out.columns}) == len(out.columns)


def test_pack():
    a, b = np.array([0, 1, 2**63 + 5], np.uint64), np.zeros(0, np.uint64)
    e = unpack(pack(a=a, b=b))
    assert e["a"].tolist() == a.tolist() and e["b"].tolist() == []
