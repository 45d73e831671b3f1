import random

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from wavegrid.llm.bpe import vocabulary_path

from .conftest import SCHEMA, SHARED, prose
from .test_decontaminate import brute as hits
from .test_decontaminate import words
from .test_substring_dedup import brute as repeats


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    r = random.Random(4)
    rows = [(k, prose(k, 80), ["en", "fr"][k % 2], "s", 1) for k in range(120) if k != 99]  # 99 is the shared passage
    near = rows[7][1].split()
    near[40] = "other"
    rows += [(200, rows[3][1], "en", "s", 1), (201, " ".join(near), "fr", "s", 1), (202, prose(900, 40) + " " + SHARED, "en", "s", 1), (203, SHARED + " " + prose(901, 40), "fr", "s", 1)]
    rows += [(300 + k, " ".join(w.upper() + "%%" for w in prose(k, 50).split()), "en", "s", 1) for k in range(8)]
    rows += [(400, prose(950, 30) + " " + prose(5000, 14) + " " + prose(951, 30), "fr", "s", 1), (401, None, "en", None, None), (402, "", None, "s", 0)]
    r.shuffle(rows)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, int(k < 300), 0) for k in range(0, 310, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, prose(5000, 14))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_and_run(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/out/{name}")
        docs = spark.read.parquet(f"{folder}/out/{name}")
        kept[name] = {r.doc_id: r for r in docs.collect()}
        if name != "bpe_encoding":
            assert docs.dtypes == before.dtypes
    q, s, w, d, b = kept.values()
    assert not any(300 <= k < 310 for k in q) and len(q) >= 119 and {401, 402} <= q.keys()
    gone = q.keys() - s.keys()
    assert {200, 201} & q.keys() <= gone and gone <= {200, 201, 402}
    rows = sorted((r.doc_id, r.text) for r in s.values())
    assert repeats(rows) == sorted((str(k), len((s[k].text or "").split()), len((s[k].text or "").split()) - len((r.text or "").split()), " ".join((r.text or "").split())) for k, r in w.items())
    assert SHARED in s[203].text and SHARED not in w[203].text and SHARED in w[202].text
    for k, r in w.items():
        n, hit, _ = hits(r.text, [(1, prose(5000, 14))])
        assert len(words(d[k].text)) == n - hit and (hit > 0) == (k == 400)
        assert d[k].n_chars == (None if d[k].text is None else len(d[k].text))
    library = Tokenizer.from_file(vocabulary_path())
    for k, r in b.items():
        ids = library.encode(d[k].text or "", add_special_tokens=False).ids
        assert list(r.ids) == ids and r.n_tokens == len(ids) and r.decoded == library.decode(ids, skip_special_tokens=False)
    again = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, folder).collect()}
    assert again == {k: list(r.ids) for k, r in b.items()}


def _folder(spark, path, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(0, 40, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, prose(5000, 14))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_empty_table(spark, tmp_path):
    path = _folder(spark, tmp_path, [])
    out = corpus_pipeline.run(spark, path)
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "decoded"] and out.count() == 0


def test_null_ids_repeated_rows_and_more_columns(spark, tmp_path):
    """Rows with a null id pass all stages; rows that repeat an id that stays do too; columns of any name stay until the last stage."""
    rows = [(k, prose(k, 60), "en", "s", 1, "kept", k, 1.5) for k in range(40)]
    rows += [(None, prose(3, 60), "en", "s", 1, "null", -1, None), (None, None, None, None, None, None, None, None), (5, prose(5, 60), "en", "s", 1, "again", 5, 0.0)]
    schema = f"{SCHEMA}, wg_words string, ids long, perplexity double"
    path = _folder(spark, tmp_path, rows, schema)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        docs.write.parquet(f"{path}/out/{name}")
        docs = spark.read.parquet(f"{path}/out/{name}")
        assert [c.lower() for c in docs.columns] == [c for c in ("doc_id", "text", "lang", "source", "n_chars", "wg_words", "ids", "perplexity")]
    kept = docs.collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted([*(str(k) for k in range(40)), "5", "None", "None"])
    assert {r.wg_words for r in kept} == {"kept", "null", "again", None} and {r.ids for r in kept if r.wg_words == "kept"} == set(range(40))
    assert {(r.wg_words, r.perplexity) for r in kept} == {("kept", 1.5), ("again", 0.0), ("null", None), (None, None)}
    (null,) = [r for r in kept if r.wg_words == "null"]
    assert null.text == prose(3, 60)  # is no copy of a document, and none is its copy
    last = corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()
    assert len(last) == len(kept) and [r for r in last if r.n_tokens != len(r.ids)] == []
