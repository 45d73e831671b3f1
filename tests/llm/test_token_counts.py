import random

import pytest
from tokenizers import Tokenizer

from wavegrid.llm.bpe import vocabulary_path
from wavegrid.llm.token_counts import VOCABULARY, Transducer, character_classes, count_tokens, op10_token_counts

from .conftest import SCHEMA
from .test_bpe import PARTS


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary_path(VOCABULARY))


def test_equals_the_library(library):
    t, classes, r = Transducer(vocabulary_path(VOCABULARY), limit=3000), character_classes(), random.Random(3)
    for _ in range(40):
        some = r.sample([*PARTS, "  ", "\n", "\n\n", "\t", " '", " s", "====", "Ⅷ"], r.randint(1, 9))
        texts = ["".join(r.choice(some) for _ in range(r.randint(0, 150))) for _ in range(20)]
        want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
        assert t.counts([x.encode() for x in texts], classes, chunk=r.choice([3, 17, 64, 512])).tolist() == want


def test_documents(docs, rows, library, empty):
    out = count_tokens(docs.withColumn("n_tokens", docs.text)).collect()
    want = sorted((str(d), len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for d, t, *_ in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in out) == want
    assert count_tokens(empty).count() == 0


def test_no_word_begins_for_long(library):
    t, classes = Transducer(vocabulary_path(VOCABULARY)), character_classes()
    for text in ("a" * 3000, "unbelievably" * 300, "=" * 2500, " " * 700):
        assert t.counts([text.encode()], classes, chunk=64).tolist() == [len(library.encode(text, add_special_tokens=False).ids)]


def test_maps_of_chunks_are_composed(library):
    """Long words of few letters: what enters a chunk depends on bytes far back."""
    t, classes, r = Transducer(vocabulary_path(VOCABULARY)), character_classes(), random.Random(8)
    for some in (["a"], ["="], ["a", "aa", "b"], ["the", "ing", "er"], ["é", "中"], list("abcdefgh"), ["-", "=", "--"]):
        texts = ["".join(r.choice(some) for _ in range(r.randrange(900))) for _ in range(4)]
        want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
        for chunk in (2, 7, 32):
            assert t.counts([x.encode() for x in texts], classes, chunk=chunk).tolist() == want


def test_another_kind_of_vocabulary_raises():
    with pytest.raises(ValueError, match="byte-level"):
        Transducer(vocabulary_path())


def test_the_query(spark, rows, library, tmp_path):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    want = [(str(d), len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024) for d, t, *_ in rows]
    assert sorted(map(str, want)) == sorted(str((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit)) for r in op10_token_counts(spark, str(tmp_path)).collect())
