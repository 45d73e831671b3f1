
import re

import numpy as np
import pytest

from wavegrid.llm.decontaminate import cut, decontaminate, windows_of
from wavegrid.llm.fm_index import FMIndex, suffix_array

from .conftest import SHARED, prose


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window=10):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        if item is None or t is None:
            continue
        v = words(t)
        for i in range(max(1, len(v) - window + 1) if v else 0):
            part = v[i : i + window]
            for j in range(len(w) - len(part) + 1):
                if w[j : j + len(part)] == part:
                    hit.update(range(j, j + len(part)))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


ITEMS = [(1, SHARED[:200]), (2, prose(3, 15)), (2, prose(3, 15)), (10, "one"), (3, None), (None, "two"), (4, ""), (5, prose(777, 30)), (6, SHARED[:200].upper() + "!!")]


def test_suffix_array_and_index():
    r = np.random.default_rng(0)
    for n, sigma in ((1, 2), (50, 3), (400, 5), (300, 40)):
        s = np.append(r.integers(1, sigma + 1, n), 0)
        assert suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
        index = FMIndex(s[:-1], sigma + 1, 4)
        for m in (1, 2, 3):
            at = int(r.integers(0, max(1, n - m)))
            low, high = index.intervals(s[at : at + m][None])
            want = [i for i in range(n) if s[i : i + m].tolist() == s[at : at + m].tolist()]
            assert sorted(index.locate(np.arange(low[0], high[0])).tolist()) == want


@pytest.mark.parametrize("shard,block", [(6 << 20, 16 << 20), (500, 300)])
def test_brute_force(spark, docs, rows, shard, block):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = decontaminate(docs, items, shard_bytes=shard, block_bytes=block, with_clean_text=True).collect()
    assert sorted((str(r.doc_id), r.text or "", r.n_words, r.n_hit, tuple(r["items"])) for r in out) == sorted((str(d), t or "", *brute(t, ITEMS)[:2], tuple(brute(t, ITEMS)[2])) for d, t, *_ in rows)
    for r in out:
        assert r.n_hit == sum(s.end - s.start for s in r.spans)
        assert (r.clean_text is None) == (r.text is None)
        if r.text is not None:
            gone = {i for s in r.spans for i in range(s.start, s.end)}
            assert words(r.clean_text) == [w for i, w in enumerate(words(r.text)) if i not in gone]


def test_empty_tables_and_clashing_names(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    out = decontaminate(docs.withColumn("spans", docs.doc_id).withColumn("Items", docs.text), none)
    assert out.count() == docs.count() and out.where("n_hit > 0").count() == 0
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    assert decontaminate(empty, spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


def test_cut_keeps_what_stands_outside():
    assert cut(b"a, bc; d e", np.array([1]), np.array([3])) == b"a,  e"
    assert windows_of([("1", b"")], 10) == ([], [])


def test_names_like_the_hidden_ones_stay(spark, docs):
    more = docs.withColumn("wg_hit_note", docs.lang).withColumn("wg_flags", docs.text).withColumn("WG_words", docs.doc_id)
    out = decontaminate(more, spark.createDataFrame(ITEMS, "item_id long, text string"), block_bytes=300, with_clean_text=True)
    assert out.columns == [*more.columns, "n_words", "n_hit", "items", "spans", "clean_text"]
    assert sorted(str((r.wg_hit_note, r.wg_flags, r.WG_words)) for r in out.collect()) == sorted(str((r.lang, r.text, r.doc_id)) for r in docs.collect())
