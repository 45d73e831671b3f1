import random

import numpy as np
import pytest
import xxhash

from wavegrid.llm.components import components, forest
from wavegrid.llm.simhash import keep_one, links, near_duplicates, plan_parts


def shingles(text, k):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [b" ".join(w)] if w else []


def simhash(text, k=4):
    s = shingles(text, k)
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def joined(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_brute_force(docs, rows):
    known = [(d, simhash(t)) for d, t, *_ in rows if d is not None]
    group = joined({d for d, _ in known}, [(a, b) for a, x in known for b, y in known if (x ^ y).bit_count() <= 4])
    out = near_duplicates(docs.withColumn("fp", docs.lang).withColumn("component_id", docs.text)).collect()
    by_print = {simhash(t): group[d] for d, t, *_ in rows if d is not None}
    want = sorted((str(d), f"{simhash(t):016x}", by_print.get(simhash(t), -1) if d is None else group[d]) for d, t, *_ in rows)
    assert sorted((str(r.doc_id), r.fingerprint, -1 if r.component_id is None else r.component_id) for r in out) == want


@pytest.mark.parametrize("distance", [0, 1, 4, 7, 10])
def test_search_loses_no_pair(spark, distance):
    r = random.Random(distance)
    fps = set()
    for _ in range(40):
        base = r.getrandbits(64)
        for _ in range(6):
            x = base
            for b in r.sample(range(64), r.randrange(0, 13)):
                x ^= 1 << b
            fps.add(x)
    hot = [0xFFFF ^ (1 << a) ^ (1 << b) for a in range(16) for b in range(a)]  # many within a few bits
    fps = sorted(fps | set(hot))
    signed = [(x - (1 << 64) if x >> 63 else x, k) for k, x in enumerate(fps)]
    df = spark.createDataFrame(signed, "fp long, rep long")
    found = links(df, distance, block=16, work=300)
    want = joined(range(len(fps)), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= distance])
    got = joined(range(len(fps)), [(e.a, e.b) for e in found.collect()])
    assert got == want
    if distance in (4, 10):  # values that are split before their rows come together
        early = links(df.coalesce(2), distance, block=16, share=0.01, least=8)
        assert joined(range(len(fps)), [(e.a, e.b) for e in early.collect()]) == want


def test_thresholds_cover_the_distance():
    for n in (10, 10**5, 10**8):
        for d in (0, 3, 4, 10):
            ones = np.full((64, 64), n / 4)
            np.fill_diagonal(ones, n / 2)
            ones[0] = ones[:, 0] = 0  # a bit that is never set
            parts = plan_parts(n, ones, d)
            assert sorted(b for p in parts for b in p.bits) == list(range(64)) and sum(p.threshold + 1 for p in parts) == d + 1


def test_components(spark):
    r = random.Random(1)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2100)]
    want = joined({x for p in pairs for x in p}, pairs)
    a, b = forest(*(np.array(x) for x in zip(*pairs)))
    assert joined(want, zip(a.tolist(), b.tolist())) == want
    out = components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()
    assert {x.node: x.root for x in out} == {n: m for n, m in want.items() if n != m}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_keep_one(docs, rows, empty):
    kept = sorted(str(r.doc_id) for r in keep_one(docs).collect())
    texts = {d: t for d, t, *_ in rows if d is not None}
    sets = {d: set(shingles(t, 5)) for d, t in texts.items()}
    alike = [(a, b) for a in texts for b in texts if texts[a] == texts[b] or not sets[a] and not sets[b] or sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    group = joined(texts, alike)
    want = sorted([str(d) for d, *_ in rows if d is None or group[d] == d])
    assert kept == want
    assert keep_one(empty).count() == 0 and near_duplicates(empty).count() == 0


def edited(words: list[str], at: list[int], mark: str) -> str:
    return " ".join(f"{mark}{k}" if k in at else w for k, w in enumerate(words))


def jaccard(a: str, b: str) -> float:
    x, y = set(shingles(a, 5)), set(shingles(b, 5))
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("copies", [20, 180])
def test_copies_that_only_a_third_text_links(spark, copies):
    """The smallest id is an edited copy, and copies are similar to their base only."""
    r = random.Random(copies)
    base = [f"w{r.randrange(10**6)}" for _ in range(300)]
    texts = {k: edited(base, [5 + 10 * x for x in r.sample(range(29), 5)], f"c{k}x") for k in range(1, copies + 1)}
    texts[500] = " ".join(base)
    texts[501] = " ".join(f"w{r.randrange(10**6)}" for _ in range(300))
    assert jaccard(texts[1], texts[2]) < 0.8 <= min(jaccard(texts[500], texts[k]) for k in range(1, copies + 1))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in keep_one(df, distance=20).collect()) == [1, 501]


def test_similar_pairs_are_found(spark):
    """Pairs at a similarity of 0.80 to 0.84, of which the distance alone finds less than two thirds."""
    r = random.Random(8)
    texts, pairs = {}, []
    for k in range(150):
        words = [f"w{r.randrange(10**6)}" for _ in range(r.randrange(200, 400))]
        at = r.sample(range(len(words) // 10), (len(words) - 4) // 45)
        texts[2 * k], texts[2 * k + 1] = " ".join(words), edited(words, [5 + 10 * x for x in at], "c")
        pairs.append(jaccard(texts[2 * k], texts[2 * k + 1]))
    assert all(0.8 <= j < 0.86 for j in pairs) and sum(j < 0.82 for j in pairs) >= 75
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    kept = {x.doc_id for x in keep_one(df).collect()}
    assert kept >= set(range(0, 300, 2)) and len(kept) <= 151


def test_only_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (3, "other words here then")], "doc_id long, text string")
    assert sorted(str(r.component_id) for r in near_duplicates(df).collect()) == ["3", "None", "None"]

