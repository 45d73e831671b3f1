import collections
import math
import random

import pytest

from wavegrid.llm import quality

from .conftest import SCHEMA, prose

MARK = "￿"


class Brute:
    """Interpolated modified Kneser-Ney, written from its formulas."""

    def __init__(self, texts, order=4):
        self.order = order
        c = {order: collections.Counter()}
        for t in texts:
            s = MARK * (order - 1) + t
            c[order].update(s[i : i + order] for i in range(len(t)))
        for n in range(order - 1, 0, -1):
            c[n] = collections.Counter(g[1:] for g in c[n + 1])
        self.c, self.d, self.h = c, {}, {n: {} for n in c}
        for n in c:
            k = collections.Counter(c[n].values())
            y = k[1] / (k[1] + 2 * k[2]) if k[1] else 0
            self.d[n] = [min(j - 0.01, max(0.01, j - (j + 1) * y * k[j + 1] / k[j])) for j in (1, 2, 3)] if all(k[j] for j in (1, 2, 3, 4)) else [0.5] * 3
            for g, v in c[n].items():
                e = self.h[n].setdefault(g[:-1], [0, 0])
                e[0] += v
                e[1] += self.d[n][min(v, 3) - 1]

    def p(self, g):
        n = len(g)
        if not n:
            return 1 / (len(self.c[1]) + 1)
        h, low, v = self.h[n].get(g[:-1]), self.p(g[1:]), self.c[n].get(g, 0)
        return low if not h else (max(0, v - (self.d[n][min(v, 3) - 1] if v else 0)) + h[1] * low) / h[0]

    def perplexity(self, t):
        s = MARK * (self.order - 1) + t
        return math.exp(-sum(math.log(self.p(s[i : i + self.order])) for i in range(len(t))) / len(t)) if t else None


@pytest.mark.parametrize("size", [32 << 20, 9000])
def test_model(spark, docs, rows, size):
    trusted = docs.where("doc_id < 8")
    model = quality.train(trusted)
    assert quality._shards(model, size)[0] == 1 or size == 9000
    brute = Brute([t or "" for d, t, *_ in rows if d is not None and d < 8])
    out = quality.perplexity(docs.withColumn("Perplexity", docs.lang), model, shard_bytes=size).collect()
    assert len(out) == len(rows)
    for r in out:
        want = brute.perplexity(r.text or "")
        assert r.perplexity == pytest.approx(want, rel=1e-9) if want else r.perplexity is None


def test_astral_characters_and_no_text(spark, empty):
    model = quality.train(spark.createDataFrame([("😀😀 a😀",)], "text string"))
    (r,) = quality.perplexity(spark.createDataFrame([("😀a",)], "text string"), model).collect()
    assert r.perplexity > 1
    none = quality.train(empty)
    assert none.count() == 0
    (r,) = quality.perplexity(spark.createDataFrame([("ab",)], "text string"), none).collect()
    assert r.perplexity == pytest.approx(1.0)
    assert quality.perplexity(empty, model).count() == 0


def test_all_characters_are_apart(spark):
    """Beyond 16 bits too, and U+FFFF is a character like others."""
    r = random.Random(5)
    some = ["😀", "🦊", chr(0x1F600 + 2048), chr(0xFFFF), "a", "b", " ", chr(0x10FFFF)]
    texts = ["".join(r.choice(some) for _ in range(60)) for _ in range(30)]
    brute = Brute([t.replace(MARK, "\0") for t in texts])
    model = quality.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    asked = [*texts[:3], "😀" + chr(0x1F600 + 2048) + "x" + chr(0xFFFF), chr(0x20000) * 5, "", None]
    out = quality.perplexity(spark.createDataFrame([(k, t) for k, t in enumerate(asked)], "k int, text string"), model, block_size=100).collect()
    for row in out:
        want = brute.perplexity((row.text or "").replace(MARK, "\0"))
        assert row.perplexity == pytest.approx(want, rel=1e-9) if want else row.perplexity is None


def test_more_characters_than_16_bits():
    text = "".join(chr(c) for c in range(32, 0x11000) if not 0xD800 <= c < 0xE000) * 2
    g = quality.Grams([text.encode(), b"", b"aa"])
    a, counts = quality.codes([text.encode(), b"", b"aa"])
    want = collections.Counter()
    at = 0
    for n in counts.tolist():
        part = a[at : at + n + 3].tolist()
        want.update(tuple(part[i : i + 4]) for i in range(n))
        at += n + 3
    found = {(h >> 42, h >> 21 & 0x1FFFFF, h & 0x1FFFFF, c): n for h, c, n in zip(g.context.tolist(), g.last.tolist(), g.n.tolist(), strict=True)}
    assert found == dict(want) and len(g.place) == counts.sum()
    i = 0x3000
    assert (int(g.context[g.place[i]]), int(g.last[g.place[i]])) == (ord(text[i - 3]) << 42 | ord(text[i - 2]) << 21 | ord(text[i - 1]), ord(text[i]))


def test_the_query(spark, tmp_path):
    """Perplexities, thresholds and decisions, against the formulas."""
    rows = [(k, prose(k, 30) if k % 5 else prose(k, 20).upper() + "##", ["en", "de"][k % 2], "s", 1) for k in range(80)] + [(90, None, "en", "s", 1), (91, "", "fr", "s", 1), (92, "zz", "fr", "s", 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k % 5 > 0), int(k % 7 == 0)) for k in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = {r.doc_id: r for r in quality.op6_quality_classifier(spark, str(tmp_path)).collect()}
    apart = {r.doc_id for r in spark.createDataFrame(rows, SCHEMA).where("pmod(xxhash64(cast(doc_id as string)), 5) = 0").collect()}
    trusted = [(d, t, lang) for d, t, lang, *_ in rows if d < 80 and d % 5 and d % 7]
    brute = Brute([t for d, t, _ in trusted if d not in apart])
    held = [(lang, brute.perplexity(t)) for d, t, lang in trusted if d in apart]
    at = lambda values: sorted(values)[max(0, math.ceil(0.99 * len(values)) - 1)]
    bar = {lang: at([p for x, p in held if x == lang]) for lang in {x for x, _ in held}}
    assert len(out) == len(rows) and bar
    for d, t, lang, *_ in rows:
        p, limit = brute.perplexity(t or ""), bar.get(lang, at([p for _, p in held]))
        assert out[d].threshold == pytest.approx(limit, abs=2e-6) and out[d].accepted == (p is None or p <= limit * (1 + 1e-12))
        assert out[d].perplexity == pytest.approx(p, abs=2e-6) if p else out[d].perplexity is None


def test_junk_is_rejected(spark):
    good = [(k, prose(k, 60), ["en", "de"][k % 2], "s", 1) for k in range(300)]
    junk = [(1000 + k, " ".join(w.upper() + "!!###" for w in prose(k, 40).split()), ["en", "de", None, "xx"][k % 4], "s", 1) for k in range(40)]
    extra = [(2000, None, "en", "s", 1), (2001, "", None, "s", 1), (None, prose(1, 50), "en", "s", 1)]
    docs = spark.createDataFrame(good + junk + extra, SCHEMA)
    trusted = spark.createDataFrame([(k,) for k in range(200)] * 2 + [(None,)], "doc_id long")
    for limit in (1_000_000, 1):
        out = {r.doc_id: r.accepted for r in quality.classify(docs, trusted, broadcast_rows=limit).collect()}
        assert len(out) == len(good + junk + extra)
        assert not any(out[d] for d, *_ in junk)
        assert sum(out[k] for k in range(200, 300)) >= 95 and out[2000] and out[2001] and out[None]
    nothing = quality.classify(docs, trusted.limit(0))
    assert nothing.where("accepted").count() == len(good + junk + extra)


def test_each_language_has_its_own_threshold(spark):
    """A rare language isn't judged by a common one's looser texts."""
    r = random.Random(2)
    noisy = lambda: "".join(chr(r.randrange(33, 400)) for _ in range(120))
    rows = [(k, noisy() if k % 4 else prose(k, 40), "xx" if k % 4 else "fr", "s", 1) for k in range(400)]
    docs = spark.createDataFrame(rows + [(1000, noisy(), "fr", "s", 1)], SCHEMA)
    out = quality.classify(docs, spark.createDataFrame([(k,) for k in range(400)], "doc_id long")).collect()
    held = {r.lang: max(x.perplexity for x in out if x.lang == r.lang and x.threshold >= x.perplexity) for r in out}
    bar = {r.lang: r.threshold for r in out}
    assert bar["fr"] < bar["xx"] and bar == pytest.approx(held)
    assert not next(r.accepted for r in out if r.doc_id == 1000)
