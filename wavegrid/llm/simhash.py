"""SimHash near-duplicates: 64-bit fingerprints, linked by a generalised pigeonhole search.

The search deals the 64 bits into parts, correlated bits together, and gives each part a threshold of its own: thresholds T with
sum(T + 1) = distance + 1 lose no pair. Which parts and thresholds are cheapest is found by dynamic programming on the candidate
counts that the fingerprints' bit statistics predict. Each distinct fingerprint is entered under its value in each part, and
probes the values within the part's threshold; what meets under one value is verified on all 64 bits.

Values that a ten-thousandth of all fingerprints share are looked for first, and no task gets all rows of one: they, and others that
take much work, are split into blocks, and pairs of blocks are searched by different tasks. Tasks return a spanning forest of the links they
find, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from wavegrid.llm.common import extended, fresh, pack, released, schema_with, small_batches, stored, trim, trimmed, unpack, utf8, without
from wavegrid.llm.components import components, forest

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Relative costs of a row that is sent to its part's value, and of a pair that is compared.
PROBE_COST, PAIR_COST = 1.0, 0.005


def shingle_hashes(text: bytes | None, k: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of k words, or of all words if there are fewer."""
    words = text.translate(_LOWER).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist(), strict=False)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; 0 of none. As a signed 64-bit integer."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


@dataclass(frozen=True)
class Part:
    bits: tuple[int, ...]
    threshold: int  # -1: the part isn't searched


def _chances(disagree: list[float], most: int) -> list[float]:
    """P(at most t of the independent bits disagree), for t up to most."""
    p = np.zeros(len(disagree) + 1)
    p[0] = 1
    for d in disagree:
        p[1:] = p[1:] * (1 - d) + p[:-1] * d
        p[0] *= 1 - d
    return np.cumsum(p)[: most + 1].tolist()


def _groups(correlation: np.ndarray, m: int) -> list[list[int]]:
    """Bits in m parts of almost equal width; each part takes the free bits that correlate most with those it has."""
    free, parts = set(range(64)), []
    strength = np.abs(correlation)
    for i in range(m):
        part = [max(free, key=lambda b: (strength[b, list(free)].sum(), -b))]
        free.discard(part[0])
        while len(part) < (64 * (i + 1)) // m - (64 * i) // m:
            best = max(free, key=lambda b: (strength[b, part].sum(), -b))
            part.append(best)
            free.discard(best)
        parts.append(sorted(part))
    return parts


def plan_parts(n: int, ones: np.ndarray, distance: int) -> list[Part]:
    """n: distinct fingerprints; ones[i, j]: of these, how many have bits i and j both set."""
    count = max(n, 1)
    p = np.diag(ones) / count
    cov = ones / count - np.outer(p, p)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    correlation = cov / np.outer(sd, sd)
    np.fill_diagonal(correlation, 1.0)  # of bits that are all alike too
    disagree = 2 * p * (1 - p)
    best: tuple[float, list[Part]] | None = None
    for m in range(2, min(distance + 1, 16) + 1) if distance else [2]:
        parts = _groups(correlation, m)
        costs = []
        for bits in parts:
            c = correlation[np.ix_(bits, bits)]
            independent = len(bits) / np.square(c).sum()  # as a share of the part's bits
            chance = [x**independent for x in _chances(disagree[bits].tolist(), distance)]
            probes = np.cumsum([comb(len(bits), t) for t in range(distance + 1)]).tolist()
            costs.append([0.0] + [n * v * PROBE_COST + n * n / 2 * (2 * v - 1) * chance[0] * PAIR_COST for v in probes])
        # least[s]: cost and thresholds of the parts so far, with sum(T + 1) = s
        least: list[tuple[float, list[int]]] = [(0.0, [])] + [(float("inf"), [])] * (distance + 1)
        for cost in costs:
            least = [min(((least[s - x][0] + cost[x], [*least[s - x][1], x - 1]) for x in range(s + 1)), key=lambda c: c[0]) for s in range(distance + 2)]
        if best is None or least[-1][0] < best[0]:
            best = least[-1][0], [Part(tuple(b), t) for b, t in zip(parts, least[-1][1], strict=True)]
    return best[1]


def _values(fps: np.ndarray, bits: tuple[int, ...]) -> np.ndarray:
    v = np.zeros(len(fps), np.uint64)
    for k, b in enumerate(bits):
        v |= ((fps >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return v


def _bit_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((64, 64), np.int64)
    for batch in batches:
        fps = batch.column(0).to_numpy().view(np.uint64)
        bits = np.unpackbits(np.ascontiguousarray(fps.astype("<u8")).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
        total += (bits.T @ bits).astype(np.int64)
    i, j = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "n"])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _keys(fps: np.ndarray, parts: list[Part], k: int) -> np.ndarray:
    """The values of part k, as keys that no other part has."""
    return _values(fps, parts[k].bits) | np.uint64(k) << np.uint64(58)


def _often(parts: list[Part], share: float):
    """Keys under which this share of some task's fingerprints are entered, or nearly, and how many are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def counts() -> pa.RecordBatch:
            fps, keys, n = np.concatenate(held), [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for k, part in enumerate(parts):
                if part.threshold >= 0:
                    key, count = np.unique(_keys(fps, parts, k), return_counts=True)
                    many = count >= max(8, share * len(fps) / 2)
                    keys.append(key[many])
                    n.append(count[many])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(n))], ["key", "n"])

        for batch in batches:
            held.append(batch.column(0).to_numpy().view(np.uint64))
            rows += batch.num_rows
            if rows >= 1_000_000:
                yield counts()
                held, rows = [], 0
        if rows:
            yield counts()

    return run


def _probe(parts: list[Part], buckets: int, often: np.ndarray):
    """For each searched part, the values that a fingerprint is entered under or probes, packed by buckets of values: a row a bucket, not a probe. Those of
    keys that occur often (in order) have no bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 8192):
                few = batch.slice(begin, 8192)
                fps, reps = few.column(0).to_numpy().view(np.uint64), few.column(1).to_numpy()
                keys, of, probes = [], [], []
                for k, part in enumerate(parts):
                    value = _values(fps, part.bits)
                    for t in range(part.threshold + 1):
                        for flips in combinations(range(len(part.bits)), t):
                            keys.append((value ^ np.uint64(sum(1 << b for b in flips))) | np.uint64(k) << np.uint64(58))
                            of.append(np.arange(len(fps)))
                            probes.append(np.full(len(fps), t > 0))
                key, i, probe = (np.concatenate(x) for x in (keys, of, probes))
                bucket = (((_mix(key) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
                if len(often):
                    bucket[often[np.minimum(np.searchsorted(often, key), len(often) - 1)] == key] = -1
                order = np.lexsort((key, bucket))
                key, i, probe, bucket = key[order], i[order], probe[order], bucket[order]
                cuts = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(key)]))
                rows = []
                for c, d in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    j = i[c:d]
                    rows.append((int(bucket[c]), pack(key=np.diff(key[c:d], prepend=np.uint64(0)), fp=fps[j], rep=reps[j].view(np.uint64), probe=probe[c:d])))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "payload"])

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for payload in batch.column(0).to_pylist():
            e = unpack(payload)
            yield pa.RecordBatch.from_arrays([pa.array(np.cumsum(e["key"], dtype=np.uint64).view(np.int64)), pa.array(e["fp"].view(np.int64)), pa.array(e["rep"].view(np.int64)), pa.array(e["probe"].astype(bool))], ["key", "fp", "rep", "probe"])


def _search(distance: int, work: int):
    """A bucket in: a forest of the links within its values out (key null), and the rows of values that take more than work comparisons."""

    def run(_, table):
        released()
        try:
            parts = [unpack(p) for p in table.column("payload").to_pylist()]
            key = np.concatenate([np.cumsum(p["key"], dtype=np.uint64) for p in parts])
            fp, rep, probe = (np.concatenate([p[k] for p in parts]) for k in ("fp", "rep", "probe"))
            order = np.lexsort((probe, key))  # probes stand last under their value
            key, fp, rep, probe = key[order], fp[order], rep[order].view(np.int64), probe[order].astype(bool)
            begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size = np.diff(np.append(begin, len(key)))
            entered = np.add.reduceat((~probe).astype(np.int64), begin)
            hot = np.repeat(entered * size > work, size)
            a, b = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in zip(*_within(key[~hot], fp[~hot], rep[~hot], probe[~hot], distance), (np.zeros(0, np.int64),) * 2, strict=True))
            a, b = forest(a, b) if len(a) else (a, b)
            none = pa.nulls(len(a), pa.int64())
            cold = pa.table({"a": pa.array(a), "b": pa.array(b), "key": none, "fp": none, "probe": pa.nulls(len(a), pa.bool_())})
            warm = pa.table({"a": pa.array(rep[hot]), "b": pa.nulls(int(hot.sum()), pa.int64()), "key": pa.array(key[hot].view(np.int64)), "fp": pa.array(fp[hot].view(np.int64)), "probe": pa.array(probe[hot])})
            return pa.concat_tables([cold, warm])
        finally:
            trim()

    return run


def _within(key: np.ndarray, fp: np.ndarray, rep: np.ndarray, probe: np.ndarray, distance: int, dense: int = 48) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links within each key's rows, which stand together, probes last; two probes aren't compared. All links of keys with few rows, a forest for others."""
    begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(key)))
    sizes = np.repeat(size, size)
    found = []
    small = np.flatnonzero(sizes <= dense)
    last = np.repeat(begin + size, size)
    for shift in range(1, min(dense, int(size.max(initial=0)))):
        small = small[small + shift < last[small]]
        i, j = small, small + shift
        near = (np.bitwise_count(fp[i] ^ fp[j]) <= distance) & ~(probe[i] & probe[j])
        found.append((rep[i[near]], rep[j[near]]))
    for b, n in zip(begin[size > dense].tolist(), size[size > dense].tolist(), strict=True):
        f, r, p = fp[b : b + n], rep[b : b + n], probe[b : b + n]
        entered = n - int(np.count_nonzero(p))
        step = max(1, (1 << 20) // n)
        for row in range(0, entered, step):
            i, j = np.nonzero(np.bitwise_count(f[row : min(row + step, entered), None] ^ f[None, :]) <= distance)
            i += row
            found.append(forest(r[i[i < j]], r[j[i < j]]))
    return found


def _links(distance: int):
    """Rows sorted by key and pair in; a forest of the links within the keys out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0

        def flush(everything: bool):
            nonlocal held, rows
            key, pair, fp, rep, probe = (np.concatenate(x) for x in zip(*held, strict=True))
            both = np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]) | (pair[1:] != pair[:-1]))))
            end = len(key) if everything else int(np.searchsorted(both, both[-1]))
            held, rows = ([(key[end:], pair[end:], fp[end:], rep[end:], probe[end:])], len(key) - end) if end < len(key) else ([], 0)
            if end:
                a, b = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in zip(*_within(both[:end], fp[:end], rep[:end], probe[:end], distance), (np.zeros(0, np.int64),) * 2, strict=True))
                if len(a):
                    a, b = forest(a, b)
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            if batch.num_rows:
                c = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
                held.append((c[0], c[1], c[2].view(np.uint64), c[3], c[4]))
                rows += batch.num_rows
                if rows >= 200_000:
                    yield from flush(False)
        if held:
            yield from flush(True)

    return run


def links(distinct: DataFrame, distance: int, block: int = 4096, work: int = 1 << 28, share: float = 1e-4, least: int = 1 << 18) -> DataFrame:
    """(a, b): ids of fingerprints within the distance; not all pairs, but enough to connect all that are connected. distinct: fp, rep, stored.

    A value whose rows take more than work comparisons is split into blocks of about block rows; one under which this share of all fingerprints, and least
    of them, are found to be entered is split before its rows come together.
    """
    counts = distinct.select("fp").mapInArrow(_bit_counts, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    ones = np.zeros((64, 64))
    for r in counts:
        ones[r.i, r.j] = r.n
    n = distinct.count()
    parts = plan_parts(n, ones, distance)
    probes = sum(comb(len(p.bits), t) for p in parts for t in range(p.threshold + 1))
    buckets = max(1, -(-n * probes // 400_000))
    often = np.zeros(0, np.uint64)
    if n >= least:
        counts = distinct.select("fp").mapInArrow(trimmed(_often(parts, share)), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= max(least, share * n))
        often = np.sort(np.array([r.key for r in counts.select("key").collect()], np.int64).view(np.uint64))  # one in share for each part at most
    packed = distinct.select("fp", "rep").mapInArrow(trimmed(_probe(parts, buckets, often)), "bucket int, payload binary")
    if len(often):
        packed = stored(packed, "near-probes")
        split = packed.where("bucket < 0").select("payload").mapInArrow(trimmed(_unpacked), "key long, fp long, rep long, probe boolean")
        packed = packed.where("bucket >= 0")
    found = stored(packed.groupBy("bucket").applyInArrow(_search(distance, work), "a long, b long, key long, fp long, probe boolean"), "near-values")
    cold, hot = found.where("key is null").select("a", "b"), found.where("key is not null").select("key", "fp", F.col("a").alias("rep"), "probe")
    if len(often):
        hot = hot.unionByName(split)
    elif not hot.limit(1).count():
        return cold
    # values that many share are cut into blocks; each block meets each other one in some task
    blocks = hot.groupBy("key").agg(F.ceil(F.count("*") / block).cast("long").alias("blocks"))
    rows = hot.join(blocks, "key").withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("key", (F.least("mine", "other") * F.col("blocks") + F.greatest("mine", "other")).alias("pair"), "fp", "rep", "probe")
    return cold.union(rows.repartition("key", "pair").sortWithinPartitions("key", "pair", "probe").mapInArrow(trimmed(_links(distance)), "a long, b long"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4) -> DataFrame:
    """docs' ids with fingerprint (16 hex digits) and component_id: the smallest id that links reach, itself included.

    Words are runs of what isn't ASCII white space, A-Z lower-cased; fewer than shingle are one shingle, none give fingerprint zero,
    which is linked like any other, as is that of a null text. Fingerprints that only rows with a null id have are not linked, and
    their component_id is null; other rows with a null id get that of their fingerprint. Rows with equal ids are one node.
    """
    fps = stored(fingerprints(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), text_col, shingle).select(F.col(f"`{id_col}`"), "fp"), "fingerprints")
    return components_of(fps, id_col, distance).select(f"`{id_col}`", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def fingerprints(docs: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """docs with fp, the fingerprint as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            yield from extended(table, {"fp": pa.array([fingerprint(shingle_hashes(t, shingle)) for t in utf8(table.column(text_col))], pa.int64())})

    small_batches(docs.sparkSession)
    docs = without(docs, ["fp"])
    return docs.mapInArrow(trimmed(run), schema_with(docs, [T.StructField("fp", T.LongType())]))


def components_of(fps: DataFrame, id_col: str, distance: int) -> DataFrame:
    """fps (stored; with fp) with component_id."""
    key = F.col(f"`{id_col}`")
    distinct = stored(fps.groupBy("fp").agg(F.min(key.cast("long")).alias("rep")), "distinct-fingerprints")
    found = components(links(distinct.where("rep is not null"), distance), "a", "b")
    labelled = distinct.join(found, distinct.rep == found.node, "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return without(fps, ["component_id"]).join(labelled, "fp")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _similar(shingle: int, similarity: float):
    """Pairs with both texts in; the pairs whose sets of shingles are similar enough out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, last = [], (None, np.zeros(0, np.uint64))
            for i, (x, y) in enumerate(zip(utf8(batch.column(2)), utf8(batch.column(3)), strict=True)):
                if last[0] is None or last[0] != y:
                    last = y, np.unique(shingle_hashes(y, shingle))
                mine = np.unique(shingle_hashes(x, shingle))
                both = len(np.intersect1d(mine, last[1], assume_unique=True))
                if both >= similarity * (len(mine) + len(last[1]) - both):
                    kept.append(i)
            if kept:
                yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(kept)) for k in (0, 1)], ["a", "b"])

    return run


def _joined(similarity: float, shingle: int):
    """Rows sorted by component and pair in; of each such group, a forest of the pairs that are similar enough and have an open text out."""

    def links_of(docs: list[int], opens: list[bool], texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        sets = [np.unique(shingle_hashes(t, shingle)) for t in texts]
        size = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), size)
        _, at = np.unique(np.concatenate(sets), return_inverse=True)
        holders = owner[np.argsort(at, kind="stable")]  # by shingle
        end = np.cumsum(np.bincount(at, minlength=1))
        ids, found = np.array(docs), []
        first = np.cumsum(size) - size
        for i in np.flatnonzero(opens).tolist():
            mine = at[first[i] : first[i] + size[i]]
            both = np.bincount(np.concatenate([holders[end[k - 1] if k else 0 : end[k]] for k in mine.tolist()] or [owner[:0]]), minlength=len(sets))
            near = np.flatnonzero(both >= similarity * (size[i] + size - both))
            near = near[ids[near] != ids[i]]
            found.append((np.full(len(near), ids[i]), ids[near]))
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        return forest(a, b) if len(a) else (a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, ([], [], [])

        def flush() -> Iterator[pa.RecordBatch]:
            if any(rows[1]):
                a, b = links_of(*rows)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            for component, pair, doc, rest, text in zip(*(batch.column(i).to_pylist() for i in range(4)), utf8(batch.column(4)), strict=True):
                if (component, pair) != group:
                    yield from flush()
                    group, rows = (component, pair), ([], [], [])
                for column, value in zip(rows, (doc, rest, text), strict=True):
                    column.append(value)
        yield from flush()

    return run


def similar_links(linked: DataFrame, texts: DataFrame, body: DataFrame, shingle: int, similarity: float, block: int = 128) -> DataFrame:
    """(a, b): similar pairs, enough to connect all similar pairs of one component of linked. texts: doc, md5; body: id, md5, text.

    Each link and each text with its component's least is compared first. What that leaves apart from the component's least is open,
    and is compared with every text of the component, block by block: a component that the first comparison joins is done.
    """
    roots = stored(components(linked, "a", "b").select(F.col("node").alias("a"), F.col("root").alias("b")), "candidates")
    pairs = linked.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).union(roots).distinct()
    one = body.join(texts.select(F.col("doc").alias("id"), "md5"), ["id", "md5"]).select("id", "text")
    both = pairs.join(one.select(F.col("id").alias("a"), F.col("text").alias("x")), "a").join(one.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")
    alike = stored(both.select("a", "b", "x", "y").mapInArrow(trimmed(_similar(shingle, similarity)), "a long, b long"), "alike")
    joined = components(alike, "a", "b")
    every = roots.select(F.col("a").alias("doc"), F.col("b").alias("component")).union(roots.select("b", "b").distinct())
    every = every.join(joined, F.col("doc") == F.col("node"), "left").select("doc", "component", (F.coalesce("root", "doc") != F.col("component")).alias("rest"))
    every = stored(every, "members")
    sizes = every.groupBy("component").agg(F.count_if("rest").alias("open"), F.count("*").alias("n")).where("open > 0")
    one_block = F.col("n") <= block
    sizes = sizes.select("component", F.when(one_block, 1).otherwise(F.ceil(F.col("open") / block)).cast("long").alias("opens"), F.when(one_block, 0).otherwise(F.ceil((F.col("n") - F.col("open")) / block)).cast("long").alias("others"))
    blocks = F.col("opens") + F.col("others")
    hashed = F.xxhash64("doc")
    mine = F.when(F.col("rest") | (F.col("others") == 0), F.pmod(hashed, F.col("opens"))).otherwise(F.col("opens") + F.pmod(hashed, F.greatest("others", F.lit(1))))
    rows = every.join(sizes, "component").withColumn("mine", mine)
    meets = F.when(F.col("mine") < F.col("opens"), blocks).otherwise(F.col("opens"))  # two blocks without an open text don't meet
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), meets - 1)))
    rows = rows.select("component", (F.least("mine", "other") * blocks + F.greatest("mine", "other")).alias("pair"), "doc", "rest")
    rows = rows.join(one, F.col("doc") == F.col("id")).select("component", "pair", "doc", "rest", "text").repartition("component", "pair").sortWithinPartitions("component", "pair")
    return alike.union(stored(rows.mapInArrow(trimmed(_joined(similarity, shingle)), "a long, b long"), "alike"))


def _multipliers(count: int) -> np.ndarray:
    """Odd numbers, the same on every machine."""
    return np.array([xxhash.xxh64_intdigest(k.to_bytes(4, "little"), 7) | 1 for k in range(count)], np.uint64)


def band_values(hashes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """For each band a hash of the least values that so many multiplications of the shingles' hashes have: sets of similarity s agree in one with chance s ** rows."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    factors = _multipliers(bands * rows)
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 1024):
        part = hashes[i : i + 1024]
        least = np.minimum(least, (part[None, :] * factors[:, None]).min(axis=1))
    value = np.arange(bands, dtype=np.uint64)
    for column in _mix(least).reshape(bands, rows).T:
        value = _mix(value * np.uint64(0xD6E8FEB86659FD93) + column)
    return value


def band_links(texts: DataFrame, shingle: int, bands: int = 40, rows: int = 8) -> DataFrame:
    """(a, b): enough to connect all texts that agree in a band. texts: doc, text. At similarity 0.8 a pair agrees in none with chance 6e-4."""
    buckets = max(1, -(-texts.count() * bands // 400_000))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column(0).to_numpy()
            values = [band_values(shingle_hashes(t, shingle), bands, rows) for t in utf8(batch.column(1))]
            key, doc = np.concatenate([*values, np.zeros(0, np.uint64)]), np.repeat(docs, [len(v) for v in values])
            bucket = ((_mix(key) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            order = np.lexsort((key, bucket))
            key, doc, bucket = key[order], doc[order], bucket[order]
            cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(key)]
            out = [(int(bucket[c]), pack(key=np.diff(key[c:d], prepend=np.uint64(0)), doc=doc[c:d].view(np.uint64))) for c, d in zip(cuts[:-1], cuts[1:]) if c < d]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.binary())], ["bucket", "payload"])

    def met(_, table):
        released()
        try:
            parts = [unpack(p) for p in table.column("payload").to_pylist()]
            key = np.concatenate([np.cumsum(p["key"], dtype=np.uint64) for p in parts])
            doc = np.concatenate([p["doc"] for p in parts]).view(np.int64)
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order]
            same = np.flatnonzero((key[1:] == key[:-1]) & (doc[1:] != doc[:-1]))
            a, b = forest(doc[same], doc[same + 1]) if len(same) else (doc[:0], doc[:0])
            return pa.table({"a": pa.array(a), "b": pa.array(b)})
        finally:
            trim()

    packed = texts.select("doc", "text").mapInArrow(trimmed(dealt), "bucket int, payload binary")
    return packed.groupBy("bucket").applyInArrow(met, "a long, b long")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, distance: int = 10, similarity: float = 0.8) -> DataFrame:
    """docs without near copies: of each group, the document with the smallest id stays.

    Equal texts are one group, and so are texts with this Jaccard similarity of their sets of shingles if links connect them, directly
    or over others: of fingerprints within the distance, and of texts that agree in one of the independent fingerprints of
    band_links, as the distance alone misses over a third of the pairs at 0.8. All texts of a component of such links are compared,
    but for those that similar texts have joined already. Documents without words are one group, null texts among them. Rows with a null id stay, and
    repeated rows of an id that stays.
    """
    key, text = F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")
    md5 = F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit("null")).cast("binary")).alias("md5")
    fps = fingerprints(docs.select(key, text, md5).where("id is not null"), "text", shingle).select("id", "md5", "fp")
    fps = stored(fps, "fingerprints")
    texts = stored(fps.groupBy("md5").agg(F.min("id").alias("doc"), F.min("fp").alias("fp")), "distinct-texts")
    distinct = stored(texts.groupBy("fp").agg(F.min("doc").alias("rep")), "distinct-fingerprints")
    found = stored(links(distinct, distance), "links")
    same = texts.join(distinct, "fp").where("doc != rep").select(F.col("doc").alias("a"), F.col("rep").alias("b"))
    body = docs.select(key, md5, text).where("id is not null")
    once = body.join(texts.select(F.col("doc").alias("id"), "md5"), ["id", "md5"]).select(F.col("id").alias("doc"), "text")
    linked = stored(found.union(same).union(band_links(once, shingle)), "links")
    alike = similar_links(linked, texts, body, shingle, similarity)
    group = components(alike, "a", "b")
    gone = fps.join(texts.select("md5", "doc"), "md5").join(group, F.col("doc") == F.col("node"), "left").where(F.col("id") != F.coalesce("root", "doc"))
    out = fresh(docs.columns, "wg_gone")
    return docs.join(gone.select(F.col("id").alias(out)).distinct(), F.col(f"`{id_col}`") == F.col(out), "left_anti")
