"""Substring deduplication over a log-structured fingerprint index.

Documents arrive in batches. Tasks cut a batch into blocks of bounded size, keep each block's rows in a file, hash every
window of words and send one entry per distinct hash of a block to the hash's bucket: a hot passage costs one entry a block,
however many of its documents have it. For each bucket a task merges the sorted entries of the batch with the sorted
immutable runs of earlier batches. A window that an earlier document has becomes a claim and goes back to its block; new hashes
become the bucket's part of a new run. Runs of similar size are compacted into one. A manifest, replaced atomically, names the
runs that count.

Blocks then turn their claims into word spans. Consecutive claims on consecutive windows of one block are checked together:
the claimed block compares a digest of the words themselves. Where a check fails, two texts have one hash. All claims on that
hash's first window name the blocks that have it in this batch; these send the texts themselves, which joins resolve. The texts
are kept with the index, as the next batches see only the hash's first window. So results are exact whatever collides, and however much.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from wavegrid.llm import storage
from wavegrid.llm.common import chunks_of, dropped, extended, pack, released, shared_dir, small_batches, split_words, stored, trim, trimmed, unpack, utf8, without

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _deltas(a: np.ndarray) -> np.ndarray:
    return np.diff(a.astype(np.uint64), prepend=np.uint64(0))


def _sums(a: np.ndarray) -> np.ndarray:
    return np.cumsum(a, dtype=np.uint64)


class Block:
    """A block's words: ids that are equal for equal words, and the windows that lie within one document."""

    def __init__(self, texts: list[bytes | None], window: int, seed: int | None):
        """seed: of the windows' hashes; without one there are none."""
        self.ids, self.dictionary, self.starts = split_words(texts)
        self._words = None
        self.counts = np.diff(self.starts)
        inside = np.zeros(len(self.ids) + 1, np.int8)
        long = self.counts >= window
        inside[self.starts[:-1][long]] = 1
        np.add.at(inside, self.starts[1:][long] - window + 1, -1)
        self.at = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8))  # first word of each window
        if seed is None:
            return
        hashes = np.array([xxhash.xxh64_intdigest(w, seed) for w in self.words], np.uint64)
        per_word = hashes[self.ids] if len(self.ids) else np.zeros(0, np.uint64)
        total = np.zeros(max(0, len(self.ids) - window + 1), np.uint64)
        for j, m in enumerate(_mix(np.arange(1, window + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)):
            total += per_word[j : j + len(total)] * m
        self.hashes = _mix(total[self.at])

    @property
    def words(self) -> list[bytes]:
        if self._words is None:
            self._words = self.dictionary.to_pylist()
        return self._words

    def by_hash(self, count: int) -> tuple[np.ndarray, ...]:
        """Of the first windows: hashes in order, their first words, where each distinct hash begins, and the number of distinct hashes before each."""
        order = np.argsort(self.hashes[:count])
        h, at = self.hashes[order], self.at[order]
        begin = np.ones(count, bool)
        begin[1:] = h[1:] != h[:-1]
        return h, at, np.flatnonzero(begin), np.cumsum(begin) - 1

    @staticmethod
    def hashes_of(windows: list[bytes], window: int, seed: int) -> np.ndarray:
        """Of windows' texts."""
        return Block(windows, window, seed).hashes

    def doc_of(self, word: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, word, side="right") - 1

    def text(self, first: int, words: int) -> bytes:
        return b" ".join([self.words[i] for i in self.ids[first : first + words].tolist()])


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of hashes."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


@dataclass
class Index:
    """Of a folder: the manifest's runs, oldest first, with their entries, and those that have texts of colliding hashes.

    Each run has a part for each bucket, empty or not, so a part that is lost raises. Buckets are split in two when the index has grown.
    """

    path: str
    buckets: int
    runs: list[tuple[str, int]] = field(default_factory=list)
    version: int = 0
    collisions: list[str] = field(default_factory=list)

    @staticmethod
    def opened(path: str) -> Index | None:
        if not storage.exists(f"{path}/MANIFEST"):
            return None
        with storage.reading(f"{path}/MANIFEST") as f:
            m = json.loads(f.read())
        return Index(path, m["buckets"], [tuple(r) for r in m["runs"]], m["version"], m.get("collisions", []))

    def commit(self) -> None:
        self.version += 1
        with storage.creating(f"{self.path}/MANIFEST") as out:
            out.write(json.dumps({"version": self.version, "buckets": self.buckets, "runs": self.runs, "collisions": self.collisions}).encode())


def _part(path: str, run: str, bucket: int) -> str:
    return f"{path}/runs/{run}/{bucket:08d}"


def _read_part(path: str, run: str, bucket: int) -> dict[str, np.ndarray]:
    with storage.reading(_part(path, run, bucket)) as f:
        e = unpack(f.read())
    return {"h": _sums(e["h"]), "block": e["block"], "at": e["at"]}


def _write_part(path: str, run: str, bucket: int, h: np.ndarray, block: np.ndarray, at: np.ndarray) -> None:
    with storage.creating(_part(path, run, bucket)) as out:
        out.write(pack(h=_deltas(h), block=block, at=at))


def _block_path(path: str, block: int) -> str:
    return f"{path}/blocks/{block:016x}"


#: Stands for a document of an earlier batch.
EARLIER = -(1 << 63)
#: Rows of checks that a task takes for one block.
CHECKS = 1000
_ENTRIES = "bucket int, block long, payload binary"
_CLAIMS = "block long, n long, payload binary"  # or, without a block, the number of entries that a bucket's part has


def _cut_blocks(path: str, batch: int, id_col: str, text_col: str, window: int, buckets: int, block_bytes: int, seed: int, hash_bits: int):
    """Rows in, entries out. Block ids hold the batch, the task's partition and a count, so a task that runs again makes the same ones."""
    mask = np.uint64((1 << 64) - (1 << (64 - hash_bits)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, table in enumerate(chunks_of(batches, text_col, block_bytes)):
            table = table.sort_by([(id_col, "ascending")])  # nulls stand last
            number = (batch << 48) | (part << 20) | k
            storage.write_table(_block_path(path, number), table)
            block = Block(utf8(table.column(text_col)), window, seed)
            ids = table.column(id_col)
            known = len(ids) - ids.null_count
            live = int(np.searchsorted(block.at, block.starts[known]))
            h, at, begin, _ = block.by_hash(live)
            h, at = h[begin] & mask, np.minimum.reduceat(at, begin) if live else at
            doc_ids = ids.slice(0, known).to_numpy().astype(np.int64).view(np.uint64)
            rows: list[tuple[int, bytes]] = [(-1, b"")]  # a block without windows counts too
            which = bucket_of(h, buckets)
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(which)) + 1, [len(h)]))
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if i < j:
                    mine = np.unique(block.doc_of(at[i:j]))  # no row is longer for documents that have no entry in it
                    rows.append((int(which[i]), pack(h=_deltas(h[i:j]), at=at[i:j], doc=_deltas(doc_ids[mine]), first=_deltas(block.starts[mine]))))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([number] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "block", "payload"])

    return run


def _merge_bucket(path: str, runs: list[str], new: str):
    """Merges a bucket's entries with each other and with the bucket's part of every run; writes the bucket's part of the new run."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        if bucket < 0:
            return pa.table({"block": table.column("block"), "n": pa.array([0] * table.num_rows, pa.int64()), "payload": table.column("payload")})
        parts = []
        for number, payload in sorted(zip(table.column("block").to_pylist(), table.column("payload").to_pylist(), strict=True)):
            e = unpack(payload)
            doc = _sums(e["doc"]).view(np.int64)
            doc = doc[np.searchsorted(_sums(e["first"]), e["at"], side="right") - 1]
            parts.append((_sums(e["h"]), doc, np.full(len(doc), number, np.int64), e["at"].astype(np.int64)))
        h, doc, block, at = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(h)
        h, doc, block, at = h[order], doc[order], block[order], at[order]
        begin = np.ones(len(h), bool)
        begin[1:] = h[1:] != h[:-1]
        starts = np.flatnonzero(begin)
        group = np.cumsum(begin) - 1
        least = np.minimum.reduceat(doc, starts)
        smallest = np.flatnonzero(doc == least[group])
        first = smallest[np.concatenate(([True], group[smallest][1:] != group[smallest][:-1]))]
        to_block, to_at, old = block[first], at[first], np.zeros(len(first), bool)
        unique = h[starts]
        for name in runs:
            e = _read_part(path, name, bucket)
            if not len(e["h"]):
                continue
            i = np.minimum(np.searchsorted(e["h"], unique), len(e["h"]) - 1)
            there = (e["h"][i] == unique) & ~old
            to_block[there], to_at[there] = e["block"][i[there]].astype(np.int64), e["at"][i[there]].astype(np.int64)
            old |= there
        _write_part(path, new, bucket, unique[~old], to_block[~old], to_at[~old])
        tie = ~(old[group] | (doc > least[group]))  # of the least document too: makes nothing a copy, but is checked, as it may be another text
        kept = np.ones(len(h), bool)
        kept[first[~old]] = False
        claimed = np.flatnonzero(kept)
        by = claimed[np.lexsort((at[claimed], block[claimed]))]
        numbers, cuts = np.unique(block[by], return_index=True)
        out = []
        for i in np.split(by, cuts[1:]) if len(by) else []:
            g = group[i]
            out.append(pack(at=_deltas(at[i]), block=to_block[g], to=to_at[g], tie=tie[i]))
        blocks = pa.array([None, *numbers.tolist()], pa.int64())
        return pa.table({"block": blocks, "n": pa.array([int((~old).sum()), *[0] * len(out)], pa.int64()), "payload": pa.array([None, *out], pa.binary())})

    return run


def _claims(payloads: list[bytes]) -> tuple[np.ndarray, ...]:
    """Claiming word, claimed block and word, and whether it is a tie."""
    parts = [unpack(p) for p in payloads if p]
    if not parts:
        return (np.zeros(0, np.int64),) * 4
    at = np.concatenate([_sums(p["at"]) for p in parts]).astype(np.int64)
    block, to, tie = (np.concatenate([p[k] for p in parts]).astype(np.int64) for k in ("block", "to", "tie"))
    order = np.argsort(at, kind="stable")
    return at[order], block[order], to[order], tie[order]


def _each_claim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a claim."""
    for batch in batches:
        for number, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            at, to_block, to, _ = _claims([payload])
            for i in range(0, len(at), 100_000):
                j = slice(i, i + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at[j]), number)), pa.array(at[j]), pa.array(to_block[j]), pa.array(to[j])], ["block", "at", "first_block", "first_at"])


_SPANNED = "block long, kind int, payload binary"  # kind 0: spans of block; 1: checks for block; 2: words of block that begin windows of several texts with one hash


def _digest(text: bytes) -> int:
    return int.from_bytes(xxhash.xxh3_128_digest(text)[:8], "little")


def _span_block(path: str, id_col: str, text_col: str, window: int, seed: int):
    """Claims of a block in, and answers for hashes that several texts have, if any; its word spans out, and without answers the checks that they need of other blocks."""

    def run(table: pa.Table, answers: pa.Table | None = None) -> pa.Table:
        number = table.column("block")[0].as_py()
        at, to_block, to, tie = _claims(table.column("payload").to_pylist())
        rows = storage.read_table(_block_path(path, number))
        block = Block(utf8(rows.column(text_col)), window, seed)
        ids = rows.column(id_col)
        known = len(ids) - ids.null_count
        doc_ids = ids.slice(0, known).to_numpy().astype(np.int64)
        h, mine, begin, group = block.by_hash(int(np.searchsorted(block.at, block.starts[known])))
        leader = np.minimum.reduceat(mine, begin)[group] if len(mine) else mine  # the first window with this hash, for which the block has an entry
        docs, leads = doc_ids[block.doc_of(mine)], doc_ids[block.doc_of(leader)]
        claimed = np.zeros(len(block.ids) + 1, bool)
        claimed[at[tie == 0]] = True
        remove = (docs > leads) | claimed[leader]
        out: list[tuple[int, int, bytes]] = []
        if answers is None:
            same, other = np.ones(len(mine), bool), np.flatnonzero(leader != mine)
            for j in range(window):
                same[other] &= block.ids[mine[other] + j] == block.ids[leader[other] + j]
            if not same.all():
                out.append((number, 2, pack(at=_deltas(np.unique(leader[~same])))))
        else:
            texts = dict(zip(answers.column("words").to_pylist(), answers.column("doc").to_pylist(), strict=True))
            for i in np.flatnonzero(np.isin(leader, answers.column("at").to_numpy())).tolist():
                remove[i] = texts[block.text(int(mine[i]), window)] < docs[i]
        flags = np.zeros(len(block.ids) + 1, np.int32)
        np.add.at(flags, mine[remove], 1)
        np.add.at(flags, mine[remove] + window, -1)
        hit = np.cumsum(flags[:-1]) > 0
        edge = np.ones(len(hit) + 1, bool)
        edge[1:-1] = hit[1:] != hit[:-1]
        edge[block.starts] = True  # a span lies within one document
        edges = np.flatnonzero(edge)
        a, b = edges[:-1], edges[1:]
        a, b = a[hit[a]], b[hit[a]]
        out.append((number, 0, pack(start=_deltas(a), length=b - a)))
        if len(at) and answers is None:
            cut = np.ones(len(at), bool)
            cut[1:] = (at[1:] != at[:-1] + 1) | (to_block[1:] != to_block[:-1]) | (to[1:] != to[:-1] + 1)
            s = np.flatnonzero(cut)
            length = np.diff(np.append(s, len(at)))
            at, to_block, to = at[s], to_block[s], to[s]
            digests = np.array([_digest(block.text(i, n + window - 1)) for i, n in zip(at.tolist(), length.tolist(), strict=True)], np.uint64)
            order = np.argsort(to_block, kind="stable")
            targets, begins = np.unique(to_block[order], return_index=True)
            for target, i in zip(targets.tolist(), np.split(order, begins[1:]), strict=True):
                out.append((target, 1, pack(to=to[i], length=length[i], digest=digests[i], at=at[i], block=np.full(len(i), number))))
        return pa.table({"block": pa.array([r[0] for r in out], pa.int64()), "kind": pa.array([r[1] for r in out], pa.int32()), "payload": pa.array([r[2] for r in out], pa.binary())})

    return run


def _check_block(path: str, text_col: str, window: int):
    """Checks for a block in; the claims that fail out."""

    def run(table: pa.Table) -> pa.Table:
        number = table.column("block")[0].as_py()
        block = Block(utf8(storage.read_table(_block_path(path, number)).column(text_col)), window, None)
        failed: list[tuple[int, int, int]] = []
        for payload in table.column("payload").to_pylist():
            c = unpack(payload)
            for to, n, digest, at, source in zip(*(c[k].tolist() for k in ("to", "length", "digest", "at", "block")), strict=True):
                if _digest(block.text(to, n + window - 1)) != digest:
                    failed.append((source, at, n))
        return pa.table({k: pa.array([f[i] for f in failed], pa.int64()) for i, k in enumerate(("block", "at", "n"))})

    return run


def _window_texts(path: str, id_col: str, text_col: str, window: int, seed: int, batch: int):
    """Words of a block in, with their hash's first window; each distinct text out of the block's windows with such a word's hash, and the earliest document that has it."""

    def run(table: pa.Table) -> pa.Table:
        number = table.column("block")[0].as_py()
        rows = storage.read_table(_block_path(path, number))
        block, ids = Block(utf8(rows.column(text_col)), window, seed), rows.column(id_col)
        at, hashes = block.at, block.hashes
        first = {(b, a, w) for b, a, w in zip(*(table.column(c).to_pylist() for c in ("first_block", "first_at", "at")), strict=True)}
        wanted: dict[int, list[tuple[int, int, int]]] = {}
        for b, a, w in sorted(first):
            wanted.setdefault(int(hashes[np.searchsorted(at, w)]), []).append((b, a, w))
        found: dict[tuple, int] = {}
        for i in np.flatnonzero(np.isin(hashes, np.array(list(wanted), np.uint64))).tolist():
            doc = ids[int(block.doc_of(at[i]))].as_py()
            if doc is not None:
                text = block.text(int(at[i]), window)
                for key in wanted[int(hashes[i])]:
                    found[*key, text] = min(doc if number >> 48 == batch else EARLIER, found.get((*key, text), doc))
        return pa.table({"first_block": pa.array([k[0] for k in found], pa.int64()), "first_at": pa.array([k[1] for k in found], pa.int64()), "block": pa.array([number] * len(found), pa.int64()),
                         "at": pa.array([k[2] for k in found], pa.int64()), "words": pa.array([k[3] for k in found], pa.binary()), "doc": pa.array(list(found.values()), pa.int64())})

    return run


_TEXTS = "first_block long, first_at long, block long, at long, words binary, doc long"


def _answers(spark: SparkSession, index: Index, run: str, batch: int, claims: DataFrame, failed: DataFrame, odd: DataFrame, id_col: str, text_col: str, window: int, seed: int, tasks: int) -> DataFrame:
    """(block, at, words, doc), stored: for windows of this batch's blocks whose hash several texts have, the text and its earliest document.

    A hash is named by its first window, which all claims on it have. claims, failed (block, at, n) and odd (block, payload) are
    stored. The texts are written to the index, for batches to come.
    """
    unpacked = odd.mapInArrow(_each_position, "block long, at long")
    places = failed.select("block", F.explode(F.sequence("at", F.col("at") + F.col("n") - 1)).alias("at")).union(unpacked).distinct()
    each = claims.where("block is not null").select("block", "payload").mapInArrow(trimmed(_each_claim), "block long, at long, first_block long, first_at long")
    named = places.join(each, ["block", "at"], "left").select(F.coalesce("first_block", "block").alias("first_block"), F.coalesce("first_at", "at").alias("first_at")).distinct()
    named = stored(named, "substring-collisions")
    members = each.join(named, ["first_block", "first_at"]).select("first_block", "first_at", "block", "at")
    members = members.union(named.select("first_block", "first_at", F.col("first_block").alias("block"), F.col("first_at").alias("at")))
    texts = stored(members.repartition(tasks, "block").groupBy("block").applyInArrow(_by_group(_window_texts(index.path, id_col, text_col, window, seed, batch)), _TEXTS), "substring-texts")
    every = texts.select("first_block", "first_at", "words", "doc")
    for earlier in index.collisions:
        known = spark.read.schema("first_block long, first_at long, words binary").parquet(f"{index.path}/collisions/{earlier}")
        every = every.union(known.join(named, ["first_block", "first_at"], "left_semi").withColumn("doc", F.lit(EARLIER)))
    first = stored(every.groupBy("first_block", "first_at", "words").agg(F.min("doc").alias("doc")), "substring-texts")
    first.drop("doc").write.mode("overwrite").parquet(f"{index.path}/collisions/{run}")
    index.collisions.append(run)
    mine = texts.where(F.shiftright("block", 48) == batch).drop("doc")
    return stored(mine.join(first, ["first_block", "first_at", "words"]).select("block", "at", "words", "doc"), "substring-answers")


def _each_position(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for number, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            at = _sums(unpack(payload)["at"]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), number)), pa.array(at)], ["block", "at"])


def _compact_bucket(path: str, runs: list[str], new: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket in batch.column(0).to_pylist():
                parts = [_read_part(path, r, bucket) for r in runs]
                h, block, at = (np.concatenate([p[k] for p in parts]) for k in ("h", "block", "at"))
                order = np.argsort(h, kind="stable")
                _write_part(path, new, bucket, h[order], block[order], at[order])
                yield pa.RecordBatch.from_arrays([pa.array([len(h)], pa.int64())], ["n"])

    return run


def _split_bucket(path: str, run_name: str, new: str, buckets: int):
    """Each part of a run becomes two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket in batch.column(0).to_pylist():
                e = _read_part(path, run_name, bucket)
                middle = int(np.searchsorted(bucket_of(e["h"], 2 * buckets), 2 * bucket + 1))
                for half, i in ((0, slice(0, middle)), (1, slice(middle, None))):
                    _write_part(path, new, 2 * bucket + half, e["h"][i], e["block"][i], e["at"][i])
                yield pa.RecordBatch.from_arrays([pa.array([len(e["h"])], pa.int64())], ["n"])

    return run


def _over_buckets(spark: SparkSession, index: Index, task) -> int:
    """Runs a task for each bucket; the sum of what they return."""
    ids = spark.range(0, index.buckets, 1, min(index.buckets, max(4, spark.sparkContext.defaultParallelism * 2)))
    return int(ids.mapInArrow(trimmed(task), "n long").agg(F.sum("n")).first()[0] or 0)


def _gone(index: Index, runs: list[tuple[str, int]]) -> None:
    """Deletes runs that no manifest names any more."""
    for r, _ in runs:
        where, path = storage.located(f"{index.path}/runs/{r}")
        if storage.exists(f"{index.path}/runs/{r}"):
            where.delete_dir(path)


def _compact(spark: SparkSession, index: Index, ratio: float, most: int) -> None:
    """Size-tiered: while the newest run has at least 1 / ratio of the entries of the one before it, the two become one. Then buckets are split until they have most entries on average, at most."""
    while len(index.runs) > 1 and index.runs[-1][1] * ratio >= index.runs[-2][1]:
        old, new = index.runs[-2:], f"c{index.version + 1:06d}"
        n = _over_buckets(spark, index, _compact_bucket(index.path, [r for r, _ in old], new))
        if n != sum(size for _, size in old):
            raise RuntimeError("a compaction has lost entries")
        index.runs[-2:] = [(new, n)]
        index.commit()
        _gone(index, old)
    while sum(n for _, n in index.runs) > index.buckets * most:
        old, named = index.runs, []
        for k, (r, n) in enumerate(old):
            named.append((f"s{index.version + 1:06d}-{k}", n))
            _over_buckets(spark, index, _split_bucket(index.path, r, named[-1][0], index.buckets))
        index.runs, index.buckets = named, 2 * index.buckets
        index.commit()
        _gone(index, old)


def _completed(spark: SparkSession, index: Index, new: str, claims: DataFrame) -> int:
    """The entries of a new run. Buckets without entries get an empty part; parts that the merge has written must be there, whole."""
    path = index.path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket in batch.column(0).to_pylist():
                n = -1
                if storage.exists(_part(path, new, bucket)):
                    n = len(_read_part(path, new, bucket)["h"])
                else:
                    _write_part(path, new, bucket, *(np.zeros(0, np.uint64),) * 3)
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    wanted = claims.where("block is null").agg(F.count("*"), F.sum("n")).first()
    n = _over_buckets(spark, index, run)
    if n != (wanted[1] or 0) - (index.buckets - wanted[0]):
        raise RuntimeError(f"parts of the run {new} are lost")
    return wanted[1] or 0


def _apply(path: str, text_col: str):
    """Block numbers with their spans in; the block's rows with n_words, n_removed and clean_text out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = storage.read_table(_block_path(path, number))
                spans = unpack(payload)
                a = _sums(spans["start"]).astype(np.int64)
                b = a + spans["length"].astype(np.int64)
                texts = utf8(rows.column(text_col))
                n_words, n_removed, clean, base, i = [], [], [], 0, 0
                for text in texts:
                    words = text.split() if text else []
                    n, gone, mine = len(words), 0, []
                    while i < len(a) and a[i] < base + n:
                        mine.append((int(a[i]) - base, int(b[i]) - base))
                        gone += mine[-1][1] - mine[-1][0]
                        i += 1
                    clean.append(_without(text, mine) if mine else text)
                    n_words.append(n)
                    n_removed.append(gone)
                    base += n
                if rows.num_rows:
                    yield from extended(rows, {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "clean_text": pa.array(clean, pa.binary()).cast(pa.string())})

    return run


def _without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """text without the words of the spans and what stands between them."""
    table = np.zeros(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    inside = np.concatenate(([False], ~table[np.frombuffer(text, np.uint8)], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    first, after = edges[::2], edges[1::2]
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at : first[a]])
        at = int(after[b - 1])
    return b"".join([*kept, text[at:]])


def dedup_substrings(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 13, batches: int = 3, index_path: str | None = None,
    block_bytes: int = 3 << 20, bucket_bytes: int = 10 << 20, ratio: float = 2.0, seed: int = 0, hash_bits: int = 64,
) -> DataFrame:
    """docs with n_words, n_removed and clean_text: the text without each word that a window of so many words covers which also starts in an earlier document.

    Earlier: in an earlier call on the same index_path, or with a smaller id. One call's rows are dealt into batches by ranges of
    ids; batches changes how the work is cut, not the result. index_path: an index to go on with; a new one is made where none is. A file of the index that is lost raises.
    docs is stored first unless it is a plain scan of files, as blocks are made by position.
    Nulls: a null text has no words and clean text null; rows with a null id keep their text and make nothing a copy. Rows with equal
    ids are not earlier than each other. Columns named like a result are replaced.
    A text of any length stays in one block. Windows are judged on the texts as they come, not on what is left of them.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = without(docs, ["n_words", "n_removed", "clean_text"])
    if "Exchange" in docs._jdf.queryExecution().executedPlan().toString() or not docs.inputFiles():
        docs = stored(docs, "substring-docs")
    path = index_path or shared_dir(spark, "substring-index")
    key = F.col(f"`{id_col}`")
    fractions = [k / batches for k in range(1, batches)]
    size, cuts, nulls = docs.agg(F.sum(F.octet_length(f"`{text_col}`")), F.percentile_approx(key.cast("long"), F.array(*map(F.lit, fractions or [0.5])), 1000), F.count_if(key.isNull())).first()
    index = Index.opened(path) or Index(path, max(1, -(-(size or 0) // bucket_bytes)))
    cuts = sorted(set(cuts or [])) if fractions else []
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size or 0) // (2 * block_bytes)))
    kept = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false")
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")  # a batch's shuffle goes when the batch is done
    done: list[DataFrame] = []
    try:
        for k in range(len(cuts) + 1):
            low, high = (cuts[k - 1] if k else None), (cuts[k] if k < len(cuts) else None)
            mine = F.lit(True)
            mine = mine & (key > low) if low is not None else mine
            mine = mine & (key <= high) if high is not None else mine
            part = docs.where(mine | key.isNull() if k == 0 and nulls else mine) if cuts else docs
            new = f"r{index.version + 1:06d}"
            entries = part.mapInArrow(trimmed(_cut_blocks(path, index.version + 1, id_col, text_col, window, index.buckets, block_bytes, seed, hash_bits)), _ENTRIES)
            batch = index.version + 1
            claims = entries.groupBy("bucket", F.when(F.col("bucket") < 0, F.col("block"))).applyInArrow(_by_group(_merge_bucket(path, [r for r, _ in index.runs], new)), _CLAIMS)
            claims_path = shared_dir(spark, "substring-claims")
            claims.write.parquet(claims_path)
            claims = spark.read.schema(_CLAIMS).parquet(claims_path)
            entered = _completed(spark, index, new, claims)
            blocks = claims.where("block is not null").drop("n").repartition(tasks, "block")  # a number of partitions of one's own: a block's claims are small, and its work isn't
            span = _span_block(path, id_col, text_col, window, seed)
            spans = stored(blocks.groupBy("block").applyInArrow(_by_group(span), _SPANNED), "substring-spans")
            checks = spans.where("kind = 1")
            often = checks.groupBy("block").agg(F.count("*").alias("n")).where(f"n > {CHECKS}")  # a hot passage's block is read by several tasks
            checks = checks.join(often, "block", "left").withColumn("part", F.pmod(F.xxhash64("payload"), F.coalesce(F.ceil(F.col("n") / CHECKS), F.lit(1))))
            failed = stored(checks.repartition(tasks, "block", "part").groupBy("block", "part").applyInArrow(_by_group(_check_block(path, text_col, window)), "block long, at long, n long"), "substring-failed")
            odd = spans.where("kind = 2").select("block", "payload")
            spans = spans.where("kind = 0").select("block", "payload")
            if failed.limit(1).count() or odd.limit(1).count():
                answers = _answers(spark, index, new, batch, claims, failed, odd, id_col, text_col, window, seed, tasks)
                again = blocks.join(answers.select("block").distinct(), "block", "left_semi").groupBy("block").cogroup(answers.groupBy("block"))
                again = stored(again.applyInArrow(_answered(span), _SPANNED).select("block", "payload"), "substring-spans")
                spans = spans.join(again.select("block"), "block", "left_anti").union(again)
            done.append(spans)
            dropped(claims, claims_path)
            index.runs.append((new, entered))
            index.commit()
            _compact(spark, index, ratio, max(1, bucket_bytes // 4))
    finally:
        spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", kept)
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("clean_text", T.StringType())])
    return every.mapInArrow(trimmed(_apply(path, text_col)), schema)


def _answered(span):
    def run(claims: pa.Table, answers: pa.Table) -> pa.Table:
        return span(claims, answers)

    return run


def _by_group(function):
    """For applyInArrow; memory goes back to the system after each eighth group, as taking it anew costs time."""
    groups = 0

    def run(key, table):
        nonlocal groups
        released()
        try:
            return function(table)
        finally:
            groups += table.nbytes > 1000
            if groups == 8:
                groups = 0
                trim()

    return run


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    kept = F.trim(F.regexp_replace(F.coalesce("clean_text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2(kept, 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS t FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
least_doc AS (SELECT t, min(doc_id) AS d FROM win GROUP BY t),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM (SELECT win.doc_id, win.i FROM win JOIN least_doc ON win.t = least_doc.t WHERE least_doc.d < win.doc_id)),
word AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS x FROM w),
kept AS (SELECT word.doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY word.p) AS t FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.p = gone.p WHERE gone.p IS NULL GROUP BY word.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""
