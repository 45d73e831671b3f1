"""Benchmark decontamination: an FM-index per training shard, searched backwards for every window of every benchmark item.

Each task cuts its documents into shards of bounded size and indexes the words of each: suffix array, wavelet matrix of the
transformed text, sampled suffix positions. All windows are searched at once; their occurrences are located by walking to a
sampled position, and overlapping ones merge into removal spans. Documents are never shuffled.

The items come in blocks of bounded size. Each block's windows are broadcast, as arrays of word numbers, and searched against all shards in a
pass of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from wavegrid.llm.common import FOLD, chunks_of, extended, fresh, schema_with, small_batches, stored, trimmed, utf8, without
from wavegrid.llm.fm_index import FMIndex


def windows_of(items: list[tuple[str, bytes]], window: int) -> tuple[list[tuple[bytes, ...]], list[list[str]]]:
    """The distinct windows of the items, and for each the ids that have it."""
    found: dict[tuple[bytes, ...], dict[str, None]] = {}
    for item, text in items:
        words = text.translate(FOLD).split()
        for i in range(max(1, len(words) - window + 1) if words else 0):
            found.setdefault(tuple(words[i : i + window]), {})[item] = None
    return list(found), [list(x) for x in found.values()]


@dataclass
class Windows:
    """What windows_of() gives, in arrays."""

    words: list[bytes]  # distinct
    rows: np.ndarray  # a row a window: its words' places in words, right-aligned; -1 before a shorter one
    items: list[str]  # distinct
    begins: np.ndarray  # where each window's items begin in held, and their number
    held: np.ndarray  # places in items

    @staticmethod
    def of(windows: list[tuple[bytes, ...]], ids: list[list[str]], width: int) -> Windows:
        number: dict[bytes, int] = {}
        rows = np.full((len(windows), width), -1, np.int32)
        for k, words in enumerate(windows):
            rows[k, width - len(words) :] = [number.setdefault(w, len(number)) for w in words]
        names: dict[str, int] = {}
        held = np.fromiter((names.setdefault(i, len(names)) for some in ids for i in some), np.int32)
        return Windows(list(number), rows, list(names), np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int64), held)

    @property
    def lengths(self) -> np.ndarray:
        return np.count_nonzero(self.rows >= 0, axis=1)


def hits(texts: list[bytes | None], windows: Windows, sample: int) -> tuple[np.ndarray, np.ndarray, list[set[str]]]:
    """Of one shard: words of each text, a hit flag for each word of all texts, item ids of each text."""
    vocabulary: dict[bytes, int] = {}
    ids: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = text.translate(FOLD).split() if text else []
        counts[i] = len(words)
        ids += [vocabulary.setdefault(w, len(vocabulary) + 2) for w in words]
        ids.append(1)  # ends a text; no window has it
    items: list[set[str]] = [set() for _ in texts]
    starts = np.concatenate(([0], np.cumsum(counts + 1)))  # in ids
    flags = np.zeros(len(ids) + 1, np.int32)
    here = np.array([*(vocabulary.get(w, 0) for w in windows.words), -1], np.int64)  # at -1: what stands before a shorter window
    rows = here[windows.rows]
    which = np.flatnonzero((rows != 0).all(axis=1))
    if len(which) and vocabulary:
        rows = rows[which]
        index = FMIndex(np.array(ids, np.int64), len(vocabulary) + 2, sample)
        low, high = index.intervals(rows)
        count = high - low
        if total := int(count.sum()):
            pattern = np.repeat(np.arange(len(rows)), count)
            offset = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
            at = index.locate(low[pattern] + offset)
            np.add.at(flags, at, 1)
            np.add.at(flags, at + windows.lengths[which][pattern], -1)
            text_of = np.searchsorted(starts, at, side="right") - 1
            for pair in np.unique(text_of * len(rows) + pattern).tolist():
                k = which[pair % len(rows)]
                items[pair // len(rows)].update(windows.items[i] for i in windows.held[windows.begins[k] : windows.begins[k + 1]].tolist())
    hit = np.cumsum(flags[:-1]) > 0
    return counts, np.delete(hit, starts[1:] - 1), items


def word_spans(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word and the byte after it."""
    inside = np.concatenate(([False], np.frombuffer(text.translate(FOLD), np.uint8) != 0x20, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def cut(text: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """text without the words of the spans [start, end) and what stands between them."""
    first, after = word_spans(text)
    kept, at = [], 0
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        kept.append(text[at : first[a]])
        at = int(after[b - 1])
    return b"".join([*kept, text[at:]])


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
    return edges[::2], edges[1::2]


def _item_blocks(items: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks whose texts have about block_bytes at most; their sizes are summed first."""
    rows = items.select(F.col(f"`{item_col}`").cast("string").alias("i"), F.col(f"`{text_col}`").alias("t")).where("i is not null and t is not null")
    size = rows.agg(F.sum(F.octet_length("t") + F.octet_length("i"))).first()[0] or 0
    blocks = max(1, -(-2 * size // block_bytes)) if size > block_bytes else 1
    for b in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b)
        yield [(r.i, r.t.encode()) for r in part.collect()]


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10,
    with_clean_text: bool = False, shard_bytes: int = 4 << 20, sample: int = 16, block_bytes: int = 2 << 20,
) -> DataFrame:
    """docs with n_words, n_hit, items (ids, sorted as strings) and spans (word positions [start, end) to remove); with_clean_text adds clean_text.

    Words: A-Z lower-cased, runs of digits, letters and non-ASCII characters. An item of fewer words than window, but not none, is one window.
    Nulls: a null text has no words and clean text null; null items and items with a null id are ignored. An empty benchmark hits nothing.
    Items with the same id count once, and repeated documents each get their row. Columns named like a result are replaced.
    A text of any length stays in one shard. block_bytes: of the items' texts that are searched at once; their windows, in arrays of numbers, are
    about nine times as large when they are broadcast. clean_text drops each span with what stands between its words.
    """
    spark = docs.sparkSession
    small_batches(spark)
    results = ["n_words", "n_hit", "items", "spans"] + ["clean_text"] * with_clean_text
    df = without(docs, [r for r in results if r != text_col.lower()])
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    hidden = [fresh(df.columns, f"wg_{k}") for k in ("words", "items", "flags")]
    fields = [T.StructField(name, kind) for name, kind in zip(hidden, (T.LongType(), T.ArrayType(T.StringType()), T.BinaryType()), strict=True)]
    passes = 0
    for items in _item_blocks(benchmark, item_col, item_text_col, block_bytes):
        sent = spark.sparkContext.broadcast(Windows.of(*windows_of(items, window), window))
        schema = df.schema if passes else schema_with(df, fields)
        df = df.mapInArrow(trimmed(_search(text_col, hidden, sent, shard_bytes, sample)), schema)
        passes += 1
        if passes > 1:
            df = stored(df, "decontaminate")
    return df.mapInArrow(trimmed(_spans(text_col, hidden, with_clean_text)), T.StructType([f for f in df.schema.fields if f.name not in hidden] + [
        T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", span)]
        + [T.StructField("clean_text", T.StringType())] * with_clean_text))


def _search(text_col: str, hidden: list[str], sent, shard_bytes: int, sample: int):
    n_words, found, marks = hidden

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in chunks_of(batches, text_col, shard_bytes):
            counts, flags, items = hits(utf8(shard.column(text_col)), sent.value, sample)
            ends = np.cumsum(counts)
            packed = [zlib.compress(np.packbits(flags[e - n : e]).tobytes(), 1) if flags[e - n : e].any() else b"" for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
            if marks in shard.column_names:
                for i, (old, held) in enumerate(zip(shard.column(marks).to_pylist(), shard.column(found).to_pylist(), strict=True)):
                    items[i].update(held)
                    if old and packed[i]:
                        packed[i] = zlib.compress((np.frombuffer(zlib.decompress(old), np.uint8) | np.frombuffer(zlib.decompress(packed[i]), np.uint8)).tobytes(), 1)
                    packed[i] = packed[i] or old
                shard = shard.drop_columns(hidden)
            yield from extended(shard, {n_words: pa.array(counts), found: pa.array([sorted(x) for x in items], pa.list_(pa.string())), marks: pa.array(packed, pa.binary())})

    return run


def _spans(text_col: str, hidden: list[str], with_clean_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            words, items, flags = table.column(hidden[0]).to_pylist(), table.column(hidden[1]), table.column(hidden[2]).to_pylist()
            texts = utf8(table.column(text_col)) if with_clean_text else [None] * len(words)
            n_hit, starts, ends, offsets, clean = [], [], [], [0], []
            for n, packed, text in zip(words, flags, texts, strict=True):
                hit = np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8), count=n).astype(bool) if packed else np.zeros(0, bool)
                a, b = _runs(hit)
                starts.append(a)
                ends.append(b)
                offsets.append(offsets[-1] + len(a))
                n_hit.append(int(hit.sum()))
                clean.append(text if text is None or not len(a) else cut(text, a, b))
            spans = pa.StructArray.from_arrays([pa.array(np.concatenate([*x, np.zeros(0, np.int64)]), pa.int64()).cast(pa.int32()) for x in (starts, ends)], ["start", "end"])
            table = table.drop_columns(hidden)
            more = {"n_words": pa.array(words, pa.int64()), "n_hit": pa.array(n_hit, pa.int64()), "items": items, "spans": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans)}
            if with_clean_text:
                more["clean_text"] = pa.array(clean, pa.binary()).cast(pa.string())
            yield from extended(table, more)

    return run


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


#: Words by RE2; the window joins run on the words' own text.
ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE item_id IS NOT NULL),
bw AS (
  SELECT DISTINCT item, least(len(ws), 10) AS n, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS win
  FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w CROSS JOIN lens WHERE len(ws) >= n)),
m AS (SELECT dw.doc_id, dw.i, dw.n, bw.item FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
h AS (SELECT doc_id, CAST(count(DISTINCT p) AS BIGINT) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM m)) GROUP BY doc_id),
it AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN h ON w.doc_id = h.doc_id LEFT JOIN it ON w.doc_id = it.doc_id
"""
