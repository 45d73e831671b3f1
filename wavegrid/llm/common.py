"""What the operators of this subpackage share: the shared folder, Arrow helpers and word tables."""

from __future__ import annotations

import ctypes
import gc
import json
import re
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterable, Iterator
from functools import wraps
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

#: Bytes that separate words once A-Z are lower-cased: [\x00-\x2F\x3A-\x60\x7B-\x7F].
_SEPARATORS = [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]


def _folding() -> bytes:
    table = bytearray(range(256))
    for b in _SEPARATORS:
        table[b] = 0x20
    for b in range(0x41, 0x5B):
        table[b] = b + 0x20
    return bytes(table)


#: For bytes.translate(): lower-cases A-Z and turns each separator into a space.
FOLD = _folding()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder's path below spark.checkpoint.dir, which driver and executors share. If that is unset, below a temporary folder where all is one
    machine and one process; elsewhere each machine would have another such folder, so it raises."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext._jsc.sc()
        if not context.getCheckpointDir().isDefined():
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="wavegrid-"))
        base = context.getCheckpointDir().get()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession, size: str = "8m") -> None:
    """From now on the session sends Python workers batches of about this size, so that long texts take little memory on both sides."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


_HELD: tuple[tuple[Hashable, ...] | None, Any] = (None, None)


def held(key: tuple[Hashable, ...], make: Callable[[], Any]) -> Any:
    """What make() gives, kept by the worker process for its next tasks until another key is asked for, or a task of an operator with another key begins."""
    global _HELD
    if _HELD[0] != key:
        _HELD = (None, None)
        _HELD = (key, make())
    return _HELD[1]


def released(keeps: str | None = None) -> None:
    """Forgets what held() keeps, unless its key begins with keeps."""
    global _HELD
    if _HELD[0] is not None and (keeps is None or _HELD[0][0] != keeps):
        _HELD = (None, None)
        gc.collect()
        trim()


def trimmed(run, keeps: str | None = None):
    """A task's function that gives its memory back to the system when it ends; the worker process lives on. What an earlier operator's tasks
    hold goes before it begins, unless its key begins with keeps."""

    @wraps(run)
    def task(batches):
        released(keeps)
        try:
            yield from run(batches)
        finally:
            gc.collect()
            trim()

    return task


def trim() -> None:
    """Gives freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet into the shared folder and read again, so that later plans don't depend on executors that may be lost. discarded() deletes it."""
    path = shared_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discarded(*frames: DataFrame) -> None:
    """Deletes what stored() has written for these, which no plan that is still to run may read."""
    for df in frames:
        dropped(df, df._stored_at)


def dropped(df: DataFrame, path: str) -> None:
    """Deletes a folder that stored() or an operator has made."""
    jvm = df.sparkSession._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def limited(df: DataFrame, most: int) -> DataFrame:
    """df, marked to be broadcast if it has at most so many rows; else joined by a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def fresh(names: Iterable[str], wanted: str) -> str:
    """wanted, or with underscores before it until no name equals it (Spark's names ignore case)."""
    taken = {n.lower() for n in names}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """df without the columns that a result's columns replace."""
    gone = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone])


def schema_with(df: DataFrame, fields: list[T.StructField]) -> T.StructType:
    return T.StructType([*df.schema.fields, *fields])


def utf8(column: pa.Array) -> list[bytes | None]:
    """A string or binary column's values as bytes, without decoding them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        return column.to_pylist()
    binary = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.view(binary).to_pylist()


def chunks_of(batches: Iterable[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.Table]:
    """The batches' rows in order, as tables whose texts have about limit bytes at most (one row may have more)."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        text = batch.column(batch.schema.get_field_index(column))
        lengths = np.nan_to_num(pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
        begin = 0
        for i, n in enumerate(lengths.tolist()):
            if size and size + n > limit:
                if i > begin:
                    held.append(batch.slice(begin, i - begin))
                yield pa.Table.from_batches(held)
                held, size, begin = [], 0, i
            size += n + 16
        if begin < batch.num_rows:
            held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held)


def extended(table: pa.Table, columns: dict[str, pa.Array]) -> Iterator[pa.RecordBatch]:
    """The table with more columns, as batches for mapInArrow."""
    for name, values in columns.items():
        table = table.append_column(name, values)
    yield from table.combine_chunks().to_batches()


def list_array(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))


_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def split_words(texts: list[bytes | None]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Runs of what isn't ASCII white space: for each word of all texts its place among the distinct words; these; where each text's words begin, and their number."""
    data = np.frombuffer(b"\n".join([t or b"" for t in texts]), np.uint8)
    letters = ~_BLANK[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], letters, [False])).astype(np.int8)))
    begins, lengths = edges[::2], edges[1::2] - edges[::2]
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data[letters])]).dictionary_encode()
    ends = np.cumsum([len(t or b"") + 1 for t in texts])
    starts = np.concatenate(([0], np.searchsorted(begins, ends))).astype(np.int64)
    return words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary, starts


def pack(**arrays: np.ndarray) -> bytes:
    """Unsigned integer arrays; each is cut into planes of bytes, without those that are zero, and compressed."""
    parts, head = [], []
    for name, a in arrays.items():
        a = np.ascontiguousarray(a, np.uint64)
        planes = a.view(np.uint8).reshape(-1, 8).T
        used = 8 - next((i for i in range(8) if planes[7 - i].any()), 8) if len(a) else 0
        head.append((name, len(a), used))
        parts += [np.ascontiguousarray(planes[i]).tobytes() for i in range(used)]
    top = json.dumps(head).encode()
    return zstandard.ZstdCompressor(level=1).compress(b"".join([len(top).to_bytes(4, "little"), top, *parts]))


def unpack(data: bytes) -> dict[str, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int.from_bytes(raw[:4], "little")
    at, found = 4 + n, {}
    for name, length, used in json.loads(raw[4:at]):
        planes = np.zeros((length, 8), np.uint8)
        for i in range(used):
            planes[:, i] = np.frombuffer(raw, np.uint8, length, at)
            at += length
        found[name] = planes.reshape(-1).view(np.uint64)
    return found
