"""Digests of whole streams, taken as the samples pass: nothing but the digest's state is held."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T


def sample_bytes(x: Column, bits: int) -> Column:
    """Hexadecimal digits of a sample, sign-extended to whole bytes, the lowest first."""
    width = -(-bits // 8)
    unsigned = F.pmod(x, F.lit(1 << (8 * width)))
    return F.concat(*[F.lpad(F.hex(F.shiftright(unsigned, 8 * k) % 256), 2, "0") for k in range(width)])


def stream_md5(blocks: DataFrame, keys: list[str], bits: int, order: str = "frame", value: str = "xs") -> DataFrame:
    """keys, samples and md5: of a stream's interleaved samples as their bytes, in order. blocks: an array of interleaved samples a row.

    A stream's rows go to one task, as a digest has no other order, and pass one by one.
    """
    width = -(-bits // 8)
    rows = blocks.select(*keys, order, F.col(value).cast("array<bigint>").alias(value)).repartition(*keys).sortWithinPartitions(*keys, order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, samples, done = None, hashlib.md5(), 0, []

        def out() -> pa.RecordBatch:
            columns = [pa.array([d[0][i] for d in done], kind) for i, kind in enumerate(kinds)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.string())], [*keys, "samples", "md5"])

        kinds: list[pa.DataType] = []
        for batch in batches:
            kinds = [batch.schema.field(i).type for i in range(len(keys))]
            column = batch.column(len(keys) + 1)
            at, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width]
            for k, key in enumerate(zip(*(batch.column(i).to_pylist() for i in range(len(keys))), strict=True)):
                if key != now:
                    if now is not None:
                        done.append((now, samples, digest.hexdigest()))
                    now, digest, samples = key, hashlib.md5(), 0
                digest.update(flat[at[k] : at[k + 1]].tobytes())
                samples += int(at[k + 1] - at[k])
            if len(done) > 1000:
                yield out()
                done = []
        if now is not None:
            done.append((now, samples, digest.hexdigest()))
            yield out()

    fields = [T.StructField(k, blocks.schema[k].dataType) for k in keys]
    return rows.mapInArrow(run, T.StructType([*fields, T.StructField("samples", T.LongType()), T.StructField("md5", T.StringType())]))


def verified(expected: Column, found: Column) -> Column:
    """Whether a stream's digest is as stated; all zeros state nothing."""
    return (expected == "0" * 32) | (expected == found)
