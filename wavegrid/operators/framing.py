"""Count windows over ordered streams: fixed and scheduled frames, and packing of frames into batches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql import types as T

from wavegrid.functions.columns import big
from wavegrid.operators.running import prefix

#: Fixed values of the presets: block size, fixed order, LPC order, partition order, mid/side.
LEVELS = [
    (0, 576, 4, 0, 0, False), (1, 576, 4, 0, 1, True), (2, 1152, 4, 8, 2, True), (3, 1152, 4, 8, 2, True), (4, 2304, 4, 12, 3, True),
    (5, 2304, 4, 12, 4, True), (6, 4096, 4, 16, 5, True), (7, 4096, 4, 32, 6, True), (8, 4096, 4, 32, 6, True),
]
#: Frames and samples of a batch.
BATCH_FRAMES, BATCH_SAMPLES = 256, 1 << 20


def levels(spark: SparkSession) -> DataFrame:
    """(level, block_size, max_fixed_order, max_lpc_order, max_partition_order, mid_side)"""
    names = ["level", "block_size", "max_fixed_order", "max_lpc_order", "max_partition_order"]
    schema = T.StructType([T.StructField(n, T.LongType()) for n in names] + [T.StructField("mid_side", T.BooleanType())])
    return spark.createDataFrame(LEVELS, schema)


def fixed(samples: DataFrame, size: int, keys: list[str], index: str = "i") -> DataFrame:
    """samples with frame, j (position in the frame) and n (the frame's samples)."""
    out = samples.withColumn("frame", F.expr(f"{index} div {size}")).withColumn("j", F.col(index) % size)
    return out.withColumn("n", F.count("*").over(W.partitionBy(*keys, "frame")))


def fixed_plan(totals: DataFrame, size: int, total: str = "total") -> DataFrame:
    """totals with a row for each frame: frame, sample_offset and block_size; the last frame may be short. No samples are read."""
    count = F.ceil(F.col(total) / size).cast("bigint")
    frames = F.when(count > 0, F.sequence(F.lit(0).cast("bigint"), count - 1))
    out = totals.withColumn("frame", F.explode(frames)).withColumn("sample_offset", F.col("frame") * size)
    return out.withColumn("block_size", F.least(F.lit(size).cast("bigint"), F.col(total) - F.col("sample_offset")))


def scheduled_plan(schedule: DataFrame, order: str, size: str, keys: list[str] | None = None) -> DataFrame:
    """schedule with sample_offset: what the stream's earlier blocks hold."""
    if not keys:
        return prefix(schedule, order, size, "sample_offset")
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return schedule.withColumn("sample_offset", F.coalesce(F.sum(size).over(w), F.lit(0).cast("bigint")))


def assign(samples: DataFrame, plan: DataFrame, index: str = "i", keys: list[str] | None = None, width: int = 1024) -> DataFrame:
    """samples with the frame of a scheduled plan (frame, sample_offset, block_size) that holds them. Samples outside the plan are left out.

    An equi-join on ranges of width samples: a block stands in each range that it touches, and a range has few blocks, so no
    sample meets blocks far from it, and a long stream is dealt over many tasks.
    """
    last = F.expr(f"(sample_offset + block_size - 1) div {width}")
    touched = plan.where("block_size > 0").withColumn("range", F.explode(F.sequence(F.expr(f"sample_offset div {width}"), last)))
    inside = (F.col(index) >= F.col("sample_offset")) & (F.col(index) < F.col("sample_offset") + F.col("block_size"))
    return samples.withColumn("range", F.expr(f"{index} div {width}")).join(touched, [*(keys or []), "range"]).where(inside).drop("range")


def faults(plan: DataFrame) -> Column:
    """Why a stream can't be planned, or null: total, channels, rate, bits, block_size."""
    rules = [("channels", 1, 8), ("rate", 1, 1_048_575), ("bits", 4, 32), ("block_size", 16, 65_535), ("total", 0, (1 << 36) - 1)]
    out = None
    for name, low, high in rules:
        bad = ~F.col(name).between(low, high)
        out = F.when(bad, name) if out is None else out.when(bad, name)
    return out


def packed_fixed(plan: DataFrame, size: int) -> DataFrame:
    """A fixed plan with its batch: as many whole blocks as a batch may hold."""
    per = max(1, min(BATCH_FRAMES, BATCH_SAMPLES // size))
    return plan.withColumn("batch", F.expr(f"frame div {per}"))


def packed(plan: DataFrame, keys: list[str], order: str = "frame", size: str = "block_size", frames: int = BATCH_FRAMES, samples: int = BATCH_SAMPLES) -> DataFrame:
    """A scheduled plan with its batch: a batch ends after so many frames, or before a frame that would pass so many samples; a frame
    always enters an empty batch. Each stream's rows pass one by one; none is gathered."""
    rows = plan.select(*keys, big(order).alias(order), big(size).alias(size)).repartition(*keys).sortWithinPartitions(*keys, order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, batch, count, total = None, 0, 0, 0
        for rows in batches:
            out = []
            for *key, n in zip(*(rows.column(i).to_pylist() for i in (*range(len(keys)), len(keys) + 1)), strict=True):
                if key != now:
                    now, batch, count, total = key, 0, 0, 0
                if count and (count >= frames or total + n > samples):
                    batch, count, total = batch + 1, 0, 0
                count, total = count + 1, total + n
                out.append(batch)
            yield pa.RecordBatch.from_arrays([*rows.columns[: len(keys) + 1], pa.array(out, pa.int64())], [*rows.schema.names[: len(keys) + 1], "batch"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[: len(keys) + 1], T.StructField("batch", T.LongType())]))


@dataclass(frozen=True)
class Options:
    """How a stream is encoded. A level brings its block size and keeps a schedule; a block size ends a schedule; a schedule keeps both."""

    level: int = 8
    block_size: int = 4096
    schedule: tuple[int, ...] | None = None

    def with_level(self, level: int) -> Options:
        sizes = {number: size for number, size, *_ in LEVELS}
        if level not in sizes:
            raise ValueError(f"there is no level {level}")
        return replace(self, level=level, block_size=sizes[level])

    def with_block_size(self, size: int) -> Options:
        return replace(self, block_size=size, schedule=None)

    def with_schedule(self, sizes) -> Options:
        return replace(self, schedule=tuple(sizes))


def decode_batches(frames: DataFrame, keys: list[str], most_frames: int = 256, most_samples: int = BATCH_SAMPLES, most_bytes: int = 8 << 20, order: str = "frame") -> DataFrame:
    """frames (keys, frame, block_size, frame_size) with batch, for decoding: a batch is sealed before a frame that would pass the samples or bytes, and after one
    that reaches the frames, samples or bytes. Each stream's rows pass one by one."""
    rows = frames.select(*keys, big(order).alias(order), big("block_size").alias("block_size"), big("frame_size").alias("frame_size")).repartition(*keys).sortWithinPartitions(*keys, order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, batch, held = None, 0, (0, 0, 0)
        for rows in batches:
            out = []
            for *key, n, size in zip(*(rows.column(i).to_pylist() for i in (*range(len(keys)), len(keys) + 1, len(keys) + 2)), strict=True):
                if key != now:
                    now, batch, held = key, 0, (0, 0, 0)
                if held[0] and (held[1] + n > most_samples or held[2] + size > most_bytes):
                    batch, held = batch + 1, (0, 0, 0)
                out.append(batch)
                held = held[0] + 1, held[1] + n, held[2] + size
                if held[0] >= most_frames or held[1] >= most_samples or held[2] >= most_bytes:
                    batch, held = batch + 1, (0, 0, 0)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(out, pa.int64())], [*rows.schema.names, "batch"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("batch", T.LongType())]))
