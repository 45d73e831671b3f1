"""Channel transforms: planes, mid/side and its relatives, and the choice between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def deinterleave(samples: DataFrame, channels: int, index: str = "i", value: str = "x") -> DataFrame:
    """samples with t (inter-channel position) and channel."""
    return samples.withColumn("t", F.expr(f"{index} div {channels}")).withColumn("channel", F.col(index) % channels)


def interleave(planes: DataFrame, columns: list[str], index: str = "i") -> DataFrame:
    """A row for each channel's value, in order k: a frame of values becomes len(columns) rows. Planes have equal lengths by being columns."""
    n = len(columns)
    values = F.posexplode(F.array(*columns)).alias("channel", "x")
    rest = [c for c in planes.columns if c not in columns]
    return planes.select(*rest, values).withColumn("channel", F.col("channel").cast("bigint")).withColumn("k", F.col(index) * n + F.col("channel"))


def mid_side(left: Column, right: Column) -> tuple[Column, Column]:
    return F.shiftright(left + right, 1), left - right


def from_mid_side(mid: Column, side: Column) -> tuple[Column, Column]:
    """The mid's lost bit is the side's lowest."""
    left = mid + F.shiftright(side + side.bitwiseAND(F.lit(1).cast("bigint")), 1)
    return left, left - side


def from_left_side(left: Column, side: Column) -> tuple[Column, Column]:
    return left, left - side


def from_side_right(side: Column, right: Column) -> tuple[Column, Column]:
    return side + right, right


def stereo_choice(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys with the sums of magnitudes and mid_side: whether it costs strictly less than independent channels."""
    mid, side = mid_side(F.col("l"), F.col("r"))
    sums = pairs.groupBy(*keys).agg(F.sum(F.abs("l") + F.abs("r")).alias("independent_cost"), F.sum(F.abs(mid) + F.abs(side)).alias("mid_side_cost"))
    return sums.withColumn("mid_side", F.col("mid_side_cost") < F.col("independent_cost"))
