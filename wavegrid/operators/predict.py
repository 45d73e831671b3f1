"""Linear prediction within frames: fixed and adaptive predictors, and their inverses."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql import types as T


def difference(k: int, window, value: str = "x") -> Column:
    """The k-th finite difference; right where the frame has k samples before."""
    out = F.col(value)
    for m in range(1, k + 1):
        term = F.lag(value, m).over(window) * comb(k, m)
        out = out - term if m % 2 else out + term
    return out


def fixed_residuals(framed: DataFrame, keys: list[str], orders=range(5)) -> DataFrame:
    """A row for each order k and sample past the warm-up: keys, frame, n, j, k, r. One sort within the stream's partition."""
    w = W.partitionBy(*keys, "frame").orderBy("j")
    wide = framed.select(*keys, "frame", "n", "j", *[difference(k, w).alias(f"r{k}") for k in orders])
    rows = F.explode(F.array(*[F.struct(F.lit(k).cast("bigint").alias("k"), F.col(f"r{k}").alias("r")) for k in orders])).alias("e")
    return wide.select(*keys, "frame", "n", "j", rows).select(*keys, "frame", "n", "j", "e.k", "e.r").where("j >= k")


def restore(residuals: DataFrame, keys: list[str], order: int | str, most: int = 4) -> DataFrame:
    """x from d, the order-th difference with zeros before the frame: running sums, nested. order: of all rows, or a column that is among keys, with most at most."""
    w = W.partitionBy(*keys, "frame").orderBy("j").rowsBetween(W.unboundedPreceding, 0)
    out = residuals.withColumn("x", F.col("d"))
    for m in range(1, (order if isinstance(order, int) else most) + 1):
        deeper = F.sum("x").over(w).cast("bigint")
        out = out.withColumn("x", deeper if isinstance(order, int) else F.when(F.col(order) >= m, deeper).otherwise(F.col("x")))
    return out


def _zero_difference(order: int, window) -> Column:
    out = F.col("x")
    for m in range(1, order + 1):
        term = F.when(F.col("j") >= m, F.lag("x", m).over(window) * comb(order, m)).otherwise(0)
        out = out - term if m % 2 else out + term
    return out.cast("bigint")


def zero_history(framed: DataFrame, keys: list[str], orders) -> DataFrame:
    """framed with k and d for each order k: the k-th difference where samples before the frame count as zero; it equals the residual past the warm-up. One sort."""
    w = W.partitionBy(*keys, "frame").orderBy("j")
    wide = framed.select("*", *[_zero_difference(k, w).alias(f"_d{k}") for k in orders])
    each = F.explode(F.array(*[F.struct(F.lit(k).cast("bigint").alias("k"), F.col(f"_d{k}").alias("d")) for k in orders])).alias("e")
    return wide.select(*framed.columns, each).select(*framed.columns, "e.k", "e.d")


def autocorrelation(framed: DataFrame, keys: list[str], lags: int) -> DataFrame:
    """keys, frame, lag, value: sums of products of samples that far apart in the frame. Exact integers."""
    w = W.partitionBy(*keys, "frame").orderBy("j")
    wide = framed.select(*keys, "frame", *[(F.col("x") * F.when(F.col("j") >= m, F.lag("x", m).over(w))).alias(f"p{m}") if m else (F.col("x") * F.col("x")).alias("p0") for m in range(lags + 1)])
    sums = wide.groupBy(*keys, "frame").agg(*[F.coalesce(F.sum(f"p{m}"), F.lit(0)).cast("bigint").alias(f"a{m}") for m in range(lags + 1)])
    rows = F.explode(F.array(*[F.struct(F.lit(m).cast("bigint").alias("lag"), F.col(f"a{m}").alias("value")) for m in range(lags + 1)])).alias("e")
    return sums.select(*keys, "frame", rows).select(*keys, "frame", "e.lag", "e.value")


def levinson(r: np.ndarray) -> list[np.ndarray]:
    """Predictors of order 1, 2, ... for autocorrelations r; it stops where the error vanishes."""
    out: list[np.ndarray] = []
    if not len(r) or r[0] == 0:
        return out
    a, error = np.zeros(0), float(r[0])
    for order in range(1, len(r)):
        if abs(error) < np.finfo(float).eps:
            break
        k = float(r[order])
        for i in range(order - 1):
            k -= a[i] * r[order - 1 - i]
        k /= error
        a = np.concatenate((a - k * a[::-1], [k]))
        error *= 1 - k * k
        if not np.isfinite(error) or error <= np.finfo(float).eps:
            break
        out.append(a)
    return out


def levinson_many(r: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """levinson() of many rows of autocorrelations at once: for order 1, 2, ... the rows that have a predictor, and their predictors. The same operations in
    the same order, so the same numbers."""
    rows = np.flatnonzero(r[:, 0] != 0) if r.size else np.zeros(0, np.int64)
    a, error = np.zeros((len(rows), 0)), r[rows, 0].astype(np.float64) if len(rows) else np.zeros(0)
    out, least = [], np.finfo(float).eps
    for order in range(1, r.shape[1]):
        on = np.abs(error) >= least
        rows, a, error = rows[on], a[on], error[on]
        k = r[rows, order].astype(np.float64)
        for i in range(order - 1):
            k = k - a[:, i] * r[rows, order - 1 - i]
        with np.errstate(all="ignore"):
            k = k / error
            a = np.concatenate((a - k[:, None] * a[:, ::-1], k[:, None]), axis=1)
            error = error * (1 - k * k)
        on = np.isfinite(error) & (error > least)
        rows, a, error = rows[on], a[on], error[on]
        out.append((rows, a))
    return out


def adaptive(x: np.ndarray, rate: int, most: int, precision: int = 15) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of one length, a row each: for each order that is tried, the order, the rows that have a predictor, and shifts, coefficients and residuals of these. Autocorrelation,
    recursion, quantiser and residuals are those of the frame codec."""
    from wavegrid.functions.frames import lpc_orders as tried

    n = x.shape[1]
    limit = min(most, 32, 12 if rate <= 48_000 else 32, n - 1)
    if limit < 1 or not len(x):
        return
    f = x.astype(np.float64)
    r = np.stack([np.add.accumulate(f[:, k:] * f[:, : n - k], axis=1)[:, -1] for k in range(limit + 1)], axis=1)
    found = levinson_many(r)
    for k in tried(limit):
        some, a = found[k - 1] if k <= len(found) else (np.zeros(0, np.int64), np.zeros((0, k)))
        shift, c = quantise_many(a, precision)
        some, shift, c = some[shift >= 0], shift[shift >= 0], c[shift >= 0]
        if len(some):
            prediction = sum(c[:, m - 1 : m] * x[some][:, k - m : n - m] for m in range(1, k + 1))
            yield k, some, shift, c, x[some][:, k:] - (prediction >> shift[:, None])


def lpc_candidates(blocks: DataFrame, keys: list[str], rate: int, most: int, precision: int = 15, value: str = "xs") -> DataFrame:
    """blocks (keys, frame, xs) as a row for each order that is tried and sample past the warm-up: keys, frame, n, k, shift, coefficients, j and r.

    All blocks of one length in a batch run side by side.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(keys) + 1)
            at, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
            length = np.diff(at)
            for n in np.unique(length).tolist():
                rows = np.flatnonzero(length == n)
                for k, some, shift, c, residual in adaptive(flat[at[rows][:, None] + np.arange(n)], rate, most, precision):
                    lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * v.shape[1], pa.int32()), pa.array(np.ascontiguousarray(v).reshape(-1))) for v in (c, residual)]
                    heads = [batch.column(i).take(pa.array(rows[some])) for i in range(len(keys) + 1)]
                    yield pa.RecordBatch.from_arrays([*heads, pa.array(np.full(len(some), n)), pa.array(np.full(len(some), k)), pa.array(shift), *lists], names)

    names = [*keys, "frame", "n", "k", "shift", "coefficients", "rs"]
    fields = [blocks.schema[c] for c in [*keys, "frame"]] + [T.StructField(c, T.LongType()) for c in ("n", "k", "shift")] + [T.StructField(c, T.ArrayType(T.LongType())) for c in ("coefficients", "rs")]
    out = blocks.select(*keys, "frame", F.col(value).cast("array<bigint>").alias(value)).mapInArrow(run, T.StructType(fields))
    return out.select(*names[:-1], F.posexplode("rs").alias("j", "r")).withColumn("j", F.col("j") + F.col("k"))


def half_away(x: np.ndarray) -> np.ndarray:
    """Rounds halves away from zero."""
    return np.sign(x) * np.floor(np.abs(x) + 0.5)


def quantise(coefficients: np.ndarray, precision: int = 15) -> tuple[int, np.ndarray] | None:
    """(shift, integers): the shift of 15 to 0 with the least squared error that fits precision; the larger one wins ties."""
    shift, integers = quantise_many(np.asarray(coefficients, np.float64)[None], precision)
    return None if shift[0] < 0 else (int(shift[0]), integers[0])


def quantise_many(coefficients: np.ndarray, precision: int = 15) -> tuple[np.ndarray, np.ndarray]:
    """quantise() of many rows at once: shifts, -1 where none fits, and integers."""
    shifts = np.arange(15, -1, -1)
    scale = (1 << shifts).astype(np.float64)[None, :, None]
    scaled = half_away(coefficients[:, None, :] * scale)  # a row, a shift, a coefficient
    errors = np.add.accumulate((coefficients[:, None, :] - scaled / scale) ** 2, axis=2)[:, :, -1] if coefficients.shape[1] else np.zeros(scaled.shape[:2])
    errors = np.where(np.abs(scaled).max(axis=2, initial=0) <= (1 << (precision - 1)) - 1, errors, np.inf)
    best = errors.argmin(axis=1)  # the first of equals, so the largest shift
    rows = np.arange(len(coefficients))
    return np.where(np.isfinite(errors[rows, best]), shifts[best], -1), scaled[rows, best].astype(np.int64)


def quantised(coefficients: DataFrame, keys: list[str], value: str = "c", precision: int = 15) -> DataFrame:
    """keys, shift and error of the best shift; coefficients: a row each. Candidates are exploded and reduced."""
    shifts = coefficients.withColumn("shift", F.explode(F.sequence(F.lit(0), F.lit(15))))
    scale = F.pow(F.lit(2.0), "shift")
    q = F.signum(F.col(value)) * F.floor(F.abs(F.col(value) * scale) + 0.5)
    delta = F.col(value) - q / scale
    costs = shifts.groupBy(*keys, "shift").agg(F.sum(delta * delta).alias("error"), F.max(F.abs(q)).alias("most")).where(F.col("most") <= (1 << (precision - 1)) - 1)
    return costs.groupBy(*keys).agg(F.min_by(F.col("shift").cast("bigint"), F.struct("error", -F.col("shift"))).alias("shift"))


def lpc_orders(rate: Column, most: Column, n: Column) -> Column:
    """Orders that are tried: all up to 4; beyond, those of 8, 12 and the largest that aren't larger."""
    limit = F.least(most, F.lit(32).cast("bigint"), F.when(rate <= 48_000, 12).otherwise(32).cast("bigint"), F.greatest(n - 1, F.lit(0).cast("bigint")))
    few = F.when(limit > 0, F.sequence(F.lit(1).cast("bigint"), limit)).otherwise(F.array().cast("array<bigint>"))
    return F.when(limit <= 4, few).otherwise(F.array_distinct(F.filter(F.array(F.lit(8).cast("bigint"), F.lit(12).cast("bigint"), limit), lambda o: o <= limit)))


def lpc_residuals(framed: DataFrame, keys: list[str], coefficients: list[int], shift: int) -> DataFrame:
    """keys, frame, j and r, past the warm-up."""
    w = W.partitionBy(*keys, "frame").orderBy("j")
    prediction = F.lit(0).cast("bigint")
    for m, c in enumerate(coefficients, 1):
        prediction = prediction + F.lag("x", m).over(w) * c
    out = framed.withColumn("r", F.col("x") - F.shiftright(prediction, shift))
    return out.where(F.col("j") >= len(coefficients)).select(*keys, "frame", "j", "r")


def lpc_restored(blocks: DataFrame, coefficients: list[int], shift: int, warmup: str = "warmup", residuals: str = "residuals") -> DataFrame:
    """blocks with xs, their samples: each follows from those before it. Sequential in a block, side by side over the blocks of a batch."""
    c = np.array(coefficients, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from wavegrid.functions.frames import Recurrence, lpc_restored as restored

        def arrays(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
            column = batch.column(batch.schema.get_field_index(name))
            at, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
            return [flat[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

        for batch in batches:
            if batch.num_rows:
                first, rest = arrays(batch, warmup), arrays(batch, residuals)
                whole = [i for i, w in enumerate(first) if len(w) == len(c)]
                xs = [w[: len(c)] for w in first]
                for i, x in zip(whole, restored([Recurrence(first[i], rest[i], c, shift) for i in whole]), strict=True):
                    xs[i] = x
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in xs]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(xs), pa.int64()))], [*batch.schema.names, "xs"])

    return blocks.mapInArrow(run, T.StructType([*blocks.schema.fields, T.StructField("xs", T.ArrayType(T.LongType()))]))
