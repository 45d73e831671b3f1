"""Costs of encodings, and the cheapest one per partition, residual, block and frame.

Samples are sorted by block in the partition that holds the stream, and pass in that order: whole blocks are costed side by side, a bounded number of samples at a time. No
residual becomes a row, so a task holds its samples' sort and nothing that grows with orders or partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql import types as T

from wavegrid.functions.columns import big
from wavegrid.operators.predict import adaptive

#: Bits of a subframe's header, and of a quantised coefficient.
HEADER_BITS, PRECISION = 8, 15
#: Bits of a parameter and its largest value, of the two methods.
METHODS = ((4, 14), (5, 30))
LEAST, MOST = -(1 << 30), (1 << 30) - 1
#: Samples that are costed at once; a longer block is costed whole.
HELD = 1 << 17
#: No such form, of bits.
NONE = np.iinfo(np.int64).max


def partition_orders(n: Column, order: Column, most: int) -> Column:
    """The highest partition order that divides n into partitions longer than the predictor's order, the one below, and 0."""
    highest = F.lit(None).cast("int")
    for p in range(min(most, 8), -1, -1):
        highest = F.coalesce(highest, F.when((n % (1 << p) == 0) & (F.shiftright(n, p) > order), p))
    few = F.array_distinct(F.array(highest, F.greatest(highest - 1, F.lit(0)), F.lit(0)))
    return F.when(highest.isNotNull(), few)


def _orders(n: int, order: int, most: int) -> list[int]:
    """partition_orders() of one block, padded by -1."""
    highest = next((p for p in range(min(most, 8), -1, -1) if n % (1 << p) == 0 and n >> p > order), None)
    few = [] if highest is None else sorted({highest, max(highest - 1, 0), 0}, reverse=True)
    return few + [-1] * (3 - len(few))


# ---- blocks side by side


@dataclass
class Blocks:
    """Samples of whole blocks, one after another: value, whether it isn't null, block, position in the block (at) and as stated (j); and samples of each block."""

    x: np.ndarray
    known: np.ndarray
    block: np.ndarray
    at: np.ndarray
    j: np.ndarray
    n: np.ndarray

    def of(self, x: np.ndarray, known: np.ndarray) -> Blocks:
        return Blocks(x, known, self.block, self.at, self.j, self.n)


@dataclass
class Residual:
    """A predictor's residual of several blocks; rows of a block stand together."""

    k: int
    r: np.ndarray
    known: np.ndarray
    block: np.ndarray
    j: np.ndarray
    n: np.ndarray


def _exact(x: np.ndarray, growth: int) -> np.ndarray:
    """x, as whole numbers of any size if sums of values that are growth times as large may pass 64 bits."""
    top = max(int(x.max()), -int(x.min())) if len(x) else 0
    return x.astype(object) if top * growth >= 1 << 62 else x


def _fixed(b: Blocks, most: int) -> Iterator[Residual]:
    """Finite differences of order 0 to most."""
    r, known = _exact(b.x, int(b.n.max()) << (most + 1)), b.known
    for k in range(most + 1):
        if k:
            r, known = r.copy(), known.copy()
            r[1:] -= r[:-1].copy()
            known[1:] &= known[:-1].copy()
            known &= b.at >= k
        rows = b.j >= k
        yield Residual(k, r[rows], known[rows], b.block[rows], b.j[rows], b.n)


def _adaptive(b: Blocks, rate: int, most: int) -> Iterator[Residual]:
    """Residuals of adaptive predictors, by order. A block with nulls has none."""
    whole = np.ones(len(b.n), bool)
    whole[b.block[~b.known]] = False
    found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    first = np.cumsum(b.n) - b.n
    for n in np.unique(b.n).tolist():
        rows = np.flatnonzero((b.n == n) & whole)
        for k, some, _, _, residual in adaptive(b.x[first[rows][:, None] + np.arange(n)], rate, most, PRECISION):
            found.setdefault(k, []).append((rows[some], residual))
    for k in sorted(found):
        block = np.concatenate([np.repeat(rows, r.shape[1]) for rows, r in found[k]])
        j = np.concatenate([np.tile(np.arange(k, k + r.shape[1]), len(r)) for _, r in found[k]])
        r = np.concatenate([r.reshape(-1) for _, r in found[k]])
        yield Residual(k, _exact(r, int(b.n.max()) << 1), np.ones(len(r), bool), block, j, b.n)


def _ends(x: np.ndarray, known: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest known value of each group; 0 if there is none."""
    if known.all():
        return np.minimum.reduceat(x, first), np.maximum.reduceat(x, first)
    top = 1 << 80 if x.dtype == object else NONE  # beyond every value
    low, high = np.minimum.reduceat(np.where(known, x, top), first), np.maximum.reduceat(np.where(known, x, -top), first)
    some = np.logical_or.reduceat(known, first)
    return np.where(some, low, 0), np.where(some, high, 0)


def _bit_length(v: np.ndarray) -> np.ndarray:
    """Bits of integers of 0 to 2 ** 62, or of any size as objects."""
    if v.dtype == object:
        return np.frompyfunc(int.bit_length, 1, 1)(v).astype(np.int64)
    length = np.frexp(v.astype(np.float64))[1].astype(np.int64)
    return length - ((v > 0) & (v >> np.maximum(length - 1, 0) == 0))  # a float may be rounded up to the next power


@dataclass
class Parts:
    """Partitions of one partition order a block: of a block's rows, one after another. folded, low and high are 0 where no value is known."""

    block: np.ndarray
    p: np.ndarray
    part: np.ndarray
    count: np.ndarray
    folded: np.ndarray
    known: np.ndarray
    low: np.ndarray
    high: np.ndarray
    bits: list[np.ndarray]
    escape: list[np.ndarray]
    parameter: list[np.ndarray]


def _parts(r: Residual, most: int) -> Iterator[Parts]:
    """The partitions of a residual with the cost of each by both methods, for each partition order that is tried, the highest first. An escape wins ties, then the smaller
    parameter."""
    lengths, which = np.unique(r.n, return_inverse=True)
    tried = np.array([_orders(n, r.k, most) for n in lengths.tolist()]).reshape(-1, 3)[which]
    for order in tried.T:
        rows = np.flatnonzero(order[r.block] >= 0)
        if not len(rows):
            continue
        block, j, x, known = (r.block, r.j, r.r, r.known) if len(rows) == len(r.r) else (r.block[rows], r.j[rows], r.r[rows], r.known[rows])
        part = j // (r.n >> np.maximum(order, 0))[block]
        first = np.concatenate(([0], np.flatnonzero((block[1:] != block[:-1]) | (part[1:] != part[:-1])) + 1))
        count = np.diff(np.append(first, len(block)))
        low, high = _ends(x, known, first)
        u = np.where(known, np.where(x >= 0, x * 2, -x * 2 - 1), 0)
        folded = np.add.reduceat(u, first)
        e = np.maximum(_bit_length(folded // count) - 1, 0)
        width = np.where((low == 0) & (high == 0), 0, _bit_length(np.maximum(high, -low - 1)) + 1)
        some = np.logical_or.reduceat(known, first)
        out = Parts(block[first], order[block[first]], part[first], count, folded, some, low, high, [], [], [])
        shifted = None
        for size, top in METHODS:
            parameter = np.minimum(e, top)
            if shifted is None or e.max() > METHODS[0][1]:
                shifted = np.add.reduceat(u >> np.repeat(parameter, count), first)
            costs = np.stack([
                np.where(width <= 31, size + 5 + count * width, NONE),
                np.where(parameter <= 2, size + folded + count, NONE),
                size + shifted + count * (parameter + 1),
            ])
            best = costs.argmin(axis=0)
            out.bits.append(costs[best, np.arange(len(best))])
            out.escape.append((best == 0) & some)
            out.parameter.append(np.where(some, np.where(best == 0, width, np.where(best == 1, 0, parameter)), 0))
        yield out


@dataclass
class Choice:
    """The cheapest encoding of a residual, a row a block; bits are NONE where it can't be encoded."""

    bits: np.ndarray
    p: np.ndarray
    method: np.ndarray


def _chosen(r: Residual, most: int) -> Choice:
    """Ties keep the higher partition order, then the first method. The second method is tried where the whole residual's estimate passes the first one's largest
    parameter. Orders with a residual beyond 31 bits are left out."""
    kind = object if r.r.dtype == object else np.int64
    out = Choice(np.full(len(r.n), NONE, kind), np.zeros(len(r.n), np.int64), np.zeros(len(r.n), np.int64))
    for s in _parts(r, most):
        first = np.concatenate(([0], np.flatnonzero(s.block[1:] != s.block[:-1]) + 1))
        block = s.block[first]
        estimate = np.maximum(_bit_length(np.add.reduceat(s.folded, first) // np.add.reduceat(s.count, first)) - 1, 0)
        fits = (np.minimum.reduceat(s.low, first) >= LEAST) & (np.maximum.reduceat(s.high, first) <= MOST) & np.logical_or.reduceat(s.known, first)
        for method, bits in enumerate(s.bits):
            total = np.add.reduceat(np.where(s.known, bits, 0), first) + 6
            better = fits & (total < out.bits[block])
            if method:
                better &= estimate > METHODS[0][1]
            at = block[better]
            out.bits[at], out.p[at], out.method[at] = total[better], s.p[first][better], method
    return out


@dataclass
class Forms:
    """The cheapest form of each block: kind is a place in KINDS; order, p and method count for predictors only."""

    kind: np.ndarray
    order: np.ndarray
    p: np.ndarray
    method: np.ndarray
    bits: np.ndarray


KINDS = ("constant", "verbatim", "fixed", "lpc")


def _forms(b: Blocks, bits: int, fixed_order: int, partition_order: int, rate: int = 0, lpc_order: int = 0) -> Forms:
    """Ties keep constant, verbatim, fixed and adaptive predictors in that order, and the smaller order."""
    first = np.cumsum(b.n) - b.n
    low, high = _ends(b.x, b.known, first)
    constant = (low == high) & np.logical_or.reduceat(b.known, first)
    out = Forms(np.where(constant, 0, 1), *(np.zeros(len(b.n), np.int64) for _ in range(3)), np.where(constant, 1, b.n) * bits + HEADER_BITS)
    for kind, residuals in ((2, _fixed(b, fixed_order)), (3, _adaptive(b, rate, lpc_order) if lpc_order else ())):
        for r in residuals:
            c = _chosen(r, partition_order)
            extra = HEADER_BITS + r.k * bits + (9 + r.k * PRECISION if kind == 3 else 0)
            at = np.flatnonzero(c.bits < out.bits - extra)
            out.kind[at], out.order[at], out.p[at], out.method[at], out.bits[at] = kind, r.k, c.p[at], c.method[at], c.bits[at] + extra
    return out


# ---- streams of rows


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order as batches of whole blocks; the last column is 1 where a block begins."""
    held, rows, enough = [], 0, HELD

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < enough:
            continue
        all_ = joined()
        last = int(np.flatnonzero(all_.columns[-1].to_numpy() == 1)[-1])  # it may go on
        if last:
            yield all_.slice(0, last)
        held, rows = [all_.slice(last)], rows - last
        enough = max(HELD, 2 * rows)
    if rows:
        yield joined()


def _mapped(framed: DataFrame, keys: list[str], values: list[str], run: Callable, fields: list[T.StructField]) -> DataFrame:
    """keys, frame and fields, by run(blocks of each of the values): the block of each row and the rows' columns, as arrays."""
    by = [*keys, "frame"]
    # the window asks for the blocks' rows in one partition and in order, wherever they come from
    begins = F.row_number().over(W.partitionBy(*by).orderBy("j")).alias("_at")
    rows = framed.select(*by, big("j").alias("j"), *[big(v).alias(v) for v in values], begins).sortWithinPartitions(*by, "j")
    schema = T.StructType([rows.schema[k] for k in by] + fields)
    names = schema.names

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole(batches):
            at = batch.columns[-1].to_numpy().astype(np.int64) - 1
            first = np.flatnonzero(at == 0)
            n = np.diff(np.append(first, len(at)))
            blocks = Blocks(at, at, np.repeat(np.arange(len(n)), n), at, batch.column(len(by)).to_numpy(), n)
            columns = batch.columns[len(by) + 1 : -1]
            heads = [batch.column(i).take(pa.array(first)) for i in range(len(by))]
            for block, *out in run(*[blocks.of(c.fill_null(0).to_numpy(), pc.is_valid(c).to_numpy(zero_copy_only=False)) for c in columns]):
                yield pa.RecordBatch.from_arrays([*[h.take(pa.array(block)) for h in heads], *out], names)

    return rows.mapInArrow(mapped, schema)


def _longs(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.LongType()) for n in names]


def _long(values: np.ndarray, known: np.ndarray | None = None) -> pa.Array:
    return pa.array(values, pa.int64(), mask=None if known is None else ~known)


def _names(names: tuple[str, ...], which: np.ndarray) -> pa.Array:
    return pa.array(names).take(pa.array(which))


def partition_costs(framed: DataFrame, keys: list[str], fixed_order: int = 4, partition_order: int = 6) -> DataFrame:
    """keys, frame, n, k, p, part with count, folded (sum), low, high and, for each method m, bits{m}, kind{m} and parameter{m}, of the fixed predictors' residuals.

    An escape wins ties, then the smaller parameter.
    """

    def run(b: Blocks) -> Iterator[tuple]:
        for r in _fixed(b, fixed_order):
            for s in _parts(r, partition_order):
                costs = [c for m in range(2) for c in (_long(s.bits[m], s.known), _names(("rice", "escape"), s.escape[m].astype(np.int64)), _long(s.parameter[m]))]
                yield s.block, _long(b.n[s.block]), _long(np.full(len(s.p), r.k)), _long(s.p), _long(s.part), _long(s.count), *(_long(v, s.known) for v in (s.folded, s.low, s.high)), *costs

    costs = [f for m in range(2) for f in (*_longs(f"bits{m}"), T.StructField(f"kind{m}", T.StringType()), *_longs(f"parameter{m}"))]
    return _mapped(framed, keys, ["x"], run, [*_longs("n", "k", "p", "part", "count", "folded", "low", "high"), *costs])


def residual_choice(framed: DataFrame, keys: list[str], fixed_order: int = 4, partition_order: int = 6) -> DataFrame:
    """keys, frame, n, k with bits, p and method of the cheapest encoding of each fixed predictor's residual. Ties keep the higher partition order, then the first method.

    The second method is tried where the whole residual's estimate passes the first one's largest parameter. Orders with a
    residual beyond 31 bits are left out.
    """

    def run(b: Blocks) -> Iterator[tuple]:
        for r in _fixed(b, fixed_order):
            c = _chosen(r, partition_order)
            at = np.flatnonzero(c.bits != NONE)
            yield at, _long(b.n[at]), _long(np.full(len(at), r.k)), _long(c.bits[at]), _long(c.p[at]), _long(c.method[at])

    return _mapped(framed, keys, ["x"], run, _longs("n", "k", "bits", "p", "method"))


def subframes(framed: DataFrame, keys: list[str], bits: int, fixed_order: int = 4, partition_order: int = 6) -> DataFrame:
    """keys, frame, n with kind, order, p, method and bits of each block's cheapest form of constant, verbatim and fixed; ties keep the first."""
    return _subframes(framed, keys, bits, fixed_order, partition_order)


def subframes_with_lpc(framed: DataFrame, keys: list[str], bits: int, rate: int, lpc_order: int, fixed_order: int = 4, partition_order: int = 6) -> DataFrame:
    """subframes() with adaptive predictors too: they come last, by order, and cost their coefficients."""
    return _subframes(framed, keys, bits, fixed_order, partition_order, rate, lpc_order)


def _subframes(framed: DataFrame, keys: list[str], *how: int) -> DataFrame:
    def run(b: Blocks) -> Iterator[tuple]:
        f = _forms(b, *how)
        predicted = f.kind > 1
        yield np.arange(len(b.n)), _long(b.n), _names(KINDS, f.kind), *(_long(v, predicted) for v in (f.order, f.p, f.method)), _long(f.bits)

    return _mapped(framed, keys, ["x"], run, [*_longs("n"), T.StructField("kind", T.StringType()), *_longs("order", "p", "method", "bits")])


def stereo_frames(framed: DataFrame, keys: list[str], bits: int, fixed_order: int = 4, partition_order: int = 6) -> DataFrame:
    """framed pairs l and r: keys, frame with the bits of both stereo forms (independent, mid_side_bits), their sums of magnitudes (independent_cost, mid_side_cost) and mid_side:
    whether the latter's is strictly less, null if no pair is known. The side channel has a bit more a stored sample."""

    def run(left: Blocks, right: Blocks) -> Iterator[tuple]:
        both = left.known & right.known
        x, y = (_exact(b.x, int(b.n.max()) * 4) for b in (left, right))
        planes = [left.of(x, left.known), right.of(y, right.known), left.of((x + y) >> 1, both), left.of(x - y, both)]
        first = np.cumsum(left.n) - left.n
        known = np.logical_or.reduceat(both, first)
        independent, mid_side = (np.add.reduceat(np.where(both, np.abs(a.x) + np.abs(b.x), 0), first) for a, b in (planes[:2], planes[2:]))
        forms = [_forms(b, bits, fixed_order, partition_order) for b in planes]
        side = forms[3]
        side.bits = side.bits + np.where(side.kind == 0, 1, np.where(side.kind == 1, left.n, side.order))
        sums = _long(forms[0].bits + forms[1].bits), _long(forms[2].bits + side.bits), _long(independent, known), _long(mid_side, known)
        yield np.arange(len(left.n)), *sums, pa.array((mid_side < independent).astype(bool), mask=~known)

    return _mapped(framed, keys, ["l", "r"], run, [*_longs("independent", "mid_side_bits", "independent_cost", "mid_side_cost"), T.StructField("mid_side", T.BooleanType())])
