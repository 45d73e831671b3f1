"""One frame: its analysis, its bytes, and the samples that they give back. Frames know nothing of each other."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from wavegrid.functions import bits as B
from wavegrid.functions.columns import DEPTH_CODES, RATE_CODES
from wavegrid.operators.cost import HEADER_BITS, LEAST, METHODS, MOST
from wavegrid.operators.framing import LEVELS
from wavegrid.operators.predict import levinson, quantise

PRECISION = 15


@dataclass(frozen=True)
class Profile:
    block_size: int
    fixed_order: int
    lpc_order: int
    partition_order: int
    mid_side: bool

    @staticmethod
    def of(level: int) -> Profile:
        for number, *rest in LEVELS:
            if number == level:
                return Profile(*rest)
        raise ValueError(f"there is no level {level}")


@dataclass
class Residual:
    bits: int
    order: int
    method: int
    partitions: list[tuple[str, int, int, int]]  # kind, parameter or width, start, end
    values: np.ndarray


@dataclass
class Subframe:
    kind: str
    bits: int
    order: int = 0
    residual: Residual | None = None
    shift: int = 0
    coefficients: np.ndarray | None = None


def folded(r: np.ndarray) -> np.ndarray:
    return np.where(r >= 0, 2 * r, -2 * r - 1)


def unfolded(u: np.ndarray) -> np.ndarray:
    return (u >> 1) ^ -(u & 1)


@dataclass
class _Candidate:
    """A residual, and what its partitions of the highest order sum up to."""

    r: np.ndarray
    order: int
    n: int
    highest: int
    u: np.ndarray  # folded, with zeros for the warm-up
    total: np.ndarray
    low: np.ndarray
    high: np.ndarray
    wide: int  # of the whole residual's estimate

    @staticmethod
    def of(r: np.ndarray, order: int, most: int) -> _Candidate | None:
        n = len(r) + order
        valid = [p for p in range(min(most, 8) + 1) if n % (1 << p) == 0 and n >> p > order]
        if not valid or (len(r) and (r.min() < LEAST or r.max() > MOST)):
            return None
        u = np.zeros(n, np.int64)
        u[order:] = folded(r)
        filled = np.concatenate((np.full(order, r[0]), r)) if order else r
        parts = 1 << valid[-1]
        total = u.reshape(parts, -1).sum(axis=1)
        return _Candidate(r, order, n, valid[-1], u, total, filled.reshape(parts, -1).min(axis=1), filled.reshape(parts, -1).max(axis=1), int(total.sum()) // max(1, len(r)))

    def counts(self, p: int) -> np.ndarray:
        count = np.full(1 << p, self.n >> p)
        count[0] -= self.order
        return count

    def least(self) -> int:
        """Bits that no encoding goes below. With parameter e a partition of count values and this sum takes count * e + (sum + count) / 2 ** e at least, which is
        smallest at the first e with 2 ** (e + 1) >= mean + 1; coarser partitions have one parameter for several, and an escape takes the width of the widest value."""
        count = self.counts(self.highest).astype(np.float64)
        sums = self.total + count
        e = np.maximum(np.ceil(np.log2(sums / count)) - 1, 0)
        bits = np.minimum(count * e + sums / np.exp2(e), count * _span(self.low, self.high))
        return 6 + METHODS[0][0] + int(np.floor(bits.sum() - 1e-3))

    def best(self) -> Residual:
        """The cheapest partition order, method and encoding of each partition; ties keep what is tried first."""
        best, total, low, high = None, self.total, self.low, self.high
        for p in dict.fromkeys((self.highest, max(self.highest - 1, 0), 0)):
            total, low, high = (x.reshape(1 << p, -1) for x in (total, low, high))
            total, low, high = total.sum(axis=1), low.min(axis=1), high.max(axis=1)
            count, rows = self.counts(p), self.u.reshape(1 << p, -1)
            log, span = np.maximum(_bit_length(total // count) - 1, 0), _span(low, high)
            for m, (width, largest) in enumerate(METHODS):
                if m and max(0, self.wide.bit_length() - 1) <= METHODS[0][1]:
                    continue
                e = np.minimum(log, largest)
                rice = width + (rows >> e[:, None]).sum(axis=1) + count * (e + 1)
                zero = np.where(e <= 2, width + total + count, np.iinfo(np.int64).max)
                escape = width + 5 + count * span
                least = np.minimum(np.minimum(escape, zero), rice)
                bits = 6 + int(least.sum())
                if best is None or bits < best[0]:
                    best = bits, p, m, escape == least, np.where(escape == least, span, np.where(zero == least, 0, e))
        bits, p, m, escapes, values = best
        size = self.n >> p
        kinds = ["escape" if x else "rice" for x in escapes.tolist()]
        return Residual(bits, p, m, [(kind, v, max(0, k * size - self.order), (k + 1) * size - self.order) for k, (kind, v) in enumerate(zip(kinds, values.tolist(), strict=True))], self.r)


def best_residual(r: np.ndarray, order: int, most: int) -> Residual | None:
    found = _Candidate.of(r, order, most)
    return found.best() if found else None


def _span(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Signed bits that hold all values between; 0 if all are 0."""
    return np.where((low == 0) & (high == 0), 0, _bit_length(np.maximum(high, -low - 1)) + 1)


def _bit_length(x: np.ndarray) -> np.ndarray:
    """Of numbers from 0 to below 2 ** 53."""
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def lpc_residual(x: np.ndarray, coefficients: np.ndarray, shift: int) -> np.ndarray:
    k = len(coefficients)
    prediction = np.zeros(len(x) - k, np.int64)
    for m, c in enumerate(coefficients.tolist(), 1):
        prediction += c * x[k - m : len(x) - m]
    return x[k:] - (prediction >> shift)


@dataclass
class Recurrence:
    """A block whose samples follow from those before them."""

    warmup: np.ndarray
    residual: np.ndarray
    coefficients: np.ndarray
    shift: int


def lpc_restored(blocks: list[Recurrence]) -> list[np.ndarray]:
    """Samples of blocks that know nothing of each other: sequential within a block, side by side over blocks, of which the longest stand first."""
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i].residual))
    some = [blocks[i] for i in order]
    if not some:
        return []
    most, steps = max(len(b.coefficients) for b in some), len(some[0].residual)
    x = np.zeros((most + steps, len(some)), np.int64)  # a column a block; what stands before a shorter warm-up is zero
    r = np.zeros((steps, len(some)), np.int64)
    c = np.zeros((most, len(some)), np.int64)
    for k, b in enumerate(some):
        n = len(b.coefficients)
        x[most - n : most, k] = b.warmup
        r[: len(b.residual), k] = b.residual
        c[most - n :, k] = b.coefficients[::-1]
    shift = np.array([b.shift for b in some], np.int64)
    lengths = -np.array([len(b.residual) for b in some])
    live = np.searchsorted(lengths, -np.arange(steps), side="left").tolist()
    for i, n in enumerate(live):
        x[most + i, :n] = r[i, :n] + (np.einsum("ij,ij->j", c[:, :n], x[i : i + most, :n]) >> shift[:n])
    out: list[np.ndarray] = [r[0]] * len(blocks)
    for k, (i, b) in enumerate(zip(order, some, strict=True)):
        out[i] = x[most - len(b.coefficients) : most + len(b.residual), k].copy()
    return out


def autocorrelation(x: np.ndarray, lags: int) -> np.ndarray:
    """Sums of products of samples; they are exact below 2 ** 53."""
    f = x.astype(np.float64)
    return np.array([float(np.add.accumulate(f[k:] * f[: len(f) - k])[-1]) if len(f) > k else 0.0 for k in range(lags + 1)])


def lpc_orders(most: int) -> list[int]:
    return list(range(1, most + 1)) if most <= 4 else list(dict.fromkeys(o for o in (8, 12, most) if o <= most))


def analyse(x: np.ndarray, depth: int, rate: int, profile: Profile) -> Subframe:
    """The cheapest form of a block; ties keep constant, verbatim, fixed and adaptive, in this order.

    What can't be cheaper than the best so far, by its least bits, isn't worked out; the most promising come first.
    """
    n, best = len(x), None
    if (x == x[0]).all():
        best = Subframe("constant", HEADER_BITS + depth)
    if best is None or HEADER_BITS + n * depth < best.bits:
        best = Subframe("verbatim", HEADER_BITS + n * depth)
    forms: list[tuple[_Candidate, Subframe]] = []
    r = x
    for k in range(min(profile.fixed_order, 4) + 1):
        if n < k:
            break
        r = np.diff(r) if k else x
        if found := _Candidate.of(r, k, profile.partition_order):
            forms.append((found, Subframe("fixed", HEADER_BITS + k * depth, k)))
    most = min(profile.lpc_order, 32, 12 if rate <= 48_000 else 32, n - 1)
    if most > 0:
        predictors = levinson(autocorrelation(x, most))
        for k in lpc_orders(most):
            if k > len(predictors) or not (q := quantise(predictors[k - 1], PRECISION)):
                continue
            if found := _Candidate.of(lpc_residual(x, q[1], q[0]), k, profile.partition_order):
                forms.append((found, Subframe("lpc", HEADER_BITS + k * depth + 9 + PRECISION * k, k, None, q[0], q[1])))
    least = [found.least() + form.bits for found, form in forms]
    place = -1  # of the best so far among forms
    for i in sorted(range(len(forms)), key=lambda i: (least[i], i)):
        if least[i] > best.bits:
            break
        found, form = forms[i]
        residual = found.best()
        if (form.bits + residual.bits, i) < (best.bits, place):
            form.bits, form.residual = form.bits + residual.bits, residual
            best, place = form, i
    return best


def _residual_bits(r: Residual) -> list[np.ndarray]:
    """All partitions at once: places first, then the bits of one rank of all values together."""
    width, _ = METHODS[r.method]
    escape = np.array([kind == "escape" for kind, *_ in r.partitions])
    value, starts, ends = (np.array(x, np.int64) for x in list(zip(*r.partitions, strict=True))[1:])
    count, head = ends - starts, width + 5 * escape
    k, raw, u = np.repeat(value, count), np.repeat(escape, count), folded(r.values)
    stop = u >> k
    length = np.where(raw, k, stop + 1 + k)
    after = np.concatenate(([0], np.cumsum(length)))
    at = after[:-1] + np.repeat(np.cumsum(head), count)
    out = np.zeros(int(after[-1] + head.sum()), np.uint8)

    def put(place: np.ndarray, values: np.ndarray, widths: np.ndarray | int) -> None:
        """The low bits of values, the highest first."""
        for bit in range(int(np.max(widths, initial=0))):
            some = widths > bit if isinstance(widths, np.ndarray) else slice(None)
            left = (widths[some] if isinstance(widths, np.ndarray) else widths) - 1 - bit
            out[place[some] + bit] = values[some] >> left & 1

    place = np.cumsum(head) - head + after[starts]
    put(place, np.where(escape, (1 << width) - 1, value), width)
    if escape.any():
        put(place[escape] + width, value[escape], 5)
        put(at[raw], r.values[raw], k[raw])
        at, k, u, stop = at[~raw], k[~raw], u[~raw], stop[~raw]
    out[at + stop] = 1
    if len(k) and (k == k[0]).all():
        put(at + stop + 1, u, int(k[0]))
    else:
        put(at + stop + 1, u, k)
    return [B.field([r.method], 2), B.field([r.order], 4), out]


def _subframe_bits(s: Subframe, x: np.ndarray, depth: int) -> list[np.ndarray]:
    code = {"constant": 0, "verbatim": 1, "fixed": 8 + s.order, "lpc": 31 + s.order}[s.kind]
    out = [B.field([code << 1], 8)]
    if s.kind == "constant":
        return [*out, B.field(x[:1], depth)]
    if s.kind == "verbatim":
        return [*out, B.field(x, depth)]
    out.append(B.field(x[: s.order], depth))
    if s.kind == "lpc":
        out += [B.field([PRECISION - 1], 4), B.field([s.shift], 5), B.field(s.coefficients, PRECISION)]
    return out + _residual_bits(s.residual)


def _size_code(n: int) -> tuple[int, bytes]:
    for k in range(4):
        if n == 576 << k:
            return 2 + k, b""
    for k in range(8):
        if n == 256 << k:
            return 8 + k, b""
    return (1, b"") if n == 192 else (6, bytes((n - 1,))) if n <= 256 else (7, (n - 1).to_bytes(2, "big"))


def _rate_code(rate: int) -> tuple[int, bytes]:
    for code, hz in RATE_CODES.items():
        if hz == rate:
            return code, b""
    if rate % 1000 == 0 and rate <= 255_000:
        return 12, bytes((rate // 1000,))
    if rate <= 65_535:
        return 13, rate.to_bytes(2, "big")
    return (14, (rate // 10).to_bytes(2, "big")) if rate % 10 == 0 and rate <= 655_350 else (0, b"")


def header(n: int, rate: int, assignment: int, depth: int, number: int, variable: bool) -> bytes:
    (size, more), (speed, hz) = _size_code(n), _rate_code(rate)
    depth_code = next((c for c, b in DEPTH_CODES.items() if b == depth), 0)
    head = bytes((0xFF, 0xF8 | variable, size << 4 | speed, assignment << 4 | depth_code << 1)) + B.coded(number) + more + hz
    return head + bytes((B.crc8(head),))


def encode(planes: np.ndarray, depth: int, rate: int, profile: Profile, number: int, variable: bool = False) -> tuple[bytes, list[Subframe]]:
    """A frame of planes (channels, samples). Mid/side stands in for two channels if its magnitudes sum to less; not at 32 bits."""
    x = np.asarray(planes, np.int64)
    assignment, depths = len(x) - 1, [depth] * len(x)
    if len(x) == 2 and profile.mid_side and depth < 32:
        mid, side = (x[0] + x[1]) >> 1, x[0] - x[1]
        if np.abs(mid).sum() + np.abs(side).sum() < np.abs(x).sum():
            x, assignment, depths = np.array([mid, side]), 10, [depth, depth + 1]
    forms = [analyse(c, d, rate, profile) for c, d in zip(x, depths, strict=True)]
    body = np.concatenate([b for s, c, d in zip(forms, x, depths, strict=True) for b in _subframe_bits(s, c, d)])
    data = header(x.shape[1], rate, assignment, depth, number, variable) + np.packbits(body).tobytes()
    return data + B.crc16(data).to_bytes(2, "big"), forms


@dataclass(frozen=True)
class Header:
    size: int
    rate: int
    assignment: int
    depth: int
    number: int
    variable: bool
    length: int


def parse_header(data: bytes, at: int, rate: int, depth: int) -> Header:
    """Raises ValueError for what is no frame header; rate and depth are those of the stream."""
    h = data[at : at + 16]
    if len(h) < 6 or h[0] != 0xFF or h[1] & 0xFE != 0xF8 or h[3] & 1:
        raise ValueError("no frame header")
    size, speed, assignment, deep = h[2] >> 4, h[2] & 15, h[3] >> 4, h[3] >> 1 & 7
    if size == 0 or speed == 15 or assignment > 10 or deep == 3:
        raise ValueError("a frame header has reserved values")
    number, p = B.uncoded(h, 4)
    n = 192 if size == 1 else 576 << (size - 2) if size < 6 else 256 << (size - 8) if size > 7 else int.from_bytes(h[p : p + size - 5], "big") + 1
    p += size - 5 if size in (6, 7) else 0
    extra = {12: 1, 13: 2, 14: 2}.get(speed, 0)
    value = int.from_bytes(h[p : p + extra], "big")
    hz = {0: rate, 12: value * 1000, 13: value, 14: value * 10}.get(speed) if speed in (0, 12, 13, 14) else RATE_CODES[speed]
    p += extra
    if p >= len(h) or B.crc8(h[:p]) != h[p]:
        raise ValueError("a frame header's checksum is wrong")
    if hz != rate:
        raise ValueError("the rate changes within the stream")
    return Header(n, hz, assignment, DEPTH_CODES.get(deep, depth), number, bool(h[1] & 1), p + 1)


class _Bits:
    """The bits of some frames' bytes: fields anywhere, and the next set bit after any place."""

    def __init__(self, data: bytes):
        self.bytes = data
        raw = np.frombuffer(data + bytes(8), np.uint8)
        self.size = 8 * len(data)
        self.windows = np.zeros(len(data) + 4, np.int64)  # 40 bits from each byte on
        for k in range(5):
            self.windows = self.windows << 8 | raw[k : k + len(self.windows)]
        bits = np.unpackbits(raw[: len(data)])
        ones = np.where(bits, np.arange(self.size, dtype=np.int32), np.int32(self.size))
        self.next = np.append(np.minimum.accumulate(ones[::-1])[::-1], np.int32(self.size))

    def field(self, at: int, width: int) -> int:
        last = (at + width + 7) >> 3
        return int.from_bytes(self.bytes[at >> 3 : last], "big") >> (8 * last - at - width) & ((1 << width) - 1)

    def fields(self, at: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        """Of up to 33 bits each."""
        return self.windows[np.minimum(at, self.size) >> 3] >> (40 - (at & 7) - width) & ((1 << width) - 1)

    def signed(self, at: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        v = self.fields(at, width)
        half = (1 << width) >> 1
        return (v ^ half) - half


@dataclass
class _Lane:
    """A residual that is to be read: n samples, order of them warm-up; at: of its first partition's parameter."""

    at: int
    end: int
    n: int
    order: int
    width: int
    partitions: int


def _residuals(b: _Bits, lanes: list[_Lane]) -> tuple[list[np.ndarray], list[int]]:
    """Residuals and where each ends. A value's place follows from the one before, so each step reads one value of every residual; the longest stand first."""
    order = sorted(range(len(lanes)), key=lambda i: lanes[i].order - lanes[i].n)
    some = [lanes[i] for i in order]
    counts = np.array([x.n - x.order for x in some])
    steps = int(counts[0]) if len(some) else 0
    begins: dict[int, list[int]] = {}  # of partitions: which residuals have one that begins at a step
    at, width = np.array([x.at for x in some]), np.array([x.width for x in some])
    for k, x in enumerate(some):
        size = x.n // x.partitions
        for m in range(x.partitions):
            if m == 0 and size == x.order:  # a first partition without values has a parameter all the same
                at[k] += x.width + 5 * (b.field(x.at, x.width) == (1 << x.width) - 1)
            else:
                begins.setdefault(max(0, m * size - x.order), []).append(k)
    parameter, raw = np.zeros(len(some), np.int64), np.zeros(len(some), bool)
    first, parameters, raws = np.zeros((steps, len(some)), np.int64), np.zeros((steps, len(some)), np.int64), np.zeros((steps, len(some)), bool)
    stops = np.zeros((steps, len(some)), np.int64)
    live = np.searchsorted(-counts, -np.arange(steps), side="left").tolist()
    for i, n in enumerate(live):
        if i in begins:
            k = np.array(begins[i])
            value = b.fields(at[k], width[k])
            raw[k] = value == (1 << width[k]) - 1
            at[k] += width[k]
            parameter[k] = np.where(raw[k], b.fields(at[k], 5), value)
            at[k] += 5 * raw[k]
        here = np.minimum(at[:n], b.size)
        stop = b.next[here]
        first[i, :n], stops[i, :n], parameters[i, :n], raws[i, :n] = here, stop, parameter[:n], raw[:n]
        at[:n] = np.where(raw[:n], here, stop + 1) + parameter[:n]
    if any(at > [x.end for x in some]):
        raise ValueError("a frame ends early")
    folds = (stops - first) << parameters | b.fields(stops + 1, parameters)
    values = np.where(raws, b.signed(first, parameters), unfolded(folds))
    out, ends = [values[0]] * len(lanes) if steps else [np.zeros(0, np.int64)] * len(lanes), [0] * len(lanes)
    for k, i in enumerate(order):
        out[i], ends[i] = values[: counts[k], k].copy(), int(at[k])
    return out, ends


def _subframe(b: _Bits, at: int, end: int, n: int, depth: int) -> tuple[int, np.ndarray | None, _Lane | None, tuple]:
    """What stands at a place: wasted bits, samples or what they follow from, the residual to be read, and what the samples need of it. Without a residual the subframe ends where the samples do."""
    code, wasted = b.field(at, 8), 0
    if code & 0x80:
        raise ValueError("a subframe's padding isn't zero")
    at += 8
    if code & 1:
        stop = int(b.next[min(at, b.size)])
        wasted, at = stop - at + 1, stop + 1
    code, depth = code >> 1, depth - wasted
    if depth < 1:
        raise ValueError("a subframe has more wasted bits than bits")
    many = lambda count, width: b.signed(at + width * np.arange(count), width)
    if code < 2:
        size = depth * (1 if code == 0 else n)
        if at + size > end:
            raise ValueError("a frame ends early")
        return wasted, np.full(n, many(1, depth)[0]) if code == 0 else many(n, depth), None, (at + size,)
    if not (8 <= code <= 12 or code >= 32):
        raise ValueError("a subframe has reserved values")
    order = code - 8 if code <= 12 else code - 31
    if order > n or at + order * depth + 6 > end:
        raise ValueError("a frame ends early")
    warmup = many(order, depth)
    at, coefficients, shift = at + order * depth, None, 0
    if code >= 32:
        precision = b.field(at, 4) + 1
        shift = int(b.signed(np.array([at + 4]), 5)[0])
        if precision == 16:
            raise ValueError("a subframe has reserved values")
        at += 9
        coefficients = many(order, precision)
        at += order * precision
    method, p = b.field(at, 2), b.field(at + 2, 4)
    if method > 1 or n % (1 << p) or n >> p < order:
        raise ValueError("a residual's partitions don't fit the block")
    return wasted, None, _Lane(at + 6, end, n, order, METHODS[method][0], 1 << p), (warmup, coefficients, shift)


def _samples(residual: np.ndarray, warmup: np.ndarray, coefficients: np.ndarray | None, shift: int) -> np.ndarray | Recurrence:
    if coefficients is not None:
        return Recurrence(warmup, residual, coefficients << -shift if shift < 0 else coefficients, max(shift, 0))
    x = residual
    for m in range(len(warmup), 0, -1):  # running sums from the warm-up's differences
        x = np.cumsum(np.concatenate(([np.diff(warmup, m - 1)[-1]], x)))[1:]
    return np.concatenate((warmup, x))


def _parsed(data: bytes, places: list[tuple[int, int]], rate: int, depth: int) -> list[tuple[Header, list[tuple[np.ndarray | Recurrence, int]]]]:
    """Headers and subframes of frames, read side by side: all first subframes, then all second ones."""
    base = min(at for at, _ in places)
    b = _Bits(data[base : max(end for _, end in places)])
    heads, at, ends = [], [], []
    for start, end in places:
        h = parse_header(data, start, rate, depth)
        if B.crc16(data[start : end - 2]) != int.from_bytes(data[end - 2 : end], "big"):
            raise ValueError("a frame's checksum is wrong")
        heads.append(h)
        at.append(8 * (start + h.length - base))
        ends.append(8 * (end - 2 - base))
    out: list[list[tuple[np.ndarray | Recurrence, int]]] = [[] for _ in heads]
    for c in range(8):
        todo = []
        for k, h in enumerate(heads):
            if c < (h.assignment + 1 if h.assignment < 8 else 2):
                side = {8: 1, 9: 0, 10: 1}.get(h.assignment, -1)
                wasted, x, lane, rest = _subframe(b, at[k], ends[k], h.size, h.depth + (c == side))
                if lane is None:
                    out[k].append((x, wasted))
                    at[k] = rest[0]
                else:
                    todo.append((k, wasted, lane, rest))
        found, after = _residuals(b, [lane for _, _, lane, _ in todo])
        for (k, wasted, _, rest), residual, place in zip(todo, found, after, strict=True):
            out[k].append((_samples(residual, *rest), wasted))
            at[k] = place
    return list(zip(heads, out, strict=True))


def _planes(h: Header, x: list[np.ndarray]) -> np.ndarray:
    if h.assignment == 8:
        x = [x[0], x[0] - x[1]]
    elif h.assignment == 9:
        x = [x[0] + x[1], x[1]]
    elif h.assignment == 10:
        left = x[0] + ((x[1] + (x[1] & 1)) >> 1)
        x = [left, left - x[1]]
    planes = np.array(x, np.int64)
    if planes.size and (planes.min() < -(1 << (h.depth - 1)) or planes.max() >= 1 << (h.depth - 1)):
        raise ValueError("a sample is beyond the stream's depth")
    return planes


def decode_many(data: bytes, places: list[tuple[int, int]], rate: int, depth: int, together: int = 128) -> Iterator[tuple[Header, np.ndarray]]:
    """Headers and planes of the frames in data[at:end], in order. Frames know nothing of each other, so together of them run side by side."""
    for begin in range(0, len(places), together):
        frames = _parsed(data, places[begin : begin + together], rate, depth)
        done = iter(lpc_restored([x for _, subframes in frames for x, _ in subframes if isinstance(x, Recurrence)]))
        for h, subframes in frames:
            yield h, _planes(h, [(next(done) if isinstance(x, Recurrence) else x) << wasted for x, wasted in subframes])


def decode(data: bytes, at: int, end: int, rate: int, depth: int) -> tuple[Header, np.ndarray]:
    """The header and planes of the frame in data[at:end]; end is where the next frame begins."""
    return next(decode_many(data, [(at, end)], rate, depth))


def boundaries(data: bytes, at: int, rate: int, depth: int, total: int) -> list[tuple[int, int, int]]:
    """(place, first sample, samples) of each frame. A frame begins where a header with a right checksum has the number that comes next
    and the bytes before it end in a right checksum."""
    found: list[tuple[int, int, int]] = []
    done = 0
    while True:
        h = parse_header(data, at, rate, depth)
        found.append((at, done, h.size))
        done += h.size
        if done >= total:
            return found
        at = following(data, at, h, rate, depth)
        if at is None:
            raise ValueError("the stream ends early")


def following(data: bytes, at: int, h: Header, rate: int, depth: int) -> int | None:
    """Where the frame after that of header h at a place begins; None if data has no such place."""
    after = h.number + h.size if h.variable else h.number + 1
    place = at + h.length
    while True:
        place = data.find(b"\xff", place + 1)
        if place < 0:
            return None
        try:
            nxt = parse_header(data, place, rate, depth)
        except (ValueError, IndexError):
            continue
        if nxt.number == after and nxt.variable == h.variable and B.crc16(data[at : place - 2]) == int.from_bytes(data[place - 2 : place], "big"):
            return place


def entered(data: bytes, rate: int, depth: int, before: int) -> int | None:
    """Where the first frame that is known to begin in data begins, up to a place: a header after which a frame follows, as following() has it."""
    place = -1
    while 0 <= (place := data.find(b"\xff", place + 1)) <= before:
        try:
            h = parse_header(data, place, rate, depth)
        except (ValueError, IndexError):
            continue
        if following(data, place, h, rate, depth) is not None:
            return place
    return None


class Scanner:
    """Frames of a stream whose bytes come in pieces: push() gives those that are known to be whole, finish() the last one. What isn't whole is held."""

    def __init__(self, rate: int, depth: int, total: int):
        self.rate, self.depth, self.total = rate, depth, total
        self.held, self.done, self.ended = b"", 0, False

    def push(self, data: bytes) -> list[tuple[Header, bytes]]:
        if self.ended and data:
            raise ValueError("something follows the last frame")
        self.held += data
        out: list[tuple[Header, bytes]] = []
        at = 0
        while len(self.held) - at >= 16:
            h = parse_header(self.held, at, self.rate, self.depth)
            if self.done + h.size >= self.total:
                break
            end = following(self.held, at, h, self.rate, self.depth)
            if end is None:
                break
            out.append((h, self.held[at:end]))
            self.done += h.size
            at = end
        self.held = self.held[at:]
        return out

    def finish(self) -> list[tuple[Header, bytes]]:
        """The last frame; raises if the stream isn't at its stated end."""
        self.ended = True
        if self.done == self.total and not self.held:
            return []
        h = parse_header(self.held, 0, self.rate, self.depth)
        if self.done + h.size != self.total or B.crc16(self.held[:-2]) != int.from_bytes(self.held[-2:], "big"):
            raise ValueError("the stream ends early")
        last, self.held, self.done = (h, self.held), b"", self.total
        return [last]
