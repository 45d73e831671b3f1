"""Checksums, coded numbers and bit fields of frames."""

from __future__ import annotations

from functools import cache

import numpy as np


#: Bytes whose checksums are taken at once.
_RUN = 256


@cache
def _tables(poly: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a byte adds to the checksum of a run that ends so many bytes after it, flattened; and what a checksum's low and high byte become when a run follows."""
    top, mask = 1 << (width - 1), (1 << width) - 1
    one = np.arange(256, dtype=np.int64) << (width - 8)
    for _ in range(8):
        one = np.where(one & top, (one << 1) ^ poly, one << 1) & mask
    after = lambda crc: ((crc << 8) & mask) ^ one[crc >> (width - 8)]  # noqa: E731  a zero byte follows
    rows = [one]
    for _ in range(_RUN - 1):
        rows.append(after(rows[-1]))
    low, high = np.arange(256, dtype=np.int64), np.arange(256, dtype=np.int64) << 8 if width > 8 else np.zeros(256, np.int64)
    for _ in range(_RUN):
        low, high = after(low), after(high)
    return np.array(rows[::-1], np.uint16).reshape(-1), low, high


def _crc(data: bytes, poly: int, width: int) -> int:
    by_place, low, high = _tables(poly, width)
    # zeros before the data change nothing, as a checksum begins at 0
    padded = np.zeros(-(-len(data) // _RUN) * _RUN, np.int64)
    padded[len(padded) - len(data) :] = np.frombuffer(data, np.uint8)
    crc = 0
    for begin in range(0, len(padded), _RUN << 10):
        runs = padded[begin : begin + (_RUN << 10)].reshape(-1, _RUN)
        for part in np.bitwise_xor.reduce(by_place[runs + (np.arange(_RUN) << 8)], axis=1).tolist():
            crc = int(low[crc & 0xFF]) ^ int(high[crc >> 8]) ^ part
    return crc


@cache
def _bytewise(poly: int) -> tuple[int, ...]:
    return tuple(_tables(poly, 8)[0].reshape(_RUN, 256)[-1].tolist())


def crc8(data: bytes) -> int:
    """Polynomial 0x07, most significant bit first, from 0."""
    if len(data) > 32:
        return _crc(data, 0x07, 8)
    t, r = _bytewise(0x07), 0  # frame headers are short
    for b in data:
        r = t[r ^ b]
    return r


def crc16(data: bytes) -> int:
    """Polynomial 0x8005, most significant bit first, from 0."""
    return _crc(data, 0x8005, 16)


def coded(number: int) -> bytes:
    """A number of up to 36 bits, as UTF-8 would go on."""
    if not 0 <= number < 1 << 36:
        raise ValueError(f"{number} has no coded form")
    if number < 0x80:
        return bytes((number,))
    size = 2
    while number >= 1 << (5 * size + 1):
        size += 1
    lead = (0xFF << (8 - size)) & 0xFF
    tail = [0x80 | (number >> (6 * i)) & 0x3F for i in range(size - 1)]
    return bytes((lead | number >> (6 * (size - 1)), *reversed(tail)))


def uncoded(data: bytes, at: int) -> tuple[int, int]:
    """The number at a place, and the place after it."""
    first = data[at]
    if first < 0x80:
        return first, at + 1
    size = 8 - (first ^ 0xFF).bit_length()
    if not 2 <= size <= 7 or at + size > len(data):
        raise ValueError("a coded number is malformed")
    number = first & (0xFF >> (size + 1))
    for b in data[at + 1 : at + size]:
        if b & 0xC0 != 0x80:
            raise ValueError("a coded number is malformed")
        number = number << 6 | b & 0x3F
    return number, at + size


def field(values: np.ndarray, width: int) -> np.ndarray:
    """Two's complement bits of values, one row after another."""
    v = np.asarray(values, np.int64)
    shifts = np.arange(width - 1, -1, -1)
    return ((v[:, None] >> shifts) & 1).astype(np.uint8).reshape(-1)


def rice(folded: np.ndarray, parameter: int) -> np.ndarray:
    """Each value as so many zeros, a one and its low bits."""
    q = folded >> parameter
    ends = np.cumsum(q + 1 + parameter)
    stop = ends - parameter - 1
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    out[stop] = 1
    for b in range(parameter):
        out[stop + 1 + b] = folded >> (parameter - 1 - b) & 1
    return out
