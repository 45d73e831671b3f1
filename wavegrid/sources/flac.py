"""FLAC streams: header blocks, comments, cue sheets, seek tables and whole files."""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass

import numpy as np

from wavegrid.functions import frames as fr
from wavegrid.operators.metadata import MASK_KEY, MOST_SEEK_POINTS, PROVENANCE_SUFFIX
from wavegrid.sources.containers import ContainerError, Spec, checked

PLACEHOLDER = (1 << 64) - 1
PROVENANCE_KEY = f"WAVEGRID{PROVENANCE_SUFFIX}"
#: The private chunk that keeps header blocks in WAVE files: id and magic, version, flags.
BUNDLE = (b"fxmd", 1, 1)


@dataclass(frozen=True)
class StreamInfo:
    min_block: int
    max_block: int
    min_frame: int
    max_frame: int
    rate: int
    channels: int
    bits: int
    total: int
    md5: bytes = bytes(16)

    def fits(self) -> bool:
        """Whether rate, channels, bits and total fit their 20, 3, 5 and 36 bits."""
        return 0 <= self.rate < 1 << 20 and 1 <= self.channels <= 8 and 1 <= self.bits <= 32 and 0 <= self.total < 1 << 36

    def bytes(self) -> bytes:
        if not self.fits():
            raise ContainerError("a stream's rate, channels, bits or total don't fit its header block")
        packed = self.rate << 44 | (self.channels - 1) << 41 | (self.bits - 1) << 36 | self.total
        return struct.pack(">HH", self.min_block, self.max_block) + self.min_frame.to_bytes(3, "big") + self.max_frame.to_bytes(3, "big") + packed.to_bytes(8, "big") + self.md5

    @staticmethod
    def parse(b: bytes) -> StreamInfo:
        if len(b) != 34:
            raise ContainerError("a stream's header block isn't 34 bytes")
        p = int.from_bytes(b[10:18], "big")
        return StreamInfo(*struct.unpack_from(">HH", b), int.from_bytes(b[4:7], "big"), int.from_bytes(b[7:10], "big"), p >> 44, (p >> 41 & 7) + 1, (p >> 36 & 31) + 1, p & ((1 << 36) - 1), b[18:34])


def block(kind: int, body: bytes, last: bool) -> bytes:
    if len(body) >= 1 << 24:
        raise ContainerError("a metadata block is too long")
    return bytes((last << 7 | kind,)) + len(body).to_bytes(3, "big") + body


def comments_bytes(vendor: str, entries: list[str]) -> bytes:
    text = lambda t: struct.pack("<I", len(t.encode())) + t.encode()
    return text(vendor) + struct.pack("<I", len(entries)) + b"".join(map(text, entries))


def parse_comments(b: bytes) -> tuple[str, list[str]]:
    """Vendor and entries; the block must end with the last one."""

    def text(at: int) -> tuple[str, int]:
        n = struct.unpack_from("<I", b, at)[0]
        if at + 4 + n > len(b):
            raise ContainerError("a comment ends early")
        return b[at + 4 : at + 4 + n].decode(), at + 4 + n

    try:
        vendor, at = text(0)
        (count,), at, entries = struct.unpack_from("<I", b, at), at + 4, []
        for _ in range(count):
            entry, at = text(at)
            entries.append(entry)
    except (struct.error, UnicodeDecodeError) as e:
        raise ContainerError("comments are malformed") from e
    if at != len(b):
        raise ContainerError("something follows the comments")
    return vendor, entries


def bundle_bytes(blocks: list[tuple[int, bytes]]) -> bytes:
    """Header blocks in the private chunk's form: distinct bodies once, then a record a block. Empty without blocks."""
    bodies = list(dict.fromkeys(b for _, b in blocks))
    place = {b: i for i, b in enumerate(bodies)}
    head = struct.pack("<4sHHII", *BUNDLE, len(bodies), len(blocks))
    texts = b"".join(struct.pack("<I", len(b)) + b for b in bodies)
    return head + texts + b"".join(struct.pack("<BBHII", kind, 0, 0, n, place[b]) for n, (kind, b) in enumerate(blocks)) if blocks else b""


def parse_bundle(data: bytes) -> list[tuple[int, bytes]]:
    """Header blocks of the private chunk; records must be in order and nothing may follow."""
    try:
        *kind, bodies, records = struct.unpack_from("<4sHHII", data)
        at, texts, out, last = 16, [], [], -1
        for _ in range(bodies):
            (n,) = struct.unpack_from("<I", data, at)
            texts.append(data[at + 4 : at + 4 + n])
            at += 4 + n
        for _ in range(records):
            block_type, _, _, ordinal, body = struct.unpack_from("<BBHII", data, at)
            if ordinal < last:
                raise ContainerError("a bundle's records are out of order")
            out.append((block_type, texts[body]))
            at, last = at + 12, ordinal
    except (struct.error, IndexError) as e:
        raise ContainerError("a bundle ends early") from e
    if tuple(kind) != BUNDLE or at != len(data):
        raise ContainerError("not a bundle that can be read")
    return out


def cuesheet_bytes(offsets: list[int], lead_out: int) -> bytes:
    """A track for each offset, with index 1 at its start, and the lead-out track."""
    out = bytes(128) + bytes(8) + bytes(259) + bytes((len(offsets) + 1,))
    for n, offset in enumerate(offsets, 1):
        out += struct.pack(">QB", offset, n) + bytes(12) + bytes(14) + b"\1" + struct.pack(">QB", 0, 1) + bytes(3)
    return out + struct.pack(">QB", lead_out, 255) + bytes(12) + bytes(14) + b"\0"


def parse_cuesheet(b: bytes) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """(track, offset, [(number, offset)]) with the lead-out last. Track numbers are unique, index numbers ascend."""
    tracks, at = [], 396
    try:
        for _ in range(b[395]):
            offset, number, count = *struct.unpack_from(">QB", b, at), b[at + 35]
            points = [struct.unpack_from(">QB", b, at + 36 + 12 * k)[::-1] for k in range(count)]
            at += 36 + 12 * count
            numbers = [p[0] for p in points]
            if number in (t[0] for t in tracks) or any(y != x + 1 for x, y in zip(numbers, numbers[1:], strict=False)) or (numbers and numbers[0] > 1):
                raise ContainerError("a cue sheet's numbers are out of order")
            tracks.append((number, offset, points))
    except (struct.error, IndexError) as e:
        raise ContainerError("a cue sheet ends early") from e
    if at != len(b) or not tracks or tracks[-1][0] not in (170, 255) or tracks[-1][2]:
        raise ContainerError("a cue sheet has no lead-out at its end")
    return tracks


def cue_offsets(tracks) -> list[int]:
    """Each track's offset plus that of its index 1, once each."""
    return list(dict.fromkeys(offset + dict(points).get(1, 0) for number, offset, points in tracks[:-1]))


def seektable_bytes(points: list[tuple[int, int, int]]) -> bytes:
    return b"".join(struct.pack(">QQH", *p) for p in points)


def parse_seektable(b: bytes, strict: bool = False) -> list[tuple[int, int, int]]:
    """Points; a malformed table is none, or an error if strict."""
    points = [struct.unpack_from(">QQH", b, i) for i in range(0, len(b) - 17, 18)]
    numbers = [p[0] for p in points if p[0] != PLACEHOLDER]
    good = len(b) % 18 == 0 and all(x < y for x, y in zip(numbers, numbers[1:], strict=False)) and all(p[0] == PLACEHOLDER for p in points[len(numbers) :])
    if not good and strict:
        raise ContainerError("a seek table is malformed")
    return points if good else []


def selected(frames: int, most: int = MOST_SEEK_POINTS) -> list[int]:
    """Frames that get seek points: all, or most of them evenly spread."""
    n = min(frames, most)
    return list(range(n)) if n == frames else [s * (frames - 1) // max(n - 1, 1) for s in range(n)]


@dataclass(frozen=True)
class Stream:
    info: StreamInfo
    blocks: tuple[tuple[int, bytes], ...]
    start: int  # of the first frame

    def entries(self) -> list[str]:
        for kind, body in self.blocks:
            if kind == 4:
                return parse_comments(body)[1]
        return []

    def mask(self, strict: bool = False) -> int:
        for e in self.entries():
            key, _, value = e.partition("=")
            if key.upper() == MASK_KEY:
                try:
                    return int(value.strip().lower().removeprefix("0x"), 16)
                except ValueError:
                    if strict:
                        raise ContainerError("a channel mask is malformed") from None
            if strict and key.upper().endswith(PROVENANCE_SUFFIX) and value.strip() != "1":
                raise ContainerError("a mask's provenance is malformed")
        return 0

    def spec(self, strict: bool = False) -> Spec:
        i = self.info
        return checked(Spec(i.rate, i.channels, i.bits, 0, self.mask(strict), i.total, self.start, family="flac"))


def parse(read, strict: bool = False) -> Stream:
    """Header blocks; the first one must be the stream's own. Opaque blocks are kept as they are."""
    if read(0, 4) != b"fLaC":
        raise ContainerError("not FLAC")
    at, blocks, last = 4, [], False
    while not last:
        head = read(at, 4)
        if len(head) < 4:
            raise ContainerError("the header blocks end early")
        last, kind, size = bool(head[0] & 0x80), head[0] & 0x7F, int.from_bytes(head[1:], "big")
        body = read(at + 4, size)
        if len(body) < size or kind == 127 or (kind == 0) != (at == 4):
            raise ContainerError("a header block is malformed or out of place")
        if kind == 3:
            parse_seektable(body, strict)
        blocks.append((kind, body))
        at += 4 + size
    return Stream(StreamInfo.parse(blocks[0][1]), tuple(blocks[1:]), at)


def digest_bytes(x: np.ndarray, bits: int) -> bytes:
    """What a stream's digest is of: interleaved samples, sign-extended to whole bytes, little-endian."""
    width = -(-bits // 8)
    return np.asarray(x, "<i8").reshape(-1).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def header(info: StreamInfo, blocks: list[tuple[int, bytes]]) -> bytes:
    every = [(0, info.bytes()), *blocks]
    return b"fLaC" + b"".join(block(k, b, i == len(every) - 1) for i, (k, b) in enumerate(every))


def schedule(total: int, block_size: int, sizes: list[int] | None = None) -> list[int]:
    """Samples of each frame: blocks of one size with a short last one, or the scheduled ones, which must sum to the total."""
    if sizes is None:
        return [min(block_size, total - i) for i in range(0, total, block_size)]
    if sum(sizes) != total or any(s < 16 for s in sizes[:-1]) or any(not 0 < s < 1 << 16 for s in sizes):
        raise ContainerError("the schedule doesn't fit the samples")
    return sizes


def assembled(info: StreamInfo, frames: list[tuple[int, bytes]], blocks: list[tuple[int, bytes]], seek: bool = True) -> bytes:
    """A file of frames (samples, bytes) in order, with a seek table before the other blocks."""
    points, at, done = [], 0, 0
    chosen = set(selected(len(frames)))
    for k, (n, b) in enumerate(frames):
        if k in chosen:
            points.append((done, at, n))
        at, done = at + len(b), done + n
    table = [(3, seektable_bytes(points))] if seek and points else []
    return header(info, [*table, *[b for b in blocks if b[0] != 3]]) + b"".join(b for _, b in frames)


def stream_info(s: Spec, sizes: list[int], lengths: list[int], md5: bytes, fixed: bool) -> StreamInfo:
    """Smallest and largest blocks and frames; a short last block of a fixed size doesn't count."""
    body = sizes[:-1] if fixed and len(sizes) > 1 else sizes
    return StreamInfo(min(body, default=16), max(sizes, default=16), min(lengths, default=0), max(lengths, default=0), s.rate, s.channels, s.valid_bits, s.total, md5)


def encode(x: np.ndarray, s: Spec, level: int = 8, sizes: list[int] | None = None, block_size: int | None = None, blocks: list[tuple[int, bytes]] = ()) -> bytes:
    """A whole file of samples (samples, channels)."""
    profile = fr.Profile.of(level)
    plan, out, at = schedule(s.total, block_size or profile.block_size, sizes), [], 0
    for k, n in enumerate(plan):
        out.append((n, fr.encode(x[at : at + n].T, s.valid_bits, s.rate, profile, at if sizes else k, bool(sizes))[0]))
        at += n
    info = stream_info(s, plan, [len(b) for _, b in out], hashlib.md5(digest_bytes(x, s.valid_bits)).digest(), not sizes)
    return assembled(info, out, list(blocks))


def decode(data: bytes, verify: bool = True, strict: bool = False) -> tuple[Stream, np.ndarray]:
    """Header blocks and samples (samples, channels). An all-zero digest isn't compared."""
    s = parse(lambda at, n: data[at : at + n], strict)
    i = s.info
    if not i.total:
        return s, np.zeros((0, i.channels), np.int64)
    index = fr.boundaries(data, s.start, i.rate, i.bits, i.total)
    ends = [a for a, _, _ in index[1:]] + [len(data)]
    x = np.concatenate([planes for _, planes in fr.decode_many(data, [(a, e) for (a, _, _), e in zip(index, ends, strict=True)], i.rate, i.bits)], axis=1).T
    if len(x) != i.total:
        raise ContainerError(f"{len(x)} samples where {i.total} are stated")
    if verify and i.md5 != bytes(16) and hashlib.md5(digest_bytes(x, i.bits)).digest() != i.md5:
        raise ContainerError("the samples' digest is wrong")
    return s, x
