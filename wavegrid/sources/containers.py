"""PCM containers: WAVE, RF64, Wave64, AIFF, AIFC, CAF and raw samples, read and written."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field, replace

import numpy as np

from wavegrid.functions.columns import CHANNEL_MASKS, MASK_BITS
from wavegrid.operators.metadata import AIFF_TEXTS, CAF_KEYS, CAF_OTHER_DATE
from wavegrid.operators.planning import RIFF_MOST

#: The end of a Wave64 chunk's id, after its four letters; of the first chunk; and of the PCM subformat.
W64_TAIL, W64_RIFF_TAIL = bytes.fromhex("f3acd3118cd100c04f8edb8a"), bytes.fromhex("2e91cf11a5d628db04c10000")
PCM_GUID_TAIL = bytes.fromhex("000000001000800000aa00389b71")


class ContainerError(ValueError):
    """What isn't a container that can be read or written."""


@dataclass(frozen=True)
class Spec:
    """How samples are stored. layout: unsigned8 (8-bit WAVE), le or be."""

    rate: int
    channels: int
    valid_bits: int
    container_bits: int = 0
    mask: int = 0
    total: int = 0
    data_offset: int = 0
    layout: str = "le"
    family: str = "wave"
    chunks: tuple[tuple[bytes, bytes], ...] = field(default=(), repr=False)

    @property
    def frame_bytes(self) -> int:
        return self.channels * self.container_bits // 8

    @property
    def usual_mask(self) -> int:
        return CHANNEL_MASKS[self.channels]


def checked(s: Spec) -> Spec:
    """s with container width and mask filled in; raises for what is out of bounds."""
    width = s.container_bits or -(-s.valid_bits // 8) * 8
    if not 1 <= s.channels <= 8 or not 4 <= s.valid_bits <= 32 or width not in (8, 16, 24, 32) or s.valid_bits > width:
        raise ContainerError(f"{s.channels} channels of {s.valid_bits} bits in {width} can't be read")
    if not 1 <= s.rate < 1 << 20 or not 0 <= s.total < 1 << 36:
        raise ContainerError(f"a rate of {s.rate} or {s.total} samples can't be read")
    mask = s.mask or CHANNEL_MASKS[s.channels]
    if mask & ~MASK_BITS or mask.bit_count() > s.channels:
        raise ContainerError(f"mask {mask:#x} doesn't fit {s.channels} channels")
    return replace(s, container_bits=width, mask=mask)


def unpack(data: bytes, s: Spec) -> np.ndarray:
    """(samples, channels) of packed bytes: sign-extended, without the container's low padding bits."""
    width = s.container_bits // 8
    if width == 1:
        x = np.frombuffer(data, np.uint8).astype(np.int32)
        x = x - 128 if s.layout == "unsigned8" else x - ((x & 0x80) << 1)
    else:
        raw = np.frombuffer(data, np.uint8).reshape(-1, width)
        raw = raw if s.layout == "be" else raw[:, ::-1]
        wide = np.zeros((len(raw), 4), np.uint8)
        wide[:, :width] = raw
        x = (wide.view(">i4").astype(np.int32).reshape(-1)) >> (32 - 8 * width)
    return (x >> (s.container_bits - s.valid_bits)).reshape(-1, s.channels)


def pack(x: np.ndarray, s: Spec) -> bytes:
    """The bytes of samples; raises for samples beyond the valid bits."""
    v = np.asarray(x, np.int64).reshape(-1)
    if len(v) and (v.min() < -(1 << (s.valid_bits - 1)) or v.max() >= 1 << (s.valid_bits - 1)):
        raise ContainerError(f"a sample is beyond {s.valid_bits} bits")
    width, shift = s.container_bits // 8, s.container_bits - s.valid_bits
    if width == 1 and s.layout == "unsigned8":
        v = v + (1 << (s.valid_bits - 1))
    v = v << shift
    raw = v.astype(">i8").view(np.uint8).reshape(-1, 8)[:, 8 - width :]
    return (raw if s.layout == "be" else raw[:, ::-1]).tobytes()


# ---- reading headers; read(at, size) gives bytes of the file, and short ones at its end


#: The families that a reader is chosen from; wave stands for WAVE, RF64 and Wave64.
READERS = ("wave", "aiff", "caf")


def parse(read, size: int, keep: bool = True, family: str | None = None) -> Spec:
    """The spec of a self-describing file, by its first bytes. keep: with its metadata chunks. family: one of READERS; a file of another one raises."""
    head = read(0, 16)
    found = {b"FORM": "aiff", b"caff": "caf"}.get(head[:4], "wave")
    if family is not None and found != family:
        raise ContainerError(f"not a file of the family {family}")
    if head[:4] == b"FORM":
        return _aiff(read, size)
    if head[:4] == b"caff":
        return _caf(read, size)
    if head[:4] in (b"RIFF", b"RF64"):
        return _riff(read, size, keep)
    if head[:4] == b"riff" and head[4:] == W64_RIFF_TAIL:
        return _w64(read, size, keep)
    raise ContainerError("neither WAVE, RF64, Wave64, AIFF nor CAF")


def _format(body: bytes) -> Spec:
    if len(body) < 16:
        raise ContainerError("a short fmt chunk")
    tag, channels, rate, speed, align, width = struct.unpack_from("<HHIIHH", body)
    valid, mask = width, 0
    if tag == 0xFFFE and len(body) >= 40:
        valid, mask = struct.unpack_from("<HI", body, 18)
        if body[24:26] != b"\1\0" or body[26:40] != PCM_GUID_TAIL:
            raise ContainerError("not PCM")
    elif tag != 1 or channels > 2:
        raise ContainerError(f"format tag {tag} with {channels} channels can't be read")
    s = checked(Spec(rate, channels, valid, width, mask, layout="unsigned8" if width == 8 else "le"))
    if align != s.frame_bytes or speed != rate * align:
        raise ContainerError("sizes in the fmt chunk contradict each other")
    return s


def _captured(name: bytes) -> bool:
    return name in (b"LIST", b"cue ", b"fxmd")


def _with_data(s: Spec | None, at: int, length: int, size: int, family: str, chunks: list) -> Spec:
    if s is None:
        raise ContainerError("no fmt chunk before the samples")
    if length % s.frame_bytes or at + length > size:
        raise ContainerError("the samples' size doesn't fit the file or its frames")
    return checked(replace(s, total=length // s.frame_bytes, data_offset=at, family=family, chunks=tuple(chunks)))


def _riff(read, size: int, keep: bool) -> Spec:
    if read(8, 4) != b"WAVE":
        raise ContainerError("RIFF, but not WAVE")
    wide, spec, data, chunks, at, long = read(0, 4) == b"RF64", None, None, [], 12, None
    while at + 8 <= size:
        name, length = struct.unpack("<4sI", read(at, 8))
        if name == b"ds64":
            long = struct.unpack_from("<QQQ", read(at + 8, 24))
        if name == b"data":
            if wide and long is None:
                raise ContainerError("RF64 without ds64")
            length = long[1] if wide and length == RIFF_MOST else length
            data = at + 8, length
        elif name == b"fmt ":
            spec = _format(read(at + 8, length))
        elif keep and _captured(name):
            chunks.append((name, read(at + 8, length)))
        at += 8 + length + length % 2
    if data is None:
        raise ContainerError("no data chunk")
    return _with_data(spec, *data, size, "rf64" if wide else "wave", chunks)


def _w64(read, size: int, keep: bool) -> Spec:
    spec, data, chunks, at = None, None, [], 40
    if read(24, 4) != b"wave":
        raise ContainerError("Wave64, but not wave")
    while at + 24 <= size:
        name, tail, length = struct.unpack("<4s12sQ", read(at, 24))
        if length < 24:
            raise ContainerError("a Wave64 chunk is shorter than its header")
        known = tail == W64_TAIL
        if known and name == b"fmt ":
            spec = _format(read(at + 24, length - 24))
        elif known and name == b"data":
            data = at + 24, length - 24
        elif keep and known and _captured({b"list": b"LIST"}.get(name, name)):
            chunks.append(({b"list": b"LIST"}.get(name, name), read(at + 24, length - 24)))
        at += length + -length % 8
    if data is None:
        raise ContainerError("no data chunk")
    return _with_data(spec, *data, size, "wave64", chunks)


def extended_rate(b: bytes) -> int:
    """A whole sample rate in 80-bit floating point."""
    top, mantissa = struct.unpack(">HQ", b)
    shift = 16383 + 63 - (top & 0x7FFF)
    if top & 0x8000 or top & 0x7FFF == 0x7FFF or not 0 <= shift < 64 or mantissa & ((1 << shift) - 1):
        raise ContainerError("a rate that isn't a whole positive number")
    return mantissa >> shift


def extended_bytes(rate: int) -> bytes:
    n = rate.bit_length()
    return struct.pack(">HQ", 16383 + n - 1, rate << (64 - n))


def _aiff(read, size: int) -> Spec:
    kind, spec, data, at = read(8, 4), None, None, 12
    if kind not in (b"AIFF", b"AIFC"):
        raise ContainerError("FORM, but not AIFF")
    while at + 8 <= size:
        name, length = struct.unpack(">4sI", read(at, 8))
        if name == b"COMM":
            body = read(at + 8, length)
            channels, total, bits = struct.unpack_from(">hIh", body)
            packing = body[18:22] if kind == b"AIFC" else b"NONE"
            if packing not in (b"NONE", b"sowt") or (packing == b"sowt" and bits != 16):
                raise ContainerError(f"AIFC packing {packing!r} can't be read")
            spec = checked(Spec(extended_rate(body[8:18]), channels, bits, total=total, layout="le" if packing == b"sowt" else "be"))
        elif name == b"SSND":
            skip = struct.unpack(">I", read(at + 8, 4))[0]
            data = at + 16 + skip, length - 8 - skip
        at += 8 + length + length % 2
    if spec is None or data is None or data[1] != spec.total * spec.frame_bytes:
        raise ContainerError("COMM and SSND don't fit each other")
    return _with_data(spec, *data, size, "aifc" if kind == b"AIFC" else "aiff", [])


def _caf(read, size: int) -> Spec:
    if read(4, 4) != b"\0\1\0\0":
        raise ContainerError("an unknown CAF version")
    spec, data, at, mask, first = None, None, 8, 0, True
    while at + 12 <= size:
        name, length = struct.unpack(">4sq", read(at, 12))
        if length < 0 or first != (name == b"desc") or name == b"pakt":
            raise ContainerError("a CAF chunk that can't be read")
        first = False
        if name == b"desc":
            rate, kind, flags, packet, per, channels, bits = struct.unpack(">d4sIIIII", read(at + 12, 32))
            if kind != b"lpcm" or flags & 1 or per != 1 or not channels or rate != int(rate):
                raise ContainerError("not whole-numbered linear PCM")
            spec = Spec(int(rate), channels, bits, packet // channels * 8, layout="le" if flags & 2 else "be")
        elif name == b"chan":
            tag, bitmap = struct.unpack_from(">II", read(at + 12, 12))
            mask = bitmap if tag == 1 << 16 else 0
        elif name == b"data":
            data = at + 16, length - 4
        at += 12 + length
    if spec is None or data is None:
        raise ContainerError("no desc or data chunk")
    return _with_data(checked(replace(spec, mask=mask)), *data, size, "caf", [])


def raw(size: int, rate: int, channels: int, valid_bits: int, container_bits: int = 0, layout: str = "le", mask: int = 0) -> Spec:
    """Samples without a header. Three channels and more need a mask."""
    if channels > 2 and not mask:
        raise ContainerError("raw samples of over two channels need a mask")
    s = checked(Spec(rate, channels, valid_bits, container_bits, mask, layout=layout, family="raw"))
    return _with_data(s, 0, size, size, "raw", [])


#: What may be said of a known header's samples: the layouts of each family.
LAYOUTS = {"wave": ("unsigned8", "le"), "rf64": ("unsigned8", "le"), "wave64": ("unsigned8", "le"), "aiff": ("be",), "aifc": ("be", "le"), "caf": ("be", "le"), "raw": ("be", "le")}


def described(size: int, family: str, rate: int, channels: int, valid_bits: int, data_offset: int, total: int, container_bits: int = 0, layout: str = "le", mask: int = 0) -> Spec:
    """The spec of a file whose header is known already and isn't read: what it says is checked against the file's size, and the layout against the family's."""
    if layout not in LAYOUTS.get(family, ()):
        raise ContainerError(f"samples of the family {family} aren't {layout}")
    s = checked(Spec(rate, channels, valid_bits, container_bits, mask, layout=layout, family=family))
    if (layout == "unsigned8") != (s.container_bits == 8 and family in ("wave", "rf64", "wave64")):
        raise ContainerError("8-bit samples of the WAVE families are unsigned, and no others")
    if data_offset < 0 or total < 0 or data_offset + total * s.frame_bytes > size:
        raise ContainerError("the samples' size doesn't fit the file")
    return checked(replace(s, total=total, data_offset=data_offset))


# ---- writing: what stands before and after the packed samples


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + bytes(len(body) % 2)


def _aiff_metadata(entries: list[tuple[str, str]], cues: list[int]) -> bytes:
    """Text chunks of INFO entries, one of each but annotations, and markers."""
    out, seen = b"", set()
    block = lambda name, body: name + struct.pack(">I", len(body)) + body + bytes(len(body) % 2)
    for key, value in entries:
        name = AIFF_TEXTS.get(key)
        if name and (name == "ANNO" or name not in seen):
            seen.add(name)
            out += block(name.encode(), value.encode())
    if cues:
        out += block(b"MARK", struct.pack(">H", len(cues)) + b"".join(struct.pack(">HIH", n, o, 0) for n, o in enumerate(cues, 1)))
    return out


def _caf_metadata(entries: list[tuple[str, str]], cues: list[int]) -> bytes:
    """Information, repeats joined by commas, and markers without SMPTE times."""
    texts: dict[str, list[str]] = {}
    for key, value in entries:
        name = CAF_OTHER_DATE if key == "ICRD" and not (len(value) == 4 and value.isascii() and value.isdigit()) else CAF_KEYS.get(key)
        if name:
            texts.setdefault(name, []).append(value)
    out = b""
    if texts:
        body = struct.pack(">I", len(texts)) + b"".join(k.encode() + b"\0" + ",".join(v).encode() + b"\0" for k, v in texts.items())
        out += b"info" + struct.pack(">q", len(body)) + body
    if cues:
        body = struct.pack(">II", 0, len(cues)) + b"".join(struct.pack(">IdI8sI", 0, o, n, b"\xff" * 8, 0) for n, o in enumerate(cues, 1))
        out += b"mark" + struct.pack(">q", len(body)) + body
    return out


def _fmt(s: Spec) -> bytes:
    plain = s.channels <= 2 and s.valid_bits == s.container_bits and s.mask == s.usual_mask
    base = struct.pack("<HHIIHH", 1 if plain else 0xFFFE, s.channels, s.rate, s.rate * s.frame_bytes, s.frame_bytes, s.container_bits)
    return base if plain else base + struct.pack("<HHI", 22, s.valid_bits, s.mask) + b"\1\0" + PCM_GUID_TAIL


def written(s: Spec, family: str = "auto", chunks: list[tuple[bytes, bytes]] = (), entries: list[tuple[str, str]] = (), cues: list[int] = ()) -> tuple[Spec, bytes, bytes]:
    """The spec of samples as family stores them, and the bytes before and after them. auto: WAVE, or RF64 beyond its size.

    chunks: of WAVE and its relatives. entries (INFO id, text) and cues: of AIFF and CAF.
    """
    s = checked(replace(s, container_bits=0))
    length = s.total * s.frame_bytes
    if family in ("auto", "wave", "rf64", "wave64"):
        s = replace(s, layout="unsigned8" if s.container_bits == 8 else "le")
        fmt, extra = _fmt(s), b"".join(_chunk(n, b) for n, b in chunks)
        size = 4 + len(_chunk(b"fmt ", fmt)) + len(extra) + 8 + length + length % 2
        if family == "wave" and size > RIFF_MOST:
            raise ContainerError("too long for WAVE")
        if family == "wave64":
            pad = lambda n: bytes(-n % 8)
            block = lambda n, b: n + W64_TAIL + struct.pack("<Q", 24 + len(b)) + b + pad(len(b))
            body = block(b"fmt ", fmt) + b"".join(block({b"LIST": b"list"}.get(n, n), b) for n, b in chunks)
            total = 40 + len(body) + 24 + length + len(pad(length))
            head = b"riff" + W64_RIFF_TAIL + struct.pack("<Q", total) + b"wave" + W64_TAIL + body + b"data" + W64_TAIL + struct.pack("<Q", 24 + length)
            return replace(s, family="wave64", data_offset=len(head)), head, pad(length)
        if family == "rf64" or size > RIFF_MOST:
            ds64 = _chunk(b"ds64", struct.pack("<QQQI", size + 36, length, s.total, 0))
            head = b"RF64" + struct.pack("<I", RIFF_MOST) + b"WAVE" + ds64 + _chunk(b"fmt ", fmt) + extra + b"data" + struct.pack("<I", RIFF_MOST)
            return replace(s, family="rf64", data_offset=len(head)), head, bytes(length % 2)
        head = b"RIFF" + struct.pack("<I", size) + b"WAVE" + _chunk(b"fmt ", fmt) + extra + b"data" + struct.pack("<I", length)
        return replace(s, family="wave", data_offset=len(head)), head, bytes(length % 2)
    if s.mask != s.usual_mask and family != "caf":
        raise ContainerError(f"{family} can't state mask {s.mask:#x}")
    if family in ("aiff", "aifc"):
        s = replace(s, layout="be")
        comm = struct.pack(">hIh", s.channels, s.total, s.valid_bits) + extended_bytes(s.rate) + (b"NONE\0\0" if family == "aifc" else b"")
        body = b"COMM" + struct.pack(">I", len(comm)) + comm + _aiff_metadata(list(entries), list(cues)) + b"SSND" + struct.pack(">III", length + 8, 0, 0)
        if 4 + len(body) + length >= RIFF_MOST:
            raise ContainerError("too long for AIFF")
        head = b"FORM" + struct.pack(">I", 4 + len(body) + length + length % 2) + family.upper().encode() + body
        return replace(s, family=family, data_offset=len(head)), head, bytes(length % 2)
    if family == "caf":
        s = replace(s, layout="le")
        desc = struct.pack(">d4sIIIII", s.rate, b"lpcm", 2, s.frame_bytes, 1, s.channels, s.valid_bits)
        chan = b"" if s.mask == s.usual_mask else b"chan" + struct.pack(">qIII", 12, 1 << 16, s.mask, 0)
        head = b"caff\0\1\0\0desc" + struct.pack(">q", 32) + desc + chan + _caf_metadata(list(entries), list(cues)) + b"data" + struct.pack(">qI", length + 4, 0)
        return replace(s, family="caf", data_offset=len(head)), head, b""
    raise ContainerError(f"there is no container {family}")
