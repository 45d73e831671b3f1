"""Frames, files and containers: exact round trips, known checksums and damage."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wavegrid.functions import bits as B
from wavegrid.functions import frames as fr
from wavegrid.plans import convert
from wavegrid.sources import containers, flac
from wavegrid.sources.containers import ContainerError, Spec


def ramp(frames: int, channels: int = 1) -> np.ndarray:
    return np.array([[(f * 97 + c * 1013) % 30000 - 15000 for c in range(channels)] for f in range(frames)])


def reading(data: bytes):
    return lambda at, n: data[at : at + n]


def test_checksums():
    assert B.crc8(b"123456789") == 0xF4 and B.crc16(b"123456789") == 0xFEE8


@given(st.integers(0, (1 << 36) - 1))
def test_coded_numbers(n):
    data = B.coded(n)
    assert B.uncoded(data + b"x", 0) == (n, len(data))
    if n < 0xD800:
        assert data == chr(n).encode()


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 3), st.sampled_from([1, 5, 16, 17, 192, 576, 1000]), st.sampled_from([4, 8, 12, 16, 20, 24, 32]), st.integers(0, 8), st.integers(0, 4), st.integers(0, 10**6))
def test_frames_come_back(channels, n, depth, level, kind, seed):
    r, top = np.random.default_rng(seed), 1 << (depth - 1)
    x = {
        0: lambda: r.integers(-top, top, (channels, n)),
        1: lambda: np.full((channels, n), int(r.integers(-top, top))),
        2: lambda: np.clip(np.cumsum(r.integers(-3, 4, (channels, n)), 1), -top, top - 1),
        3: lambda: np.clip((np.sin(np.arange(n) / 9) * top * 0.7 + r.normal(0, top / 200 + 1, (channels, n))).astype(np.int64), -top, top - 1),
        4: lambda: np.where(r.random((channels, n)) < 0.02, top - 1, r.integers(-1, 2, (channels, n))),
    }[kind]()
    data, forms = fr.encode(x, depth, 44100, fr.Profile.of(level), 7)
    h, y = fr.decode(data, 0, len(data), 44100, depth)
    assert np.array_equal(x, y) and h.number == 7
    assert len(data) <= sum(-(-f.bits // 8) for f in forms) + 20


def test_choice_is_the_cheapest():
    x = ramp(64)[:, 0]
    best = fr.analyse(x, 16, 44100, fr.Profile.of(8))
    assert best.kind == "fixed" and best.bits < 8 + 64 * 16
    assert fr.analyse(np.full(50, 7), 16, 44100, fr.Profile.of(8)).kind == "constant"
    noise = np.random.default_rng(0).integers(-(1 << 15), 1 << 15, 4096)
    assert fr.analyse(noise, 16, 44100, fr.Profile.of(8)).bits <= 8 + 4096 * 16


def test_wasted_bits_and_other_assignments_are_read():
    x = np.array([[4, 8, -12, 16] * 8, [0, 4, 8, -4] * 8])
    for assignment, planes in ((8, [x[0], x[0] - x[1]]), (9, [x[0] - x[1], x[1]])):
        depths = (16, 17) if assignment == 8 else (17, 16)
        body = np.concatenate([b for p, d in zip(planes, depths, strict=True) for b in [B.field([3], 8), B.field([0, 1], 1), B.field(p >> 2, d - 2)]])
        data = fr.header(32, 44100, assignment, 16, 0, False) + np.packbits(body).tobytes()
        data += B.crc16(data).to_bytes(2, "big")
        assert np.array_equal(fr.decode(data, 0, len(data), 44100, 16)[1], x)


@pytest.mark.parametrize("family", ["auto", "wave", "rf64", "wave64", "aiff", "aifc", "caf"])
@pytest.mark.parametrize("channels,valid", [(1, 4), (1, 8), (2, 12), (3, 16), (5, 20), (8, 24), (2, 32)])
def test_containers(family, channels, valid):
    r = np.random.default_rng(channels)
    for n in (0, 1, 33):
        x = r.integers(-(1 << valid - 1), 1 << valid - 1, (n, channels))
        s, head, tail = containers.written(Spec(48000, channels, valid, total=n), family)
        data = head + containers.pack(x, s) + tail
        p = containers.parse(reading(data), len(data))
        assert np.array_equal(containers.unpack(data[p.data_offset : p.data_offset + n * p.frame_bytes], p), x)
        assert (p.rate, p.channels, p.valid_bits, p.total, p.mask) == (48000, channels, valid, n, s.mask)
        with pytest.raises(ContainerError):
            containers.parse(reading(data[: len(head) - 10]), len(head) - 10)


def test_raw_layouts():
    x = np.array([[-8, 7], [3, -1]])
    for layout in ("le", "be"):
        s = containers.checked(Spec(8000, 2, 12, 16, layout=layout, total=2))
        data = containers.pack(x, s)
        p = containers.raw(len(data), 8000, 2, 12, 16, layout)
        assert np.array_equal(containers.unpack(data, p), x)
    with pytest.raises(ContainerError):
        containers.raw(12, 8000, 3, 16)
    with pytest.raises(ContainerError):
        containers.raw(3, 8000, 1, 16)
    with pytest.raises(ContainerError):
        containers.pack(np.array([[1 << 11]]), s)


@pytest.mark.parametrize("sizes", [None, [576, 1152, 576, 2048]])
def test_files(sizes):
    x = ramp(4352, 2)
    s = containers.checked(Spec(44100, 2, 16, total=len(x)))
    data = flac.encode(x, s, 5, sizes)
    stream, y = flac.decode(data)
    assert np.array_equal(x, y) and stream.info.total == len(x) and stream.blocks[0][0] == 3
    points = flac.parse_seektable(stream.blocks[0][1], strict=True)
    assert [p[2] for p in points] == (sizes or [2304, 2048]) and points[0][:2] == (0, 0)
    for bad in (b"fLaX" + data[4:], data[:-1], data[:-3] + bytes((data[-3] ^ 1,)) + data[-2:], data[:300]):
        with pytest.raises(ValueError):
            flac.decode(bad)
    wrong = data[:26] + bytes(16 * [1]) + data[42:]
    with pytest.raises(ContainerError):
        flac.decode(wrong)
    assert np.array_equal(flac.decode(data[:26] + bytes(16) + data[42:])[1], x)
    with pytest.raises(ContainerError):
        flac.schedule(100, 16, [50, 49])


def test_metadata_survives():
    info = b"INFO" + b"IART\5\0\0\0name\0\0" + b"INAM\3\0\0\0ab\0\0" + b"XXXX\2\0\0\0a\0"
    cue = (2).to_bytes(4, "little") + b"".join(n.to_bytes(4, "little") + o.to_bytes(4, "little") + b"data" + bytes(8) + o.to_bytes(4, "little") for n, o in ((1, 900), (2, 30)))
    x = ramp(1000, 4)
    s, head, tail = containers.written(Spec(44100, 4, 16, mask=0x12104, total=1000), "wave", [(b"LIST", info), (b"cue ", cue)])
    data = head + containers.pack(x, s) + tail
    coded = convert.encode_bytes(data, 3)
    stream = flac.parse(reading(coded))
    assert stream.entries() == ["ARTIST=name", "TITLE=ab", f"{flac.MASK_KEY}=0x00012104", f"{flac.PROVENANCE_KEY}=1"]
    assert flac.cue_offsets(flac.parse_cuesheet(dict(stream.blocks)[5])) == [30, 900]
    for container in ("wave", "wave64"):
        back = convert.decode_bytes(coded, container)
        p = containers.parse(reading(back), len(back))
        assert p.mask == 0x12104 and [n for n, _ in p.chunks] == [b"fxmd", b"LIST", b"cue "]
        assert flac.parse_bundle(p.chunks[0][1]) == [b for b in stream.blocks if b[0] != 3]
        assert flac.parse(reading(convert.encode_bytes(back, 3))).entries() == stream.entries()
    usual = flac.encode(ramp(1000, 2), containers.checked(Spec(44100, 2, 16, total=1000)), blocks=[(4, flac.comments_bytes("v", ["TITLE=ab", "title=cd", "DATE=1999", "MOOD=x"])), (5, flac.cuesheet_bytes([30], 1000))])
    aiff, caf = convert.decode_bytes(usual, "aiff"), convert.decode_bytes(usual, "caf")
    assert b"NAME\0\0\0\2abSSND" not in aiff and b"NAME\0\0\0\2abMARK" in aiff and b"title\0ab,cd\0year\x001999\0" in caf and b"mark" in caf
    for data in (aiff, caf):
        p = containers.parse(reading(data), len(data))
        assert np.array_equal(containers.unpack(data[p.data_offset : p.data_offset + 4000], p), ramp(1000, 2))
    assert flac.decode(convert.recompress_bytes(coded, 0))[0].entries() == stream.entries()
    assert not flac.parse(reading(convert.encode_bytes(data, mode="loose"))).entries()


def test_malformed_metadata():
    good = flac.comments_bytes("v", ["A=b", "C=d"])
    assert flac.parse_comments(good) == ("v", ["A=b", "C=d"])
    for bad in (good[:-1], good + b"x", b"\xff\xff"):
        with pytest.raises(ContainerError):
            flac.parse_comments(bad)
    bundle = flac.bundle_bytes([(2, b"x"), (4, good), (2, b"x")])
    assert flac.parse_bundle(bundle) == [(2, b"x"), (4, good), (2, b"x")] and flac.bundle_bytes([]) == b""
    for bad in (bundle[:-1], bundle + b"x", b"fxmx" + bundle[4:], bundle[:10]):
        with pytest.raises(ContainerError):
            flac.parse_bundle(bad)
    table = flac.seektable_bytes([(5, 0, 1), (4, 9, 1)])
    assert flac.parse_seektable(table) == [] and flac.selected(10, 4) == [0, 3, 6, 9]
    for b in (table, table + b"x"):
        with pytest.raises(ContainerError):
            flac.parse_seektable(b, strict=True)
    sheet = flac.cuesheet_bytes([0, 588], 1000)
    assert [t[0] for t in flac.parse_cuesheet(sheet)] == [1, 2, 255]
    with pytest.raises(ContainerError):
        flac.parse_cuesheet(sheet[:-1])


def test_bytes_in_pieces():
    """What the scanner gives is the file's frames, whatever the pieces; a stream that ends early or goes on is found."""
    from wavegrid.sources import flac

    r = np.random.default_rng(6)
    x = np.cumsum(r.integers(-50, 51, (9000, 2)), axis=0)
    for sizes in (None, [500, 700] * 7 + [600]):
        data = flac.encode(x, containers.checked(Spec(44100, 2, 16, total=9000)), 3, sizes=sizes, block_size=None if sizes else 1000)
        s = flac.parse(lambda at, n: data[at : at + n])
        index = [a for a, _, _ in fr.boundaries(data, s.start, 44100, 16, 9000)]
        want = [data[a:b] for a, b in zip(index, [*index[1:], len(data)], strict=True)]
        for piece in (7, 100, 4096, len(data)):
            scanner = fr.Scanner(44100, 16, 9000)
            found = [f for at in range(s.start, len(data), piece) for f in scanner.push(data[at : at + piece])] + scanner.finish()
            assert [b for _, b in found] == want and sum(h.size for h, _ in found) == 9000 and scanner.finish() == []
            with pytest.raises(ValueError):
                scanner.push(b"x")
        early = fr.Scanner(44100, 16, 9000)
        early.push(data[s.start : -40])
        with pytest.raises(ValueError):
            early.finish()


def test_known_headers():
    x = ramp(50, 2)
    s, head, tail = containers.written(Spec(44100, 2, 16, total=50), "wave")
    data = head + containers.pack(x, s) + tail
    d = containers.described(len(data), "wave", 44100, 2, 16, len(head), 50)
    assert (containers.unpack(data[d.data_offset : d.data_offset + d.total * d.frame_bytes], d) == x).all()
    for bad in (("aiff", 44100, 2, 16, len(head), 50), ("wave", 44100, 2, 8, len(head), 50), ("wave", 44100, 2, 16, len(head), 51 + len(tail)), ("mp3", 44100, 2, 16, 0, 1), ("wave", 0, 2, 16, 0, 1)):
        with pytest.raises(containers.ContainerError):
            containers.described(len(data), *bad)


def test_options_in_order():
    from wavegrid.operators.framing import Options

    o = Options().with_schedule([16, 32])
    assert o.with_level(0) == Options(0, 576, (16, 32)) and o.with_block_size(100) == Options(8, 100, None)
    assert Options().with_block_size(100).with_level(2).block_size == 1152 and o.block_size == 4096
    with pytest.raises(ValueError):
        o.with_level(9)


def test_display_width():
    from wavegrid.functions.text import cut_to, width_of

    assert width_of("a漢é\u0301") == 4 and cut_to("abcdef", 4) == "abc…" and cut_to("漢字漢字", 4) == "漢…" and cut_to("漢字", 4) == "漢字"
    assert cut_to("abc", 1) == "…" and cut_to("abc", 0) == "" and cut_to("", 0) == ""


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(-(1 << 20), 1 << 20) | st.integers(-4, 4), min_size=1, max_size=130), st.integers(0, 4), st.integers(0, 6))
def test_bounds_hold(values, order, most):
    """No residual takes fewer bits than its bound."""
    found = fr._Candidate.of(np.array(values, np.int64), order, most)
    if found:
        assert found.least() <= found.best().bits
