"""Spark data sources of sample streams.

"pcm" and "flac" read (path, frame, sample_offset, channel, values); long PCM files are cut into ranges of frames and long FLAC files into ranges of
bytes, which tasks read on their own. "pcm" and "flac" also write: a task writes whole streams to temporary files, which the commit moves into place.
Files are reached through pyarrow's file systems.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from wavegrid.functions import frames as fr
from wavegrid.sources import containers, flac

SCHEMA = "path string, frame bigint, sample_offset bigint, channel int, rate int, bits int, mask bigint, total bigint, values array<int>"
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
_KINDS = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
PCM_SUFFIXES, FLAC_SUFFIXES = (".wav", ".rf64", ".w64", ".aif", ".aiff", ".aifc", ".caf", ".raw", ".pcm"), (".flac",)


def located(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def listed(uri: str, suffixes: tuple[str, ...], depth: int = 0) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of a folder's files with these suffixes down to depth (0: any), sorted; links aren't followed."""
    where, path = located(uri)
    info = where.get_file_info(path)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    found = [f for f in where.get_file_info(fs.FileSelector(path, recursive=True)) if f.type == fs.FileType.File and f.path.lower().endswith(suffixes)]
    found = [f for f in found if not depth or f.path[len(path) :].strip("/").count("/") < depth]
    return sorted((f.path, f.size) for f in found if not (isinstance(where, fs.LocalFileSystem) and os.path.islink(f.path)))


def ranged(uri: str):
    """read(at, size) of a file."""
    where, path = located(uri)
    f = where.open_input_file(path)

    def read(at: int, size: int) -> bytes:
        f.seek(at)
        return f.read(size)

    return read


class Range(InputPartition):
    def __init__(self, uri: str, path: str, size: int, first: int, last: int):
        self.uri, self.path, self.size, self.first, self.last = uri, path, size, first, last


class _Reader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.options, self.columns = options, columns
        self.block = int(options.get("blocksize", 4096))
        self.failfast = options.get("mode", "FAILFAST").upper() != "PERMISSIVE"

    def rows(self, spec: containers.Spec, path: str, blocks: Iterator[tuple[int, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for frame, offset, planes in blocks:
            n = len(planes)
            values = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * planes.shape[1], pa.int32()), pa.array(planes.astype(np.int32).reshape(-1)))
            columns = [[path] * n, [frame] * n, [offset] * n, range(n), [spec.rate] * n, [spec.valid_bits] * n, [spec.mask] * n, [spec.total] * n]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, _KINDS, strict=False)), values], _NAMES)


class _PcmReader(_Reader):
    def spec(self, uri: str, size: int) -> containers.Spec:
        o = self.options
        if o.get("family", "auto") == "raw":
            return containers.raw(size, int(o["rate"]), int(o["channels"]), int(o["bits"]), int(o.get("containerbits", 0)), o.get("layout", "le"), int(o.get("mask", "0"), 0))
        if "dataoffset" in o:
            return containers.described(size, o["family"], int(o["rate"]), int(o["channels"]), int(o["bits"]), int(o["dataoffset"]), int(o["total"]), int(o.get("containerbits", 0)), o.get("layout", "le"), int(o.get("mask", "0"), 0))
        return containers.parse(ranged(uri), size)

    def partitions(self):
        per = max(1, int(self.options.get("framespertask", 256)))
        parts = []
        for path, size in listed(self.options["path"], PCM_SUFFIXES, int(self.options.get("depth", 0))):
            try:
                count = -(-self.spec(path, size).total // self.block)
            except containers.ContainerError:
                if self.failfast:
                    raise
                continue
            parts += [Range(path, path, size, a, min(a + per, count)) for a in range(0, count, per)]
        return parts

    def read(self, partition):
        spec = self.spec(partition.uri, partition.size)
        read = ranged(partition.uri)

        def blocks():
            for k in range(partition.first, partition.last):
                n = min(self.block, spec.total - k * self.block)
                data = read(spec.data_offset + k * self.block * spec.frame_bytes, n * spec.frame_bytes)
                yield k, k * self.block, containers.unpack(data, spec).T

        yield from self.rows(spec, partition.path, blocks())


class _FlacReader(_Reader):
    """A file of fixed blocks is cut into ranges of bytes. A range has the frames that begin in it; its task reads from a little before, so that the
    frames of all ranges follow on each other. Frames of varying blocks aren't numbered, so such a file is one range."""

    def partitions(self):
        per = max(1 << 16, int(self.options.get("bytespertask", 8 << 20)))
        parts = []
        for path, size in listed(self.options["path"], FLAC_SUFFIXES, int(self.options.get("depth", 0))):
            try:
                s = flac.parse(ranged(path), self.failfast)
                step = size if s.info.total and self.first(ranged(path), s).variable else per
            except (ValueError, IndexError) as e:
                if self.failfast:
                    raise containers.ContainerError(f"{path}: {e}") from e
                continue
            parts += [Range(path, path, size, a, min(a + step, size)) for a in range(0, size, step)]
        return parts

    @staticmethod
    def first(read, s: flac.Stream) -> fr.Header:
        return fr.parse_header(read(s.start, 16), 0, s.info.rate, s.info.bits)

    def read(self, partition):
        try:
            s = flac.parse(ranged(partition.uri), self.failfast)
            if s.info.total and partition.last > s.start:
                yield from self.rows(s.spec(), partition.path, self.blocks(partition, s))
        except ValueError:
            if self.failfast:
                raise

    def blocks(self, partition, s: flac.Stream) -> Iterator[tuple[int, int, np.ndarray]]:
        i, read = s.info, ranged(partition.uri)
        size = self.first(read, s).size
        before = after = 2 * (i.max_frame or 1 << 16)
        while True:  # until what is read has a whole frame before the range, and the end of the last frame in it
            low, high = max(s.start, partition.first - before), min(partition.size, partition.last + after)
            held = read(low, high - low)
            at = 0 if low == s.start else fr.entered(held, i.rate, i.bits, partition.first - low)
            places = None if at is None else self.places(held, low, at, partition, i, size)
            if places is not None:
                break
            if low == s.start and high == partition.size:
                raise containers.ContainerError(f"{partition.path} ends early, or a frame is damaged")
            before, after = 4 * before, 4 * after
        done = 0
        for k, ((h, planes), (_, end)) in enumerate(zip(fr.decode_many(held, places, i.rate, i.bits), places, strict=True)):
            first = done if h.variable else h.number * size
            done = first + h.size
            if low + end == partition.size and done != i.total:
                raise containers.ContainerError(f"{partition.path} has {done} samples where {i.total} are stated")
            yield k if h.variable else h.number, first, planes

    @staticmethod
    def places(held: bytes, low: int, at: int, partition, i: flac.StreamInfo, size: int) -> list[tuple[int, int]] | None:
        """Of the frames that begin in the range, where in held they begin and end; None if held doesn't tell. A frame begins at a place."""
        found = []
        while low + at < partition.last:
            h = fr.parse_header(held, at, i.rate, i.bits)
            last = (h.number if h.variable else h.number * size) + h.size >= i.total
            whole = low + len(held) == partition.size
            end = (len(held) if whole else None) if last else fr.following(held, at, h, i.rate, i.bits)
            if end is None:
                return None
            if low + at >= partition.first:
                found.append((at, end))
            if last:
                break
            at = end
        return found


class _Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str, str]]):
        self.files = files  # stream, temporary file, its place


class _Writer(DataSourceArrowWriter):
    """Rows must come with all of a stream in one partition, streams one after another; they are put in order here, and one stream is held at a time.

    A stream's file is named after its path below the option base, folders included, or by the path's last part without one. Nothing is
    moved into place if two streams, or two parts of one, would be the same file.
    """

    def __init__(self, options: dict, kind: str):
        self.options, self.kind = options, kind

    def target(self, path: str, family: str) -> str:
        name, base = os.path.basename(path), self.options.get("base")
        if base:
            inside = located(path)[1] if "://" in path or path.startswith("file:") else path
            name = os.path.relpath(inside, located(base)[1])
            if name.startswith(".."):
                raise containers.ContainerError(f"{path} isn't below {base}")
        return f"{os.path.splitext(name)[0]}.{family}"

    def write(self, iterator):
        where, root = located(self.options["path"])
        where.create_dir(root, recursive=True)
        files: list[tuple[str, str, str]] = []

        def save(path: str, rows: list[dict]) -> None:
            rows = sorted(rows, key=lambda r: (r["frame"], r["channel"]))
            channels = max(r["channel"] for r in rows) + 1
            planes = [np.concatenate([np.array(r["values"], np.int64) for r in rows if r["channel"] == c]) for c in range(channels)]
            if len({len(p) for p in planes}) > 1:
                raise containers.ContainerError(f"channels of {path} have different lengths")
            x = np.array(planes).T
            s = containers.checked(containers.Spec(rows[0]["rate"], channels, rows[0]["bits"], mask=rows[0]["mask"] or 0, total=len(x)))
            if self.kind == "flac":
                family, data = "flac", flac.encode(x, s, int(self.options.get("level", 8)))
            else:
                spec, head, tail = containers.written(s, self.options.get("container", "auto"))
                family, data = {"wave": "wav", "wave64": "w64"}.get(spec.family, spec.family), head + containers.pack(x, spec) + tail
            files.append((path, f"{root}/.{uuid.uuid4().hex}.tmp", f"{root}/{self.target(path, family)}"))
            with where.open_output_stream(files[-1][1], compression=None) as f:
                f.write(data)

        try:
            last, held = None, []
            for batch in iterator:
                for row in batch.to_pylist():
                    if held and row["path"] != last:
                        save(last, held)
                        held = []
                    last = row["path"]
                    held.append(row)
            if held:
                save(last, held)
        except BaseException:
            self.remove([_Written(files)])
            raise
        return _Written(files)

    def remove(self, messages) -> None:
        where, _ = located(self.options["path"])
        for m in messages:
            for _, hidden, _ in m.files if m else []:
                if where.get_file_info(hidden).type != fs.FileType.NotFound:
                    where.delete_file(hidden)

    def commit(self, messages):
        where, _ = located(self.options["path"])
        files = [f for m in messages if m for f in m.files]
        taken: dict[str, str] = {}
        for path, _, place in files:
            if place in taken:
                self.remove(messages)
                same = "rows of one stream are apart" if taken[place] == path else f"{taken[place]} and {path} have the same name; state the option base"
                raise containers.ContainerError(f"{place} would be written twice: {same}")
            taken[place] = path
        for _, hidden, place in files:
            where.create_dir(place.rpartition("/")[0], recursive=True)
            where.move(hidden, place)

    def abort(self, messages):
        self.remove(messages)


class PcmSource(DataSource):
    """Options: path, family (auto or raw), blockSize, framesPerTask, depth, mode; rate, channels, bits, containerBits, layout and mask of raw files, and
    with dataOffset, total and another family of files whose header is known and isn't read. Writing: path, container, base."""

    @classmethod
    def name(cls):
        return "pcm"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _PcmReader(self.options, schema.names)

    def writer(self, schema, overwrite):
        return _Writer(self.options, "pcm")


class FlacSource(DataSource):
    """Options: path, bytesPerTask, depth, mode. Writing: path, level, base."""

    @classmethod
    def name(cls):
        return "flac"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _FlacReader(self.options, schema.names)

    def writer(self, schema, overwrite):
        return _Writer(self.options, "flac")


def register(spark) -> None:
    spark.dataSource.register(PcmSource)
    spark.dataSource.register(FlacSource)
