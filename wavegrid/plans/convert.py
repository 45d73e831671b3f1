"""Encoding, decoding and recompression of streams as DataFrames: frames are analysed and written apart, then put in order by stream."""

from __future__ import annotations

import contextlib
import hashlib
import time
import uuid
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from wavegrid import adapters as A
from wavegrid.functions import frames as fr
from wavegrid.functions.columns import big
from wavegrid.operators.planning import EXTENSIONS
from wavegrid.plans.queries import query
from wavegrid.sources import containers, flac

RAW_SUFFIXES = (".raw", ".pcm")
#: Options of the three modes: whether malformed seek tables, masks and metadata are errors, and whether metadata is read.
MODES = {"loose": {"strict": False, "metadata": False}, "default": {"strict": False, "metadata": True}, "strict": {"strict": True, "metadata": True}}


def encoded_frames(blocks: DataFrame, level: int = 8, by_sample: bool = False) -> DataFrame:
    """blocks (stream, frame, sample_offset, rate, bits, planes: array of arrays) as (stream, frame, samples, kinds, data)."""
    profile = fr.Profile.of(level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            planes = batch.column(5)
            outer, inner, flat = planes.offsets.to_numpy(), planes.values.offsets.to_numpy(), planes.values.values.to_numpy(zero_copy_only=False).astype(np.int64)
            frame, offset, rate, bits = (batch.column(i).to_pylist() for i in range(1, 5))
            rows = []
            for k in range(batch.num_rows):
                at = inner[outer[k] : outer[k + 1] + 1]
                if len({*np.diff(at).tolist()}) != 1:
                    raise containers.ContainerError("planes of a frame have different lengths")
                x = flat[at[0] : at[-1]].reshape(len(at) - 1, -1)
                data, forms = fr.encode(x, bits[k], rate[k], profile, offset[k] if by_sample else frame[k], by_sample)
                rows.append((x.shape[1], ",".join(f"{f.kind}{f.order}" for f in forms), data))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.string(), pa.binary())))], ["stream", "frame", "samples", "kinds", "data"])

    rows = blocks.select("stream", big("frame").alias("frame"), "sample_offset", "rate", "bits", "planes")
    return rows.mapInArrow(run, "stream string, frame long, samples long, kinds string, data binary")


def decoded_frames(frames: DataFrame, rate: int, bits: int) -> DataFrame:
    """(stream, frame, data) as (stream, frame, channel, values). A damaged frame raises. The frames of a batch are decoded side by side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data = batch.column(2)
            ends = np.cumsum([len(d.as_buffer()) for d in data]).tolist()
            found = [planes for _, planes in fr.decode_many(b"".join(data.to_pylist()), list(zip([0, *ends[:-1]], ends, strict=True)), rate, bits)]
            counts = [len(p) for p in found]
            which = pa.array(np.repeat(np.arange(batch.num_rows), counts))
            lengths = np.repeat([p.shape[1] for p in found], counts)
            values = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), pa.array(np.concatenate([p.reshape(-1) for p in found])))
            channel = pa.array(np.concatenate([np.arange(c) for c in counts]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(which), batch.column(1).take(which), channel, values], ["stream", "frame", "channel", "values"])

    return frames.select("stream", "frame", "data").mapInArrow(run, "stream string, frame long, channel long, values array<long>")


def metadata_blocks(spec: containers.Spec) -> list[tuple[int, bytes]]:
    """A container's INFO entries as comments, sorted by key, and an unusual mask; its cues within the stream as a cue sheet.

    A private bundle that can be read stands for all of them.
    """
    from wavegrid.operators.metadata import INFO_KEYS, MOST_CUES

    entries: dict[str, list[str]] = {}
    cues: list[int] = []
    for name, body in spec.chunks:
        if name == b"fxmd":
            try:
                return flac.parse_bundle(body)
            except containers.ContainerError:
                continue
        if name == b"LIST" and body[:4] == b"INFO":
            at = 4
            while at + 8 <= len(body):
                key, size = body[at : at + 4].decode("latin-1"), int.from_bytes(body[at + 4 : at + 8], "little")
                text = body[at + 8 : at + 8 + size].split(b"\0")[0]
                at += 8 + size + size % 2
                try:
                    if key in INFO_KEYS and text:
                        entries.setdefault(INFO_KEYS[key], []).append(text.decode())
                except UnicodeDecodeError:
                    continue
        elif name == b"cue ":
            count = int.from_bytes(body[:4], "little")
            points = [body[4 + 24 * k : 28 + 24 * k] for k in range(count)]
            cues += [int.from_bytes(p[20:24], "little") for p in points if len(p) == 24 and p[8:12] == b"data"]
    out = []
    comments = [f"{k}={v}" for k in sorted(entries) for v in entries[k]]
    if spec.mask != spec.usual_mask:
        comments += [f"{flac.MASK_KEY}=0x{spec.mask:08x}", f"{flac.PROVENANCE_KEY}=1"]
    if comments:
        out.append((4, flac.comments_bytes("wavegrid", comments)))
    kept = sorted({c for c in cues if c < spec.total})
    if kept and len(kept) <= MOST_CUES:
        out.append((5, flac.cuesheet_bytes(kept, spec.total)))
    return out


def texts_of(stream: flac.Stream) -> list[tuple[str, str]]:
    """(INFO id, text) of a stream's comments."""
    from wavegrid.operators.metadata import INFO_KEYS

    back = {v: k for k, v in INFO_KEYS.items()}
    split = [e.partition("=") for e in stream.entries()]
    return [(back[key.upper()], value) for key, _, value in split if key.upper() in back]


def cues_of(stream: flac.Stream) -> list[int]:
    sheets = [flac.cue_offsets(flac.parse_cuesheet(body)) for kind, body in stream.blocks if kind == 5]
    return [o for o in sheets[0] if o < stream.info.total] if sheets else []


def chunks_of(stream: flac.Stream, bundle: bool = True) -> list[tuple[bytes, bytes]]:
    """The private bundle of all header blocks but seek tables, and LIST and cue chunks from comments and the cue sheet."""
    info, out = b"", []
    kept = [b for b in stream.blocks if b[0] not in (1, 3)]
    if bundle and kept:
        out.append((b"fxmd", flac.bundle_bytes(kept)))
    for key, value in texts_of(stream):
        body = value.encode() + b"\0"
        info += key.encode() + len(body).to_bytes(4, "little") + body + bytes(len(body) % 2)
    if info:
        out.append((b"LIST", b"INFO" + info))
    if offsets := cues_of(stream):
        points = b"".join(n.to_bytes(4, "little") + o.to_bytes(4, "little") + b"data" + bytes(8) + o.to_bytes(4, "little") for n, o in enumerate(offsets, 1))
        out.append((b"cue ", len(offsets).to_bytes(4, "little") + points))
    return out


def encode_bytes(data: bytes, level: int = 8, mode: str = "default", raw: dict | None = None, family: str | None = None, **options) -> bytes:
    """A container's bytes as FLAC. raw: what describes samples without a header, as containers.raw() takes it. family: as containers.parse() takes it."""
    read = lambda at, n: data[at : at + n]
    spec = containers.raw(len(data), **raw) if raw else containers.parse(read, len(data), MODES[mode]["metadata"], family)
    x = containers.unpack(data[spec.data_offset : spec.data_offset + spec.total * spec.frame_bytes], spec)
    return flac.encode(x, spec, level, blocks=metadata_blocks(spec) if MODES[mode]["metadata"] else [], **options)


def decode_bytes(data: bytes, container: str = "auto", mode: str = "default") -> bytes:
    """FLAC as a container's bytes."""
    stream, x = flac.decode(data, strict=MODES[mode]["strict"])
    chunks, entries, cues = (chunks_of(stream), texts_of(stream), cues_of(stream)) if MODES[mode]["metadata"] else ([], [], [])
    spec, head, tail = containers.written(stream.spec(MODES[mode]["strict"]), container, chunks, entries, cues)
    return head + containers.pack(x, spec) + tail


def recompress_bytes(data: bytes, level: int = 8, mode: str = "default") -> bytes:
    """FLAC as FLAC: decoded, verified and encoded again with its metadata; an unknown digest is computed."""
    stream, x = flac.decode(data, strict=MODES[mode]["strict"])
    return flac.encode(x, stream.spec(), level, blocks=list(stream.blocks) if MODES[mode]["metadata"] else [])


def put(where, path: str, data: bytes) -> None:
    """Writes a file whole or not at all: under a name of its own first, which goes if anything fails."""
    folder, _, name = path.rpartition("/")
    where.create_dir(folder, recursive=True)
    hidden = f"{folder}/.{name}.{uuid.uuid4().hex}.tmp"
    try:
        with where.open_output_stream(hidden, compression=None) as f:
            f.write(data)
        where.move(hidden, path)
    except BaseException:
        with contextlib.suppress(OSError):
            where.delete_file(hidden)
        raise


def reader_of(path: str, raw: dict | None) -> dict:
    """What encode_bytes() takes for a file, by its extension; a file with another extension is told by its first bytes."""
    container = EXTENSIONS.get(path.rpartition("/")[2].rpartition(".")[2].lower())
    if path.lower().endswith(RAW_SUFFIXES):
        if not raw:
            raise containers.ContainerError("samples without a header need a rate, channels and bits")
        return {"raw": raw}
    return {"family": {"rf64": "wave", "wave64": "wave", "aifc": "aiff"}.get(container, container)} if container else {}


#: What the commands do with a file's bytes.
COMMANDS = {"encode": encode_bytes, "decode": decode_bytes, "recompress": recompress_bytes}


def convert(work: DataFrame, command: str, raw: dict | None = None, **options) -> DataFrame:
    """work (input, output) as (input, output, input_bytes, output_bytes, samples, error, started_ms, ended_ms): each file by a task of its own, written
    whole and then moved into place. A file that can't be converted has an error; the others go on. raw: of files without a header, see containers.raw()."""
    from wavegrid.sources.datasource import located

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for source, target in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                where, path = located(source)
                to, out = located(target)
                began = int(time.time() * 1000)
                now = lambda: int(time.time() * 1000)
                try:
                    if (where, path) == (to, out):
                        raise containers.ContainerError("input and output are the same file")
                    with where.open_input_stream(path, compression=None) as f:
                        data = f.read()
                    done = COMMANDS[command](data, **options, **(reader_of(path, raw) if command == "encode" else {}))
                    samples = flac.parse(lambda at, n, d=(data if command == "decode" else done): d[at : at + n]).info.total
                    put(to, out, done)
                    rows.append((source, target, len(data), len(done), samples, None, began, now()))
                except (ValueError, OSError) as e:
                    rows.append((source, target, None, None, None, str(e), began, now()))
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            names = ["input", "output", "input_bytes", "output_bytes", "samples", "error", "started_ms", "ended_ms"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return work.select("input", "output").mapInArrow(run, "input string, output string, input_bytes long, output_bytes long, samples long, error string, started_ms long, ended_ms long")


def framed_planes(spark: SparkSession, path: str, block_size: int, **options) -> DataFrame:
    """(stream, frame, sample_offset, rate, bits, mask, total, planes) of PCM files, by tasks of ranges of frames. options: of the data source."""
    from wavegrid.sources import datasource

    datasource.register(spark)
    rows = spark.read.format("pcm").options(path=path, blockSize=block_size, **options).load()
    planes = F.transform(F.sort_array(F.collect_list(F.struct("channel", F.col("values").cast("array<bigint>").alias("values")))), lambda s: s["values"]).alias("planes")
    return rows.groupBy(F.col("path").alias("stream"), "frame", "sample_offset", "rate", "bits", "mask", "total").agg(planes)


def encode_streams(blocks: DataFrame, level: int = 8) -> tuple[DataFrame, DataFrame]:
    """blocks of framed_planes(), persisted, as frames (stream, frame, samples, kinds, data), persisted, and a row a stream: stream and head, the bytes before its frames.

    Frames of one stream are encoded by many tasks. Only its digest and its seek points are taken in order.
    """
    from wavegrid.operators import digest

    frames = encoded_frames(blocks, level).persist()
    interleaved = F.flatten(F.transform(F.sequence(F.lit(1), F.size(F.element_at("planes", 1))), lambda j: F.transform("planes", lambda p: F.element_at(p, j))))
    one = F.when(F.size("planes") == 1, F.element_at("planes", 1)).otherwise(interleaved)
    widths = [r.bits for r in blocks.select("bits").distinct().collect()]  # of 4 to 32
    sums = None
    for bits in widths:
        part = digest.stream_md5(blocks.where(F.col("bits") == bits).select("stream", "frame", one.alias("xs")), ["stream"], bits).select("stream", "md5")
        sums = part if sums is None else sums.unionByName(part)
    specs = blocks.groupBy("stream").agg(F.first("rate").alias("rate"), F.first("bits").alias("bits"), F.first("mask").alias("mask"), F.first("total").alias("total"), F.first(F.size("planes")).alias("channels"))
    listed = frames.groupBy("stream").agg(F.transform(F.sort_array(F.collect_list(F.struct("frame", "samples", F.octet_length("data").alias("size")))), lambda s: F.struct(s["samples"].alias("samples"), s["size"].alias("size"))).alias("frames"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = []
            for r in batch.to_pylist():
                sizes, lengths = [f["samples"] for f in r["frames"]], [f["size"] for f in r["frames"]]
                spec = containers.checked(containers.Spec(r["rate"], r["channels"], r["bits"], mask=r["mask"], total=r["total"]))
                if sum(sizes) != r["total"]:
                    raise containers.ContainerError(f"{r['stream']} has {sum(sizes)} samples where {r['total']} are stated")
                chosen, points, at, done = set(flac.selected(len(sizes))), [], 0, 0
                for k, (n, size) in enumerate(zip(sizes, lengths, strict=True)):
                    if k in chosen:
                        points.append((done, at, n))
                    at, done = at + size, done + n
                table = [(3, flac.seektable_bytes(points))] if points else []
                heads.append(flac.header(flac.stream_info(spec, sizes, lengths, bytes.fromhex(r["md5"]), True), [*table, *metadata_blocks(spec)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(heads, pa.binary())], ["stream", "head"])

    rows = specs.join(sums, "stream").join(listed, "stream").select("stream", "rate", "bits", "mask", "total", "channels", "md5", "frames")
    return frames, rows.mapInArrow(run, "stream string, head binary")


def write_streams(frames: DataFrame, heads: DataFrame, folder: str) -> DataFrame:
    """Files of encode_streams(): (stream, output, bytes). A task writes a file's bytes as they come, in order, under a name of its own that is then changed."""
    from wavegrid.sources.datasource import located

    rows = frames.select("stream", "frame", "data").unionByName(heads.select("stream", F.lit(-1).cast("bigint").alias("frame"), F.col("head").alias("data")))
    rows = rows.repartition("stream").sortWithinPartitions("stream", "frame")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = located(folder)
        where.create_dir(root, recursive=True)
        now, out, hidden, size = None, None, "", 0

        def done() -> pa.RecordBatch:
            out.close()
            name = now.rpartition("/")[2]
            target = f"{root}/{name.rpartition('.')[0] or name}.flac"
            where.move(hidden, target)
            return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([target]), pa.array([size], pa.int64())], ["stream", "output", "bytes"])

        try:
            for batch in batches:
                for stream, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    if stream != now:
                        if now is not None:
                            yield done()
                        now, size, hidden = stream, 0, f"{root}/.{uuid.uuid4().hex}.tmp"
                        out = where.open_output_stream(hidden, compression=None)
                    out.write(data)
                    size += len(data)
            if now is not None:
                yield done()
        except BaseException:
            if out is not None and not out.closed:
                out.close()
                where.delete_file(hidden)
            raise

    return rows.mapInArrow(run, "stream string, output string, bytes long")


# ---- queries


def _blocks(spark: SparkSession, sf_dir: str, size: int = 16) -> DataFrame:
    """Event streams of 17 bits as blocks of one plane."""
    b = A.blocks(A.sig_events(spark, sf_dir), "user_id", size)
    return b.select(F.col("user_id").cast("string").alias("stream"), "frame", (F.col("frame") * size).alias("sample_offset"), F.lit(44100).alias("rate"), F.lit(17).alias("bits"), F.array("xs").alias("planes"))


@query
def q_frame_roundtrip(spark, sf_dir):
    """Samples of frames that were written and read again: equal to q_frame_fixed's."""
    d = decoded_frames(encoded_frames(_blocks(spark, sf_dir)), 44100, 17)
    return d.select(F.col("stream").cast("bigint").alias("user_id"), "frame", F.posexplode("values").alias("j", "x")).select("user_id", "frame", F.col("j").cast("bigint").alias("j"), "x")


@query
def q_frame_index(spark, sf_dir):
    """Frames with their bytes and offsets."""
    from wavegrid.operators import metadata

    f = encoded_frames(_blocks(spark, sf_dir)).select(F.col("stream").cast("bigint").alias("user_id"), "frame", "samples", "kinds", F.octet_length("data").cast("bigint").alias("frame_size"))
    return metadata.offsets(f, ["user_id"])


@query
def q_file_roundtrip(spark, sf_dir):
    """Whole files of each stream, written and read again: samples, and whether all came back."""

    def run(batches):
        for batch in batches:
            rows = []
            for stream, xs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.array(xs, np.int64)[:, None]
                spec = containers.checked(containers.Spec(44100, 1, 17, total=len(x)))
                data = flac.encode(x, spec, block_size=64)
                _, y = flac.decode(data)
                spec, head, tail = containers.written(replace(spec, family="wave"), "wave64")
                wave = head + containers.pack(y, spec) + tail
                again = containers.parse(lambda at, n, w=wave: w[at : at + n], len(wave))
                z = containers.unpack(wave[again.data_offset : again.data_offset + again.total * again.frame_bytes], again)
                rows.append((stream, len(z), bool(np.array_equal(x, z)), hashlib.md5(flac.digest_bytes(z, 17)).hexdigest(), len(data)))
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["user_id", "samples", "identical", "md5", "bytes"])

    e = A.sig_events(spark, sf_dir).groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("xs"))
    return e.mapInArrow(run, "user_id long, samples long, identical boolean, md5 string, bytes long")


@query
def q_crc(spark, sf_dir):
    """Checksums of page bodies; a body is one row."""

    def run(batches):
        from wavegrid.functions import bits

        for batch in batches:
            data = [(h or "").encode() for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bits.crc8(d) for d in data], pa.int64()), pa.array([bits.crc16(d) for d in data], pa.int64())], ["page_id", "crc8", "crc16"])

    return A.table(spark, sf_dir, "pages").select("page_id", "html").mapInArrow(run, "page_id long, crc8 long, crc16 long")
