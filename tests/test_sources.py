"""Data sources, the command line and streaming, on files in a temporary folder."""

import os
import time


import numpy as np
import pytest
from pyspark.sql import functions as F


from wavegrid import cli
from wavegrid.sources import containers, datasource, flac
from wavegrid.sources.containers import Spec
from wavegrid.streaming import progress

from .test_codec import ramp


@pytest.fixture
def folder(tmp_path):
    for name, channels, n, family in (("a.wav", 1, 2048, "wave"), ("sub/b.w64", 2, 4096, "wave64"), ("sub/c.aiff", 2, 100, "aiff"), ("sub/deep/d.caf", 6, 700, "caf")):
        x = ramp(n, channels)
        s, head, tail = containers.written(Spec(44100, channels, 16, total=n), family)
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(head + containers.pack(x, s) + tail)
    (tmp_path / "in/note.txt").write_text("no")
    return tmp_path


def samples(df):
    out = {}
    for r in df.collect():
        out.setdefault((os.path.splitext(os.path.basename(r.path))[0], r.channel), []).append((r.frame, r["values"]))
    return {k: [x for _, v in sorted(parts) for x in v] for k, parts in out.items()}


def test_read_write_read(spark, folder):
    datasource.register(spark)
    df = spark.read.format("pcm").option("path", f"{folder}/in").option("blockSize", 500).option("framesPerTask", 2).load()
    want = samples(df)
    assert want["a", 0] == ramp(2048)[:, 0].tolist() and want["d", 5] == ramp(700, 6)[:, 5].tolist() and len(want) == 11
    assert spark.read.format("pcm").option("path", f"{folder}/in").option("depth", 1).load().select("path").distinct().count() == 1
    by = df.repartition(3, "path").sortWithinPartitions("path", "frame")
    by.write.format("flac").option("path", f"{folder}/flac").option("level", 2).mode("append").save()
    assert sorted(os.listdir(folder / "flac")) == ["a.flac", "b.flac", "c.flac", "d.flac"]
    again = spark.read.format("flac").option("path", f"{folder}/flac").load()
    assert samples(again) == want
    again.repartition(2, "path").write.format("pcm").option("path", f"{folder}/back").option("container", "caf").mode("append").save()
    assert samples(spark.read.format("pcm").option("path", f"{folder}/back").load()) == want


def test_a_long_file_is_read_by_many_tasks(spark, tmp_path):
    """Ranges of bytes, whatever the largest frame is said to be; a damaged frame is found wherever ranges begin."""
    datasource.register(spark)
    r = np.random.default_rng(2)
    x = np.cumsum(r.integers(-90, 91, (90_000, 2)), axis=0).clip(-32768, 32767)
    spec = containers.checked(Spec(44100, 2, 16, total=len(x)))
    data = bytearray(flac.encode(x, spec, 2, block_size=1000))
    (tmp_path / "a.flac").write_bytes(data)
    data[15:18] = (40).to_bytes(3, "big")  # the stated largest frame
    (tmp_path / "b.flac").write_bytes(data)
    (tmp_path / "c.flac").write_bytes(flac.encode(x, spec, 2, sizes=[500, 700] * 75))
    df = spark.read.format("flac").option("path", str(tmp_path)).option("bytesPerTask", 1 << 16).load()
    assert df.rdd.getNumPartitions() > 6
    found = samples(df)
    assert set(found) == {(name, c) for name in "abc" for c in (0, 1)}
    assert all(v == x[:, c].tolist() for (_, c), v in found.items())
    assert df.where("path like '%a.flac' and channel = 0 and sample_offset <> frame * 1000").count() == 0
    for at in (len(data) // 2, len(data) - 40, 70_000):
        broken = bytearray(data)
        broken[at] ^= 0xFF
        (tmp_path / "broken").mkdir(exist_ok=True)
        (tmp_path / "broken/d.flac").write_bytes(broken)
        with pytest.raises(Exception, match="damaged|checksum|early"):
            spark.read.format("flac").option("path", f"{tmp_path}/broken").option("bytesPerTask", 1 << 16).load().count()
    (tmp_path / "broken/d.flac").write_bytes(data[:-3000])
    with pytest.raises(Exception, match="early"):
        spark.read.format("flac").option("path", f"{tmp_path}/broken").option("bytesPerTask", 1 << 16).load().count()


def test_streams_of_one_name(spark, tmp_path):
    """Two folders' streams keep their folders, or nothing is written."""
    datasource.register(spark)
    for k, name in enumerate(("a/x.wav", "b/x.wav")):
        s, head, tail = containers.written(Spec(44100, 1, 16, total=100 + k), "wave")
        (tmp_path / "in" / name).parent.mkdir(parents=True)
        (tmp_path / "in" / name).write_bytes(head + containers.pack(ramp(100 + k), s) + tail)
    df = spark.read.format("pcm").option("path", f"{tmp_path}/in").option("blockSize", 16).load()
    by = df.repartition(1).sortWithinPartitions("path", "frame")
    write = lambda rows, **options: rows.write.format("flac").options(path=f"{tmp_path}/out", **options).mode("append").save()
    with pytest.raises(Exception, match="same name"):
        write(by)
    with pytest.raises(Exception, match="apart"):
        write(df.where("path like '%a/x.wav'").repartitionByRange(2, "frame"))
    with pytest.raises(Exception, match="isn't below"):
        write(by, base=f"{tmp_path}/elsewhere")
    assert [f for _, _, fs in os.walk(tmp_path / "out") for f in fs] == []
    write(by, base=f"{tmp_path}/in")
    again = spark.read.format("flac").option("path", f"{tmp_path}/out").load()
    assert {r.path[-8:]: r.total for r in again.select("path", "total").distinct().collect()} == {"a/x.flac": 100, "b/x.flac": 101}
    assert not [f for _, _, fs in os.walk(tmp_path / "out") for f in fs if f.endswith(".tmp")]


def test_a_failing_write_leaves_nothing(tmp_path, monkeypatch):
    from wavegrid.plans import convert

    where, path = datasource.located(f"{tmp_path}/deep/x.flac")
    convert.put(where, path, b"abc")
    assert (tmp_path / "deep/x.flac").read_bytes() == b"abc"
    (tmp_path / "deep/y").mkdir()
    (tmp_path / "deep/y/z").write_text("")
    with pytest.raises(OSError):
        convert.put(where, f"{tmp_path}/deep/y", b"abc")  # a folder with files
    assert sorted(os.listdir(tmp_path / "deep")) == ["x.flac", "y"]


def test_command_line_of_raw_files(spark, tmp_path):
    x = ramp(300, 2)
    (tmp_path / "x.raw").write_bytes(containers.pack(x, containers.checked(Spec(8000, 2, 16, layout="be", total=300))))
    (none,) = cli.run(spark, ["encode", f"{tmp_path}/x.raw"]).collect()
    assert "rate" in none.error
    x = x >> 4
    (tmp_path / "x.raw").write_bytes(containers.pack(x, containers.checked(Spec(8000, 2, 12, 16, layout="be", total=300))))
    (done,) = cli.run(spark, ["encode", f"{tmp_path}/x.raw", "--rate", "8000", "--channels", "2", "--bits", "12", "--container-bits", "16", "--layout", "be", "--mask", "0x3"]).collect()
    assert done.error is None and done.samples == 300
    _, y = flac.decode((tmp_path / "x.flac").read_bytes())
    assert (y == x).all()
    (tmp_path / "wrong.aiff").write_bytes((tmp_path / "x.flac").read_bytes())
    (wrong,) = cli.run(spark, ["encode", f"{tmp_path}/wrong.aiff"]).collect()
    assert "family aiff" in wrong.error


def test_a_known_header_is_not_read(spark, tmp_path):
    datasource.register(spark)
    s, head, tail = containers.written(Spec(44100, 2, 16, total=300), "wave")
    (tmp_path / "x.wav").write_bytes(bytes(len(head)) + containers.pack(ramp(300, 2), s) + tail)  # no header at all
    df = spark.read.format("pcm").options(path=f"{tmp_path}/x.wav", family="wave", dataOffset=len(head), total=300, rate=44100, channels=2, bits=16, blockSize=64).load()
    assert samples(df)["x", 1] == ramp(300, 2)[:, 1].tolist()


def test_trace_and_heartbeat(spark, folder):
    beats = []
    with progress.Heartbeat(spark, lambda *b: beats.append(b), 0.05):
        done = cli.run(spark, ["encode", f"{folder}/in", "-o", f"{folder}/out", "--depth", "0"]).persist()
        assert done.count() == 4
    assert beats and beats[-1][0] >= 4 and beats[-1][2] >= beats[0][2]
    cli.write_trace(done, "encode", f"{folder}/trace")
    lines = [dict(f.split("=", 1) for f in line.split("\t")) for line in (folder / "trace").read_text().splitlines()]
    assert [x["event"] for x in lines].count("file_finish") == 4 and len(lines) == 8 and lines[0]["event"] == "file_begin" and lines[0]["kind"] == "encode" and lines[0]["batch_mode"] == "1"
    assert all(float(x["command_elapsed_seconds"]) >= float(x["elapsed_seconds"]) >= 0 for x in lines)


def test_shown_text(spark):
    from wavegrid.functions.text import display_shortened, display_width

    df = spark.createDataFrame([("漢字漢字",), ("abcdef",), (None,)], "t string")
    assert [tuple(r) for r in df.select(display_shortened(F.col("t"), 4), display_width(F.col("t"))).collect()] == [("漢…", 8), ("abc…", 6), (None, None)]


def test_one_stream_is_encoded_by_many_tasks(spark, folder):
    """The same bytes as when one task encodes the file."""
    from wavegrid.plans import convert

    blocks = convert.framed_planes(spark, f"{folder}/in", 576, framesPerTask=2).persist()
    frames, heads = convert.encode_streams(blocks, 1)
    assert frames.rdd.getNumPartitions() > 1
    done = convert.write_streams(frames, heads, f"{folder}/many").collect()
    assert sorted(os.listdir(folder / "many")) == ["a.flac", "b.flac", "c.flac", "d.flac"] and len(done) == 4
    for r in done:
        with open(r.stream.removeprefix("file:"), "rb") as f:
            assert (folder / "many" / os.path.basename(r.output)).read_bytes() == convert.encode_bytes(f.read(), 1)


def test_damaged_files(spark, folder):
    datasource.register(spark)
    (folder / "in/bad.wav").write_bytes(b"RIFF\0\0\0\0WAVEnothing")
    read = spark.read.format("pcm").option("path", f"{folder}/in")
    with pytest.raises(Exception, match="data chunk"):
        read.load().count()
    assert read.option("mode", "PERMISSIVE").load().select("path").distinct().count() == 4
    with pytest.raises(Exception, match="nowhere"):
        spark.read.format("pcm").option("path", f"{folder}/nowhere").load().count()


def test_raw(spark, folder):
    datasource.register(spark)
    x = ramp(300, 2)
    s = containers.checked(Spec(8000, 2, 16, layout="be", total=300))
    (folder / "x.raw").write_bytes(containers.pack(x, s))
    df = spark.read.format("pcm").options(path=f"{folder}/x.raw", family="raw", rate=8000, channels=2, bits=16, layout="be", blockSize=64).load()
    assert samples(df)["x", 1] == x[:, 1].tolist()


def test_command_line(spark, folder):
    done = cli.run(spark, ["encode", f"{folder}/in", "-o", f"{folder}/out", "--depth", "0", "--level", "4"]).collect()
    assert len(done) == 4 and not any(r.error for r in done) and (folder / "out/sub/deep/d.flac").exists()
    assert not [f for _, _, fs in os.walk(folder / "out") for f in fs if f.endswith(".tmp")]
    again = cli.run(spark, ["recompress", f"{folder}/out/sub/b.flac", "--level", "0"]).collect()
    assert again[0].output.endswith("b.recompressed.flac") and again[0].samples == 4096
    back = cli.run(spark, ["decode", f"{folder}/out", "-o", f"{folder}/wav", "--depth", "0", "--container", "wave"]).collect()
    assert not any(r.error for r in back)
    assert (folder / "wav/a.wav").read_bytes() == (folder / "in/a.wav").read_bytes()
    (folder / "out/broken.flac").write_bytes(b"fLaC")
    errors = [r.error for r in cli.run(spark, ["decode", f"{folder}/out", "-o", f"{folder}/wav2", "--mode", "strict"]).collect()]
    assert len(errors) == 2 and sum(e is not None for e in errors) == 1
    for bad in (["decode", f"{folder}/in", "-o", f"{folder}/wav"], ["encode", f"{folder}/in", "-o", f"{folder}/in/note.txt"]):
        with pytest.raises(ValueError):
            cli.run(spark, bad)
    assert not (folder / "wav2/broken.wav").exists()


def test_ordered_drain_and_progress(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "stream string, frame long, samples long"
    for k, rows in enumerate([[("s", 2, 7), ("s", 0, 5)], [("s", 1, 6), ("t", 1, 1)], [("s", 3, 8)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.02 * k)
    seen = []
    listener = progress.Progress(spark, seen.append)
    spark.streams.addListener(listener)
    try:
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        q = progress.ordered_drain(source).writeStream.format("memory").queryName("drained").option("checkpointLocation", f"{tmp_path}/cp").start()
        q.processAllAvailable()
        q.stop()
        rows = spark.sql("select * from drained").collect()
    except Exception as e:
        if "google" in str(e) or "protobuf" in str(e) or "grpc" in str(e):
            pytest.skip("stateful Python processors need a package that isn't here")
        raise
    finally:
        spark.streams.removeListener(listener)
    assert [(r.frame, r.samples) for r in rows if r.stream == "s"] == [(0, 5), (1, 6), (2, 7), (3, 8)] and not [r for r in rows if r.stream == "t"]


def test_described(spark):
    (r,) = cli.described(spark.sql("select 3725L as s, 2.5e6D as v"), "s", "v").select("elapsed", "speed").collect()
    assert tuple(r) == ("1:02:05", "2.4 MiB/s")
