"""Batch conversions: python -m wavegrid.cli encode|decode|recompress INPUT [-o OUTPUT]."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession, functions as F

from wavegrid.functions.columns import byte_speed, clock
from wavegrid.operators import running
from wavegrid.plans.convert import MODES, convert
from wavegrid.sources.datasource import FLAC_SUFFIXES, PCM_SUFFIXES, listed


def mask(text: str) -> int:
    """A channel mask: hexadecimal digits, with or without 0x."""
    return int(text.strip().lower().removeprefix("0x"), 16)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="wavegrid", description="Lossless conversions of sample streams, all files at once.")
    commands = p.add_subparsers(dest="command", required=True)
    for name in ("encode", "decode", "recompress"):
        c = commands.add_parser(name)
        c.add_argument("input", help="a file or a folder")
        c.add_argument("-o", "--output", help="a file, or a folder if the input is one; by default beside the input")
        c.add_argument("--depth", type=int, default=1, help="levels of folders that are searched; 0: all")
        c.add_argument("--mode", choices=[*MODES], default="default")
        c.add_argument("--trace", help="a file for a line of text about each file's beginning and end")
        if name != "decode":
            c.add_argument("--level", type=int, choices=range(9), default=8)
        if name == "encode":
            c.add_argument("--block-size", type=int)
            for name in ("--rate", "--channels", "--bits", "--container-bits"):
                c.add_argument(name, type=int, help="of .raw and .pcm files, which have no header")
            c.add_argument("--layout", choices=["le", "be"], default="le")
            c.add_argument("--mask", type=mask, default=0, help="hexadecimal; over two channels need one")
        if name == "decode":
            c.add_argument("--container", choices=["auto", "wave", "rf64", "wave64", "aiff", "aifc", "caf"], default="auto")
    return p


#: The extension of each container's files.
SUFFIXES = {"auto": "wav", "wave": "wav", "rf64": "rf64", "wave64": "w64", "aiff": "aiff", "aifc": "aifc", "caf": "caf"}


def planned(command: str, source: str, output: str | None, depth: int, suffix: str) -> list[tuple[str, str]]:
    """(input, output) of each file, sorted. Raises ValueError for outputs that don't fit the input."""
    files = [p for p, _ in listed(source, PCM_SUFFIXES if command == "encode" else FLAC_SUFFIXES, depth)]
    folder = os.path.isdir(source)
    if not files:
        raise ValueError(f"{source} has no files to {command}")
    if folder and output and os.path.isfile(output):
        raise ValueError("a folder's output can't be a file")
    work = []
    for path in files:
        name = f"{os.path.splitext(os.path.relpath(path, source) if folder else os.path.basename(path))[0]}.{suffix}"
        if folder or output is None or os.path.isdir(output):
            target = os.path.join(output or (source if folder else os.path.dirname(path)), name)
        else:
            target = output
        if os.path.abspath(target) == os.path.abspath(path):
            raise ValueError(f"{path} would be its own output")
        work.append((os.path.abspath(path), os.path.abspath(target)))
    return work


def run(spark: SparkSession, argv: list[str]) -> DataFrame:
    a = parser().parse_args(argv)
    suffix = SUFFIXES[a.container] if a.command == "decode" else "flac"
    if a.command == "recompress" and a.output is None and os.path.isfile(a.input):
        a.output = os.path.splitext(a.input)[0] + ".recompressed.flac"
    work = planned(a.command, a.input, a.output, a.depth, suffix)
    options = {"mode": a.mode} | ({"level": a.level} if a.command != "decode" else {"container": a.container}) | ({"block_size": a.block_size} if getattr(a, "block_size", None) else {})
    if a.command == "encode" and a.rate:
        options["raw"] = {"rate": a.rate, "channels": a.channels or 1, "valid_bits": a.bits or 16, "container_bits": a.container_bits or 0, "layout": a.layout, "mask": a.mask}
    rows = spark.createDataFrame(work, "input string, output string").repartition(len(work))
    return convert(rows, a.command, **options)


def main(argv: list[str] | None = None) -> int:
    spark = SparkSession.builder.appName("wavegrid").getOrCreate()
    argv = argv if argv is not None else sys.argv[1:]
    try:
        done = run(spark, argv).cache()
    except (ValueError, FileNotFoundError) as e:
        print(e, file=sys.stderr)
        return 2
    for r in done.orderBy("input").toLocalIterator():
        print(f"{r.input}: {r.error}" if r.error else f"{r.input} -> {r.output}: {r.samples} samples, {r.input_bytes} -> {r.output_bytes} bytes")
    a = parser().parse_args(argv)
    if a.trace:
        write_trace(done, a.command, a.trace)
    return int(done.where("error is not null").limit(1).count() > 0)


def write_trace(done: DataFrame, command: str, path: str) -> None:
    """The lines of running.lifecycle() of convert()'s rows, in order."""
    files = done.select(F.col("input").alias("file"), F.coalesce("input_bytes", F.lit(0).cast("bigint")).alias("input_bytes"), "started_ms", "ended_ms", "error")
    with open(path, "w", encoding="utf-8") as out:
        for r in running.lifecycle(files, command).orderBy("seq").toLocalIterator():
            out.write(r.line + "\n")


def described(rows: DataFrame, seconds: str, rate: str) -> DataFrame:
    """rows with elapsed time and speed as text."""
    return rows.withColumn("elapsed", clock(F.col(seconds))).withColumn("speed", byte_speed(F.col(rate)))


if __name__ == "__main__":
    sys.exit(main())
