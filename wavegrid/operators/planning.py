"""Work lists, containers and paths of batch conversions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wavegrid.functions.columns import CHANNEL_MASKS, big, case

#: File extensions and the container each means.
EXTENSIONS = {"wav": "wave", "rf64": "rf64", "w64": "wave64", "aif": "aiff", "aiff": "aiff", "aifc": "aifc", "caf": "caf", "flac": "flac"}
#: Bytes that a RIFF size can state.
RIFF_MOST = (1 << 32) - 1


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def container_of(path: Column) -> Column:
    """From the extension; null if it is unknown."""
    return case(extension(path), {k: F.lit(v) for k, v in EXTENSIONS.items()}, F.lit(None).cast("string"))


def sniffed(head: Column) -> Column:
    """From the first bytes: anything but the two known magics is taken for RIFF."""
    return F.when(F.substring(head, 1, 4) == "FORM", "aiff").when(F.substring(head, 1, 4) == "caff", "caf").otherwise("riff")


def riff_size(fmt: Column, metadata: Column, data: Column) -> Column:
    return fmt + metadata + data + data % 2 + F.lit(4 + 8 + 8)


def container(requested: Column, size: Column) -> Column:
    """Auto becomes RF64 beyond what RIFF can state; an explicit WAVE beyond it is an error (null)."""
    return F.when(requested == "auto", F.when(size > RIFF_MOST, "rf64").otherwise("wave")).when((requested == "wave") & (size > RIFF_MOST), F.lit(None).cast("string")).otherwise(requested)


#: The families that can be switched off, and the containers of each.
FAMILIES = {"wave": ("wave", "rf64", "wave64"), "aiff": ("aiff", "aifc"), "caf": ("caf",)}


def family(container: Column) -> Column:
    """The family of a container; null for others."""
    return case(container, {c: F.lit(f) for f, every in FAMILIES.items() for c in every}, F.lit(None).cast("string"))


def enabled_container(requested: Column, size: Column, enabled: Column) -> Column:
    """container() where only some families (an array) are switched on: auto takes the first of WAVE, AIFF and CAF that is; another container of a family that isn't is an error (null)."""
    auto = F.when(F.array_contains(enabled, "wave"), container(requested, size)).when(F.array_contains(enabled, "aiff"), "aiff").when(F.array_contains(enabled, "caf"), "caf")
    return F.when(requested == "auto", auto).when(F.array_contains(enabled, family(requested)), container(requested, size))


def usual_mask(channels: Column) -> Column:
    return case(channels, {k: F.lit(v).cast("bigint") for k, v in CHANNEL_MASKS.items()}, F.lit(None).cast("bigint"))


def canonical_format(channels: Column, valid: Column, container_bits: Column, mask: Column) -> Column:
    """Whether the plain format tag will do: one or two channels, full width, usual mask."""
    return (channels <= 2) & (valid == container_bits) & (mask == usual_mask(channels))


def worklist(files: DataFrame, command: str, depth: int = 0, extensions: list[str] | None = None, suffix: str = "flac") -> DataFrame:
    """files (root, path, total) with display, output, phase_total and overall_total of those within depth (0: any) and of the extensions.

    A recompression counts samples twice.
    """
    display = F.expr("substring(path, length(root) + 2)")
    rows = files.withColumn("display", display).withColumn("level", big(F.size(F.split("display", "/")))).where(F.col("path").startswith(F.concat("root", F.lit("/"))))
    rows = rows.where(F.col("level") <= depth) if depth else rows
    rows = rows.where(extension(F.col("path")).isin(*extensions)) if extensions else rows
    output = F.concat(F.regexp_replace("path", r"\.[^./]*$", ""), F.lit(f".{suffix}"))
    return rows.select("display", "path", output.alias("output"), F.col("total").alias("phase_total"), (F.col("total") * (2 if command == "recompress" else 1)).alias("overall_total"))
