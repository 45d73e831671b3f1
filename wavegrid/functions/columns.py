"""Column functions on integers and on arrays of them; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Sample rates with a header code of their own, code: Hz.
RATE_CODES = {1: 88200, 2: 176400, 3: 192000, 4: 8000, 5: 16000, 6: 22050, 7: 24000, 8: 32000, 9: 44100, 10: 48000, 11: 96000}
#: Bits per sample with a header code, code: bits.
DEPTH_CODES = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}
#: The usual speaker masks of 1 to 8 channels.
CHANNEL_MASKS = {1: 0x4, 2: 0x3, 3: 0x7, 4: 0x33, 5: 0x37, 6: 0x3F, 7: 0x70F, 8: 0x63F}
#: Speaker positions are the low 18 bits.
MASK_BITS = 0x3FFFF


def big(x) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("bigint")


def case(column: Column, values: dict, otherwise=None) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(column == k, v) if out is None else out.when(column == k, v)
    return out.otherwise(otherwise)


def fold(r: Column) -> Column:
    """Signed to unsigned: 0, -1, 1, -2, ... become 0, 1, 2, 3, ..."""
    return F.when(r >= 0, r * 2).otherwise(-r * 2 - 1)


def unfold(u: Column) -> Column:
    return F.when(u % 2 == 0, F.shiftright(u, 1)).otherwise(-F.shiftright(u, 1) - 1)


def bit_length(v: Column) -> Column:
    """Bits of an integer that isn't negative; 0 has none."""
    return F.when(v == 0, F.lit(0)).otherwise(F.length(F.bin(v))).cast("bigint")


def floor_log2(v: Column) -> Column:
    """0 for 0."""
    return F.greatest(bit_length(v) - 1, F.lit(0).cast("bigint"))


def escape_width(low: Column, high: Column) -> Column:
    """Least signed width that holds both: 0 if both are 0, null above 31."""
    width = F.when((low == 0) & (high == 0), F.lit(0).cast("bigint")).otherwise(bit_length(F.greatest(high, -low - 1)) + 1)
    return F.when(width <= 31, width)


def container_bits(valid: Column) -> Column:
    return F.when(valid.between(1, 8), 8).when(valid.between(9, 16), 16).when(valid.between(17, 24), 24).when(valid.between(25, 32), 32).cast("bigint")


def mask_valid(mask: Column, channels: Column) -> Column:
    return (mask.bitwiseAND(F.lit(~MASK_BITS)) == 0) & (F.bit_count(mask) <= channels)


def block_size_code(n: Column) -> Column:
    """Header code of a block size; 6 and 7 mean that 8 or 16 bits follow."""
    out = F.when(n == 192, 1)
    for k in range(4):
        out = out.when(n == 576 << k, 2 + k)
    for k in range(8):
        out = out.when(n == 256 << k, 8 + k)
    return out.when(n <= 256, 6).otherwise(7).cast("bigint")


def rate_code(rate: Column) -> Column:
    """Header code of a rate: a literal, else kHz in 8 bits (12), Hz in 16 (13), tens of Hz in 16 (14), else 0: see the stream's header."""
    out = None
    for code, hz in RATE_CODES.items():
        out = F.when(rate == hz, code) if out is None else out.when(rate == hz, code)
    return out.when((rate % 1000 == 0) & (rate <= 255_000), 12).when(rate <= 65_535, 13).when((rate % 10 == 0) & (rate <= 655_350), 14).otherwise(0).cast("bigint")


def depth_code(bits: Column) -> Column:
    return case(bits, {v: F.lit(k).cast("bigint") for k, v in DEPTH_CODES.items()}, F.lit(0).cast("bigint"))


def varint_length(v: Column) -> Column:
    """Bytes of a coded number of up to 36 bits."""
    out = F.when(v < 1 << 7, 1)
    for size, bits in ((2, 11), (3, 16), (4, 21), (5, 26), (6, 31), (7, 36)):
        out = out.when(v < 1 << bits, size)
    return out.cast("bigint")


def mask_text(mask: Column) -> Column:
    return F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(mask)), 8, "0"))


def mask_value(text: Column) -> Column:
    """A mask's text as a number: hexadecimal digits of any case, with or without 0x, blanks around them; null for anything else."""
    digits = F.regexp_replace(F.lower(F.trim(text)), "^0x", "")
    return F.when(digits.rlike("^[0-9a-f]{1,8}$"), F.conv(digits, 16, 10).cast("bigint"))


def padded_riff(size: Column) -> Column:
    return size + size % 2


def padded_w64(size: Column) -> Column:
    return size + F.pmod(-size, F.lit(8))


def clock(seconds: Column) -> Column:
    h, m, s = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", big(h), big(m), big(s))).otherwise(F.format_string("%02d:%02d", big(m), big(s)))


def byte_speed(rate: Column) -> Column:
    out = None
    for size, name in ((1 << 30, "GiB/s"), (1 << 20, "MiB/s"), (1 << 10, "KiB/s")):
        text = F.format_string(f"%.1f {name}", rate / size)
        out = F.when(rate >= size, text) if out is None else out.when(rate >= size, text)
    return F.when(rate.isNull(), "warmup").otherwise(out.otherwise(F.format_string("%.0f B/s", rate)))


def shortened(text: Column, width: int) -> Column:
    """Cut to width characters with an ellipsis; of characters one column wide."""
    if width <= 1:
        return F.when(F.length(text) <= width, text).otherwise("…" * width)
    return F.when(F.length(text) <= width, text).otherwise(F.concat(F.substring(text, 1, width - 1), F.lit("…")))


def bar(done: Column, total: Column, width: int) -> Column:
    filled = F.when(total > 0, F.least(F.expr(f"cast({width} as bigint)") * done, total * width) / total).otherwise(0).cast("int")
    return F.concat(F.lit("["), F.repeat(F.lit("="), filled), F.repeat(F.lit(" "), width - filled), F.lit("]"))

