"""The library's queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from wavegrid import adapters as A
from wavegrid.functions import columns as C
from wavegrid.functions.columns import big
from wavegrid.operators import channels, cost, digest, framing, metadata, planning, predict, running

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
BLOCK = 16
U = ["user_id"]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def framed(spark: SparkSession, sf_dir: str, size: int = BLOCK) -> DataFrame:
    return framing.fixed(A.sig_events(spark, sf_dir), size, U)


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, total)"""
    return A.table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("total"))


def values(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# ---- framing


@query
def q_frame_fixed(spark, sf_dir):
    return framed(spark, sf_dir).select("user_id", "frame", "j", "n", "x")


@query
def q_frame_plan(spark, sf_dir):
    return framing.fixed_plan(streams(spark, sf_dir), BLOCK).select("user_id", "total", "frame", "sample_offset", "block_size")


def _schedule(spark, sf_dir) -> DataFrame:
    """Block sizes by rule: 16 + 7 * k modulo 33, for k from 0 until the events are covered."""
    last = A.table(spark, sf_dir, "events").agg(F.max("event_id").alias("last"))
    rows = last.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr("last div 16"))).alias("frame"))
    return framing.scheduled_plan(rows.withColumn("block_size", 16 + F.col("frame") * 7 % 33), "frame", "block_size")


@query
def q_frame_variable(spark, sf_dir):
    found = framing.assign(A.sig_events_all(spark, sf_dir), _schedule(spark, sf_dir))
    return found.groupBy("frame", "sample_offset", "block_size").agg(big(F.count("*")).alias("n"), big(F.sum("x")).alias("total"))


@query
def q_frame_validate(spark, sf_dir):
    plan = streams(spark, sf_dir).select("user_id", "total", (F.col("user_id") % 11).alias("channels"), (F.col("user_id") * 4001).alias("rate"), (F.col("user_id") % 40).alias("bits"), (F.col("user_id") % 64).alias("block_size"))
    return plan.withColumn("fault", framing.faults(plan))


@query
def q_levels(spark, sf_dir):
    n = A.table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") % 9).cast("bigint").alias("level"))
    return n.join(F.broadcast(framing.levels(spark)), "level").select(big("n_nationkey").alias("n_nationkey"), "level", "block_size", "max_fixed_order", "max_lpc_order", "max_partition_order", "mid_side")  # 9 rows


@query
def q_pack_chunks(spark, sf_dir):
    total = A.table(spark, sf_dir, "events").agg(F.count("*").alias("total"))
    plan = framing.packed_fixed(framing.fixed_plan(total, BLOCK), BLOCK)
    return plan.groupBy("batch").agg(big(F.count("*")).alias("frames"), big(F.sum("block_size")).alias("samples"))


@query
def q_pack_variable(spark, sf_dir):
    plan = framing.scheduled_plan(streams(spark, sf_dir).withColumn("frame", F.col("user_id")).withColumn("stream", F.col("user_id") % 5).withColumn("block_size", F.col("total")), "frame", "block_size", ["stream"])
    return framing.packed(plan, ["stream"], frames=4, samples=250).groupBy("stream", "batch").agg(big(F.count("*")).alias("frames"), big(F.min("frame")).alias("first"))


# ---- channels


@query
def q_deinterleave(spark, sf_dir):
    d = channels.deinterleave(A.sig_events(spark, sf_dir), 2)
    return d.groupBy("user_id", "t").agg(F.max(F.when(F.col("channel") == 0, F.col("x"))).alias("c0"), F.max(F.when(F.col("channel") == 1, F.col("x"))).alias("c1"))


@query
def q_interleave(spark, sf_dir):
    return channels.interleave(A.sig_stereo(spark, sf_dir), ["l", "r"]).select("user_id", "k", "channel", "x")


@query
def q_midside(spark, sf_dir):
    mid, side = channels.mid_side(F.col("l"), F.col("r"))
    return A.sig_stereo(spark, sf_dir).select("user_id", "i", mid.alias("mid"), side.alias("side"))


@query
def q_midside_inverse(spark, sf_dir):
    mid, side = channels.mid_side(F.col("l"), F.col("r"))
    left, right = channels.from_mid_side(F.col("mid"), F.col("side"))
    return A.sig_stereo(spark, sf_dir).select("user_id", "i", mid.alias("mid"), side.alias("side")).select("user_id", "i", left.alias("l"), right.alias("r"))


@query
def q_leftside_inverse(spark, sf_dir):
    left, right = channels.from_left_side(F.col("l"), F.col("l") - F.col("r"))
    return A.sig_stereo(spark, sf_dir).select("user_id", "i", left.alias("left"), right.alias("right"))


@query
def q_sideright_inverse(spark, sf_dir):
    left, right = channels.from_side_right(F.col("l") - F.col("r"), F.col("r"))
    return A.sig_stereo(spark, sf_dir).select("user_id", "i", left.alias("left"), right.alias("right"))


@query
def q_stereo_choice(spark, sf_dir):
    pairs = A.sig_stereo(spark, sf_dir).withColumn("frame", F.expr(f"i div {BLOCK}"))
    c = channels.stereo_choice(pairs, ["user_id", "frame"])
    return c.select("user_id", "frame", big("independent_cost").alias("independent_cost"), big("mid_side_cost").alias("mid_side_cost"), "mid_side")


# ---- prediction


def _fixed_order(k: int) -> None:
    def q(spark, sf_dir):
        return predict.fixed_residuals(framed(spark, sf_dir), U, [k]).select("user_id", "frame", "j", "r")

    q.__name__ = f"q_fixed_residual_o{k}"
    query(q)


for _k in range(5):
    _fixed_order(_k)


@query
def q_fixed_restore(spark, sf_dir):
    f = predict.zero_history(framed(spark, sf_dir), U, range(1, 5)).select("k", "user_id", "frame", "j", "d")
    return predict.restore(f, [*U, "k"], "k").select("k", "user_id", "frame", "j", "d", "x")


@query
def q_autocorr(spark, sf_dir):
    return predict.autocorrelation(framed(spark, sf_dir), U, 4)


@query
def q_autocorr_embed(spark, sf_dir):
    lag = lambda m: C.big(F.aggregate(F.zip_with(F.slice("xs", m + 1, 64), F.slice("xs", 1, 64 - m), lambda a, b: a * b), F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0))))
    return A.sig_embed(spark, sf_dir).select("vec_id", *[lag(m).alias(f"a{m}") for m in range(3)])


def _levinson(batches):
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        if not batch.num_rows:
            continue
        user, frame = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        r = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1).astype(np.float64)
        for order, (rows, a) in enumerate(predict.levinson_many(r), 1):
            shift, integers = predict.quantise_many(a)
            rows, shift, integers = rows[shift >= 0], shift[shift >= 0], integers[shift >= 0]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(rows) * order + 1, order), pa.int32()), pa.array(integers.reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array(user[rows]), pa.array(frame[rows]), pa.array(np.full(len(rows), order)), pa.array(shift), lists], ["user_id", "frame", "order", "shift", "coefficients"])


@query
def q_levinson(spark, sf_dir):
    a = predict.autocorrelation(framed(spark, sf_dir), U, 4).groupBy("user_id", "frame").agg(F.transform(F.sort_array(F.collect_list(F.struct("lag", "value"))), lambda s: s["value"]).alias("r"))
    return a.mapInArrow(_levinson, "user_id long, frame long, order long, shift long, coefficients array<long>")


#: Coefficient sets for the quantiser, (id, position, value); dyadic values, so errors are exact.
COEFFICIENTS = [(1, 1, 1.5), (1, 2, -0.75), (2, 1, 0.8125), (3, 1, 1.9375), (3, 2, -1.40625), (3, 3, 0.34375), (4, 1, 0.0), (5, 1, 2.0), (5, 2, -1.0)]


@query
def q_lpc_quantise(spark, sf_dir):
    return predict.quantised(values(spark, "id long, pos long, c double", COEFFICIENTS), ["id"])


@query
def q_lpc_residual(spark, sf_dir):
    return predict.lpc_residuals(framed(spark, sf_dir), U, [29491, -13107], 14)


@query
def q_lpc_restore(spark, sf_dir):
    coefficients, shift = [29491, -13107], 14
    f = framed(spark, sf_dir)
    r = predict.lpc_residuals(f, U, coefficients, shift)
    ordered = lambda v: F.transform(F.sort_array(F.collect_list(F.struct("j", v))), lambda s: s[v])
    b = f.groupBy("user_id", "frame").agg(ordered("x").alias("x")).withColumn("warmup", F.slice("x", 1, 2))
    b = b.join(r.groupBy("user_id", "frame").agg(ordered("r").alias("residuals")), ["user_id", "frame"], "left").withColumn("residuals", F.coalesce("residuals", F.array().cast("array<bigint>")))
    out = predict.lpc_restored(b, coefficients, shift)
    return out.select("user_id", "frame", F.posexplode("xs").alias("j", "x"), F.col("xs").eqNullSafe(F.col("x")).alias("_")).select("user_id", "frame", big("j").alias("j"), "x")


@query
def q_lpc_orders(spark, sf_dir):
    rates = [(8000, 4096), (44100, 4096), (48000, 10), (96000, 4096), (192000, 20), (96000, 1)]
    each = F.explode(F.array(*[F.struct(big(F.lit(r)).alias("rate"), big(F.lit(n)).alias("n")) for r, n in rates])).alias("e")
    both = framing.levels(spark).select("level", "max_lpc_order", each).select("level", "max_lpc_order", "e.rate", "e.n")
    return both.select("level", "rate", "n", F.explode(predict.lpc_orders(F.col("rate"), F.col("max_lpc_order"), F.col("n"))).alias("order"))


@query
def q_warmup(spark, sf_dir):
    b = A.blocks(A.sig_events(spark, sf_dir), "user_id", BLOCK)
    rows = b.select("user_id", "frame", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("k"), "xs").withColumn("w", F.slice("xs", F.lit(1), F.col("k")))
    return rows.select("user_id", "frame", big("k").alias("k"), F.array_join(F.col("w").cast("array<string>"), ",").alias("warmup"))


# ---- costs


@query
def q_fold(spark, sf_dir):
    return A.sig_events(spark, sf_dir).select("user_id", "i", "x", C.fold(F.col("x")).alias("u"))


@query
def q_unfold(spark, sf_dir):
    u = A.sig_events(spark, sf_dir).select("user_id", "i", C.fold(F.col("x")).alias("u"))
    return u.select("user_id", "i", "u", C.unfold(F.col("u")).alias("x"))


@query
def q_rice_param(spark, sf_dir):
    u = predict.fixed_residuals(framed(spark, sf_dir), U, [1]).groupBy("user_id", "frame").agg(big(F.sum(C.fold(F.col("r")))).alias("folded"), big(F.count("*")).alias("n"))
    e = C.floor_log2(F.expr("folded div n"))
    return u.withColumn("four", F.least(e, F.lit(14).cast("bigint"))).withColumn("five", F.least(e, F.lit(30).cast("bigint"))).withColumn("zero_too", e <= 2)


@query
def q_rice_cost(spark, sf_dir):
    u = predict.fixed_residuals(framed(spark, sf_dir), U, [1]).withColumn("u", C.fold(F.col("r")))
    k = u.withColumn("parameter", F.explode(F.sequence(F.lit(0), F.lit(14))))
    bits = F.sum(F.expr("shiftright(u, parameter)") + 1 + F.col("parameter"))
    return k.groupBy("user_id", "frame", big("parameter").alias("parameter")).agg(big(bits + 4).alias("bits"))


@query
def q_escape_cost(spark, sf_dir):
    s = predict.fixed_residuals(framed(spark, sf_dir), U, [2]).groupBy("user_id", "frame").agg(big(F.count("*")).alias("n"), F.min("r").alias("low"), F.max("r").alias("high"))
    w = C.escape_width(F.col("low"), F.col("high"))
    return s.withColumn("width", w).withColumn("bits", 9 + F.col("n") * w)


@query
def q_partition_choice(spark, sf_dir):
    return cost.partition_costs(framed(spark, sf_dir), U).select("user_id", "frame", "k", "p", "part", "count", "bits0", "kind0", "parameter0", "bits1", "kind1", "parameter1")


@query
def q_partition_orders(spark, sf_dir):
    n = framing.fixed_plan(streams(spark, sf_dir), BLOCK).select("block_size").distinct().union(values(spark, "block_size long", [(576,), (1152,), (4096,), (4608,), (1000,)])).distinct()
    rows = n.select(F.col("block_size").alias("n"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(4).cast("bigint"))).alias("k"))
    return rows.select("n", "k", F.explode(cost.partition_orders(F.col("n"), F.col("k"), 6).cast("array<bigint>")).alias("p"))


@query
def q_residual_choice(spark, sf_dir):
    return cost.residual_choice(framed(spark, sf_dir), U).select("user_id", "frame", "k", "p", "method", "bits")


@query
def q_constant_block(spark, sf_dir):
    o = framing.fixed(A.sig_orders(spark, sf_dir).withColumn("x", F.expr("x div 10000000")), 4, ["status"])
    return o.groupBy("status", "frame").agg(big(F.count("*")).alias("n"), (F.min("x") == F.max("x")).alias("constant"))


@query
def q_subframe_choice(spark, sf_dir):
    return cost.subframes(framed(spark, sf_dir), U, 17)


@query
def q_subframe_lpc(spark, sf_dir):
    """The cheapest form of every block, adaptive predictors of order 1 and 2 included."""
    return cost.subframes_with_lpc(framed(spark, sf_dir), U, 17, 44_100, 2)


@query
def q_lpc_candidates(spark, sf_dir):
    """Adaptive predictors of order 1 and 2 of every block, in whole numbers, and the sum of their residuals' magnitudes."""
    blocks = A.blocks(A.sig_events(spark, sf_dir), "user_id", BLOCK)
    c = predict.lpc_candidates(blocks, U, 44_100, 2)
    return c.groupBy("user_id", "frame", "k").agg(F.first("shift").alias("shift"), F.array_join(F.first("coefficients").cast("array<string>"), ",").alias("coefficients"), big(F.sum(F.abs("r"))).alias("magnitude"))


@query
def q_frame_cost(spark, sf_dir):
    """Both stereo forms of each frame, and the one that the magnitudes choose."""
    pairs = A.sig_stereo(spark, sf_dir).where("user_id is not null")  # as in the SQL, whose join drops them
    f = cost.stereo_frames(framing.fixed(pairs, BLOCK, U), U, 16)
    return f.select("user_id", "frame", "independent", "mid_side_bits", F.when(F.col("mid_side"), F.col("mid_side_bits")).otherwise(F.col("independent")).alias("bits"))


@query
def q_streaminfo(spark, sf_dir):
    s = cost.subframes(framed(spark, sf_dir), U, 17).withColumn("frame_bytes", F.expr("(bits + 7) div 8"))
    full = F.max("frame").over(W.partitionBy("user_id"))
    s = s.withColumn("short", (F.col("frame") == full) & (full > 0) & (F.col("n") < BLOCK))
    return s.groupBy("user_id").agg(
        big(F.min(F.when(~F.col("short"), F.col("n")))).alias("min_block"), big(F.max("n")).alias("max_block"), big(F.min("frame_bytes")).alias("min_frame"),
        big(F.max("frame_bytes")).alias("max_frame"), big(F.sum("n")).alias("total"),
    )


@query
def q_summary(spark, sf_dir):
    s = cost.subframes(framed(spark, sf_dir), U, 17)
    return s.groupBy("user_id").agg(big(F.count("*")).alias("frames"), big(F.sum("n")).alias("samples"), big(F.sum("bits")).alias("bits"), big(F.count_if(F.col("kind") == "fixed")).alias("fixed"), big(F.count_if(F.col("kind") == "verbatim")).alias("verbatim"))


# ---- digests and packing


def _digests(spark, sf_dir) -> DataFrame:
    """Ordered text of a bounded block, then of a stream's block digests: no stream is gathered in one row."""
    b = A.blocks(A.sig_events(spark, sf_dir), "user_id", 64).withColumn("d", F.md5(F.array_join(F.col("xs").cast("array<string>"), ",").cast("binary")))
    top = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("frame", "d"))), lambda s: s["d"]), "")
    return b.groupBy("user_id").agg(F.md5(top.cast("binary")).alias("digest"))


@query
def q_stream_md5(spark, sf_dir):
    return _digests(spark, sf_dir)


@query
def q_md5_verify(spark, sf_dir):
    zero = "0" * 32
    d = _digests(spark, sf_dir).withColumn("expected", F.when(F.col("user_id") % 3 == 0, zero).when(F.col("user_id") % 3 == 1, F.col("digest")).otherwise(F.reverse("digest")))
    return d.select("user_id", "expected", ((F.col("expected") == zero) | (F.col("expected") == F.col("digest"))).alias("verified"))


def _packed(batches):
    """Samples as bytes of three kinds, and these as the numbers that they state; and what is unpacked."""
    import numpy as np
    import pyarrow as pa

    from wavegrid.sources.containers import Spec, checked, pack, unpack

    kinds = [checked(Spec(8000, 1, bits, width, layout=layout)) for bits, width, layout in ((6, 8, "unsigned8"), (12, 16, "le"), (20, 24, "be"))]
    for batch in batches:
        out, data = [], b""
        for k, spec in enumerate(kinds):
            x = batch.column(2 + k).to_numpy()
            data = pack(x, spec)
            raw = np.frombuffer(data, np.uint8).reshape(len(x), -1).astype(np.int64)
            raw = raw[:, ::-1] if spec.layout == "be" else raw
            value = sum(raw[:, i] << (8 * i) for i in range(raw.shape[1])) if len(x) else np.zeros(0, np.int64)
            top = 1 << spec.container_bits
            out.append(pa.array(value if spec.layout == "unsigned8" else np.where(value >= top >> 1, value - top, value), pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *out, pa.array(unpack(data, kinds[2])[:, 0], pa.int64())], ["user_id", "i", "p8", "p16", "p24", "x"])


_PACKED = "user_id long, i long, p8 long, p16 long, p24 long, x long"


@query
def q_pack_sample(spark, sf_dir):
    """6 valid bits in 8, which is unsigned, 12 in 16 and 20 in 24."""
    x = A.sig_events(spark, sf_dir).select("user_id", "i", (F.pmod("x", F.lit(64)) - 32).alias("a"), (F.pmod("x", F.lit(4096)) - 2048).alias("b"), F.col("x"))
    return x.mapInArrow(_packed, _PACKED).drop("x")


def _unpacked(batches):
    import numpy as np
    import pyarrow as pa

    from wavegrid.sources.containers import Spec, checked, pack, unpack

    spec = checked(Spec(8000, 1, 20, 24, layout="le"))
    for batch in batches:
        data = pack(batch.column(2).to_numpy(), spec)
        raw = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(raw[:, k]) for k in range(3)), pa.array(unpack(data, spec)[:, 0], pa.int64())], ["user_id", "i", "b0", "b1", "b2", "x"])


@query
def q_unpack_sample(spark, sf_dir):
    """20 valid bits in little-endian 24-bit bytes, back to signed samples."""
    return A.sig_events(spark, sf_dir).select("user_id", "i", "x").mapInArrow(_unpacked, "user_id long, i long, b0 long, b1 long, b2 long, x long")


@query
def q_stream_digest(spark, sf_dir):
    """Each stream's own digest, of its samples' bytes in order."""
    return digest.stream_md5(A.blocks(A.sig_events(spark, sf_dir), "user_id", 64), U, 17)


@query
def q_digest_verify(spark, sf_dir):
    """Digests as stated: all zeros, right, and wrong."""
    d = digest.stream_md5(A.blocks(A.sig_events(spark, sf_dir), "user_id", 64), U, 17)
    expected = F.when(F.col("user_id") % 3 == 0, "0" * 32).when(F.col("user_id") % 3 == 1, F.col("md5")).otherwise(F.reverse("md5"))
    return d.select("user_id", expected.alias("expected"), digest.verified(expected, F.col("md5")).alias("verified"))


@query
def q_decode_batches(spark, sf_dir):
    """Frames as decoders take them: sealed by samples, bytes and frames."""
    b = framing.decode_batches(_frames(spark, sf_dir), U, 4, 60, 150)
    return b.groupBy("user_id", "batch").agg(big(F.count("*")).alias("frames"), big(F.sum("block_size")).alias("samples"), big(F.sum("frame_size")).alias("bytes"), F.min("frame").alias("first"))


# ---- header tables


def _numbers(spark, low: int, high: int) -> DataFrame:
    return spark.range(low, high).select(F.col("id").alias("v"))


@query
def q_container_bits(spark, sf_dir):
    return _numbers(spark, 1, 33).select("v", C.container_bits(F.col("v")).alias("bits"))


@query
def q_channel_mask(spark, sf_dir):
    return _numbers(spark, 1, 10).select("v", planning.usual_mask(F.col("v")).alias("mask"), C.mask_text(planning.usual_mask(F.col("v"))).alias("text"))


@query
def q_mask_valid(spark, sf_dir):
    o = A.table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") * 2654435761 % (1 << 20)).alias("mask"), (F.col("o_orderkey") % 8 + 1).alias("channels"))
    return o.withColumn("valid", C.mask_valid(F.col("mask"), F.col("channels")))


@query
def q_blocksize_code(spark, sf_dir):
    return _numbers(spark, 1, 5000).select("v", C.block_size_code(F.col("v")).alias("code"), (F.when(C.block_size_code(F.col("v")) == 6, 1).when(C.block_size_code(F.col("v")) == 7, 2).otherwise(0)).cast("bigint").alias("extra"))


@query
def q_rate_code(spark, sf_dir):
    rates = _numbers(spark, 0, 3000).select((F.col("v") * 350 + F.when(F.col("v") % 7 == 0, 1).otherwise(0) + 1).alias("rate")).union(values(spark, "rate long", [(r,) for r in C.RATE_CODES.values()]))
    return rates.select("rate", C.rate_code(F.col("rate")).alias("code"))


@query
def q_depth_code(spark, sf_dir):
    return _numbers(spark, 4, 33).select("v", C.depth_code(F.col("v")).alias("code"))


@query
def q_varint_len(spark, sf_dir):
    o = A.table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") * 7919 * 7919 % (1 << 36)).alias("v"))
    powers = _numbers(spark, 0, 36).select((F.col("v") * -1 - 1).alias("o_orderkey"), F.expr("shiftleft(cast(1 as bigint), cast(v as int))").alias("v"))
    return o.union(powers).select("o_orderkey", "v", C.varint_length(F.col("v")).alias("bytes"))


def _stream_infos(batches):
    """Streams' headers as bytes, and what these are read as. A stream that doesn't fit has no bytes, and keeps what was asked."""
    import pyarrow as pa

    from wavegrid.sources.flac import StreamInfo

    for batch in batches:
        rows = []
        for user, rate, channels, bits, total in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            s = StreamInfo(16, 16, 0, 0, rate, channels, bits, total)
            packed = None
            if user is not None and s.fits():
                data = s.bytes()
                s, packed = StreamInfo.parse(data), int.from_bytes(data[10:18], "big", signed=True)
            rows.append((user, packed, s.rate, s.channels, s.bits, s.total))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(6)], ["user_id", "packed", "rate", "channels", "bits", "total"])


@query
def q_streaminfo_pack(spark, sf_dir):
    """The 64 bits of rate, channels, depth and total, and what they unpack to. A row a stream. The bits are those of a signed number, negative from a rate of
    2 ** 19 on; they are null where the header has no room: from a rate of 2 ** 20 on, as for null ids."""
    s = streams(spark, sf_dir).select("user_id", (F.col("user_id") * 977 + 8000).alias("rate"), (F.col("user_id") % 8 + 1).alias("channels"), (F.col("user_id") % 29 + 4).alias("bits"), "total")
    return s.mapInArrow(_stream_infos, "user_id long, packed long, rate long, channels long, bits long, total long")


@query
def q_padded_sizes(spark, sf_dir):
    return _numbers(spark, 0, 200).select("v", C.padded_riff(F.col("v")).alias("riff"), C.padded_w64(F.col("v")).alias("w64"))


@query
def q_progress_text(spark, sf_dir):
    e = A.sig_events_all(spark, sf_dir).select("i", F.pmod(F.col("x") * 7, F.lit(100_000)).alias("s"))
    return e.select("i", C.clock(F.col("s")).alias("clock"), C.bar(F.col("s") % 1000, F.lit(1000), 20).alias("bar"), C.shortened(F.concat(F.lit("signal-"), F.col("s").cast("string")), 9).alias("name"))


# ---- metadata


def _comments(spark, sf_dir) -> DataFrame:
    c = A.table(spark, sf_dir, "conversations")
    return c.select("conv_id", F.col("turn").alias("pos"), F.upper("role").alias("key"), F.col("text").alias("value"))


@query
def q_comment_split(spark, sf_dir):
    c = A.table(spark, sf_dir, "conversations")
    entry = F.when(F.col("turn") % 5 == 0, F.col("text")).when(F.col("turn") % 5 == 1, F.concat(F.lit("="), F.col("text"))).otherwise(F.concat("role", F.lit("="), "text"))  # null if one of them is
    key, value = metadata.split_comment(F.col("entry"))
    return c.select("conv_id", "turn", entry.alias("entry")).select("conv_id", "turn", key.alias("key"), value.alias("value"))


@query
def q_text_payload(spark, sf_dir):
    """Payloads of text chunks: with a NUL and more after it, without one, and empty before it."""
    c = A.table(spark, sf_dir, "conversations")
    nul = F.decode(F.unhex(F.lit("00")), "UTF-8")
    payload = F.when(F.col("turn") % 4 == 0, F.concat("text", nul, F.lit("more"))).when(F.col("turn") % 4 == 1, F.col("text")).when(F.col("turn") % 4 == 2, F.concat(nul, F.col("text"))).otherwise(F.concat("role", nul, nul))
    return c.select("conv_id", "turn", metadata.text_payload(payload).alias("text"))


@query
def q_mask_text(spark, sf_dir):
    """Masks to text and back, with upper-case digits and blanks."""
    o = A.table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") * 2654435761 % (1 << 18)).alias("mask"))
    t = o.withColumn("text", F.concat(F.lit(" "), F.upper(C.mask_text(F.col("mask"))), F.lit(" ")))
    return t.select("o_orderkey", C.mask_text(F.col("mask")).alias("text"), C.mask_value(F.col("text")).alias("mask"))


@query
def q_comments_visible(spark, sf_dir):
    c = _comments(spark, sf_dir).withColumn("key", F.when(F.col("pos") == 1, metadata.MASK_KEY.lower()).when(F.col("pos") == 2, F.lit("any" + metadata.PROVENANCE_SUFFIX)).otherwise(F.col("key")))
    return metadata.visible(c)


@query
def q_comments_group(spark, sf_dir):
    g = metadata.grouped(_comments(spark, sf_dir), ["conv_id"])
    known = F.filter("values", lambda v: v.isNotNull())  # nulls count, but aren't first or last
    return g.select("conv_id", "key", big(F.size("values")).alias("n"), F.get(known, F.lit(0)).alias("first"), F.get(known, F.size(known) - 1).alias("last"))


@query
def q_comments_replace(spark, sf_dir):
    new = A.table(spark, sf_dir, "conversations").select("conv_id").distinct().withColumn("value", F.lit("new"))
    out = metadata.replaced(_comments(spark, sf_dir), "user", new, ["conv_id"])
    at = F.when(F.col("value").isNotNull(), F.struct("pos", "value"))  # nulls count, but aren't last; of one pos the largest value is
    return out.groupBy("conv_id", "key").agg(big(F.count("*")).alias("n"), F.max_by("value", at).alias("last"))


@query
def q_comments_remove(spark, sf_dir):
    c = _comments(spark, sf_dir)
    left, gone = metadata.removed(c, c.select("conv_id").distinct(), "user", ["conv_id"])
    rest = left.groupBy("conv_id").agg(big(F.count("*")).alias("left"))
    return gone.join(rest, "conv_id", "left").select("conv_id", "removed", F.coalesce("left", F.lit(0).cast("bigint")).alias("left"))


@query
def q_comments_append(spark, sf_dir):
    """A comment after the others of every third conversation, and the mask of each in the place of its own."""
    c = _comments(spark, sf_dir).select("conv_id", "pos", "key", F.md5(F.col("value").cast("binary")).alias("value"))
    ids = c.select("conv_id").distinct()
    c = metadata.appended(c, ids.where("conv_id % 3 = 0").select("conv_id", F.lit(0).cast("bigint").alias("pos"), F.lit(metadata.MASK_KEY.lower()).alias("key"), F.lit("0x1").alias("value")), ["conv_id"])
    masks = ids.where("conv_id % 2 = 0").select("conv_id", (F.col("conv_id") % 8 + 1).alias("channels"), F.when(F.col("conv_id") % 4 == 0, F.lit(3)).otherwise(F.lit(5)).cast("bigint").alias("mask"))
    return metadata.with_mask(c, masks, ["conv_id"])


@query
def q_blocks_edited(spark, sf_dir):
    """What is written of each stream's blocks once every third stream has been edited: its preserved blocks go, and the others come."""
    kinds = [("preserved", 4, 0), ("preserved", 6, 1), ("draft", 5, 2), ("draft", 4, 3)]
    each = F.explode(F.array(*[F.struct(F.lit(o).alias("origin"), big(F.lit(k)).alias("block_type"), big(F.lit(n)).alias("ordinal")) for o, k, n in kinds])).alias("b")
    blocks = streams(spark, sf_dir).select("user_id", each).select("user_id", "b.*")
    return metadata.emitted(metadata.edited(blocks, streams(spark, sf_dir).where("user_id % 3 = 0"), U), U)


@query
def q_cues_set(spark, sf_dir):
    """Cue points of every fifth stream are set anew, and those of streams divisible by ten cleared."""
    e = A.sig_events(spark, sf_dir).select("user_id", F.pmod("x", F.lit(150)).alias("sample_offset"))
    own = metadata.cues(e, streams(spark, sf_dir), U)
    given = e.where("user_id % 10 = 5").select("user_id", (F.col("sample_offset") * 2).alias("sample_offset"))
    return metadata.with_cues(own, given, streams(spark, sf_dir), streams(spark, sf_dir).where("user_id % 5 = 0"), U)


@query
def q_comments_listagg(spark, sf_dir):
    return metadata.joined(_comments(spark, sf_dir), ["conv_id"])


@query
def q_info_keys(spark, sf_dir):
    ids = values(spark, "chunk string", [(k,) for k in metadata.INFO_KEYS] + [("XXXX",)])
    return ids.select("chunk", metadata.info_key(F.col("chunk")).alias("key"))


@query
def q_info_projection(spark, sf_dir):
    """Keys back to chunk ids, whatever their case; others drop out."""
    back = values(spark, "key string, chunk string", [(v, k) for k, v in metadata.INFO_KEYS.items()])
    c = A.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.element_at(F.array(F.lit("title"), F.lit("Artist"), F.lit("mood"), F.lit("GENRE")), (F.col("turn") % 4 + 1).cast("int")).alias("k"))
    return c.join(F.broadcast(back), F.upper("k") == F.col("key")).select("conv_id", "turn", "k", "chunk")  # 9 rows


@query
def q_text_projection(spark, sf_dir):
    """INFO chunks as AIFF texts and CAF keys."""
    ids = F.element_at(F.array(*map(F.lit, [*metadata.INFO_KEYS, "XXXX"])), (F.col("turn") % 10 + 1).cast("int"))
    c = A.table(spark, sf_dir, "conversations").select("conv_id", "turn", ids.alias("chunk"), F.when(F.col("conv_id") % 2 == 0, "1999").otherwise(F.col("text")).alias("value"))
    return c.select("conv_id", "turn", "chunk", metadata.aiff_text(F.col("chunk")).alias("aiff"), metadata.caf_key(F.col("chunk"), F.col("value")).alias("caf"))


@query
def q_cue_normalise(spark, sf_dir):
    e = A.sig_events(spark, sf_dir).select("user_id", F.pmod("x", F.lit(150)).alias("sample_offset"))
    return metadata.cues(e, streams(spark, sf_dir), U)


@query
def q_cue_points(spark, sf_dir):
    e = A.sig_events(spark, sf_dir)
    tracks = e.select("user_id", F.col("i").alias("track"), (F.expr("i div 2") * 588).alias("offset"))
    indexes = e.where("i % 3 = 0").select("user_id", F.col("i").alias("track"), (F.col("i") % 2).alias("number"), F.lit(588).cast("bigint").alias("offset"))
    return metadata.cue_points(tracks, indexes, U)


@query
def q_blob_dictionary(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents").select((F.col("doc_id") % 7).alias("stream"), F.col("doc_id").alias("ordinal"), F.md5(F.col("text").cast("binary")).alias("blob"))
    return metadata.dictionary(d, ["stream"]).select("stream", "ordinal", F.col("index").alias("idx"))


@query
def q_chunk_precedence(spark, sf_dir):
    """A stream's other chunks count only if it has no private bundle."""
    c = A.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 6 == 5, "fxmd").when(F.col("turn") % 2 == 0, "LIST").otherwise("cue ").alias("chunk"))
    return metadata.with_private(c, ["conv_id"])


@query
def q_block_order(spark, sf_dir):
    """Preserved blocks win over comments and cue sheets, which follow in that order."""
    block = lambda origin, kind, ordinal: F.struct(F.lit(origin).alias("origin"), big(F.lit(kind)).alias("block_type"), big(F.lit(ordinal)).alias("ordinal"))
    drafts = F.array(block("cues", 5, 0), block("comments", 4, 1))
    kept = F.when(F.col("user_id") % 4 == 0, F.array(block("preserved", 2, 0), block("preserved", 1, 1))).otherwise(F.array().cast("array<struct<origin:string,block_type:bigint,ordinal:bigint>>"))
    blocks = streams(spark, sf_dir).select("user_id", F.explode(F.concat(drafts, kept)).alias("b")).select("user_id", "b.*")
    return metadata.emitted(blocks, U).select("user_id", "ordinal", "block_type")


def _frames(spark, sf_dir) -> DataFrame:
    s = cost.subframes(framed(spark, sf_dir), U, 17)
    return s.select("user_id", "frame", F.col("n").alias("block_size"), F.expr("(bits + 7) div 8 + 8").alias("frame_size"))


@query
def q_seek_points(spark, sf_dir):
    counts = streams(spark, sf_dir).select("user_id", F.col("total").alias("count"))
    return metadata.seek_frames(counts, 7).select("user_id", "slot", "frame")


@query
def q_seek_offsets(spark, sf_dir):
    return metadata.offsets(_frames(spark, sf_dir), U).select("user_id", "frame", "frame_size", "frame_offset")


@query
def q_seek_validate(spark, sf_dir):
    last = (1 << 63) - 1
    p = A.sig_events(spark, sf_dir).select("user_id", F.col("i").alias("pos"), F.when(F.col("i") % 17 == 16, F.lit(last)).otherwise(F.col("i") * 100 - F.when(F.col("i") % 10 == 9, 150).otherwise(0)).cast("bigint").alias("sample_number"))
    return metadata.seek_faults(p, U)


# ---- progress and sessions


@query
def q_running_progress(spark, sf_dir):
    return running.cumulative(_frames(spark, sf_dir).withColumnRenamed("frame_size", "frame_bytes"), U, 42)


@query
def q_two_phase(spark, sf_dir):
    return running.two_phase(framing.fixed_plan(streams(spark, sf_dir), BLOCK), U)


@query
def q_batch_rollup(spark, sf_dir):
    e = A.table(spark, sf_dir, "events").select("user_id", "event_id").withColumn("done", F.row_number().over(W.partitionBy("user_id").orderBy("event_id")).cast("bigint") * 3)
    return running.batch_rollup(e, "user_id", "event_id", "done")


@query
def q_rate_eta(spark, sf_dir):
    e = A.sig_events(spark, sf_dir).join(streams(spark, sf_dir), "user_id")
    u = e.select("user_id", "i", (F.expr("i div 2") * 2).alias("done"), (F.col("i") * 90).alias("elapsed_ms"), "total")
    return running.rates(u, U, "i", "done", "elapsed_ms", "total").select("user_id", "i", "warm", "rate", "eta_ms")


@query
def q_peak_inflight(spark, sf_dir):
    e = A.sig_events(spark, sf_dir).select("user_id", (F.col("i") * 3).alias("start"), (F.col("i") * 3 + F.pmod("x", F.lit(40)) + 1).alias("end"))
    return running.peak(e, U, "start", "end")


@query
def q_byte_counters(spark, sf_dir):
    f = _frames(spark, sf_dir)
    return running.cumulative(f.withColumn("frame_bytes", F.col("block_size") * 2), U, 44).select("user_id", "frame", "bytes_done")


@query
def q_ordered_drain(spark, sf_dir):
    plan = framing.fixed_plan(streams(spark, sf_dir), BLOCK).withColumn("arrival", F.pmod(F.col("frame") * 7 + F.col("user_id"), F.lit(10)))
    return running.drained(plan, U, "arrival", "frame").select("user_id", "frame", "arrival", "released")


@query
def q_portions(spark, sf_dir):
    """Takes of 0 to 24 samples from buffers of whole blocks."""
    blocks = framing.fixed_plan(streams(spark, sf_dir), BLOCK).select("user_id", F.col("frame").alias("block"), F.col("block_size").alias("samples"))
    takes = streams(spark, sf_dir).select("user_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr("total div 14"))).alias("take"))
    return running.portions(blocks, takes.withColumn("budget", (F.col("take") * 7 + 3) % 25), U)


@query
def q_lifecycle(spark, sf_dir):
    """Pages as the files of a command, with some that fail."""
    p = A.table(spark, sf_dir, "pages").select(F.concat(F.lit("a\tb/"), F.col("page_id").cast("string")).alias("file"), F.col("page_id").alias("input_bytes"), (F.col("page_id") * 7 % 100 * 10).alias("started_ms"), (F.col("page_id") * 7 % 100 * 10 + F.col("page_id") % 13 * 31 + 1).alias("ended_ms"), F.when(F.col("page_id") % 7 == 0, "bad").alias("error"))
    return running.lifecycle(p, "encode")


@query
def q_reconcile(spark, sf_dir):
    plan = streams(spark, sf_dir).where("user_id % 7 != 0").select("user_id", (F.col("total") + F.col("user_id") % 3 - 1).alias("planned"))
    actual = streams(spark, sf_dir).where("user_id % 5 != 0 or user_id % 7 = 0").select("user_id", F.col("total").alias("found"))  # no stream is on neither side
    return running.reconciled(plan, actual, U)


@query
def q_worklist(spark, sf_dir):
    p = A.table(spark, sf_dir, "pages")
    path = F.concat(F.lit("/in/"), F.regexp_replace("url", r"^[a-z]+://|[?#].*$", ""), F.element_at(F.array(*map(F.lit, (".wav", ".AIFF", ".txt", ".caf"))), (F.col("page_id") % 4 + 1).cast("int")))
    files = p.select(F.lit("/in").alias("root"), path.alias("path"), F.col("page_id").alias("total"))
    return planning.worklist(files, "recompress", 2, ["wav", "aiff", "caf"])


@query
def q_worklist_deep(spark, sf_dir):
    """Paths of any depth, and those of three levels of folders at most."""
    p = A.table(spark, sf_dir, "pages")
    folders = F.repeat(F.lit("d/"), (F.col("page_id") % 5).cast("int"))
    path = F.concat(F.when(F.col("page_id") % 11 == 0, "/out/").otherwise("/in/"), folders, F.col("page_id").cast("string"), F.element_at(F.array(*map(F.lit, (".wav", ".AIFF", ".txt", ".caf"))), (F.col("page_id") % 4 + 1).cast("int")))
    files = p.select(F.lit("/in").alias("root"), path.alias("path"), F.col("page_id").alias("total"))
    every, near = (planning.worklist(files, command, depth, ["wav", "aiff", "caf"]).withColumn("depth", big(F.lit(depth))) for command, depth in (("recompress", 0), ("encode", 3)))
    return every.unionByName(near)


@query
def q_enabled_container(spark, sf_dir):
    """Containers where some families are switched off."""
    o = A.table(spark, sf_dir, "orders").select("o_orderkey", (big(F.round(F.col("o_totalprice") * 100)) * 150).alias("size"), F.element_at(F.array(*map(F.lit, ("auto", "wave", "rf64", "wave64", "aiff", "aifc", "caf"))), (F.col("o_orderkey") % 7 + 1).cast("int")).alias("requested"))
    enabled = F.array_compact(F.array(*[F.when(F.expr(f"o_orderkey div {1 << k} % 2 = 1"), name) for k, name in enumerate(planning.FAMILIES)]))
    return o.select("o_orderkey", "requested", "size", planning.family(F.col("requested")).alias("family"), planning.enabled_container(F.col("requested"), F.col("size"), enabled).alias("container"))


@query
def q_output_family(spark, sf_dir):
    p = A.table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("a.b/c."), F.element_at(F.array(*map(F.lit, ("wav", "RF64", "w64", "aif", "aifc", "caf", "flac", "mp3"))), (F.col("page_id") % 8 + 1).cast("int"))).alias("path"))
    return p.select("page_id", "path", planning.container_of(F.col("path")).alias("container"))


@query
def q_sniff(spark, sf_dir):
    heads = values(spark, "head string", [("FORMxxxxAIFF",), ("caff",), ("RIFF",), ("RF64",), ("riff",), ("FOR",), ("",)])
    return heads.select("head", planning.sniffed(F.col("head")).alias("family"))


@query
def q_container_resolve(spark, sf_dir):
    o = A.table(spark, sf_dir, "orders").select("o_orderkey", (big(F.round(F.col("o_totalprice") * 100)) * 150).alias("data"), F.element_at(F.array(*map(F.lit, ("auto", "wave", "rf64"))), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("requested"), (F.col("o_orderkey") % 4 + 1).alias("channels"))
    size = planning.riff_size(F.lit(24), F.lit(0), F.col("data"))
    plain = planning.canonical_format(F.col("channels"), F.lit(16), F.lit(16), planning.usual_mask(F.col("channels")))
    return o.select("o_orderkey", "requested", size.alias("size"), planning.container(F.col("requested"), size).alias("container"), plain.alias("plain"))
