"""Metadata as rows: comments, cue points, preserved blocks and seek points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from wavegrid.functions.columns import CHANNEL_MASKS, big, mask_text

#: The comment key of a channel mask, and how keys end that say where a mask comes from; views hide both.
MASK_KEY, PROVENANCE_SUFFIX = "WAVEFORMATEXTENSIBLE_CHANNEL_MASK", "_CHANNEL_LAYOUT_PROVENANCE"
#: INFO chunk ids and the comment keys they become.
INFO_KEYS = {"IART": "ARTIST", "ICMT": "COMMENT", "ICOP": "COPYRIGHT", "ICRD": "DATE", "IGNR": "GENRE", "INAM": "TITLE", "IPRD": "ALBUM", "ISFT": "ENCODER", "ITRK": "TRACKNUMBER"}
#: INFO chunk ids as AIFF text chunks and CAF information keys. A date that isn't four digits is CAF's recorded date.
AIFF_TEXTS = {"INAM": "NAME", "IART": "AUTH", "ICOP": "(c) ", "ICMT": "ANNO"}
CAF_KEYS = {"IART": "artist", "ICMT": "comments", "ICOP": "copyright", "ICRD": "year", "IGNR": "genre", "INAM": "title", "IPRD": "album", "ISFT": "encoding application", "ITRK": "track number"}
CAF_OTHER_DATE = "recorded date"
#: Most points of a seek table, and most cue points of a stream.
MOST_SEEK_POINTS, MOST_CUES = 932_067, 99


def split_comment(entry: Column) -> tuple[Column, Column]:
    """Key and value around the first equals sign; both null without a sign or with an empty key."""
    at = F.instr(entry, "=")
    return F.when(at > 1, F.substr(entry, F.lit(1), at - 1)), F.when(at > 1, F.substr(entry, at + 1))


def text_payload(payload: Column) -> Column:
    """Up to the first NUL; null if that is empty or isn't UTF-8."""
    text = F.substring_index(payload, "\0", 1)
    return F.when(F.is_valid_utf8(text) & (F.length(text) > 0), text)


def info_key(chunk: Column) -> Column:
    out = None
    for k, v in INFO_KEYS.items():
        out = F.when(chunk == k, v) if out is None else out.when(chunk == k, v)
    return out


def aiff_text(chunk: Column) -> Column:
    """The AIFF text chunk of an INFO chunk, or null."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in AIFF_TEXTS.items() for x in pair]), chunk)


def caf_key(chunk: Column, value: Column) -> Column:
    """The CAF information key of an INFO chunk, or null."""
    key = F.element_at(F.create_map(*[F.lit(x) for pair in CAF_KEYS.items() for x in pair]), chunk)
    return F.when((chunk == "ICRD") & ~value.rlike("^[0-9]{4}$"), CAF_OTHER_DATE).otherwise(key)


def visible(comments: DataFrame) -> DataFrame:
    """comments without those of the reserved keys; a null key is none of them."""
    reserved = (F.upper("key") == MASK_KEY) | F.upper("key").endswith(PROVENANCE_SUFFIX)
    return comments.where(~F.coalesce(reserved, F.lit(False)))


def without_key(comments: DataFrame, key: str) -> DataFrame:
    return comments.where(F.upper("key") != key.upper())


def replaced(comments: DataFrame, key: str, values: DataFrame, keys: list[str]) -> DataFrame:
    """comments with values (keys, value) in the place of those with key, after the others."""
    last = F.lit((1 << 62)).cast("bigint")
    return without_key(comments, key).unionByName(values.withColumn("key", F.lit(key)).withColumn("pos", last).select(comments.columns))


def appended(comments: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """comments and, after each stream's others, values (keys, pos, key, value); pos goes on from the last."""
    last = comments.groupBy(*keys).agg(F.max("pos").alias("_last"))
    more = values.join(last, keys, "left").withColumn("pos", F.col("pos") + F.coalesce(F.col("_last") + 1, F.lit(0).cast("bigint"))).drop("_last")
    return comments.unionByName(more.select(comments.columns))


def removed(comments: DataFrame, streams: DataFrame, key: str, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """comments without a key, and how many each of the streams (keys) has lost: keys and removed."""
    gone = comments.where(F.upper("key") == key.upper()).groupBy(*keys).agg(big(F.count("*")).alias("removed"))
    return without_key(comments, key), streams.select(*keys).join(gone, keys, "left").withColumn("removed", F.coalesce("removed", F.lit(0).cast("bigint")))


def edited(blocks: DataFrame, touched: DataFrame, keys: list[str]) -> DataFrame:
    """blocks (keys and origin) without the preserved ones of the streams that have been edited: what was kept as it came no longer holds."""
    return blocks.join(touched.select(*keys).distinct().withColumn("_touched", F.lit(True)), keys, "left").where((F.col("origin") != "preserved") | F.col("_touched").isNull()).drop("_touched")


def emitted(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """The blocks (keys, origin, block_type, ordinal) that a stream is written with, and their new ordinal: its preserved ones if there are any, else comments and then cue sheets."""
    w = W.partitionBy(*keys)
    preserved = F.max(F.when(F.col("origin") == "preserved", 1).otherwise(0)).over(w) == 1
    kept = blocks.withColumn("_p", preserved).where((F.col("origin") == "preserved") == F.col("_p"))
    place = F.row_number().over(w.orderBy(F.when(F.col("_p"), F.lit(0)).otherwise(F.col("block_type")), "ordinal"))
    return kept.withColumn("ordinal", big(place - 1)).drop("_p")


def with_private(chunks: DataFrame, keys: list[str], private: str = "fxmd") -> DataFrame:
    """chunks (keys, chunk) that count: a stream's others only if it has no private bundle."""
    bundle = F.max((F.col("chunk") == private).cast("int")).over(W.partitionBy(*keys))
    return chunks.withColumn("_b", bundle).where((F.col("_b") == 0) | (F.col("chunk") == private)).drop("_b")


def with_mask(comments: DataFrame, masks: DataFrame, keys: list[str]) -> DataFrame:
    """comments with the streams' masks (keys, channels, mask) in the place of those that are there. A usual mask, and a null one, isn't stored."""
    usual = F.lit(None).cast("bigint")
    for channels, mask in CHANNEL_MASKS.items():
        usual = F.when(F.col("channels") == channels, F.lit(mask).cast("bigint")).otherwise(usual)
    stored = masks.where(F.col("mask").isNotNull() & ~F.col("mask").eqNullSafe(usual))
    kept = comments.join(masks.select(*keys).distinct().withColumn("_set", F.lit(True)), keys, "left").where((F.upper("key") != MASK_KEY) | F.col("_set").isNull()).drop("_set")
    rows = stored.select(*keys, F.lit(0).cast("bigint").alias("pos"), F.lit(MASK_KEY).alias("key"), mask_text(F.col("mask")).alias("value"))
    return appended(kept, rows, keys)


def with_cues(points: DataFrame, given: DataFrame, totals: DataFrame, streams: DataFrame, keys: list[str]) -> DataFrame:
    """points with those of the streams (keys) replaced by the given ones, normalised as cues() does; a stream without given ones loses its own."""
    return points.join(streams.select(*keys).distinct(), keys, "left_anti").unionByName(cues(given, totals, keys).select(points.columns))


def grouped(comments: DataFrame, keys: list[str]) -> DataFrame:
    """keys, key and values: a stream's values of a key, in their order."""
    rows = F.sort_array(F.collect_list(F.struct("pos", "value")))
    return comments.groupBy(*keys, "key").agg(F.transform(rows, lambda r: r["value"]).alias("values"))


def joined(comments: DataFrame, keys: list[str], sep: str = ",") -> DataFrame:
    """keys, key and value: repeats joined by sep, in their order; nulls are left out, and a key with nothing else has a null value."""
    any_value = F.exists("values", lambda v: v.isNotNull())
    return grouped(comments, keys).select(*keys, "key", F.when(any_value, F.array_join("values", sep)).alias("value"))


def cues(points: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct cue points (sample_offset) within the stream's total, and pos in order; a stream with over 99 has none."""
    kept = points.join(totals, keys).where(F.col("sample_offset") < F.col("total")).select(*keys, "sample_offset").distinct()
    w = W.partitionBy(*keys)
    return kept.withColumn("n", F.count("*").over(w)).where(F.col("n") <= MOST_CUES).withColumn("pos", big(F.row_number().over(w.orderBy("sample_offset")) - 1)).select(*keys, "pos", "sample_offset")


def cue_points(tracks: DataFrame, indexes: DataFrame, keys: list[str]) -> DataFrame:
    """tracks (keys, track, offset) and indexes (keys, track, number, offset): each track's offset plus that of its index 1, once each, in the order of first occurrence (pos)."""
    first = indexes.where("number = 1").select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("track").alias("_track"), F.col("offset").alias("index_offset"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]  # a null key is a stream like any other
    points = tracks.join(first, [*same, F.col("track") == F.col("_track")], "left").withColumn("sample_offset", F.col("offset") + F.coalesce("index_offset", F.lit(0)))
    once = points.groupBy(*keys, "sample_offset").agg(F.min("track").alias("track"))
    return once.select(*keys, big(F.row_number().over(W.partitionBy(*keys).orderBy("track")) - 1).alias("pos"), "sample_offset")


def dictionary(blobs: DataFrame, keys: list[str], blob: str = "blob") -> DataFrame:
    """blobs (keys, ordinal, blob) with index: equal blobs share one, numbered by first ordinal."""
    w = W.partitionBy(*keys, blob)
    first = blobs.withColumn("first", F.min("ordinal").over(w))
    return first.withColumn("index", big(F.dense_rank().over(W.partitionBy(*keys).orderBy("first")) - 1)).drop("first")


def seek_frames(frames: DataFrame, most: int = MOST_SEEK_POINTS) -> DataFrame:
    """frames (stream keys and count) with slot and frame: all frames, or most of them evenly spread."""
    n = F.least(F.col("count"), F.lit(most).cast("bigint"))
    rows = frames.withColumn("points", n).where("points > 0").withColumn("slot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("points") - 1)))
    spread = F.expr("slot * (count - 1) div greatest(points - 1, 1)")
    return rows.withColumn("frame", F.when(F.col("points") == F.col("count"), F.col("slot")).otherwise(spread))


def offsets(frames: DataFrame, keys: list[str], size: str = "frame_size") -> DataFrame:
    """frames with frame_offset, the bytes of the frames before."""
    w = W.partitionBy(*keys).orderBy("frame").rowsBetween(W.unboundedPreceding, -1)
    return frames.withColumn("frame_offset", F.coalesce(F.sum(size).over(w), F.lit(0)).cast("bigint"))


def seek_faults(points: DataFrame, keys: list[str], placeholder: int = (1 << 63) - 1) -> DataFrame:
    """points (keys, pos, sample_number) with fault: not ascending, or a point after a placeholder."""
    before = F.lag("sample_number").over(W.partitionBy(*keys).orderBy("pos"))
    fault = F.when((before == placeholder) & (F.col("sample_number") != placeholder), "after placeholder").when((F.col("sample_number") != placeholder) & (F.col("sample_number") <= before), "not ascending")
    return points.withColumn("fault", fault)
