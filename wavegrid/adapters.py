"""Driver tables seen as ordered integer sample streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def big(column):
    return F.col(column).cast("bigint") if isinstance(column, str) else column.cast("bigint")


def sig_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, i, x): a stream for each user, in the order of event_id."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    i = F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1
    return e.select("user_id", big(i).alias("i"), (big(F.round(F.col("value") * 100)) - 25000).alias("x"))


def sig_events_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, x): one stream, indexed by event_id."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("i"), (big(F.round(F.col("value") * 100)) - 25000).alias("x"))


def sig_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(status, i, x): order keys stand for positions, so no stream is numbered by one task."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("i"), big(F.round(F.col("o_totalprice") * 100)).alias("x"))


def sig_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, xs): each vector as a block of 16-bit samples."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.transform("embedding", lambda v: big(F.floor(v.cast("double") * 32768))).alias("xs"))


def sig_stereo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, i, l, r): consecutive samples as pairs; an odd last one is dropped."""
    e = sig_events(spark, sf_dir).withColumn("next", F.lead("x").over(W.partitionBy("user_id").orderBy("i")))
    return e.where("i % 2 = 0 and next is not null").select("user_id", F.expr("i div 2").alias("i"), F.col("x").alias("l"), F.col("next").alias("r"))


def blocks(samples: DataFrame, stream: str, size: int, value: str = "x") -> DataFrame:
    """(stream, frame, xs): fixed blocks as arrays. Samples that are dealt by stream aren't shuffled again."""
    frame = F.expr(f"i div {size}").alias("frame")
    row = F.sort_array(F.collect_list(F.struct("i", value)))
    return samples.groupBy(stream, frame).agg(F.transform(row, lambda s: s[value]).alias("xs"))
