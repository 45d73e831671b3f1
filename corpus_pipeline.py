"""Corpus preparation from the operators of wavegrid.llm: each stage works on all documents that the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wavegrid.llm import bpe, decontaminate, quality, simhash, substring_dedup
from wavegrid.llm.common import stored


#: The columns that stages use; others are set aside, as an operator replaces columns that are named like its results.
OWN = ("doc_id", "text", "lang", "n_chars")


def _aside(docs: DataFrame) -> DataFrame:
    """docs with names for its other columns that no operator uses."""
    return docs.toDF(*[c if c in OWN else f"aside_{k}" for k, c in enumerate(docs.columns)])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within their language's threshold."""
    rows = _aside(docs)
    return quality.classify(rows, quality.trusted_labels(spark, sf_dir)).where("accepted").select(rows.columns).toDF(*docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more."""
    return simhash.keep_one(_aside(docs)).toDF(*docs.columns)


def _with_text(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.withColumn("text", F.col("clean_text")).withColumn("n_chars", F.length("clean_text").cast("long")).select(columns)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without words of 13-word windows that an earlier document has; a document may keep none."""
    rows = _aside(docs)
    return _with_text(substring_dedup.dedup_substrings(rows), rows.columns).toDF(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the benchmark's windows."""
    rows = _aside(docs)
    return _with_text(decontaminate.decontaminate(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), with_clean_text=True), rows.columns).toDF(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and what they decode to."""
    return bpe.decode(bpe.encode(docs.select("doc_id", "text", "lang", "source"))).select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_dedup", simhash_dedup),
    ("substring_dedup", substrings),
    ("decontamination", decontamination),
    ("bpe_encoding", encoding),
]

#: Perplexities, XXH64 fingerprints and byte-pair encodings can't be written in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
