"""The subpackage's queries and SQL, for the driver's contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wavegrid.llm import bpe, decontaminate, media, quality, sharding, simhash, substring_dedup, token_counts, token_file, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_benchmark_decontamination": decontaminate.op1_benchmark_decontamination,
        "op2_token_file": token_file.op2_token_file,
        "op3_warc": warc.op3_warc,
        "op4_media_sniff": media.op4_media_sniff,
        "op5_size_tiered_sharding": sharding.op5_size_tiered_sharding,
        "op6_quality_classifier": quality.op6_quality_classifier,
        "op7_substring_dedup": substring_dedup.op7_substring_dedup,
        "op8_bpe": bpe.op8_bpe,
        "op9_simhash": simhash.op9_simhash,
        "op10_token_counts": token_counts.op10_token_counts,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_benchmark_decontamination": decontaminate.ORACLE_SQL,
        "op3_warc": warc.ORACLE_SQL,
        "op7_substring_dedup": substring_dedup.ORACLE_SQL,
    }
