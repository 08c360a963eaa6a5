"""The operators applied to whole tables; the columns are those of the queries' contracts. ORACLES has SQL for some."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from siltstream.llm.alignment import align_documents
from siltstream.llm.conversations import repair_damaged
from siltstream.llm.decontaminate import decontaminate
from siltstream.llm.licenses import scan_licenses
from siltstream.llm.mixing import mix
from siltstream.llm.oracles import ORACLES
from siltstream.llm.packing import pack
from siltstream.llm.quality import quality_rules
from siltstream.llm.rlz import remove_repeated_passages
from siltstream.llm.sharding import reshard
from siltstream.llm.simhash import simhash_components
from siltstream.llm.suffix_dedup import remove_repeated_bytes
from siltstream.llm.suffix_tree import score_documents
from siltstream.llm.warc import archive_round_trip

__all__ = ["ORACLES", "QUERIES"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_warc_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(read(spark, sf_dir, "pages"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(read(spark, sf_dir, "documents"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(read(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshard(read(spark, sf_dir, "documents"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_passages(read(spark, sf_dir, "documents"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_damaged(read(spark, sf_dir, "conversations"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_warc_capture_index, op2_benchmark_decontamination, op3_lm_scoring, op4_quality_rules, op5_license_scan,
        op6_suffix_dedup, op7_simhash_near_dedup, op8_sharding, op9_source_mixing, op10_substring_dedup,
        op11_packing, op12_conversation_repair, op13_tokenizer_alignment,
    )
}
