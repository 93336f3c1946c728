"""The operators' queries with production parameters: each reads its whole table and returns its full result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    bpe_codec, itq_dedup, license_scan, packing, phrase_mining, quality_lines, secret_crf, simhash_trie, source_mixing, substring_dedup, token_counts, toxicity_zstd, turn_repair,
)
from .common import documents
from .oracles import ORACLES


def op1_itq_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq_dedup.near_groups(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op2_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_trie.near_groups(documents(spark, sf_dir))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.without_repeats(documents(spark, sf_dir))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scanned(license_scan.as_files(documents(spark, sf_dir)))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.mixed(documents(spark, sf_dir))


def op6_secret_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_crf.scanned(documents(spark, sf_dir))


def op7_quality_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_lines.scores(documents(spark, sf_dir))


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.encoded(documents(spark, sf_dir), with_ids=False)


def op9_toxicity_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_zstd.scored(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counted(documents(spark, sf_dir))


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repaired(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir))


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_mining.collocations(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_itq_dedup": op1_itq_dedup,
        "op2_simhash_trie": op2_simhash_trie,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_license_scan": op4_license_scan,
        "op5_source_mixing": op5_source_mixing,
        "op6_secret_crf": op6_secret_crf,
        "op7_quality_lines": op7_quality_lines,
        "op8_bpe_codec": op8_bpe_codec,
        "op9_toxicity_zstd": op9_toxicity_zstd,
        "op10_token_counts": op10_token_counts,
        "op11_turn_repair": op11_turn_repair,
        "op12_packing": op12_packing,
        "op13_phrase_mining": op13_phrase_mining,
    }


def oracle_sql() -> dict[str, str]:
    return ORACLES | {"op13_phrase_mining": phrase_mining.ORACLE_SQL}
