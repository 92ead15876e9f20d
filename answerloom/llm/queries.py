"""The registered queries of this subpackage: name to (query, SQL or None)."""

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers
from answerloom.llm import (
    byte_bpe, decontaminate, fill_in_middle, license_scan, line_dedup, mixing, near_copies, passages, prefix_trie,
    quality_rules, secret_scan, url_rules, warc,
)
from answerloom.llm import queries_sql as sql


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def benchmark_windows(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def repeated_lines(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.line_report(_table(spark, folder, "documents"))


def near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_copies.near_copies(_table(spark, folder, "documents"))


def byte_pairs(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.round_trip(_table(spark, folder, "documents"), path, public_tokenizers.PATTERN)


def quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.quality_report(_table(spark, folder, "documents"))


def archive_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(_table(spark, folder, "pages"))


def licenses(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan_licenses(_table(spark, folder, "documents"))


def repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    return passages.passage_spans(_table(spark, folder, "documents")).drop("mark")


def urls(spark: SparkSession, folder: str) -> DataFrame:
    pages = _table(spark, folder, "pages")
    return url_rules.judge(pages, url_rules.listed_labels(pages))


def secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.scan_secrets(_table(spark, folder, "documents"))


def mixed_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixing_report(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def middles(spark: SparkSession, folder: str) -> DataFrame:
    return fill_in_middle.middle_report(_table(spark, folder, "documents"))


def conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.trie_report(_table(spark, folder, "conversations"))


QUERIES = {
    "op1_warc": (archive_round_trip, sql.ARCHIVES),
    "op2_license_scan": (licenses, sql.LICENSES),
    "op3_benchmark_decontamination": (benchmark_windows, sql.BENCHMARK_WINDOWS),
    "op4_passage_dedup": (repeated_passages, None),
    "op5_line_dedup": (repeated_lines, sql.REPEATED_LINES),
    "op6_url_rules": (urls, None),
    "op7_secret_scan": (secrets, None),
    "op8_minhash_near_dedup": (near_duplicates, sql.NEAR_DUPLICATES),
    "op9_byte_bpe": (byte_pairs, None),
    "op10_quality_rules": (quality, None),
    "op11_source_mixing": (mixed_sources, sql.MIXED_SOURCES),
    "op12_fill_in_middle": (middles, sql.MIDDLES),
    "op13_prefix_trie": (conversation_trie, sql.CONVERSATION_TRIE),
}
