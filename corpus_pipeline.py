"""A corpus from raw documents to token counts, as five stages.

Each stage takes (spark, docs, sf_dir), docs being what the stage before it kept, and
returns a DataFrame; all but the last return the columns of documents. Results are
written as Parquet and read again between stages.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers
from answerloom.llm import byte_bpe, decontaminate, line_dedup, near_copies, quality_rules
from answerloom.session import settle


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.good_documents(docs)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that ten or more of them share."""
    return line_dedup.without_lines(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_copies.without_copies(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of each document's token ids, and of the text decoded from them."""
    return byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", good_quality),
    ("line_dedup", fresh_lines),
    ("minhash_near_dedup", one_of_each),
    ("benchmark_decontamination", clean_of_benchmark),
    ("byte_bpe", tokens),
]

# Robust covariance estimates and byte-pair merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
