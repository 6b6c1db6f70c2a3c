"""The corpus pipeline: quality rules, near-duplicates, benchmark text, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's documents. All stages but the last
return the columns of the documents they get.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointbook.llm import bpe, decontaminate, quality_rules, secret_scan, simhash
from pointbook.llm.common import table, written

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive quality rules keep."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose SimHash fingerprints (3-word shingles) link at 2 or fewer bits."""
    return simhash.keep_first(docs, width=3, distance=2)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no 10-word window of a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), 10, mode="documents")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced by a mark."""
    return secret_scan.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text (packed little-endian unsigned 32-bit), their byte offsets, and their number.

    Each text is decoded again from its ids; ``round_trip`` tells that the bytes are the same.
    """
    packed = docs.select("doc_id", "text", "lang", "source")
    decoded = bpe.recode(packed, RANKS)
    same = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return decoded.select("doc_id", "lang", "source", "ids", "offsets", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), same.alias("round_trip"))


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark),
    ("secret_scans", secrets),
    ("byte_level_bpe", tokens),
]

# Sketched quartiles, SimHash components and merges have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
