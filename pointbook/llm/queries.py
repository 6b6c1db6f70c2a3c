"""The registered queries ``opN_<name>``: each operator over its whole tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, hard_negatives, lm_scoring, quality_knn, quality_rules, secret_scan, sharding, simhash, suffix_dedup, token_counts, toxicity, whitening
from .common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes without the 50-byte strings that a document with a smaller id holds."""
    return suffix_dedup.report(table(spark, sf_dir, "documents"), 50)


@query
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text encoded to ids and decoded again; counts and digests of both."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = bpe.decode(bpe.encode(docs, RANKS, keep=["doc_id"]), RANKS, keep=["doc_id", "ids"])
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard by jump consistent hashing of its doc_id, and its slot in the shard."""
    return sharding.shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), 24)


@query
def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's loss under bigram models of the good documents and of all, and their difference."""
    return lm_scoring.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words that lie in a 10-word window of a benchmark item."""
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


@query
def op6_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality by similarity-weighted votes of labelled neighbours in a latent space."""
    return quality_knn.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets: the base forms, and context values of high guess cost."""
    return secret_scan.report(table(spark, sf_dir, "documents"))


@query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's 64-bit SimHash of 3-word shingles, and its component at 2 or fewer differing bits."""
    return simhash.report(table(spark, sf_dir, "documents"), width=3, distance=2)


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's exact token count, from its words' tables of counts at all prefixes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"))
    counted = token_counts.totals(docs, WORD_VOCABULARY, keep=["doc_id", "n_bytes"])
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts, the base rule, and the verdict by the fences of its language and source."""
    return quality_rules.report(table(spark, sf_dir, "documents"))


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every anchor's hard negatives: for each of 5 positives the first 3 rows of other labels at 50 to 95 percent of its score."""
    return hard_negatives.report(table(spark, sf_dir, "embeddings"))


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding whitened along the 4 leading components of the covariance of the distinct vectors."""
    return whitening.report(table(spark, sf_dir, "embeddings"))


@query
def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity: lexicon terms found through misspellings, weighed by their context."""
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
