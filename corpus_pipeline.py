"""A pipeline from raw documents to token ids. Every stage reads what the one before it kept and
is written as Parquet; all but the last keep the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlens.llm import bpe, decontamination, near_dups, quality, secret_scan
from meterlens.llm.common import free_name, hex_digest, stored
from meterlens.sources.scratch import scratch_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail or are probably bad go."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that with the smallest doc_id."""
    return near_dups.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold passages of the benchmark go."""
    tests = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.remove_contaminated(docs, tests)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; n_chars follows. All documents stay."""
    return secret_scan.mask_secrets(docs, scratch_dir(spark, "ledger"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as token ids: all columns but the text, then n_tokens, ids_sha256 (of the
    decimal ids joined by one space) and token_ids."""
    ids = free_name("token_ids", docs)
    rest = [c for c in docs.columns if c != "text"]
    joined = F.array_join(F.col(ids).cast("array<string>"), " ")
    return bpe.encode(docs, into=ids).select(
        *rest,
        F.size(ids).cast("long").alias(free_name("n_tokens", docs)),
        hex_digest(joined).alias(free_name("ids_sha256", docs)),
        ids,
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("secret_scans", secret_scans),
    ("tokens", tokens),
]

#: Weights by expectation-maximisation and a tokenizer are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
