"""From documents to token ids: quality rules, near copies, benchmark leaks, secrets, tokens. Each stage reads what the one before wrote.

Every stage judges rows by their own text. Null and empty texts fail the quality rules; a null doc_id goes through all stages; different texts of one
doc_id are different documents, and equal rows count once from the second stage on; empty tables give empty results; further columns
of documents are kept up to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from netglean.llm import bpe, decontaminate, jaccard_join, quality_rules, secret_scan
from netglean.llm.shared import forget, save, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality_rules.keep(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that shares four fifths of its five-word shingles, link by link, the document of the least doc_id stays."""
    return jaccard_join.one_of_each(docs, k=5, num=80, den=100)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are blanked out."""
    return secret_scan.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and hashes that let them be verified."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), with_ids=True)


STAGES = [("quality_rules", quality), ("ngram_jaccard_join", near_copies), ("benchmark_decontamination", leaks), ("secret_scan", secrets), ("byte_bpe", tokens)]

#: Similarity joins, alignment and tokens have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
        if last is not None:
            forget(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
