"""The corpus pipeline: rules, near-duplicates, secrets, mixing and encoding, each stage written and read again.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.

Rows without a text, an id or a source go through like any other; texts that the rules reject, empty ones among them, go. Empty
tables stay empty. Stages are written to a folder of their own, which goes when this Python ends.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from veilwork.llm import bpe, mixing, near_copies, quality_rules, secret_scan
from veilwork.llm._common import passing, shared_dir, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality_rules.keep_good(docs)


def single(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (Jaccard similarity of five-word shingles 0.8 at least) the document with the least id stays."""
    return near_copies.keep_one(docs)


def safe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    return secret_scan.redacted(docs)


def balanced(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in the order of the mix."""
    return mixing.mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text, a row for each copy in the mix."""
    return bpe.encoded(docs, bpe.vocabulary())


STAGES = [("quality rules", good), ("SimHash near-dedup", single), ("secret scans", safe), ("mixing", balanced), ("BPE", encoded)]
#: SQL cannot express shingles, the network's spans and merges; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents."""
    docs = table(spark, sf_dir, "documents")
    folder = passing(spark, f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}")
    return docs
