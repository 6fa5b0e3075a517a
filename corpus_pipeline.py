"""A training corpus from raw documents, in stages."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexivane.llm import decontaminate, neardup, packing, quality, secrets
from lexivane.llm.shared import delete, shared_dir, small_batches


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: lines that too many documents of a host share go, and depleted documents, null and empty texts among them."""
    small_batches(spark)
    return quality.drop_frequent_lines(docs, size_col="n_chars")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: of each group of near duplicates, repeated rows too, one document stays; texts without a word stay."""
    small_batches(spark)
    return neardup.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: passages of benchmark items go, and documents that were nothing else."""
    small_batches(spark)
    return decontaminate.remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), size_col="n_chars")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: secrets are masked; every document stays."""
    small_batches(spark)
    return secrets.redact_secrets(docs, size_col="n_chars")


def related_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: related documents share windows; a document without a token has no place."""
    small_batches(spark)
    return packing.pack_related(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("packing", related_packing),
]

#: SQL can't express the MinHash, automaton and graph stages; tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again, and deleted once the next is written.

    Each stage's handling of nulls, empty and long texts, ties and repeated rows is its operator's. Of an empty table no window comes.
    Columns beside those of documents are carried to the last stage but one; the size of texts, ``n_chars``, is kept up.
    """
    docs, at = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_dir(spark)}/lexivane/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{i}")
        docs = spark.read.parquet(f"{at}/{i}")
        if i:
            delete(spark, f"{at}/{i - 1}")
    return docs
