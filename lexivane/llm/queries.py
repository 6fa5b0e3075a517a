"""The queries of this subpackage, one to an operator, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexivane.llm import decontaminate, langid, neardup, packing, quality, secrets, seedextend, suffixdedup, tokenids, toxicity
from lexivane.llm.shared import small_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenids.encode_documents(_table(spark, sf_dir, "documents"))


def op2_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.drop_frequent_lines(_table(spark, sf_dir, "documents"), size_col="n_chars")


def op3_longest_previous_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.drop_later_copies(_table(spark, sf_dir, "documents"), size_col="n_chars")


def op4_related_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_related(_table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(_table(spark, sf_dir, "documents"))


def op7_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_seed_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seedextend.repeats(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    learned = toxicity.learn_lexicon(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, learned=learned)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_simple8b, op2_line_frequency, op3_longest_previous_factor, op4_related_packing, op5_decontaminate, op6_entropy_secrets, op7_byte_cnn, op8_near_duplicates, op9_seed_extend, op10_toxicity)
}
ORACLE_SQL: dict[str, str] = {"op2_line_frequency": quality.ORACLE, "op3_longest_previous_factor": suffixdedup.ORACLE}
