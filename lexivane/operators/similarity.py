"""Cosine of word-id sequences, place by place, and ranking."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivane.errors import RowError
from lexivane.functions.text import STOPWORDS, drop_stopwords, tokens


def query_words(spark, text: str | None, stopwords: Sequence[str] = STOPWORDS) -> list[str]:
    """The words of a query: stop words out, case and all, then tokens as of any text."""
    one = spark.range(1).select(tokens(drop_stopwords(F.lit(text), stopwords)).alias("w"))
    return one.first()[0]


def query_ids(words: list[str], vocab: DataFrame) -> tuple[list[int], list[tuple[str, int]]]:
    """The words' ids, and of those new to the dictionary the ids on from its highest, in order."""
    if not words:
        return [], []
    asked = F.when(F.col("word").isin(*set(words)), F.struct("word", "word_id"))
    found, after = vocab.agg(F.collect_list(asked), F.coalesce(F.max("word_id"), F.lit(0))).first()
    known = {r["word"]: r["word_id"] for r in found}
    new: list[tuple[str, int]] = []
    for w in words:
        if w not in known:
            after += 1
            known[w] = after
            new.append((w, after))
    return [known[w] for w in words], new


def cosine(query: list[int], vector: Column, norm2: Column) -> Column:
    """Cosine with a query, the shorter of the two filled up with zeros; 0 if either is empty or missing.

    Places past the query's end add nothing to the product, so only a prefix of each vector is looked at;
    ``norm2`` has the rest. The product is exact where a bigint holds it, and else a sum of doubles, which can't overflow.
    """
    if not query:
        return F.lit(0.0)
    q = F.array(*[F.lit(x).cast("bigint") for x in query])
    prefix, zero = F.slice(vector, 1, len(query)), F.lit(0).cast("bigint")
    exact = F.aggregate(F.zip_with(prefix, q, lambda a, b: F.try_multiply(F.coalesce(a, zero), b)), zero, lambda s, x: F.try_add(s, x))
    rough = F.aggregate(F.zip_with(prefix, q, lambda a, b: F.coalesce(a.cast("double") * b, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    dot = F.coalesce(exact.cast("double"), rough)
    length = F.lit(math.sqrt(sum(x * x for x in query)))
    return F.when(F.coalesce(norm2, F.lit(0)) > 0, dot / (length * F.sqrt(norm2.cast("double")))).otherwise(F.lit(0.0))


def scored(corpus: DataFrame, query: list[int], vector: str = "encoded_data", norm2: str = "norm2") -> DataFrame:
    """``corpus`` with ``score``, to nine places; every row has one, also of zero."""
    return corpus.withColumn("score", F.round(cosine(query, F.col(vector), F.col(norm2)), 9))


def top(ranked: DataFrame, k: int, *ties: str) -> DataFrame:
    """The ``k`` highest scores, equal ones in the order of ``ties``. Partitions keep k rows each; nothing else moves."""
    if k < 0:
        raise RowError("the number of results can't be negative")
    return ranked.orderBy(F.desc("score"), *ties).limit(k)
