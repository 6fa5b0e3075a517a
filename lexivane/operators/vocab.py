"""The dictionary: word ids by first occurrence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexivane.functions.text import tokens

#: Places that a document may have, in a packed (document, place): as many as an array holds.
_PLACES = 1 << 31
#: Documents to a chunk, within which ids are counted by themselves.
_CHUNK = 1 << 12


def exploded(docs: DataFrame, id_col: str = "doc_id", text: Column | str = "text") -> DataFrame:
    """``<id_col>, pos, word``: a row to each token, places from 0."""
    text = F.col(text) if isinstance(text, str) else text
    return docs.select(F.col(id_col), F.posexplode(tokens(text)).alias("pos", "word")).withColumn("pos", F.col("pos").cast("bigint"))


def first_places(words: DataFrame, ord_col: str = "doc_id") -> DataFrame:
    """``word, first``: where each word first occurs, document and place packed into one number.

    Combines before the shuffle, so a frequent word costs no more than a rare one. The number is a decimal that holds any
    whole number of a document with any place in it, and still one that hash aggregation updates in place.
    """
    at = (F.col(ord_col).cast("decimal(19,0)") * F.lit(_PLACES).cast("decimal(10,0)") + F.col("pos")).cast("decimal(32,0)")
    return words.groupBy("word").agg(F.min(at).alias("first"))


def numbered(first: DataFrame, after: int = 0) -> DataFrame:
    """``word, word_id``: ids from ``after + 1`` on in the order of ``first``.

    Words are counted within chunks of documents side by side; only the chunks' totals come together in one task.
    """
    first = first.withColumn("chunk", F.expr(f"first div {_PLACES * _CHUNK}"))
    before = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = first.groupBy("chunk").agg(F.count("*").alias("n")).select("chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("chunk").orderBy("first", "word"))
    return first.withColumn("n", within).join(base, "chunk").select("word", (F.lit(after) + F.col("base") + F.col("n")).cast("bigint").alias("word_id"))


def build(docs: DataFrame, id_col: str = "doc_id", text: Column | str = "text") -> DataFrame:
    """The dictionary of documents taken in the order of ``id_col``: ids 1 to V without gaps."""
    return numbered(first_places(exploded(docs, id_col, text), id_col))


def largest(vocab: DataFrame) -> int:
    """The highest id given so far, 0 for none."""
    return vocab.agg(F.coalesce(F.max("word_id"), F.lit(0))).first()[0]


def extend(vocab: DataFrame, docs: DataFrame, id_col: str = "doc_id", text: Column | str = "text", after: int | None = None) -> DataFrame:
    """Ids of the words that ``vocab`` lacks, on from its highest; ids once given never change."""
    new = first_places(exploded(docs, id_col, text), id_col).join(vocab.select("word"), "word", "left_anti")
    return numbered(new, largest(vocab) if after is None else after)
