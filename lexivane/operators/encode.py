"""Documents as sequences of word ids, and back."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexivane.functions.text import tokens
from lexivane.operators.lookup import as_lists, exchanged
from lexivane.operators.vocab import exploded


def word_ids(docs: DataFrame, vocab: DataFrame, id_col: str = "doc_id", text: Column | str = "text") -> DataFrame:
    """``<id_col>, pos, word_id``: a row to each token."""
    return exploded(docs, id_col, text).join(vocab, "word").select(id_col, "pos", "word_id")


def _squares(vector: Column | str) -> Column:
    """The sum of a vector's squares as a bigint, null where that is too small for it."""
    return F.aggregate(vector, F.lit(0).cast("bigint"), lambda s, x: F.try_add(s, F.try_multiply(x, x)))


def norm2(vector: Column | str) -> Column:
    """The sum of a vector's squares as a double: the one nearest the exact sum where a bigint holds that, so that no id is too large."""
    rough = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    return F.coalesce(_squares(vector).cast("double"), rough)


def lengths(encoded: DataFrame, id_col: str = "doc_id", vector: str = "encoded_data") -> DataFrame:
    """``<id_col>, n, norm2``: how many ids each vector has and the exact sum of their squares; one that no bigint holds is an error."""
    exact = F.coalesce(_squares(vector), F.raise_error(F.lit("a sum of squares is too large for a bigint")).cast("bigint"))
    return encoded.select(id_col, F.size(vector).cast("bigint").alias("n"), exact.alias("norm2"))


def _square_sums(ids: np.ndarray, counts: np.ndarray) -> list[float]:
    """The sum of squares of each run of ids, rounded once."""
    ends = np.cumsum(counts)
    if not len(ids) or ids.max() < 1 << 31 and ids.min() >= 0:
        squares = ids * ids
        high, low = (np.concatenate([[0], np.cumsum(x)]) for x in (squares >> 32, squares & 0xFFFFFFFF))
        high, low = high[ends] - high[ends - counts], low[ends] - low[ends - counts]
        return [float((h << 32) + x) for h, x in zip(high.tolist(), low.tolist(), strict=True)]
    return [float(sum(x * x for x in ids[e - n : e].tolist())) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]


def vectors(docs: DataFrame, vocab: DataFrame, id_col: str = "doc_id", text: Column | str = "text") -> DataFrame:
    """``<id_col>, encoded_data, norm2``: each document's word ids in text order and the sum of their squares; empty texts have no ids and 0.

    The sum is a double, the one nearest the exact sum, so that no id is too large for it.
    """

    def finish(ids: pa.Array, counts: np.ndarray) -> dict[str, pa.Array]:
        if ids.null_count:  # words that the dictionary lacks
            row = np.repeat(np.arange(len(counts)), counts)[ids.is_valid().to_numpy(zero_copy_only=False)]
            ids, counts = ids.drop_null(), np.bincount(row, minlength=len(counts))
        return {"encoded_data": as_lists(ids, counts), "norm2": pa.array(_square_sums(ids.to_numpy(zero_copy_only=False), counts), pa.float64())}

    words = docs.select(id_col, tokens(F.col(text) if isinstance(text, str) else text).alias("encoded_data"))
    out = [T.StructField("encoded_data", T.ArrayType(T.LongType())), T.StructField("norm2", T.DoubleType())]
    return exchanged(words, id_col, "encoded_data", vocab, "word", "word_id", finish, out, early=True)


def decode(encoded: DataFrame, vocab: DataFrame, id_col: str = "doc_id", vector: str = "encoded_data") -> DataFrame:
    """``<id_col>, text``: the words of each vector, a blank between them; an id that no word has reads as nothing."""

    def finish(words: pa.Array, counts: np.ndarray) -> dict[str, pa.Array]:
        return {"text": pc.binary_join(as_lists(pc.fill_null(words, ""), counts), " ")}

    return exchanged(encoded.select(id_col, vector), id_col, vector, vocab, "word_id", "word", finish, [T.StructField("text", T.StringType())], early=False)
