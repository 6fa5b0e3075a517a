"""Lists of keys exchanged for values of a dictionary that is too large to send whole."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexivane.functions.batches import slices, small_batches

#: Words, those of the lowest ids, that go to every executor. Frequent words occur early, so that most tokens are among them.
COMMON = 1 << 17
_KEY, _ROW, _AT, _VALUE, _FOUND = "_lv_key", "_lv_row", "_lv_at", "_lv_value", "_lv_found"


def _parts(col: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """A list column's elements, and how many each row has."""
    return col.flatten(), pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def as_lists(flat: pa.Array, counts: np.ndarray) -> pa.ListArray:
    """A list column: ``counts[i]`` of ``flat`` go to row i."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), flat)


def _found(col: pa.ListArray, need: np.ndarray) -> pa.Array:
    """The values for what rows lack, in order. Repeated rows share what was found, so each value may come several times."""
    flat, have = _parts(col)
    if not np.array_equal(have, need):
        times = np.where(need > 0, have // np.maximum(need, 1), 1)
        if not np.array_equal(times * need, have) or (times < 1).any():
            raise RuntimeError("different rows of one id can't be told apart")
        at = np.arange(len(flat)) - np.repeat(np.cumsum(have) - have, have)
        flat = flat.filter(pa.array(at % np.repeat(times, have) == 0))
    return flat.field(_VALUE)


def exchanged(
    lists: DataFrame, id_col: str, keys: str, vocab: DataFrame, key: str, value: str, finish: Callable[[pa.Array, np.ndarray], dict[str, pa.Array]], out: list[T.StructField], early: bool
) -> DataFrame:
    """``<id_col>`` and the columns ``out``, which ``finish`` makes of the values (null for a key without one) and the lengths of lists.

    Values of the COMMON words are looked up in Python, in a table of a fixed size; only the other elements are shuffled and joined,
    and come back to their lists by row and place. ``early`` says to do the first before lists are shuffled: where values take less room than keys.
    """
    spark = lists.sparkSession
    small_batches(spark)
    common = F.col("word_id").between(1, COMMON)
    known = vocab.where(common).select(key, value).toArrow().combine_chunks()
    shared = spark.sparkContext.broadcast(tuple(known.column(c).combine_chunks() for c in (key, value)))
    kinds = {f.name: f.dataType for f in vocab.schema.fields}
    id_kind = lists.schema[id_col].dataType
    # a row goes by its id, which a null has too so that joins needn't care, and by a hash of the rest
    lists = lists.select(id_col, F.coalesce(id_col, F.lit("0").cast(id_kind)).alias(_KEY), F.hash(F.col(id_col).isNull(), keys).alias(_ROW), keys)

    def look(flat: pa.Array) -> pa.Array:
        have, give = shared.value
        return give.take(pc.index_in(flat, value_set=have.cast(flat.type)))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for whole in batches for s in slices(whole, 4 << 20)):
            flat, counts = _parts(b.column(3))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], as_lists(look(flat), counts)], [id_col, _KEY, _ROW, keys])

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for whole in batches for s in slices(whole, 4 << 20)):
            flat, counts = _parts(b.column(2))
            lacks = look(flat).is_null()
            row = np.repeat(np.arange(b.num_rows), counts)[lacks.to_numpy(zero_copy_only=False)]
            need = np.bincount(row, minlength=b.num_rows)
            at = np.arange(len(row)) - (np.cumsum(need) - need)[row]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array(at, pa.int32()), flat.filter(lacks)], [_KEY, _ROW, _AT, key])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for whole in batches for s in slices(whole, 4 << 20)):
            flat, counts = _parts(b.column(1))
            flat = flat if early else look(flat)
            lacks = flat.is_null()
            row = np.repeat(np.arange(b.num_rows), counts)[lacks.to_numpy(zero_copy_only=False)]
            found = _found(b.column(2), np.bincount(row, minlength=b.num_rows))
            made = finish(pc.replace_with_mask(flat, lacks, found.cast(flat.type)), counts)
            yield pa.RecordBatch.from_arrays([b.column(0), *made.values()], [id_col, *made])

    id_field, key_field, row_field = (lists.schema[c] for c in (id_col, _KEY, _ROW))
    whole = lists.mapInArrow(first, T.StructType([id_field, key_field, row_field, T.StructField(keys, T.ArrayType(kinds[value]))])) if early else lists
    rare = lists.select(_KEY, _ROW, keys).mapInArrow(rest, T.StructType([key_field, row_field, T.StructField(_AT, T.IntegerType()), T.StructField(key, kinds[key])]))
    got = rare.join(vocab.where(~common).select(key, F.col(value).alias(_VALUE)), key, "left").select(_KEY, _ROW, F.struct(_AT, _VALUE).alias(_FOUND))
    # shuffled as rows: lists of the few elements of a row in a part take more room
    got = got.repartition(_KEY, _ROW).groupBy(_KEY, _ROW).agg(F.sort_array(F.collect_list(_FOUND)).alias(_FOUND))
    return whole.join(got, [_KEY, _ROW], "left").select(id_col, keys, _FOUND).mapInArrow(fill, T.StructType([id_field, *out]))
