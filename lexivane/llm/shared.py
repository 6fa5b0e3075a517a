"""Session plumbing the operators share: durable tables, row keys, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table, in estimated bytes, that an operator ships whole to every executor.
BROADCAST_BYTES = 32 << 20
#: Bytes to an Arrow batch, and the setting that says so.
BATCH_BYTES, _BATCH = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, from ``spark.checkpoint.dir``.

    Where that is unset a session of one process, as in tests, takes a temporary folder; a cluster's is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="lexivane-")
        _own[spark.sparkContext.applicationId] = base
    return base.rstrip("/")


def durable(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes ``df`` as Parquet to the shared folder and reads it back.

    The copy outlives lost executors, unlike cached blocks and shuffle files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexivane/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lv_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder from whatever file system it is on."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def forget(*tables: DataFrame) -> None:
    """Deletes tables of ``durable`` that nothing reads any more: all that came of them is written."""
    for t in tables:
        delete(t.sparkSession, t._lv_path)


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df``, marked for broadcast if its rows, counted, stay within BROADCAST_BYTES; else as it is, to be joined by a shuffle."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def small_batches(spark: SparkSession) -> None:
    """For programs, not operators: keeps the session's Arrow batches to BATCH_BYTES unless they are set.

    Operators cut the batches they get, so they work with any; smaller ones take less of an executor's memory.
    """
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, BATCH_BYTES)


def row_key(id_col: str, text_col: str) -> Column:
    """64-bit identity of a document: its id and text.

    Repeated rows share a key; rows with one id but different texts don't. Rows without an id go by their text.
    """
    return F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))


def resized(docs: DataFrame, text_col: str, size_col: str | None) -> DataFrame:
    """``docs`` with the characters of the text in ``size_col``, if one is named."""
    return docs if size_col is None else docs.withColumn(size_col, F.length(text_col).cast("bigint"))


def once(keyed: DataFrame) -> DataFrame:
    """``keyed`` with one row of each ``key``. Only rows whose key is repeated are moved, and combined before that; usually there are none."""
    again = durable(keyed.groupBy("key").count().where("count > 1").select(F.col("key").alias("in_key")), "again")
    if again.isEmpty():
        return keyed
    again, same = small(again, 16), F.col("key") == F.col("in_key")
    return keyed.join(again, same, "left_anti").unionByName(keyed.join(again, same, "left_semi").dropDuplicates(["key"]))


def slices(batch: pa.RecordBatch, text: int, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows of about ``max_bytes`` of text, one row at least, so that arrays stay in cache."""
    if not batch.num_rows:
        return
    size = np.frombuffer(batch.column(text).buffers()[1], _offset_type(batch.column(text)), batch.num_rows + 1, _offset_at(batch.column(text))).astype(np.int64)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, size[at] + max_bytes, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def _offset_type(col: pa.Array):
    return np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32


def _offset_at(col: pa.Array) -> int:
    return col.offset * np.dtype(_offset_type(col)).itemsize


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the n + 1 offsets of its rows; a null is empty."""
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    buffers = col.buffers()
    off = np.frombuffer(buffers[1], _offset_type(col), len(col) + 1, _offset_at(col)).astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[off[0] : off[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def ragged(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column: ``counts[i]`` of ``values`` go to row i."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def binaries(data: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary column: ``counts[i]`` of the bytes of ``data`` go to row i."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def runs(batches: Iterator[pa.RecordBatch], key: int = 0, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Recuts a stream sorted by its column ``key`` so that no run of equal keys is parted; about ``rows`` rows at a time."""
    held: list[pa.RecordBatch] = []
    count = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        count += b.num_rows
        if count < rows or held[0].column(key)[0] == b.column(key)[-1]:
            continue
        joined = pa.concat_batches(held)
        k = joined.column(key).to_numpy(zero_copy_only=False)
        cut = len(k) - int(np.argmax(k[::-1] != k[-1]))
        yield joined.slice(0, cut)
        held, count = [joined.slice(cut)], len(k) - cut
    if held:
        yield pa.concat_batches(held)
