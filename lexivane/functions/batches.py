"""Arrow batches of a bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes to a batch that Spark sends to Python, and the setting that says so.
BATCH_BYTES, _BATCH = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Keeps the session's Arrow batches to BATCH_BYTES, unless they are set; else 10,000 rows go at once, however long."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, BATCH_BYTES)


def slices(batch: pa.RecordBatch, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows of about ``max_bytes``, one row at least, whatever the size it came in."""
    rows = max(1, batch.num_rows * max_bytes // max(1, batch.nbytes))
    for at in range(0, batch.num_rows, rows):
        yield from _halves(batch.slice(at, rows), 2 * max_bytes)


def _halves(batch: pa.RecordBatch, max_bytes: int) -> Iterator[pa.RecordBatch]:
    if batch.num_rows < 2 or batch.nbytes <= max_bytes:
        yield batch
        return
    for part in (batch.slice(0, batch.num_rows // 2), batch.slice(batch.num_rows // 2)):
        yield from _halves(part, max_bytes)
