"""Documents that keep coming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lexivane.plans.engine import Engine


def ingest_stream(engine: Engine, rows: DataFrame, name: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Inserts each micro-batch of ``rows`` (``title, content, url``) into a table, in turn.

    Batches come one after another, so word ids go by batch, row and place. A batch that is run again after
    a failure overwrites its rows and its words, so nothing is there twice.
    """
    if engine.catalog.get(name) is None:
        engine.create_table(name)

    def each(batch: DataFrame, n: int) -> None:
        part = f"batch-{n:012d}"
        for written in (f"{name}/rows/{part}", f"_dictionary/{name}-{part}"):
            engine.catalog.folder.delete(written)
        if not batch.isEmpty():
            engine.insert(name, batch, batch=part)

    writer = rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
