"""Tables written once so that later steps agree on them."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lexivane.sources.storage import Folder


@dataclass
class Written:
    """A table in a scratch folder, to be dropped after use."""

    df: DataFrame
    folder: Folder
    name: str

    def drop(self) -> None:
        self.folder.delete(self.name)


def written(spark: SparkSession, df: DataFrame, path: str) -> Written:
    """Writes ``df`` below ``path`` and reads it back: rows and ids made there no longer depend on how they were made."""
    name = f"_scratch/{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{name}")
    return Written(spark.read.schema(df.schema).parquet(f"{path}/{name}"), Folder(spark, path), name)
