"""Tables under names: their columns, keys, and rows in Parquet."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexivane.errors import InsertError, LoadError, RowError
from lexivane.sources.storage import Folder

_TYPES = {"id": T.LongType(), "encoded_data": T.ArrayType(T.LongType()), "norm2": T.DoubleType()}
_CHUNK = 4096
#: A column that rows may bring along to be ordered by; it isn't stored.
ORDER = "_lv_order"


@dataclass(frozen=True)
class Table:
    """What a table is; its rows are ``Catalog.rows``."""

    name: str
    columns: tuple[str, ...]
    primary_key: str


def with_ids(rows: DataFrame, order: str, next_id: int, id_col: str = "id") -> DataFrame:
    """Gives ids to the rows without one, in ``order``: the next free number at each.

    A given id that isn't below the next moves that to one more; lower ones don't. Rows are counted within
    chunks of ``order`` side by side, and only the chunks' totals come together.
    """
    rows = rows.withColumn("_lv_chunk", F.floor(F.col(order) / _CHUNK))
    auto = F.col(id_col).isNull().cast("bigint")
    before = Window.partitionBy("_lv_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_lv_a", F.coalesce(F.sum(auto).over(before), F.lit(0))).withColumn("_lv_g", F.when(F.col(id_col).isNotNull(), F.col(id_col) + 1 - F.col("_lv_a")))
    rows = rows.withColumn("_lv_m", F.max("_lv_g").over(before))
    past = Window.orderBy("_lv_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = rows.groupBy("_lv_chunk").agg(F.sum(auto).alias("n"), F.max("_lv_g").alias("g"))
    chunks = chunks.withColumn("_lv_base", F.coalesce(F.sum("n").over(past), F.lit(0)))
    chunks = chunks.withColumn("_lv_top", F.max(F.col("g") - F.col("_lv_base")).over(past)).select("_lv_chunk", "_lv_base", "_lv_top")
    rows = rows.join(chunks, "_lv_chunk")
    free = F.col("_lv_base") + F.col("_lv_a") + F.greatest(F.lit(next_id), "_lv_top", F.col("_lv_m") - F.col("_lv_base"))
    return rows.withColumn(id_col, F.coalesce(id_col, free).cast("bigint")).drop("_lv_chunk", "_lv_a", "_lv_g", "_lv_m", "_lv_base", "_lv_top")


def repeated_keys(rows: DataFrame, key: str, stored: DataFrame | None = None) -> DataFrame:
    """The keys that occur more than once in ``rows``, or also in ``stored``."""
    twice = rows.groupBy(key).count().where("count > 1").select(key)
    if stored is not None:
        twice = twice.unionByName(rows.select(key).join(stored.select(key), key, "left_semi"))
    return twice.distinct()


class Catalog:
    """A folder of tables. One that can't be read fails when it is read, and names itself; the rest stay usable."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder = spark, Folder(spark, path)

    def names(self) -> list[str]:
        """All tables, sorted."""
        return [n for n in self.folder.folders() if not n.startswith("_") and self.folder.exists(f"{n}/table.json")]

    def get(self, name: str) -> Table | None:
        """The table, or None if there is none of that name."""
        if not self.folder.exists(f"{name}/table.json"):
            return None
        try:
            x = json.loads(self.folder.read(f"{name}/table.json"))
            return Table(name, tuple(x["columns"]), x["primary_key"])
        except Exception as e:
            raise LoadError(f"table {name}: {e}") from e

    def create(self, name: str, columns: Sequence[str], primary_key: str = "id") -> Table:
        """A new table; a key that isn't among the columns becomes the first."""
        if self.get(name) is not None:
            raise RowError(f"table {name} exists")
        columns = tuple(columns) if primary_key in columns else (primary_key, *columns)
        self.folder.write(f"{name}/table.json", json.dumps({"columns": columns, "primary_key": primary_key}))
        return Table(name, columns, primary_key)

    def rows(self, name: str) -> DataFrame:
        """All rows of a table, read when used."""
        table = self.get(name)
        if table is None:
            raise LoadError(f"no table {name}")
        if not self.folder.exists(f"{name}/rows"):
            return self.spark.createDataFrame([], T.StructType([T.StructField(c, _TYPES.get(c, T.StringType())) for c in table.columns]))
        rows = self.spark.read.option("recursiveFileLookup", True).option("mergeSchema", True).parquet(f"{self.folder.path}/{name}/rows")
        return rows.select(*[F.col(f"`{c}`") for c in table.columns], *(["norm2"] if "norm2" in rows.columns and "norm2" not in table.columns else []))

    def prepared(self, name: str, rows: DataFrame, order: Column | None = None) -> DataFrame:
        """``rows`` fit for the table: columns in its order, ids given, no key there twice or already.

        The columns must be just those of the table, but for an ``id`` key, which may be left out or null.
        Ids are given in the order of a whole number, ``order`` or a column ORDER; without either rows are
        taken as they come, which must then be the same each time they are computed.
        """
        table = self.get(name)
        if table is None:
            raise RowError(f"no table {name}")
        if order is not None:
            rows = rows.withColumn(ORDER, order)
        key, have = table.primary_key, {*rows.columns} - {ORDER}
        stored = self.rows(name) if self.folder.exists(f"{name}/rows") else None
        fits = {*table.columns} == (have | {"id"} if key == "id" else have)
        if not fits:
            raise InsertError(f"table {name} has the columns {', '.join(table.columns)}, not {', '.join(sorted(have))}")
        if key == "id":
            given = F.col("id").cast("bigint") if "id" in have else F.lit(None).cast("bigint")
            after = stored.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] if stored is not None else 0
            if ORDER not in rows.columns:
                rows = rows.withColumn(ORDER, F.monotonically_increasing_id())
            rows = with_ids(rows.withColumn("id", given), ORDER, max(after, 0) + 1)
        rows = rows.select(*[F.col(f"`{c}`") for c in table.columns])
        if twice := repeated_keys(rows, key, stored).take(1):
            raise InsertError(f"table {name}: key {twice[0][0]} is there already")
        return rows

    def append(self, name: str, rows: DataFrame, batch: str | None = None) -> None:
        """Adds rows as they are. A ``batch`` that is written again replaces itself."""
        path = f"{self.folder.path}/{name}/rows/{batch or uuid.uuid4().hex}"
        try:
            rows.write.mode("overwrite" if batch else "error").parquet(path)
        except Exception as e:
            raise LoadError(f"table {name} can't be written: {e}") from e

    def insert(self, name: str, rows: DataFrame, order: Column | None = None) -> None:
        """Checks rows and adds them in one piece."""
        self.append(name, self.prepared(name, rows, order))


def write_json_table(table: Table, rows: DataFrame, folder: Folder, name: str) -> None:
    """One document of a whole table: name, columns, key and rows. It passes through the driver, as the format wants one file."""
    lines = rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in table.columns]), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator()
    head = json.dumps({"table_name": table.name, "columns": list(table.columns), "primary_key": table.primary_key}, indent=4)
    folder.write(name, head[:-2] + ',\n    "data": [\n' + ",\n".join(r["j"] for r in lines) + "\n]}\n")


def read_json_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> tuple[Table, DataFrame]:
    """A table from such a document; its name is that of the file."""
    try:
        whole = spark.read.option("multiLine", True)
        whole = (whole.schema(T.StructType([T.StructField("columns", T.ArrayType(T.StringType())), T.StructField("primary_key", T.StringType()), T.StructField("data", T.ArrayType(schema))])) if schema else whole).json(path)
        head = whole.select("columns", "primary_key").first()
        columns, key = tuple(head["columns"]), head["primary_key"]
        rows = whole.select(F.explode("data").alias("r")).select(*[F.col(f"r.`{c}`") for c in columns])
    except Exception as e:
        raise LoadError(f"{path}: {e}") from e
    if not repeated_keys(rows, key).isEmpty():
        raise LoadError(f"{path}: a key occurs twice")
    return Table(path.rstrip("/").rsplit("/", 1)[-1].removesuffix(".json"), columns, key), rows
