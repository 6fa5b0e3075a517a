"""The engine: tables of articles, their dictionary, and search over them."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from lexivane.errors import EncodeError, EngineError, InsertError, RowError
from lexivane.functions.html import extract_articles
from lexivane.functions.text import STOPWORDS, combined, preview, url_title
from lexivane.operators import encode, similarity, vocab
from lexivane.plans.durable import written
from lexivane.sources import files
from lexivane.sources.catalog import ORDER, Catalog, Table, read_json_table, write_json_table

ARTICLES = ("title", "content", "url", "encoded_data")


class Engine:
    """A folder of tables that share one dictionary. Nothing is kept open; use as a context if you like."""

    def __init__(self, spark: SparkSession, path: str, stopwords: Sequence[str] = STOPWORDS):
        self.spark, self.catalog, self.stopwords = spark, Catalog(spark, path), tuple(stopwords)
        self._timing: dict[str, float] = {}

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *_) -> None:
        return None

    @contextmanager
    def _timed(self, what: str):
        began = time.perf_counter()
        yield
        self._timing[what] = (time.perf_counter() - began) * 1e6

    def last_timing(self) -> dict[str, float]:
        """Microseconds that the parts of the last call took, on the driver."""
        return dict(self._timing)

    def vocabulary(self) -> DataFrame:
        """``word, word_id``; empty before the first document."""
        if not self.catalog.folder.exists("_dictionary"):
            return self.spark.createDataFrame([], "word string, word_id bigint")
        return self.spark.read.option("recursiveFileLookup", True).schema("word string, word_id bigint").parquet(f"{self.catalog.folder.path}/_dictionary")

    def _learn(self, new: DataFrame, batch: str) -> None:
        new.write.mode("overwrite").parquet(f"{self.catalog.folder.path}/_dictionary/{batch}")

    def create_table(self, name: str, columns: Sequence[str] = ARTICLES, primary_key: str = "id") -> Table:
        return self.catalog.create(name, columns, primary_key)

    def insert(self, name: str, rows: DataFrame, order: Column | None = None, batch: str | None = None) -> int:
        """Encodes the text columns of rows and adds them: checks, ids, dictionary, vectors, rows, in this order.

        Rows that fail a check leave the dictionary as it was. The table must have ``encoded_data``. A ``batch``
        that comes again after a failure replaces what it wrote of rows, and adds no word twice.
        """
        self._timing = {}
        with self._timed("total"):
            table = self.catalog.get(name)
            if table is None:
                raise RowError(f"no table {name}")
            if "encoded_data" not in table.columns:
                raise InsertError(f"table {name} has no column encoded_data")
            fresh = None
            if order is not None:
                rows = rows.withColumn(ORDER, order)
            elif ORDER not in rows.columns:  # the order in which rows come is kept before it is relied on
                fresh = written(self.spark, rows.withColumn(ORDER, F.monotonically_increasing_id()), self.catalog.folder.path)
                rows = fresh.df
            rows = rows.withColumn("encoded_data", F.lit(None).cast("array<bigint>"))
            with self._timed("check"):
                ready = written(self.spark, self.catalog.prepared(name, rows), self.catalog.folder.path)
            key, text = table.primary_key, combined(table.columns, table.columns)
            batch = batch or f"{time.time_ns():020d}"
            # rows of a table without ids teach their words in the order of a hash of their key
            by = ready.df.withColumn("_lv_ord", F.col("id") if key == "id" else F.pmod(F.xxhash64(key), F.lit(1 << 38)))
            try:
                with self._timed("encode"):
                    old = self.vocabulary()
                    self._learn(vocab.extend(old, by, "_lv_ord", text), f"{name}-{batch}")
                    made = encode.vectors(ready.df, self.vocabulary(), key, text)
            except EngineError:
                raise
            except Exception as e:
                raise EncodeError(str(e)) from e
            with self._timed("insert"):
                self.catalog.append(name, ready.df.drop("encoded_data").join(made, key).select(*[F.col(f"`{c}`") for c in table.columns], "norm2"), batch)
            n = ready.df.count()
            for scratch in (ready, fresh):
                if scratch is not None:
                    scratch.drop()
        return n

    def ingest_pages(self, pages: DataFrame, name: str = "articles", url_col: str = "url", html_col: str = "html", order: Column | None = None, batch: str | None = None) -> int:
        """Adds the articles of web pages; pages without one, or with an empty one, add none. Makes the table at need."""
        if self.catalog.get(name) is None:
            self.create_table(name)
        keyed = pages.withColumn(ORDER, F.monotonically_increasing_id() if order is None else order)
        found = extract_articles(keyed, ORDER, html_col, keep=[url_col]).where("content <> ''")
        kept = written(self.spark, found.select(url_title(F.col(url_col)).alias("title"), "content", F.col(url_col).alias("url"), ORDER), self.catalog.folder.path)
        try:
            return self.insert(name, kept.df, batch=batch)
        finally:
            kept.drop()

    def ingest_urls(self, urls: DataFrame, name: str = "articles", get: Callable[[str], str] = files.http_get) -> int:
        """Fetches pages and adds their articles; those that can't be had add none."""
        return self.ingest_pages(files.fetch_pages(urls, "url", get).where("html is not null"), name)

    def ingest_files(self, path: str) -> dict[str, int]:
        """Adds each file at ``path`` to the table of its name, an empty one too."""
        docs, out = files.read_documents(self.spark, path), {}
        for name in sorted(r[0] for r in docs.select("table_name").distinct().collect()):
            if self.catalog.get(name) is None:
                self.create_table(name)
            out[name] = self.insert(name, docs.where(F.col("table_name") == name).select("title", "content", "url"))
        return out

    def import_json(self, path: str) -> Table:
        """Takes in a table from one JSON document, vectors and all."""
        table, rows = read_json_table(self.spark, path)
        self.create_table(table.name, table.columns, table.primary_key)
        if "encoded_data" in table.columns:
            rows = rows.withColumn("encoded_data", F.col("encoded_data").cast("array<bigint>")).withColumn("norm2", F.coalesce(encode.norm2("encoded_data"), F.lit(0.0)))
        self.catalog.append(table.name, rows)
        return table

    def export_json(self, name: str, file: str | None = None) -> str:
        """Writes a table as one JSON document into the engine's folder; gives its path."""
        table = self.catalog.get(name)
        if table is None:
            raise RowError(f"no table {name}")
        write_json_table(table, self.catalog.rows(name), self.catalog.folder, file or f"{name}.json")
        return f"{self.catalog.folder.path}/{file or f'{name}.json'}"

    def corpus(self, table_name: str | None = None) -> DataFrame | None:
        """All rows of all tables, or of one, with ``table_name`` and ``table_ord``; None without a table."""
        names = [n for n in self.catalog.names() if table_name in (None, n)]
        parts = []
        for i, n in enumerate(names):
            rows = self.catalog.rows(n)
            for c, kind in (("encoded_data", "array<bigint>"), ("norm2", "double")):
                if c not in rows.columns:
                    rows = rows.withColumn(c, F.lit(None).cast(kind))
            key = self.catalog.get(n).primary_key
            parts.append(rows.withColumns({"table_name": F.lit(n), "table_ord": F.lit(i), "row_ord": F.col(key).cast("string") if key != "id" else F.lpad(F.col("id").cast("string"), 20, "0")}))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None

    def search(self, text: str, k: int = 1, table_name: str | None = None, persist_query_terms: bool = False) -> DataFrame:
        """The ``k`` rows closest to a text: their columns, ``table_name``, ``score`` and ``rank``.

        All tables are searched unless one is named. Equal scores keep the order of tables, then of keys. A
        query of stop words alone, or no rows at all, gives no rows. ``persist_query_terms`` gives the query's
        new words their ids for good; otherwise they count only here.
        """
        if k < 0:
            raise RowError("the number of results can't be negative")
        self._timing = {}
        with self._timed("total"):
            corpus = self.corpus(table_name)
            with self._timed("encode"):
                ids, new = similarity.query_ids(similarity.query_words(self.spark, text, self.stopwords), self.vocabulary())
                if new and persist_query_terms:
                    self._learn(self.spark.createDataFrame(new, "word string, word_id bigint"), f"{time.time_ns():020d}")
            if corpus is None or not ids:
                empty = corpus if corpus is not None else self.spark.createDataFrame([], "id bigint, title string, content string, url string, encoded_data array<bigint>, table_name string, table_ord int, row_ord string, norm2 double")
                return empty.where(F.lit(False)).withColumns({"score": F.lit(0.0), "rank": F.lit(0).cast("bigint")}).drop("table_ord", "row_ord", "norm2")
            with self._timed("similarity"):
                best = similarity.top(similarity.scored(corpus, ids), k, "table_ord", "row_ord")
                ranked = F.row_number().over(_over("score", "table_ord", "row_ord")).cast("bigint")
                return best.withColumn("rank", ranked).drop("table_ord", "row_ord", "norm2")

    def closest(self, text: str, k: int = 1) -> DataFrame:
        """Search as a listing: ``source, title, content, url``, the content's first 200 characters."""
        return listing(self.search(text, k), 200).drop("rank")

    def listing(self, text: str, k: int = 5) -> DataFrame:
        """Search as a listing with ranks, the content's first 150 characters."""
        return listing(self.search(text, k), 150)

    def decode(self, rows: DataFrame, id_col: str = "id") -> DataFrame:
        """The words of vectors."""
        return encode.decode(rows, self.vocabulary(), id_col)


def _over(score: str, *ties: str) -> WindowSpec:
    return Window.orderBy(F.desc(score), *ties)  # over k rows


def listing(found: DataFrame, n: int) -> DataFrame:
    """Search results for reading, a line each."""
    named = lambda c: F.when(F.length(c) > 0, F.col(c)).otherwise(F.lit("N/A")) if c in found.columns else F.lit("N/A")
    content = preview(F.col("content"), n) if "content" in found.columns else F.lit("N/A")
    return found.select("rank", F.col("table_name").alias("source"), named("title").alias("title"), content.alias("content"), named("url").alias("url")).orderBy("rank")
