"""Documents from text files, pickled strings, and the web."""

from __future__ import annotations

import io
import pickle
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivane.errors import FetchError, LoadError, RowError
from lexivane.functions.text import file_table


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """``table_name, title, content, url``: each ``.txt`` file whole, in UTF-8."""
    files = spark.read.text(path, wholetext=True).select(F.col("value").alias("content"), F.col("_metadata.file_path").alias("at"))
    place = F.regexp_replace("at", "^file:/*", "/")
    return files.select(file_table(place).alias("table_name"), F.element_at(F.split(place, "/", -1), -1).alias("title"), "content", F.concat(F.lit("file://"), place).alias("url"))


class _StringsOnly(pickle.Unpickler):
    def find_class(self, module, name):
        raise LoadError(f"a pickle may hold a string only, not {module}.{name}")


def read_pickled_text(data: bytes) -> str:
    """The string that a pickle holds. Nothing else is accepted, as loading an object can run anything."""
    try:
        x = _StringsOnly(io.BytesIO(data)).load()
    except LoadError:
        raise
    except Exception as e:
        raise LoadError(f"not a pickle: {e}") from e
    if not isinstance(x, str):
        raise LoadError(f"a pickle may hold a string only, not {type(x).__name__}")
    return x


def read_pickles(spark: SparkSession, path: str) -> DataFrame:
    """Like ``read_text_files``, of ``.pkl`` and ``.pickle`` files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([read_pickled_text(x) for x in b.column(1).to_pylist()], pa.string())], ["at", "content"])

    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("at"), "content").mapInArrow(run, "at string, content string")
    place = F.regexp_replace("at", "^file:/*", "/")
    return files.select(file_table(place).alias("table_name"), F.element_at(F.split(place, "/", -1), -1).alias("title"), "content", F.concat(F.lit("file://"), place).alias("url"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """The files at ``path`` by its ending, in the case given: ``.txt``, ``.pkl`` or ``.pickle``."""
    if path.endswith(".txt"):
        return read_text_files(spark, path)
    if path.endswith((".pkl", ".pickle")):
        return read_pickles(spark, path)
    raise RowError(f"{path}: only .txt, .pkl and .pickle files are read")


def http_get(url: str, timeout: float = 30) -> str:
    """A page's text. Certificates are checked; anything but status 200 fails."""
    if not url.startswith(("http://", "https://")):
        raise FetchError(f"{url}: not a web address")
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "Mozilla/5.0 (compatible)"}), timeout=timeout) as r:  # noqa: S310
            if r.status != 200:
                raise FetchError(f"{url}: status {r.status}")
            return r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")
    except FetchError:
        raise
    except Exception as e:
        raise FetchError(f"{url}: {e}") from e


def fetch_pages(urls: DataFrame, url_col: str = "url", get: Callable[[str], str] = http_get, at_once: int = 10) -> DataFrame:
    """``url, html, error`` of each address, ``at_once`` at a time in each task; what fails has its error and no html."""

    def one(url: str) -> tuple[str | None, str | None]:
        try:
            return get(url), None
        except Exception as e:
            return None, str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(at_once) as pool:
            for b in batches:
                got = list(pool.map(one, b.column(0).to_pylist()))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([h for h, _ in got], pa.string()), pa.array([e for _, e in got], pa.string())], ["url", "html", "error"])

    return urls.select(F.col(url_col).alias("url")).mapInArrow(run, "url string, html string, error string")
