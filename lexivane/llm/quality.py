"""Operator 2: quality rules by how many documents of a host share a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivane.llm.shared import BROADCAST_BYTES, durable, forget, resized, small

#: A line goes where more documents of its host have it than both of these: a number, and a share of the host's documents.
MAX_DOCS, MAX_SHARE = 5, 0.02
#: A document of which less than this share of its characters is left is rejected.
LEAST_KEPT = 0.3


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hash(host: Column, line: Column) -> Column:
    return F.xxhash64(host, F.trim(F.regexp_replace(F.lower(line), r"\s+", " ")))


def _host(host_col: str) -> Column:
    return F.coalesce(F.col(f"`{host_col}`").cast("string"), F.lit(""))


def _hashes(host: Column, text: Column) -> Column:
    """Hashes of a text's lines but the blank ones, together with the host, each once."""
    return F.array_distinct(F.filter(F.transform(_lines(text), lambda x: _hash(host, x)), lambda h: h != F.xxhash64(host, F.lit(""))))


def _doc(id_col: str, text_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("bigint"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))


def frequent_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """Per host the hashes of the lines that too many of its documents have: ``host, line_hash, n_docs, host_docs``.

    A line counts once for a document however often it occurs there. Both aggregations combine before they
    shuffle and then spread by (host, line, document), so neither a hot host nor a hot line loads one task.
    Null texts and blank lines have no lines; a null host is one with the empty one; an empty table gives no rows.
    """
    slim = docs.select(_host(host_col).alias("host"), _doc(id_col, text_col).alias("doc"), F.col(text_col).alias("text"))
    lines = slim.select("host", "doc", F.explode(_hashes(F.col("host"), F.col("text"))).alias("line_hash"))
    counted = lines.groupBy("host", "line_hash").agg(F.countDistinct("doc").alias("n_docs")).where(F.col("n_docs") > max_docs)
    hosts = slim.groupBy("host").agg(F.countDistinct("doc").alias("host_docs"))
    return counted.join(hosts, "host").where(F.col("n_docs") > max_share * F.col("host_docs"))


def drop_frequent_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    max_docs: int = MAX_DOCS,
    max_share: float = MAX_SHARE,
    least_kept: float = LEAST_KEPT,
    size_col: str | None = None,
) -> DataFrame:
    """``docs``, all columns, without the lines that too many documents of the same host have, and without depleted documents.

    Lines are compared in lower case with white space run together; blank lines are never counted or removed.
    A line goes from all documents of a host if over ``max_docs`` of them and over ``max_share`` of them have
    it. A document of which under ``least_kept`` of the characters are left, or nothing but white space, is
    rejected; so are null and empty texts. A null host is a host of its own, together with the empty one. Rows
    of one doc_id count as one document; a null doc_id counts by its text. Repeated rows stay repeated. ``size_col`` names
    a column to hold the characters left; other columns are untouched.

    The lines to go are joined to hashes of lines, and each text is joined to the few of its own that go, so no row carries its host's list.
    """
    bad = durable(frequent_lines(docs, id_col, text_col, host_col, max_docs, max_share).select("line_hash"), "lines")
    text, at = F.col(f"`{text_col}`"), _host(host_col)
    key = F.xxhash64(at, text)
    lines = docs.select(key.alias("_lv_key"), F.explode(_hashes(at, text)).alias("line_hash")).join(small(bad, 16), "line_hash", "left_semi")
    own = durable(lines.groupBy("_lv_key").agg(F.collect_set("line_hash").alias("_lv_bad")), "own_lines")
    size = own.agg(F.coalesce(F.sum(16 + 8 * F.size("_lv_bad")), F.lit(0))).first()[0]
    forget(bad)
    kept = F.array_join(F.filter(_lines(text), lambda x: ~F.array_contains(F.col("_lv_bad"), _hash(at, x))), "\n")
    out = docs.withColumn("_lv_key", key).join(F.broadcast(own) if size <= BROADCAST_BYTES else own, "_lv_key", "left")
    out = out.withColumn("_lv_kept", F.when(F.col("_lv_bad").isNull(), text).otherwise(kept))
    out = out.where(F.col("_lv_kept").rlike(r"\S") & (F.length("_lv_kept") >= least_kept * F.length(text)))
    return resized(out.withColumn(text_col, F.col("_lv_kept")), text_col, size_col).select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = rf"""
WITH l AS (SELECT doc_id, source, i, line, lower(regexp_replace(line, '\s+', ' ', 'g')) AS x FROM (
    SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)),
n AS (SELECT doc_id, source, i, line, trim(x) AS x FROM l),
h AS (SELECT source, count(DISTINCT doc_id) AS host_docs FROM documents GROUP BY source),
bad AS (SELECT n.source, x FROM n JOIN h USING (source) WHERE x <> '' GROUP BY n.source, x, host_docs HAVING count(DISTINCT doc_id) > {MAX_DOCS} AND count(DISTINCT doc_id) > {MAX_SHARE} * host_docs),
k AS (SELECT n.doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM n LEFT JOIN bad ON bad.source = n.source AND bad.x = n.x WHERE bad.x IS NULL GROUP BY n.doc_id)
SELECT d.doc_id, k.text, d.lang, d.source, CAST(length(k.text) AS BIGINT) AS n_chars FROM documents d JOIN k USING (doc_id)
WHERE regexp_matches(k.text, '\S') AND length(k.text) >= {LEAST_KEPT} * length(d.text)
"""
