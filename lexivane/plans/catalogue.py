"""The catalogue of runnable queries, each with SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexivane.functions import html as page
from lexivane.functions import text as t
from lexivane.operators import encode, similarity, vocab
from lexivane.sources.catalog import repeated_keys, with_ids

QUERY = "the Thion erthing and with a onthe thation these reen"
UNSEEN = "zzqx the anea qqzzt of zzqx"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str, key: str | None = None) -> DataFrame:
    """A table, spread over all cores where its files give fewer parts than these."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores, key) if key and len(df.inputFiles()) < cores else df


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


_STOP = _quoted(t.STOPWORDS)
_TOKENS = r"""
tok AS (SELECT doc_id, CAST(i - 1 AS BIGINT) AS pos, word FROM (
    SELECT doc_id, unnest(l) AS word, unnest(range(1, len(l) + 1)) AS i FROM (
        SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS l FROM documents)))"""
_VOCAB = _TOKENS + """,
vocab AS (SELECT word, row_number() OVER (ORDER BY f) AS word_id FROM (SELECT word, min(doc_id * 4294967296 + pos) AS f FROM tok GROUP BY word))"""
_ENC = _VOCAB + """,
enc AS (SELECT doc_id, pos, word_id FROM tok JOIN vocab USING (word)),
norm AS (SELECT doc_id, count(*) AS n, CAST(sum(word_id * word_id) AS BIGINT) AS norm2 FROM enc GROUP BY doc_id)"""


def _query_sql(text: str) -> str:
    """The query's words with places and ids; new words count on from the dictionary's end."""
    q = text.replace("'", "''")
    return f"""
qt AS (SELECT lower(w) AS word, row_number() OVER (ORDER BY i) - 1 AS pos FROM (SELECT unnest(l) AS w, unnest(range(1, len(l) + 1)) AS i FROM (SELECT string_split('{q}', ' ') AS l)) WHERE w <> '' AND w NOT IN ({_STOP})),
fresh AS (SELECT word, (SELECT max(word_id) FROM vocab) + row_number() OVER (ORDER BY min(pos)) AS word_id FROM qt WHERE word NOT IN (SELECT word FROM vocab) GROUP BY word),
q AS (SELECT pos, word_id FROM qt JOIN (SELECT word, word_id FROM vocab UNION ALL SELECT word, word_id FROM fresh) USING (word)),
q2 AS (SELECT CAST(sum(word_id * word_id) AS DOUBLE) AS n FROM q)"""


def _score_sql(text: str) -> str:
    return f"""WITH {_ENC}, {_query_sql(text)},
dots AS (SELECT doc_id, CAST(sum(enc.word_id * q.word_id) AS BIGINT) AS dot FROM enc JOIN q USING (pos) GROUP BY doc_id),
scores AS (SELECT d.doc_id, round(coalesce(CAST(dot AS DOUBLE) / (sqrt((SELECT n FROM q2)) * sqrt(CAST(norm2 AS DOUBLE))), 0.0), 9) AS score FROM documents d LEFT JOIN dots USING (doc_id) LEFT JOIN norm ON norm.doc_id = d.doc_id)"""


def _documents(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id")


def _encoded(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    words = vocab.build(docs).persist()  # used more than once
    return encode.vectors(docs, words), words


@query(f"WITH {_TOKENS} SELECT doc_id, pos, word FROM tok")
def tokenize(spark, sf_dir):
    return vocab.exploded(_documents(spark, sf_dir))


@query(r"SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS BIGINT) AS n_tokens FROM documents")
def token_counts(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.size(t.tokens(F.col("text"))).cast("bigint").alias("n_tokens"))


@query(f"WITH {_VOCAB} SELECT word, word_id FROM vocab")
def vocab_build(spark, sf_dir):
    return vocab.build(_documents(spark, sf_dir))


@query(
    rf"""WITH {_VOCAB},
b AS (SELECT item_id, i, word FROM (SELECT item_id, unnest(l) AS word, unnest(range(1, len(l) + 1)) AS i FROM (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS l FROM benchmark)))
SELECT word, (SELECT max(word_id) FROM vocab) + row_number() OVER (ORDER BY f) AS word_id FROM (SELECT word, min(item_id * 4294967296 + i) AS f FROM b WHERE word NOT IN (SELECT word FROM vocab) GROUP BY word)"""
)
def vocab_extend(spark, sf_dir):
    return vocab.extend(vocab.build(_documents(spark, sf_dir)), table(spark, sf_dir, "benchmark"), "item_id")


@query(f"WITH {_ENC} SELECT doc_id, pos, word_id FROM enc")
def encode_documents(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    return encode.word_ids(docs, vocab.build(docs))


@query(f"WITH {_ENC} SELECT d.doc_id, coalesce(n, 0) AS n, coalesce(norm2, 0) AS norm2 FROM documents d LEFT JOIN norm USING (doc_id)")
def encode_lengths(spark, sf_dir):
    return encode.lengths(_encoded(spark, sf_dir)[0])


@query(f"WITH {_TOKENS} SELECT d.doc_id, coalesce(string_agg(word, ' ' ORDER BY pos), '') AS text FROM documents d LEFT JOIN tok USING (doc_id) GROUP BY d.doc_id")
def decode(spark, sf_dir):
    return encode.decode(*_encoded(spark, sf_dir))


@query(f"WITH {_VOCAB} SELECT CAST(1 AS BIGINT) AS doc_id, (SELECT word FROM vocab WHERE word_id = 1) || '  ' || (SELECT word FROM vocab WHERE word_id = 2) AS text")
def decode_unknown(spark, sf_dir):
    words = vocab.build(_documents(spark, sf_dir))
    return encode.decode(spark.createDataFrame([(1, [1, 1 << 50, 2])], "doc_id bigint, encoded_data array<bigint>"), words)


@query("SELECT page_id, coalesce(CASE WHEN page_id % 3 = 0 THEN NULL ELSE split_part(url, '/', -1) END, 'None') || '  ' || url AS combined FROM pages")
def combine_fields(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 3 != 0, t.url_title(F.col("url"))).alias("title"), "url")
    return rows.select("page_id", t.combined(["title", "content", "url", "encoded_data"], rows.columns).alias("combined"))


@query(rf"SELECT conv_id, turn, array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '' AND x NOT IN ({_STOP})), ' ') AS filtered FROM conversations")
def stopword_filter(spark, sf_dir):
    return table(spark, sf_dir, "conversations", "conv_id").select("conv_id", "turn", t.drop_stopwords(F.col("text")).alias("filtered"))


def _scored(spark, sf_dir, text: str) -> DataFrame:
    encoded, words = _encoded(spark, sf_dir)
    ids, _ = similarity.query_ids(similarity.query_words(spark, text), words)
    return similarity.scored(encoded, ids).select("doc_id", "score")


def _ranked(df: DataFrame, k: int, *ties: str) -> DataFrame:
    best = similarity.top(df, k, *ties)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), *ties)).cast("bigint"))  # over k rows


@query(f"{_score_sql(QUERY)} SELECT doc_id, score FROM scores")
def cosine_scores(spark, sf_dir):
    return _scored(spark, sf_dir, QUERY)


@query(f"{_score_sql(QUERY)} SELECT row_number() OVER (ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scores ORDER BY score DESC, doc_id LIMIT 5")
def topk_search(spark, sf_dir):
    return _ranked(_scored(spark, sf_dir, QUERY), 5, "doc_id").select("rank", "doc_id", "score")


@query(f"{_score_sql(QUERY)} SELECT doc_id, score FROM scores ORDER BY score DESC, doc_id LIMIT 1")
def closest_one(spark, sf_dir):
    return similarity.top(_scored(spark, sf_dir, QUERY), 1, "doc_id")


@query(f"{_score_sql(UNSEEN)} SELECT row_number() OVER (ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scores ORDER BY score DESC, doc_id LIMIT 5")
def search_unseen_terms(spark, sf_dir):
    return _ranked(_scored(spark, sf_dir, UNSEEN), 5, "doc_id").select("rank", "doc_id", "score")


#: Row ids that a table has room for in the ids of ``_all_tables``, and the tables.
_TABLE, _TABLES = 1 << 60, ("benchmark", "conversations", "documents")


def _all_tables(spark, sf_dir) -> DataFrame:
    """Rows of three tables as one corpus; doc_id carries the table in its high bits, so words are learned table by table.

    It puts rows in the order of tables and of their ids, and says both: ids are within 2^59 of 0.
    """
    parts = zip(_TABLES, (F.col("item_id"), F.col("conv_id") * 1000 + F.col("turn"), F.col("doc_id")), strict=True)
    dfs = [table(spark, sf_dir, n, "doc_id" if n == "documents" else None).select((F.lit(i * _TABLE) + k).alias("doc_id"), "text") for i, (n, k) in enumerate(parts)]
    return dfs[0].unionByName(dfs[1]).unionByName(dfs[2])


@query(
    f"""WITH all_rows AS (SELECT 'benchmark' AS table_name, 0 AS o, item_id AS row_id, text FROM benchmark UNION ALL SELECT 'conversations', 1, conv_id * 1000 + turn, text FROM conversations UNION ALL SELECT 'documents', 2, doc_id, text FROM documents),
docs AS (SELECT row_number() OVER (ORDER BY o, row_id) AS doc_id, table_name, o, row_id, text FROM all_rows), """
    + _score_sql(QUERY).removeprefix("WITH ").replace("FROM documents", "FROM docs")
    + """ SELECT row_number() OVER (ORDER BY score DESC, o, row_id) AS rank, table_name, row_id, score FROM scores JOIN docs USING (doc_id) ORDER BY score DESC, o, row_id LIMIT 10"""
)
def search_all_tables(spark, sf_dir):
    rows = _all_tables(spark, sf_dir)
    words = vocab.build(rows).persist()
    ids, _ = similarity.query_ids(similarity.query_words(spark, QUERY), words)
    best = _ranked(similarity.scored(encode.vectors(rows, words), ids).select("doc_id", "score"), 10, "doc_id")
    at = F.shiftright(F.col("doc_id") + _TABLE // 2, 60)
    name = F.element_at(F.array(*[F.lit(n) for n in _TABLES]), (at + 1).cast("int"))
    return best.select("rank", name.alias("table_name"), (F.col("doc_id") - at * _TABLE).alias("row_id"), "score")


@query("SELECT CAST(1 AS BIGINT) AS rank, doc_id, CAST(0 AS DOUBLE) AS score FROM documents WHERE false")
def search_stopwords_only(spark, sf_dir):
    words = similarity.query_words(spark, "the of and these")
    docs = _documents(spark, sf_dir).select("doc_id", F.lit(0.0).alias("score"))
    return _ranked(docs.where(F.lit(bool(words))), 5, "doc_id").select("rank", "doc_id", "score")


@query(f"{_score_sql(QUERY)} SELECT count(*) AS n_rows, CAST(sum(CASE WHEN score = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_zero FROM scores")
def search_keeps_all(spark, sf_dir):
    return _scored(spark, sf_dir, QUERY).agg(F.count("*").alias("n_rows"), F.sum((F.col("score") == 0).cast("bigint")).alias("n_zero"))


@query(
    f"{_score_sql(QUERY)} SELECT row_number() OVER (ORDER BY score DESC, s.doc_id) AS rank, 'documents' AS source, 'N/A' AS title, left(text, 150) || '...' AS content, 'N/A' AS url FROM scores s JOIN documents d USING (doc_id) ORDER BY score DESC, s.doc_id LIMIT 5"
)
def search_preview(spark, sf_dir):
    best = topk_search(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id")
    return best.select("rank", F.lit("documents").alias("source"), F.lit("N/A").alias("title"), t.preview(F.col("text"), 150).alias("content"), F.lit("N/A").alias("url"))


@query("SELECT page_id, split_part(url, '/', -1) AS title FROM pages")
def url_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", t.url_title(F.col("url")).alias("title"))


@query()
def html_extract(spark, sf_dir):
    return page.extract_articles(table(spark, sf_dir, "pages", "page_id")).select("page_id", "content")


@query()
def ingest_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages", "page_id")
    found = page.extract_articles(pages, keep=["url"]).where("content <> ''")
    rows = found.select("page_id", "url", t.url_title(F.col("url")).alias("title"), "content").withColumn("id", F.lit(None).cast("bigint"))
    rows = with_ids(rows, "page_id", 1)
    return rows.select("id", "title", "url", F.size(t.tokens(t.combined(["title", "content", "url"], ["title", "content", "url"]))).cast("bigint").alias("n_tokens"))


_PATHS = ("/data/a.b.txt", "/data/notes.txt", "/data/x/plain", "/data/old.tar.gz", "/data/.hidden")


@query(
    "SELECT path, 'file_' || CASE WHEN regexp_matches(name, '[^.].*\\.') THEN regexp_replace(name, '\\.[^.]*$', '') ELSE name END AS table_name, 'file://' || path AS url FROM (SELECT path, split_part(path, '/', -1) AS name FROM (SELECT unnest(["
    + _quoted(_PATHS)
    + "]) AS path))"
)
def file_table_name(spark, sf_dir):
    return spark.createDataFrame([(p,) for p in _PATHS], "path string").select("path", t.file_table(F.col("path")).alias("table_name"), F.concat(F.lit("file://"), "path").alias("url"))


@query("SELECT row_number() OVER (ORDER BY item_id) AS id, text FROM benchmark")
def auto_id(spark, sf_dir):
    return with_ids(table(spark, sf_dir, "benchmark").withColumn("id", F.lit(None).cast("bigint")), "item_id", 1).select("id", "text")


@query(
    """WITH RECURSIVE r AS (SELECT item_id, text, CASE WHEN item_id % 5 = 2 THEN item_id * 3 END AS given, row_number() OVER (ORDER BY item_id) AS i FROM benchmark),
w AS (SELECT i, coalesce(given, CAST(1 AS BIGINT)) AS id, greatest(CAST(1 AS BIGINT), coalesce(given, CAST(1 AS BIGINT)) + 1) AS nxt, text FROM r WHERE i = 1
UNION ALL SELECT r.i, coalesce(r.given, w.nxt), greatest(w.nxt, coalesce(r.given, w.nxt) + 1), r.text FROM w JOIN r ON r.i = w.i + 1)
SELECT id, text FROM w"""
)
def auto_id_mixed(spark, sf_dir):
    given = F.when(F.col("item_id") % 5 == 2, F.col("item_id") * 3)
    return with_ids(table(spark, sf_dir, "benchmark").withColumn("id", given), "item_id", 1).select("id", "text")


@query("SELECT doc_id FROM (SELECT doc_id FROM documents UNION ALL SELECT doc_id FROM labels) GROUP BY doc_id HAVING count(*) > 1")
def dup_key_check(spark, sf_dir):
    return repeated_keys(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", table(spark, sf_dir, "documents").select("doc_id"))


@query("SELECT item_id, text FROM benchmark")
def table_roundtrip(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark")
    one = rows.agg(F.to_json(F.collect_list(F.struct("item_id", "text"))).alias("data"))
    return one.select(F.explode(F.from_json("data", "array<struct<item_id: bigint, text: string>>")).alias("r")).select("r.*")


@query(
    """WITH q AS (SELECT list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS q FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)),
s AS (SELECT vec_id, round(list_cosine_similarity(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), q), 6) AS score FROM embeddings, q)
SELECT row_number() OVER (ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s ORDER BY score DESC, vec_id LIMIT 10"""
)
def embedding_topk(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    q = [float(x) for x in rows.orderBy("vec_id").select("embedding").first()[0]]
    e = F.transform("embedding", lambda x: x.cast("double"))
    dot = F.aggregate(F.zip_with(e, F.array(*[F.lit(x) for x in q]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(e, F.lit(0.0), lambda s, x: s + x * x))
    return _ranked(rows.select("vec_id", F.round(dot / (norm * F.lit(sum(x * x for x in q) ** 0.5)), 6).alias("score")), 10, "vec_id").select("rank", "vec_id", "score")
