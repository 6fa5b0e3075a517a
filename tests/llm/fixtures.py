"""Small tables with what breaks operators: nulls, empty and long texts, repeated rows, clashing names."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}x{rng.randrange(9)}" for _ in range(n))


def row(i, text, source="s", lang="en"):
    return (i, text, lang, source, None if text is None else len(text))


def odd_rows():
    return [
        row(None, None, None, None),
        row(None, "a null id"),
        row(1, None),
        row(2, ""),
        row(3, " \n\t "),
        row(4, "ünïcödé — “words” здесь 漢字 x"),
        row(5, prose(1, 30_000)),
        row(6, "y" * 200_000),
        row(7, prose(2, 120)),
        row(7, prose(2, 120)),
        row(7, prose(3, 60)),
        row(8, "same " * 300),
    ]


def table(spark, rows=None, clash=True):
    df = spark.createDataFrame(odd_rows() if rows is None else rows, SCHEMA)
    if clash:
        from pyspark.sql import functions as F

        for name in ("key", "sig", "rep", "root", "host", "line_hash", "u", "v", "node", "doc", "places", "sketch", "lane", "step", "item_ids", "toxic"):
            df = df.withColumn(name, F.lit("extra"))
    return df


def ids(df, column="doc_id"):
    return sorted((r[column] for r in df.select(column).collect()), key=lambda x: (x is None, x))
