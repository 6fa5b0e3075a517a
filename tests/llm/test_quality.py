import duckdb
from pyspark.sql import functions as F

from lexivane.llm import quality, shared
from tests.llm.fixtures import ids, row, table


def test_limits(spark):
    rows = [row(i, f"Menu  Home\nown line {i} of this page\nown again {i}") for i in range(10)]
    rows += [row(100 + i, f"menu home\nother {i}", "t") for i in range(4)]
    rows += [row(200, "MENU HOME\n\n"), row(201, "menu home\nmenu home\nmenu home\nx")]
    got = {r["doc_id"]: r for r in quality.drop_frequent_lines(table(spark, rows), size_col="n_chars").collect()}
    assert got[0]["text"] == "own line 0 of this page\nown again 0"
    assert got[0]["n_chars"] == len(got[0]["text"])
    assert got[100]["text"] == "menu home\nother 0"  # four documents of its host only
    assert 200 not in got  # nothing left
    assert 201 not in got  # depleted
    assert got[0]["key"] == "extra"


def test_share(spark):
    rows = [row(i, ("common\n" if i % 50 == 0 else "") + f"text {i} is here") for i in range(400)]
    assert quality.frequent_lines(table(spark, rows)).count() == 0  # 8 documents, not over 2 per cent of 400
    assert quality.frequent_lines(table(spark, rows), max_share=0.01).count() == 1


def test_counts_documents_once(spark):
    rows = [row(1, "line one here\nline one here")] * 20 + [row(2, "line one here")]
    assert quality.frequent_lines(table(spark, rows)).count() == 0
    assert quality.drop_frequent_lines(table(spark, rows)).count() == 21


def test_odd(spark):
    out = quality.drop_frequent_lines(table(spark))
    assert ids(out) == [4, 5, 6, 7, 7, 7, 8, None]
    assert out.columns == table(spark).columns
    mine = table(spark, [row(1, "menu\nown words here")]).withColumn("n_chars", F.lit("mine"))
    assert quality.drop_frequent_lines(mine).first()["n_chars"] == "mine"
    assert quality.drop_frequent_lines(table(spark, [])).count() == 0
    hosts = [row(i, "shared line of text\n" + f"{i} own words", None if i % 2 else "") for i in range(8)]
    assert all("shared" not in r["text"] for r in quality.drop_frequent_lines(table(spark, hosts), least_kept=0.1).collect())


def test_without_broadcast(spark, monkeypatch):
    rows = [row(i, f"Menu\nown line {i} of this page", f"s{i % 3}") for i in range(30)]
    want = sorted(map(str, quality.drop_frequent_lines(table(spark, rows)).collect()))
    for module in (quality, shared):
        monkeypatch.setattr(module, "BROADCAST_BYTES", -1)
    assert sorted(map(str, quality.drop_frequent_lines(table(spark, rows)).collect())) == want


def test_sql(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.01/documents.parquet'")
    want = sorted(con.execute(f"select doc_id, text, lang, source, n_chars from ({quality.ORACLE})").fetchall())
    got = sorted(tuple(r) for r in quality.drop_frequent_lines(docs, size_col="n_chars").collect())
    assert got == want
