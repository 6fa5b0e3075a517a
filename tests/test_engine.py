import json
import os
import pickle

import pytest
from pyspark.sql import functions as F

from lexivane.__main__ import main
from lexivane.errors import EngineError, InsertError, LoadError, RowError
from lexivane.plans.engine import Engine
from lexivane.sources.catalog import with_ids
from lexivane.sources.files import fetch_pages, read_pickled_text
from lexivane.streaming.ingest import ingest_stream

ROWS = [("t1", "the cat sat", "u1"), ("t2", None, "u2"), ("t1", "the cat sat", "u1")]


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "db"))


def rows(spark, data=ROWS):
    return spark.createDataFrame(data, "title string, content string, url string").coalesce(1)


def test_insert_and_search(spark, engine):
    with engine as e:
        e.create_table("articles")
        assert e.insert("articles", rows(spark)) == 3
        got = e.catalog.rows("articles").orderBy("id").collect()
        assert [r["id"] for r in got] == [1, 2, 3]
        words = {r["word"]: r["word_id"] for r in e.vocabulary().collect()}
        assert words == {w: i for i, w in enumerate("t1 the cat sat u1 t2 none u2".split(), 1)}
        assert got[1]["encoded_data"] == [6, 7, 8]
        assert [r["text"] for r in e.decode(e.catalog.rows("articles")).orderBy("id").collect()] == ["t1 the cat sat u1", "t2 none u2", "t1 the cat sat u1"]
        found = e.search("t1 The cat sat u1", 5).orderBy("rank").collect()
        assert [r["id"] for r in found] == [1, 3, 2]
        assert found[0]["score"] == 1 == found[1]["score"]
        assert found[0]["table_name"] == "articles"
        assert len(e.search("t1", 1).collect()) == 1
        assert e.search("t1", 0).collect() == []
        assert e.search("the of", 3).collect() == []
        assert len(e.search("qqq", 10).collect()) == 3
        assert e.closest("t1 The cat sat u1").first()["content"] == "the cat sat..."
        assert [r["rank"] for r in e.listing("t1", 3).collect()] == [1, 2, 3]
        with pytest.raises(RowError):
            e.search("x", -1)
        assert e.last_timing()


def test_query_terms(spark, engine):
    engine.create_table("articles")
    engine.insert("articles", rows(spark))
    n = engine.vocabulary().count()
    engine.search("qq rr")
    assert engine.vocabulary().count() == n
    engine.search("qq rr", persist_query_terms=True)
    assert {r["word"]: r["word_id"] for r in engine.vocabulary().collect()}["rr"] == n + 2
    engine.insert("articles", rows(spark, [("new", "qq", "u")]))
    ids = [r["word_id"] for r in engine.vocabulary().collect()]
    assert sorted(ids) == list(range(1, len(ids) + 1))


def test_constraints(spark, engine):
    engine.create_table("t", ["title", "encoded_data"])
    assert engine.catalog.get("t").columns == ("id", "title", "encoded_data")
    with pytest.raises(RowError):
        engine.create_table("t")
    with pytest.raises(RowError):
        engine.insert("none", rows(spark))
    with pytest.raises(InsertError):
        engine.insert("t", rows(spark))
    with pytest.raises(InsertError):
        engine.insert("t", spark.createDataFrame([(1,)], "id bigint"))
    assert engine.vocabulary().count() == 0
    one = spark.createDataFrame([(10, "a"), (None, "b")], "id bigint, title string").coalesce(1)
    engine.insert("t", one)
    assert [r["id"] for r in engine.catalog.rows("t").orderBy("id").collect()] == [10, 11]
    with pytest.raises(InsertError):
        engine.insert("t", one.where("id = 10"))
    engine.create_table("bare", ["title"])
    with pytest.raises(InsertError):
        engine.insert("bare", rows(spark).select("title"))
    assert engine.catalog.get("missing") is None
    with pytest.raises(LoadError):
        engine.catalog.rows("missing")


def test_other_key(spark, engine):
    engine.create_table("k", ["code", "title", "encoded_data"], "code")
    df = spark.createDataFrame([("x", "a b"), ("y", "b")], "code string, title string")
    engine.insert("k", df)
    assert engine.search("x a b", 1).first()["code"] == "x"
    with pytest.raises(InsertError):
        engine.insert("k", df)
    with pytest.raises(InsertError):
        engine.insert("k", df.select("title"))


def test_with_ids(spark):
    given = [None, 5, None, 3, None, 100, None, None]
    nxt, want = 1, []
    for g in given:
        want.append(nxt if g is None else g)
        nxt = max(nxt, want[-1] + 1)
    df = spark.createDataFrame([(i * 3000, g) for i, g in enumerate(given)], "o bigint, id bigint")
    assert [r["id"] for r in with_ids(df, "o", 1).orderBy("o").collect()] == want


def test_all_tables(spark, engine):
    for name in ("b", "a"):
        engine.create_table(name)
        engine.insert(name, rows(spark, [("same", "text", "u")]))
    assert [r["table_name"] for r in engine.search("same text u", 5).orderBy("rank").collect()] == ["a", "b"]
    assert [r["table_name"] for r in engine.search("same text u", 5, table_name="b").collect()] == ["b"]


def test_empty(spark, engine):
    assert engine.search("x").collect() == []
    engine.create_table("articles")
    assert engine.search("x").collect() == []
    assert engine.catalog.rows("articles").count() == 0
    assert engine.insert("articles", rows(spark, [])) == 0


def test_pages(spark, engine):
    pages = spark.createDataFrame([("http://a/x", "<p>one two</p>"), ("http://a/", "<article></article>"), ("http://a/z", "<div/>"), ("http://a/", "<p>b</p>")], "url string, html string").coalesce(1)
    assert engine.ingest_pages(pages) == 2
    got = engine.catalog.rows("articles").orderBy("id").collect()
    assert [(r["id"], r["title"], r["content"]) for r in got] == [(1, "x", "one two"), (2, "", "b")]

    def get(url):
        if url.endswith("bad"):
            raise EngineError("down")
        return "<p>web</p>"

    urls = spark.createDataFrame([("http://a/good",), ("http://a/bad",)], "url string")
    assert {r["url"][-3:]: r["error"] for r in fetch_pages(urls, get=get).collect()} == {"ood": None, "bad": "down"}
    assert engine.ingest_urls(urls, get=get) == 1


def test_files(spark, engine, tmp_path):
    (tmp_path / "a.b.txt").write_text("Hello wörld\nagain")
    (tmp_path / "p.pkl").write_bytes(pickle.dumps("pickled text"))
    (tmp_path / "c.csv").write_text("x")
    (tmp_path / "d.TXT").write_text("x")
    assert engine.ingest_files(str(tmp_path / "a.b.txt")) == {"file_a.b": 1}
    row = engine.catalog.rows("file_a.b").first()
    assert (row["title"], row["content"], row["url"]) == ("a.b.txt", "Hello wörld\nagain", f"file://{tmp_path}/a.b.txt")
    assert engine.ingest_files(str(tmp_path / "p.pkl")) == {"file_p": 1}
    for bad in ("c.csv", "d.TXT"):
        with pytest.raises(RowError):
            engine.ingest_files(str(tmp_path / bad))
    with pytest.raises(LoadError):
        read_pickled_text(pickle.dumps(None))
    with pytest.raises(LoadError):
        read_pickled_text(pickle.dumps(os.system))


def test_json_round_trip(spark, engine, tmp_path):
    engine.create_table("articles")
    engine.insert("articles", rows(spark))
    path = engine.export_json("articles")
    whole = json.loads(open(path).read())
    assert whole["columns"] == ["id", "title", "content", "url", "encoded_data"]
    other = Engine(spark, str(tmp_path / "other"))
    other.import_json(path)
    pick = lambda e: sorted(map(str, e.catalog.rows("articles").select(*whole["columns"]).collect()))
    assert pick(other) == pick(engine)
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(LoadError):
        other.import_json(str(tmp_path / "bad.json"))


def test_stream(spark, engine, tmp_path):
    src = tmp_path / "in"
    for i, part in enumerate((ROWS[:1], ROWS[1:])):
        rows(spark, part).write.mode("append").parquet(str(src))
        q = ingest_stream(engine, spark.readStream.schema("title string, content string, url string").parquet(str(src)), "articles", str(tmp_path / "cp"), once=True)
        q.awaitTermination()
        assert q.exception() is None
        assert engine.catalog.rows("articles").count() == (1, 3)[i]
    assert engine.vocabulary().count() == 8
    again = Engine(spark, engine.catalog.folder.path)
    q = ingest_stream(again, spark.readStream.schema("title string, content string, url string").parquet(str(src)), "articles", str(tmp_path / "cp"), once=True)
    q.awaitTermination()
    assert again.catalog.rows("articles").count() == 3


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "n.txt").write_text("some words here")
    assert main(["--dir", str(tmp_path / "db"), "insert-file", str(tmp_path / "n.txt")], spark) == 0
    assert main(["--dir", str(tmp_path / "db"), "search", "n.txt some words", "-n", "1"], spark) == 0
    assert main(["--dir", str(tmp_path / "db"), "closest", "words"], spark) == 0
    assert main(["--dir", str(tmp_path / "db"), "insert-file", "x.csv"], spark) == 1
    assert "some words here..." in capsys.readouterr().out
