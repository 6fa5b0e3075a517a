import inspect

import __spark_entry__
import corpus_pipeline
from lexivane.llm import neardup, packing, queries
from tests.llm.fixtures import SCHEMA, odd_rows, prose, row

ITEM = "what is the name of the first river that the old traders crossed on their way to the southern sea"
KEY = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"


def written(spark, tmp_path, rows):
    path = str(tmp_path / "sf")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def stages(spark, path):
    docs, out = spark.read.parquet(f"{path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        out.append({r[0] if "text" in docs.columns else r["doc_id"]: r for r in docs.collect()})
    return out


def test_each_stage(spark, tmp_path):
    clean = [row(i, f"{prose(i, 60)}\n{prose(1000 + i, 40)}", f"s{i % 2}") for i in range(20)]
    rows = [(i, f"Site menu\n{t}" if i % 2 else t, a, b, n) for i, t, a, b, n in clean]
    rows += [row(100, "SITE menu", "s1"), row(101, clean[2][1] + " more", "s0"), row(102, f"{prose(7, 30)} {ITEM} {prose(8, 30)}"), row(103, f"key {KEY} {prose(9, 30)}")]
    q, d, c, s, p = stages(spark, written(spark, tmp_path, rows))
    assert set(q) == {*range(20), 101, 102, 103}
    assert all(q[i]["text"] == clean[i][1] for i in range(20))
    assert set(d) == {*range(20), 102, 103}
    assert c[102]["text"] == f"{prose(7, 30)} {prose(8, 30)}"
    assert s[103]["text"] == f"key <secret> {prose(9, 30)}"
    assert all(s[i]["text"] == clean[i][1] and s[i]["n_chars"] == len(clean[i][1]) for i in range(20))
    assert set(p) == set(s)


def test_run(spark, tmp_path):
    path = written(spark, tmp_path, [row(i, prose(i, 50)) for i in range(10)] + odd_rows())
    out = corpus_pipeline.run(spark, path)
    assert sorted({r["doc_id"] for r in out.collect() if r["doc_id"] is not None}) == list(range(10))
    assert len(corpus_pipeline.STAGES) == 5
    assert written(spark, tmp_path / "none", []) and corpus_pipeline.run(spark, str(tmp_path / "none" / "sf")).count() == 0


def test_queries(spark):
    names = [f.split("_")[0] for f in queries.QUERIES]
    assert names == [f"op{n}" for n in range(1, 11)]
    assert {*queries.QUERIES, "pipeline"} <= set(__spark_entry__.queries())
    for name, f in queries.QUERIES.items():
        assert f(spark, "/root/testdata/sf0.001").count() > 0 or name.startswith("op6_"), name


def test_no_local_checkpoints():
    for module in (neardup, packing):
        assert "localCheckpoint" not in inspect.getsource(module)
