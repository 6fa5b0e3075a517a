import random

import duckdb
import pytest
from pyspark.sql import functions as F

from lexivane.llm import anchors, queries, seedextend, suffixdedup
from tests.llm import brute
from tests.llm.fixtures import odd_rows, prose, row, table


def corpus():
    p, q, r = prose("p", 70), prose("q", 50), prose("r", 49)
    return {
        1: f"{prose(1, 30)} {p} {prose(2, 40)}",
        2: f"{p} {prose(3, 10)} {q}",
        3: f"{prose(4, 200)} {q} {p}\n{r}",
        4: f"{r} {prose(5, 60)}",
        5: prose(6, 120),
        6: prose(6, 120),
        7: f"{prose(7, 20)} {prose(6, 120)} {prose(8, 20)}",
        8: "same " * 130,
        9: f"{prose(9, 80)} {prose(10, 5)} {prose(9, 80)}",
        10: prose(11, 49),
        11: prose(11, 49),
        12: f"{prose(1, 30)} {' '.join(p.split()[:45])}",
        13: ("a b c " * 60).strip(),
        14: p,
    }


def rows_of(df):
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def touching():
    """Passages of two documents end to end in a third."""
    x, y = prose("x", 70), prose("y", 55)
    return {1: f"{x} {prose(1, 20)}", 2: f"{y} {prose(2, 20)}", 3: f"{prose(3, 5)} {y} {x} {prose(4, 10)}"}


@pytest.fixture(params=[anchors.MOST, 1])
def most(request, monkeypatch):
    """Contexts of an anchor within one task, and each run of words by itself."""
    monkeypatch.setattr(anchors, "MOST", request.param)


@pytest.mark.parametrize("make", [corpus, touching])
def test_against_brute_force(spark, most, make):
    texts = make()
    df = table(spark, [row(d, t) for d, t in texts.items()]).repartition(3)
    later, every = brute.repeats(texts, anchors.LEAST)
    assert later
    assert rows_of(suffixdedup.later_copies(df)) == later
    assert rows_of(seedextend.repeats(df)) == every


def test_touching(spark):
    df = table(spark, [row(d, t) for d, t in touching().items()])
    assert rows_of(suffixdedup.later_copies(df)) == {(3, 5, 55, 2, 0), (3, 60, 70, 1, 0)}
    assert rows_of(seedextend.repeats(df)) == {(3, 5, 55, 2, 0), (3, 60, 70, 1, 0), (1, 0, 70, 3, 60), (2, 0, 55, 3, 5)}


def test_random_copies(spark, most):
    """Texts put together of pieces of each other, with edits, so that first places change all along."""
    rng = random.Random(5)
    base = prose("base", 400).split()
    texts = {}
    for d in range(40):
        words = list(base[(a := rng.randrange(300)) : a + rng.randrange(60, 300)])
        for _ in range(rng.randrange(6)):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(9)}"
        texts[d] = " ".join(words + texts.get(rng.randrange(60), "").split()[: rng.randrange(150)])
    df = table(spark, [row(d, t) for d, t in texts.items()])
    later, every = brute.repeats(texts, anchors.LEAST)
    assert rows_of(suffixdedup.later_copies(df)) == later
    assert rows_of(seedextend.repeats(df)) == every


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_real_texts(spark, sf):
    """Every row, and so the words at both places, as brute force has it."""
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    later, every = brute.repeats(texts, anchors.LEAST)
    assert rows_of(suffixdedup.later_copies(docs)) == later
    assert rows_of(seedextend.repeats(docs)) == every
    words = {d: t.split() for d, t in texts.items()}
    for d, s, n, o, t in later | every:
        assert words[d][s : s + n] == words[o][t : t + n]


def test_many_copies_of_a_passage(spark):
    """Thousands of different texts around one passage, and thousands of equal ones: rows in proportion, no pairs."""
    p = prose("p", 60)
    some = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.format_string("own%d of %d ", F.col("id"), F.col("id") * 7), F.lit(p), F.format_string(" end%d", F.col("id"))).alias("text"))
    equal = spark.range(6000, 9000).select(F.col("id").alias("doc_id"), F.lit(f"{prose('q', 80)}").alias("text"))
    docs = some.unionByName(equal)
    got = suffixdedup.later_copies(docs)
    assert {(r["n"], r["m"], r["o"]) for r in got.groupBy("n_words", "first_doc_id").agg(F.count("*").alias("m")).selectExpr("n_words n", "m", "first_doc_id o").collect()} == {(60, 5999, 0), (80, 2999, 6000)}
    assert seedextend.repeats(docs).count() == 9000


def test_sql(spark):
    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.01/documents.parquet'")
    want = sorted(con.execute(f"select doc_id, text, lang, source, n_chars from ({suffixdedup.ORACLE})").fetchall())
    assert sorted(tuple(r) for r in queries.op3_longest_previous_factor(spark, "/root/testdata/sf0.01").collect()) == want


def test_removal(spark):
    texts = corpus()
    out = {r["doc_id"]: r["text"] for r in suffixdedup.drop_later_copies(table(spark, [row(d, t) for d, t in texts.items()])).collect()}
    assert out[1] == texts[1]
    assert out[2].split() == texts[2].split()[70:]
    assert 6 not in out
    assert 14 not in out
    assert out[5] == texts[5]
    assert out[7].split() == (prose(7, 20) + " " + prose(8, 20)).split()


@pytest.mark.parametrize("repeats", [suffixdedup.later_copies, seedextend.repeats])
def test_odd(spark, repeats):
    got = repeats(table(spark)).collect()
    # repeated rows are one document; document 8 repeats itself
    assert {r["doc_id"] for r in got} == {8}
    assert repeats(table(spark, [])).collect() == []
    both = repeats(table(spark, [row(None, prose(1, 60)), row(9, prose(1, 60))])).collect()
    assert None in {r["doc_id"] for r in both}  # null ids are the last


def test_odd_removal(spark):
    out = suffixdedup.drop_later_copies(table(spark))
    assert out.count() == len(odd_rows())
    assert out.columns == table(spark).columns
    again = table(spark, [row(1, prose(1, 60)), row(2, prose(1, 60) + " x")] * 2).withColumn("n_chars", F.lit("mine"))
    assert [(r["doc_id"], r["n_chars"]) for r in suffixdedup.drop_later_copies(again).orderBy("doc_id").collect()] == [(1, "mine")] * 2 + [(2, "mine")] * 2


def test_smaller():
    import numpy as np

    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 50, 500):
        for top in (2, 10, 10_000):
            v = rng.integers(0, top, n)
            want = [max((j for j in range(i) if v[j] < v[i]), default=-1) for i in range(n)]
            assert suffixdedup.nearest_smaller(v).tolist() == want


def test_longest_previous():
    """Against all pairs of suffixes, within what a row of context shows."""
    import numpy as np

    rng = np.random.default_rng(1)
    base = rng.integers(1, 50, anchors.SPAN).astype(np.uint32)
    m = np.stack([base, base, np.where(np.arange(anchors.SPAN) < 70, base, 99), np.where(np.arange(anchors.SPAN) < 8, 77, base), np.where(np.arange(anchors.SPAN) > 80, 0, base)])
    position = np.arange(5)[:, None] * 1000 + np.arange(anchors.SPAN)
    flat, n, other = suffixdedup.longest_previous(m, position)
    got = dict(zip(flat.tolist(), n.tolist(), strict=True))
    starts = anchors.SPAN - anchors.LEAST + 1
    for r in range(5):
        for c in range(starts):
            best = 0
            for q in range(r):
                for d in range(anchors.SPAN):
                    k = 0
                    while c + k < anchors.SPAN and d + k < anchors.SPAN and m[r, c + k] == m[q, d + k] != 0:
                        k += 1
                    best = max(best, k)
            i = r * anchors.SPAN + c
            if best >= anchors.LEAST:
                assert min(best, 64) <= got[i] <= best
            else:
                assert i not in got
