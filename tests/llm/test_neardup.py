import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexivane.llm import neardup, shared
from lexivane.llm.graph import components
from lexivane.llm.shared import durable
from tests.llm import brute
from tests.llm.fixtures import ids, odd_rows, prose, row, table


def edited(text, share, seed):
    rng = random.Random(seed)
    return " ".join(w if rng.random() > share else f"new{rng.random()}" for w in text.split())


def test_all_pairs_within_the_distance(spark):
    """The join finds exactly what comparing all signatures finds, up to the largest distance."""
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 16, (6, neardup.SLOTS)).astype("<u2")
    sigs = [base[i % 6].copy() for i in range(240)]
    for s in sigs:
        at = rng.permutation(neardup.SLOTS)[: rng.integers(0, 13)]
        s[at] = rng.integers(0, 1 << 16, len(at))
    m = np.unique(np.stack(sigs), axis=0)
    df = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(m)], "rep bigint, sig binary")
    for most in (neardup.MAX_DISTANCE, 9):
        want = {(i, j, int((m[i] != m[j]).sum())) for i in range(len(m)) for j in range(i) if (m[i] != m[j]).sum() <= most}
        want = {(j, i, d) for i, j, d in want}
        assert {tuple(r) for r in neardup.hamming_pairs(df, most).collect()} == want
    with pytest.raises(ValueError, match="guarantee"):
        neardup.hamming_pairs(df, neardup.MAX_DISTANCE + 1)


def same_pairs(m, most):
    return {(j, i, int((m[i] != m[j]).sum())) for i in range(len(m)) for j in np.flatnonzero((m[:i] != m[i]).sum(1) <= most).tolist()}


@pytest.mark.parametrize("bucket", [50, 4])
def test_large_sets(spark, monkeypatch, bucket):
    """Sets over the limit: the same pairs, and the same groups, by further keys and by blocks."""
    monkeypatch.setattr(neardup, "BUCKET", bucket)
    rng = np.random.default_rng(4)
    m = rng.integers(0, 1 << 16, (300, neardup.SLOTS)).astype("<u2")
    m[:, :5] = 7  # all share a chunk
    m[100:200, 5:15] = 9  # and some three
    for i in range(0, 300, 3):
        m[i + 1] = m[i]
        m[i + 1, rng.permutation(neardup.SLOTS)[: rng.integers(0, 20)]] += 1
    m = np.unique(m, axis=0)
    df = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(m)], "rep bigint, sig binary")
    want = same_pairs(m, neardup.MAX_DISTANCE)
    assert {tuple(r) for r in neardup.hamming_pairs(df).collect()} == want
    joined = {r["node"]: r["root"] for r in components(neardup._pairs(df, neardup.MAX_DISTANCE, False).select("u", "v")).collect()}
    root = brute.components(range(len(m)), [p[:2] for p in want])
    assert joined == {n: r for n, r in root.items() if sum(x == r for x in root.values()) > 1}


def test_many_unrelated_under_one_key(spark):
    """100,000 signatures that share a chunk and nothing else, and a few near ones among them."""
    rng = np.random.default_rng(5)
    m = rng.integers(0, 1 << 16, (100_000, neardup.SLOTS)).astype("<u2")
    m[:, :5] = 3
    for i in range(10):
        m[50_000 + i] = m[i]
        m[50_000 + i, 5:22] += 1
    rows = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(m)], "rep bigint, sig binary").repartition(4)
    got = {(r["u"], r["v"]) for r in neardup._pairs(durable(rows, "reps"), neardup.MAX_DISTANCE, False).collect()}
    assert got == {(i, 50_000 + i) for i in range(10)}


def test_repeated_rows_that_differ_elsewhere(spark):
    rows = [row(1, "a b c d", "z"), row(1, "a b c d", "b"), row(1, "a b c d", "c")]
    for part in (1, 3):
        assert [r["source"] for r in neardup.drop_near_duplicates(table(spark, rows).repartition(part)).collect()] == ["b"]


def test_pigeonhole():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 16, (300, neardup.SLOTS)).astype(np.uint16)
    b = a.copy()
    for s in b:
        s[rng.permutation(neardup.SLOTS)[: neardup.MAX_DISTANCE]] += 1
    assert (neardup.chunk_keys(a) == neardup.chunk_keys(b)).any(1).all()


def test_groups_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sigs = neardup.signatures(docs).collect()
    m = np.array([np.frombuffer(r["sig"], "<u2") for r in sigs])
    names = [r["doc_id"] for r in sigs]
    pairs = [(names[i], names[j]) for i in range(len(m)) for j in np.flatnonzero((m[:i] != m[i]).sum(1) <= neardup.MAX_DISTANCE)]
    root = brute.components(names, pairs)
    groups = {}
    for n, r in root.items():
        groups.setdefault(r, []).append(n)
    want = {(n, min(g), len(g)) for g in groups.values() if len(g) > 1 for n in g}
    assert {tuple(r) for r in neardup.near_duplicates(docs).collect()} == want


def test_catches_copies_and_leaves_others(spark):
    base = [prose(i, 150) for i in range(30)]
    rows = [row(i, t) for i, t in enumerate(base)]
    rows += [row(100 + i, t.upper().replace(" ", "\n")) for i, t in enumerate(base[:5])]
    rows += [row(200 + i, edited(t, 0.04, i)) for i, t in enumerate(base[5:15])]
    got = {r["doc_id"]: r["keep_doc_id"] for r in neardup.near_duplicates(table(spark, rows)).collect()}
    assert got == {**{i: i for i in range(15)}, **{100 + i: i for i in range(5)}, **{200 + i: 5 + i for i in range(10)}}
    left = neardup.drop_near_duplicates(table(spark, rows))
    assert ids(left) == list(range(30))
    assert left.columns == table(spark, rows).columns


def test_many_copies(spark):
    rows = [row(i, prose(1, 80)) for i in range(400)] + [row(1000 + i, edited(prose(1, 80), 0.02, i)) for i in range(60)]
    out = neardup.near_duplicates(table(spark, rows, clash=False)).collect()
    assert {r["n_docs"] for r in out} == {460}
    assert neardup.drop_near_duplicates(table(spark, rows)).count() == 1


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(shared, "BROADCAST_BYTES", -1)
    rows = [row(i, prose(i // 2, 80)) for i in range(12)] + [row(0, prose(0, 80))]
    assert ids(neardup.drop_near_duplicates(table(spark, rows))) == [0, 2, 4, 6, 8, 10]


def test_odd(spark):
    got = sorted(tuple(r) for r in neardup.near_duplicates(table(spark)).collect())
    assert got == [(7, 7, 2), (7, 7, 2)]  # the repeated row
    left = neardup.drop_near_duplicates(table(spark))
    assert left.count() == len(odd_rows()) - 1  # texts without words stay
    assert neardup.near_duplicates(table(spark, [])).count() == 0
    assert neardup.drop_near_duplicates(table(spark, [])).count() == 0
    nulls = [row(None, "a b c d e f"), row(3, "A b c, d e f")]
    assert [r["doc_id"] for r in neardup.drop_near_duplicates(table(spark, nulls)).collect()] == [3]
    short = [row(1, "Hello"), row(2, "hello!"), row(3, "other")]
    assert ids(neardup.drop_near_duplicates(table(spark, short))) == [1, 3]


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(400 + i, 401 + i) for i in range(40)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "u bigint, v bigint")).collect()}
    want = brute.components({x for a, b in pairs for x in (a, b)}, pairs)
    assert got == {n: r for n, r in want.items() if any(n in p and p[0] != p[1] for p in pairs)}


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0
    assert components(spark.range(3).select(F.col("id").alias("u"), F.col("id").alias("v"))).count() == 0
