import math

import pytest
from pyspark.sql import functions as F

from lexivane.errors import RowError
from lexivane.operators import encode, lookup, similarity, vocab


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def as_dict(df):
    return {r[0]: r[1] for r in df.collect()}


def model(texts, known=()):
    ids = dict(known)
    return [[ids.setdefault(w, len(ids) + 1) for w in t.lower().split()] for t in texts], ids


TEXTS = ["a b a", "c b", "", "B d\nd e", "a " * 40 + "z"]


def test_dictionary_and_vectors(spark):
    d = docs(spark, *TEXTS)
    v = vocab.build(d)
    want, ids = model(TEXTS)
    assert as_dict(v) == ids
    got = {r["doc_id"]: r for r in encode.vectors(d, v).collect()}
    assert [got[i]["encoded_data"] for i in range(len(TEXTS))] == want
    assert all(got[i]["norm2"] == sum(x * x for x in w) for i, w in enumerate(want))


def test_dictionary_over_chunks(spark):
    rows = [(i * 3000, f"w{i} w{i - 1} w{i % 7}") for i in range(30)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert as_dict(vocab.build(d)) == model([t for _, t in rows])[1]


def test_extend_keeps_ids(spark):
    first, more = docs(spark, "a b"), docs(spark, "c a", "d c")
    v = vocab.build(first)
    assert as_dict(vocab.extend(v, more)) == {"c": 3, "d": 4}
    assert as_dict(vocab.extend(v, first)) == {}
    assert as_dict(vocab.build(docs(spark))) == {}


def test_decode(spark):
    d = docs(spark, *TEXTS)
    v = vocab.build(d)
    assert as_dict(encode.decode(encode.vectors(d, v), v)) == {i: " ".join(t.lower().split()) for i, t in enumerate(TEXTS)}
    odd = spark.createDataFrame([(1, [1, 99, 2]), (2, [])], "doc_id bigint, encoded_data array<bigint>")
    assert as_dict(encode.decode(odd, v)) == {1: "a  b", 2: ""}


@pytest.mark.parametrize(("q", "d", "want"), [([1, 2], [1, 2, 2], 5 / (math.sqrt(5) * 3)), ([], [1], 0.0), ([1], [], 0.0), ([1], [7], 1.0), ([1], None, 0.0), ([3, 1, 2], [3], 3 / math.sqrt(14))])
def test_cosine(spark, q, d, want):
    df = spark.createDataFrame([(d, sum(x * x for x in d) if d is not None else None)], "encoded_data array<bigint>, norm2 bigint")
    assert similarity.scored(df, q).first()["score"] == pytest.approx(want, abs=1e-9)


def test_query_ids(spark):
    v = vocab.build(docs(spark, "a b c"))
    assert similarity.query_ids(["z", "b", "y", "z"], v) == ([4, 2, 5, 4], [("z", 4), ("y", 5)])
    assert similarity.query_ids([], v) == ([], [])
    assert similarity.query_ids(["q"], vocab.build(docs(spark))) == ([1], [("q", 1)])
    assert similarity.query_words(spark, "The the Cat of") == ["the", "cat"]


def test_top(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate([0.5, 0.0, 0.5, 0.9])], "doc_id bigint, score double")
    order = lambda k: [r["doc_id"] for r in similarity.top(df, k, "doc_id").collect()]
    assert order(10) == [3, 0, 2, 1]
    assert [order(k) for k in range(4)] == [[3, 0, 2, 1][:k] for k in range(4)]
    with pytest.raises(RowError):
        similarity.top(df, -1, "doc_id")


def test_scores_between_zero_and_one(spark):
    d = docs(spark, *TEXTS)
    v = vocab.build(d)
    e = encode.vectors(d, v)
    for text in TEXTS:
        if not text:
            continue
        ids, _ = similarity.query_ids(text.lower().split(), v)
        s = as_dict(similarity.scored(e, ids).select("doc_id", "score"))
        assert all(0 <= x <= 1 for x in s.values())
        assert s[TEXTS.index(text)] == pytest.approx(1)


def test_top_k_moves_no_corpus(spark):
    df = spark.range(100).select(F.col("id").alias("doc_id"), F.rand(1).alias("score"))
    plan = similarity.top(df, 3, "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_no_number_is_too_large(spark):
    top = (1 << 63) - 1
    rows = [(top, "b a"), (-5, "c b"), (top - 1, "d")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert as_dict(vocab.build(d)) == {"c": 1, "b": 2, "d": 3, "a": 4}
    v = spark.createDataFrame([("a", 3_100_000_000), ("b", 1 << 62)], "word string, word_id bigint")
    e = encode.vectors(docs(spark, "a a", "b a"), v)
    got = as_dict(similarity.scored(e, [1 << 62, 3_100_000_000]).select("doc_id", "score"))
    assert got[1] == pytest.approx(1)
    assert 0 < got[0] <= 1


def test_places_beyond_sixteen_million(spark):
    words = spark.createDataFrame([(1, 1 << 25, "late"), (1, 1 << 24, "early"), (2, 0, "next")], "doc_id bigint, pos bigint, word string")
    assert as_dict(vocab.numbered(vocab.first_places(words))) == {"early": 1, "late": 2, "next": 3}


def test_sums_beyond_doubles_are_exact(spark):
    v = spark.createDataFrame([("a", 94_906_267), ("b", 1)], "word string, word_id bigint")
    e = encode.vectors(docs(spark, "a b", "a " * 900 + "b", ""), v)
    want = [94_906_267**2 + 1, 900 * 94_906_267**2 + 1, 0]
    assert as_dict(encode.lengths(e).select("doc_id", "norm2")) == dict(enumerate(want))
    assert as_dict(e.select("doc_id", "norm2")) == {i: float(x) for i, x in enumerate(want)}


@pytest.mark.parametrize("common", [0, 2, 1 << 17])
def test_rare_words_come_back_to_their_places(spark, monkeypatch, common):
    monkeypatch.setattr(lookup, "COMMON", common)
    texts = ["a b a", "c b", "", None, "B d\nd e", "a b a"]
    d = spark.createDataFrame([(i if i < 5 else None, x) for i, x in enumerate(texts)] + [(0, "e c e"), (1, "c b")], "doc_id bigint, text string").repartition(3)
    v = spark.createDataFrame([(w, i + 1) for i, w in enumerate("abcd")], "word string, word_id bigint")
    got = sorted(((r[0], r[1]) for r in encode.vectors(d, v).select("doc_id", "encoded_data").collect()), key=str)
    assert got == sorted([(0, [1, 2, 1]), (1, [3, 2]), (2, []), (3, []), (4, [2, 4, 4]), (None, [1, 2, 1]), (0, [3]), (1, [3, 2])], key=str)
    odd = spark.createDataFrame([(1, [1, 99, 4]), (2, []), (3, None), (4, [3, None])], "doc_id bigint, encoded_data array<bigint>")
    assert as_dict(encode.decode(odd, v)) == {1: "a  d", 2: "", 3: "", 4: "c "}


def test_tokens_arent_exploded_before_shuffles(spark):
    d = docs(spark, "a b c")
    v = vocab.build(d).persist()
    plan = encode.decode(encode.vectors(d, v), v)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan.split("InMemoryRelation")[0]
    assert as_dict(encode.decode(encode.vectors(d, v), v)) == {0: "a b c"}
