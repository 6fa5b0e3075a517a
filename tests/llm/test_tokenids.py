import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexivane.llm.tokenids import BITS, BLOCK, COUNT, decode_documents, encode_documents, pack, unpack
from tests.llm.fixtures import odd_rows, table


def round_trip(lists):
    counts = np.array([len(x) for x in lists], np.int64)
    flat = np.array([v for x in lists for v in x], np.uint64)
    words, per_doc, per_block = pack(flat, counts)
    w = b = 0
    for x, n in zip(lists, per_doc.tolist(), strict=True):
        k = -(-len(x) // BLOCK)
        assert unpack(words[w : w + n], per_block[b : b + k], len(x)).tolist() == list(x)
        w, b = w + n, b + k
    assert w == len(words)
    assert b == len(per_block)
    return words


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 64).flatmap(lambda b: st.integers(0, (1 << b) - 1 if b else 0)), max_size=300), max_size=5))
def test_round_trip(lists):
    round_trip(lists)


@pytest.mark.parametrize("bits", range(65))
def test_each_width(bits):
    top = (1 << bits) - 1 if bits else 0
    for n in (1, 2, 59, 60, 61, 127, 128, 129, 500):
        round_trip([[top] * n, [], [0] * n, [top, 0] * n])


def test_words_are_full():
    """Each word but the last of a block takes as many ids as a selector can: 7 bits go 8 to a word."""
    assert len(round_trip([[127] * BLOCK])) == BLOCK // 8
    assert len(round_trip([[0] * BLOCK])) == 2  # 120 and 8
    assert len(round_trip([[1 << 63] * 4])) == 8  # an escape each
    assert all(c * b <= 60 for c, b in zip(COUNT[1:].tolist(), BITS[1:].tolist(), strict=True))


def test_documents(spark):
    docs = table(spark)
    packed = encode_documents(docs)
    assert packed.columns == ["doc_id", "n_tokens", "block_words", "packed"]
    got = sorted(r["text"] for r in decode_documents(packed).collect())
    assert got == sorted(r[1] or "" for r in odd_rows())
    rows = packed.collect()
    assert len(rows) == len(odd_rows())
    for r in rows:
        assert len(r["packed"]) == 8 * sum(r["block_words"])
        assert len(r["block_words"]) == -(-r["n_tokens"] // BLOCK)
    assert encode_documents(docs.where("false")).count() == 0


def test_real_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    back = {r["doc_id"]: r["text"] for r in decode_documents(encode_documents(docs)).collect()}
    assert back == {r["doc_id"]: r["text"] for r in docs.collect()}
