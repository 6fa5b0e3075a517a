"""Operator 1: token ids as binary, by Simple-8b word-aligned coding."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexivane.llm.shared import binaries, ragged, slices

#: Place of the tokenizer's ranks; nothing of it is kept here.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Ids to a block. Each block begins at a word of its own, so blocks decode side by side.
BLOCK = 128
#: Values of a word and bits of a value by selector, the low 4 bits of a word. Selector 0 is the escape: its value is the next word, whole.
COUNT = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
SCHEMA = "doc_id bigint, n_tokens bigint, block_words array<int>, packed binary"
_CHUNK = 2048


def pack(ids: np.ndarray, counts: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes the ids of several documents, ``counts`` of them each.

    Gives the 64-bit words, how many words each document takes, and the words of each block. A document
    has ``ceil(count / block)`` blocks. Each word takes as many of its block's ids as one of the selectors
    holds; the last word of a block may hold fewer, the rest zeros.
    """
    counts = np.asarray(counts, np.int64)
    blocks = -(-counts // block)
    size = np.full(int(blocks.sum()), block, np.int64)
    ends = np.cumsum(blocks)[blocks > 0] - 1
    size[ends] = counts[blocks > 0] - (blocks[blocks > 0] - 1) * block
    begin = np.cumsum(size) - size
    out, lengths = [], []
    ids = np.asarray(ids).astype(np.uint64)
    for at in range(0, len(size), _CHUNK):
        n = size[at : at + _CHUNK]
        first, last = int(begin[at]), int(begin[at : at + _CHUNK][-1] + n[-1])
        w, k = _pack_blocks(ids[first:last], n, block)
        out.append(w)
        lengths.append(k)
    words = np.concatenate(out) if out else np.zeros(0, np.uint64)
    per_block = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
    total = np.concatenate([[0], np.cumsum(per_block)])
    edge = np.concatenate([[0], np.cumsum(blocks)])
    return words, np.diff(total[edge]), per_block


def _pack_blocks(ids: np.ndarray, n: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    rows = len(n)
    v = np.zeros((rows, block + 120), np.uint64)
    inside = np.arange(block) < n[:, None]
    v[:, :block][inside] = ids
    b = np.zeros((rows, block), np.uint8)
    wide = np.zeros(len(ids), np.uint8)
    for width in np.unique(BITS[1:-1]):
        wide += ids >> np.uint64(width) > 0  # the number of widths that are too small
    wide[ids >> np.uint64(60) > 0] = 15
    b[inside] = wide
    level = {int(w): i for i, w in enumerate(np.unique(BITS[1:-1]))} | {60: 14}

    def longer(a: np.ndarray, c: np.ndarray, by: int) -> np.ndarray:
        """The largest over a's window and c's, which begins ``by`` places on."""
        r = a.copy()
        if by < block:
            np.maximum(r[:, :-by], c[:, by:], out=r[:, :-by])
        return r

    most = {1: b}
    for k, (i, j) in {2: (1, 1), 3: (2, 1), 4: (2, 2), 5: (4, 1), 6: (4, 2), 7: (4, 3), 8: (4, 4), 10: (8, 2), 12: (8, 4), 15: (8, 7), 20: (12, 8), 30: (20, 10), 60: (30, 30), 120: (60, 60)}.items():
        most[k] = longer(most[i], most[j], i)
    sel = np.where(b > 14, 0, 15).astype(np.uint8)
    for s in range(14, 0, -1):
        sel[most[int(COUNT[s])] <= level[int(BITS[s])]] = s
    begins = np.zeros((rows, block), bool)
    live, p = np.flatnonzero(n > 0), np.zeros(rows, np.int64)
    while len(live):  # all blocks step at once, at most ``block`` times
        q = p[live]
        begins[live, q] = True
        q = q + COUNT[sel[live, q]]
        p[live] = q
        live = live[q < n[live]]
    r, c = np.nonzero(begins)
    s = sel[r, c]
    words = s.astype(np.uint64)
    for k in range(1, 16):
        at = np.flatnonzero(s == k)
        if not len(at) or not BITS[k]:
            continue
        w, flat = words[at], r[at] * v.shape[1] + c[at]
        for j in range(int(COUNT[k])):
            w |= v.ravel()[flat + j] << np.uint64(4 + j * int(BITS[k]))
        words[at] = w
    length = np.bincount(r, minlength=rows)
    if (escaped := np.flatnonzero(s == 0)).size:
        raw = v[r[escaped], c[escaped]]
        words = np.insert(words, escaped + 1, raw)
        length += np.bincount(r[escaped], minlength=rows)
    return words, length


def unpack(words: np.ndarray, per_block: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The ``n`` ids of one document from its words and its blocks' numbers of words; all blocks step at once."""
    out = np.zeros((len(per_block), block + 120), np.uint64)
    at = np.cumsum(per_block) - per_block
    end, p = at + per_block, np.zeros(len(per_block), np.int64)
    live = np.flatnonzero(at < end)
    while len(live):
        w = words[at[live]]
        s = (w & np.uint64(15)).astype(np.int64)
        for k in np.unique(s):
            who = live[s == k]
            if k == 0:
                out[who, p[who]] = words[at[who] + 1]
                at[who] += 1
            elif BITS[k]:
                shift = np.uint64(4) + np.arange(COUNT[k], dtype=np.uint64) * np.uint64(BITS[k])
                out[who[:, None], p[who][:, None] + np.arange(COUNT[k])] = w[s == k][:, None] >> shift & np.uint64((1 << int(BITS[k])) - 1)
        at[live] += 1
        p[live] += COUNT[s]
        live = live[at[live] < end[live]]
    return out[:, :block].ravel()[:n]


@lru_cache(4)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """Token ids of each text as Simple-8b words: ``doc_id, n_tokens, block_words, packed``.

    ``packed`` is the words in little-endian order, ``block_words`` the number of words of each block of 128
    ids. One row in gives one row out, repeated rows and null ids too; a null or empty text has no tokens, no
    blocks and an empty ``packed``. Other columns are dropped. One narrow pass: no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(tokenizer).encode_to_numpy
        for whole in batches:
            for batch in slices(whole, 1):
                ids = [encode(t, disallowed_special=()) if t else np.zeros(0, np.uint32) for t in batch.column(1).to_pylist()]
                counts = np.array([len(x) for x in ids], np.int64)
                words, per_doc, per_block = pack(np.concatenate(ids), counts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(counts), ragged(per_block, -(-counts // BLOCK), pa.int32()), binaries(words.astype("<u8").view(np.uint8), per_doc * 8)],
                    ["doc_id", "n_tokens", "block_words", "packed"],
                )

    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, SCHEMA)


def decode_documents(packed: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Back from ``encode_documents``: ``doc_id, ids, text``. A document without tokens gives no ids and an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = _encoding(tokenizer).decode
        for b in batches:
            ids = [unpack(np.frombuffer(d, "<u8"), np.array(k, np.int64), n) for n, k, d in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64())), pa.array([decode(x.tolist()) for x in ids], pa.string())], ["doc_id", "ids", "text"])

    return packed.select("doc_id", "n_tokens", "block_words", "packed").mapInArrow(run, "doc_id bigint, ids array<bigint>, text string")
