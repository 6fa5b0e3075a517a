"""What operators 3 and 9 share: winnowed anchors, those that recur, where their runs of words occur first, and passages along these.

A *place* is a document (id, key) and a word of it, as 24 bytes that sort in that order. Each run of LEAST words is
looked at around one anchor, its least GRAM-word hash, which all its copies share. Equal surroundings of an
anchor, its *context*, are one class however many documents have them, so only different contexts are compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivane.llm.shared import binaries, durable, forget, row_key, runs, slices, small, utf8
from lexivane.llm.wordhash import Words, mix, ngrams, powers, whole, words

#: Words of the shortest repeat.
LEAST = 50
#: Words of an anchor. Each run of LEAST words holds an anchor, the same one in all its copies.
GRAM = 12
#: Words kept before an anchor, and in all: enough for any run of LEAST words that holds it.
LEFT = LEAST - GRAM
SPAN = 2 * LEAST - GRAM
#: Contexts of one anchor that one task compares at once. Of anchors with more, each run of words is grouped by itself; the result is the same.
MOST = 8192
_LAST = (1 << 63) - 1
_SIGN = np.uint64(1 << 63)
_Q = np.uint64(0xD1B54A32D192ED03)
_Q_INV = np.uint64(pow(int(_Q), -1, 1 << 64))
_WIDTH = LEAST - GRAM + 1
FOUND = "anchor bigint, ctx bigint, c0 int, c1 int, e_doc bigint, e_key bigint, e_start bigint, a_doc bigint, a_key bigint, a_start bigint"
SPANS = "key bigint, doc bigint, start bigint, stop bigint, last boolean, other_key bigint, other_doc bigint, other_start bigint"


def _sliding(a: np.ndarray, width: int, fold) -> np.ndarray:
    """``fold`` over each run of ``width`` values."""
    have, step = a, 1
    while step * 2 <= width:
        have, step = fold(have[:-step], have[step:]), step * 2
    return fold(have[: len(a) - width + 1], have[width - step :]) if step < width else have


def winnow(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Place and hash of each run of GRAM words that is the least, and of equals the first, in some run of LEAST words, and the first and last word these runs begin at.

    So each run of LEAST words has one anchor, at the same word of it wherever it occurs.
    """
    g = ngrams(w.hash, GRAM)
    if len(w.hash) < LEAST:
        z = np.zeros(0, np.int64)
        return z, g[:0], z, z
    least = _sliding(g, _WIDTH, np.minimum)
    least[~whole(w.off, LEAST)] = 0
    pad = np.zeros(_WIDTH - 1, np.uint64)
    at = np.flatnonzero(_sliding(np.concatenate([pad, least, pad]), _WIDTH, np.maximum) == g)
    value = g[at]
    padded = np.concatenate([pad, least, pad])
    first, last = np.full(len(at), -1), np.full(len(at), -1)
    for j in range(_WIDTH):  # run starts at - LEFT + j
        holds = padded[at + j] == value
        last[holds] = j
        first[holds & (first < 0)] = j
    order = np.argsort(value, kind="stable")
    equal = np.flatnonzero(value[order][1:] == value[order][:-1]) + 1
    first[order[equal]] = np.maximum(first[order[equal]], at[order[equal - 1]] + 1 - at[order[equal]] + LEFT)
    some = first <= last
    at, value, first, last = (x[some] for x in (at, value, first, last))
    return at, value, at - LEFT + first, at - LEFT + last


def as_places(doc: np.ndarray, key: np.ndarray, word: np.ndarray) -> pa.Array:
    """Places as bytes that sort as their parts do."""
    parts = np.stack([doc.astype(np.int64).view(np.uint64) ^ _SIGN, key.astype(np.int64).view(np.uint64) ^ _SIGN, word.astype(np.uint64)], axis=1)
    return binaries(parts.astype(">u8").view(np.uint8).ravel(), np.full(len(parts), 24))


def of_places(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, keys and words of ``as_places``."""
    data, _ = utf8(col)
    parts = data.view(">u8").reshape(-1, 3).astype(np.uint64)
    return (parts[:, 0] ^ _SIGN).view(np.int64), (parts[:, 1] ^ _SIGN).view(np.int64), parts[:, 2].view(np.int64)


# the word of an anchor's place carries the offsets of its first and last run's start, and whether that run ends the document
def _packed(at, lo, hi, last) -> np.ndarray:
    return at << 13 | lo << 7 | hi << 1 | last


def unpacked(word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return word >> 13, word >> 7 & 63, word >> 1 & 63, word & 1


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(row_key(id_col, text_col).alias("key"), F.coalesce(docs[id_col].cast("bigint"), F.lit(_LAST)).alias("doc"), docs[text_col].cast("string").alias("text")).where(F.length("text") >= 2 * LEAST - 1)


def _anchors(w: Words, doc: np.ndarray, key: np.ndarray, d: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Hash of the context of each anchor, and its place."""
    total = np.zeros(len(w.hash) + 1, np.uint64)
    np.cumsum(w.hash * powers(_Q, len(w.hash)), out=total[1:])
    begin, end = np.maximum(w.off[d], at - LEFT), np.minimum(w.off[d + 1], at + SPAN - LEFT)
    ctx = mix((total[end] - total[begin]) * powers(_Q_INV, len(w.hash))[begin] + mix((at - begin).astype(np.uint64) << np.uint64(32) | (end - begin).astype(np.uint64)))
    base = at - LEFT
    return ctx, as_places(doc[d], key[d], _packed(at - w.off[d], lo - base, hi - base, (hi + LEAST == w.off[d + 1]).astype(np.int64)))


def _recurring(docs: DataFrame) -> DataFrame:
    """Anchors that two different places have: ``anchor``. Combines before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for all_rows in batches:
            for b in slices(all_rows, 2):
                w = words(*utf8(b.column(2)))
                at, g, _, _ = winnow(w)
                d = np.searchsorted(w.off, at, "right") - 1
                key = b.column(0).to_numpy().view(np.uint64)
                p = mix(key[d] * np.uint64(3) + (at - w.off[d]).astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(p.view(np.int64))], ["anchor", "p"])

    return docs.mapInArrow(run, "anchor bigint, p bigint").groupBy("anchor").agg(F.min("p").alias("p"), F.max("p").alias("q")).where("p <> q").select("anchor")


def _members(docs: DataFrame, recurring: DataFrame) -> DataFrame:
    """``anchor, ctx, place`` of each anchor that recurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for all_rows in batches:
            for b in slices(all_rows, 2):
                w = words(*utf8(b.column(2)))
                at, g, lo, hi = winnow(w)
                d = np.searchsorted(w.off, at, "right") - 1
                ctx, place = _anchors(w, b.column(1).to_numpy(), b.column(0).to_numpy(), d, at, lo, hi)
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(ctx.view(np.int64)), place], ["anchor", "ctx", "place"])

    return docs.mapInArrow(run, "anchor bigint, ctx bigint, place binary").join(small(recurring, 16), "anchor")


def _around(docs: DataFrame, reps: DataFrame, words_too: bool) -> DataFrame:
    """``anchor, ctx, first, last, data`` of classes, with the context's words as 32-bit hashes, 0 for none, or else its runs' 64-bit hashes.

    Only the texts of the documents that classes are first in are moved.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for all_rows in batches:
            for b in slices(all_rows, 0, 1 << 19):
                w = words(*utf8(b.column(0)))
                lists = b.column(1)
                size = np.diff(np.frombuffer(lists.buffers()[1], np.int32, len(lists) + 1, 4 * lists.offset))
                d, flat = np.repeat(np.arange(len(size)), size), lists.flatten()
                short = (w.hash >> np.uint64(32)).astype(np.uint32)
                short[short == 0] = 1
                long = np.concatenate([ngrams(w.hash, LEAST), np.zeros(LEAST, np.uint64)])
                for i in range(0, len(flat), 8192):
                    part, e = flat.slice(i, 8192), d[i : i + 8192]
                    at, lo, hi, _ = unpacked(of_places(part.field("first"))[2])
                    at = at + w.off[e]
                    if words_too:
                        p = at[:, None] + np.arange(-LEFT, SPAN - LEFT)
                        inside = (p >= w.off[e][:, None]) & (p < w.off[e + 1][:, None])
                        data = binaries(np.where(inside, short[np.where(inside, p, 0)], 0).astype("<u4").view(np.uint8).ravel(), np.full(len(e), 4 * SPAN))
                    else:
                        n = hi - lo + 1
                        p = np.repeat(at - LEFT + lo - np.cumsum(n) + n, n) + np.arange(n.sum())
                        data = binaries(long[p].astype("<u8").view(np.uint8), 8 * n)
                    yield pa.RecordBatch.from_arrays([*(part.field(c) for c in ("anchor", "ctx", "first", "last")), data], ["anchor", "ctx", "first", "last", "data"])

    by = reps.groupBy(F.conv(F.hex(F.substring("first", 9, 8)), 16, -10).cast("bigint").bitwiseXOR(F.lit(-1 << 63)).alias("in_key")).agg(F.collect_list(F.struct("anchor", "ctx", "first", "last")).alias("classes"))
    by = durable(by, "classes")
    mine = docs.join(small(by.select("in_key"), 16), F.col("key") == F.col("in_key"), "left_semi")
    return mine.join(by, F.col("key") == F.col("in_key")).select("text", "classes").mapInArrow(run, "anchor bigint, ctx bigint, first binary, last binary, data binary")


def run_hashes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The runs' hashes of classes as ``_around`` gives them, and how many each class has."""
    data, off = utf8(col)
    return data.view("<u8").astype(np.uint64), np.diff(off) // 8


def rle(anchor, ctx, c, e, a) -> pa.RecordBatch:
    """Runs at consecutive offsets ``c`` of a context whose first places ``e`` and last places ``a`` (documents, keys, words) go along, as one. Rows are in order."""
    same = np.zeros(len(c), bool)
    if len(c):
        same[1:] = (ctx[1:] == ctx[:-1]) & (anchor[1:] == anchor[:-1]) & (c[1:] == c[:-1] + 1)
        for _, key, word in (e, a):
            same[1:] &= (key[1:] == key[:-1]) & (word[1:] == word[:-1] + 1)
    head = np.flatnonzero(~same)
    tail = np.concatenate([head[1:], [len(c)]])[: len(head)] - 1
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor[head], ctx[head], c[head].astype(np.int32), c[tail].astype(np.int32), *(x[head] for x in (*e, *a)))], ["anchor", "ctx", "c0", "c1", "e_doc", "e_key", "e_start", "a_doc", "a_key", "a_start"])


def _alone(classes: DataFrame) -> DataFrame:
    """All runs of an anchor's only context, first and last at its first and last place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e, a = of_places(b.column(2)), of_places(b.column(3))
            at, lo, hi, _ = unpacked(e[2])
            columns = [b.column(0), b.column(1), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), *(pa.array(x) for x in (e[0], e[1], at - LEFT + lo, a[0], a[1], (a[2] >> 13) - LEFT + lo))]
            yield pa.RecordBatch.from_arrays(columns, ["anchor", "ctx", "c0", "c1", "e_doc", "e_key", "e_start", "a_doc", "a_key", "a_start"])

    return classes.select("anchor", "ctx", "first", "last").mapInArrow(run, FOUND)


def _apart(rows: DataFrame) -> DataFrame:
    """As the buckets find it, each run of words grouped by itself: for anchors with any number of contexts."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for all_rows in batches:
            for at in range(0, all_rows.num_rows, 2048):
                b = all_rows.slice(at, 2048)
                h, n = run_hashes(b.column(4))
                row = np.repeat(np.arange(len(n)), n)
                places = []
                for col in (b.column(2), b.column(3)):
                    doc, key, word = of_places(col)
                    anchored, lo, _, _ = unpacked(word)
                    c = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + lo[row]
                    places.append(as_places(doc[row], key[row], anchored[row] - LEFT + c))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array(c.astype(np.int32)), *places], ["run", "anchor", "ctx", "c", "e", "a"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield rle(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy().astype(np.int64), of_places(b.column(3)), of_places(b.column(4)))

    single = durable(rows.mapInArrow(each, "run bigint, anchor bigint, ctx bigint, c int, e binary, a binary"), "runs")
    ends = single.groupBy("run").agg(F.min("e").alias("e"), F.max("a").alias("a")).where("e <> a")
    back = single.select("run", "anchor", "ctx", "c").join(ends, "run").select("anchor", "ctx", "c", "e", "a")
    return back.repartition("anchor", "ctx").sortWithinPartitions("anchor", "ctx", "c").mapInArrow(joined, FOUND)


def found(docs: DataFrame, members: DataFrame, bucket: Callable, words_too: bool) -> tuple[DataFrame, DataFrame]:
    """For each context the first and the last place of its runs that have more than one: a table like FOUND; and one of classes to forget later.

    ``bucket`` does that for anchors with up to MOST contexts: it gets anchor, ctx, first, last and data of whole anchors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in runs(batches, rows=2048):
            yield bucket(b)

    classes = durable(members.groupBy("anchor", "ctx").agg(F.min("place").alias("first"), F.max("place").alias("last")), "contexts")
    many = durable(classes.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1"), "anchors")
    alone = _alone(classes.join(small(many.select("anchor"), 16), "anchor", "left_anti").where("first <> last"))
    some = classes.join(small(many.where(F.col("k") <= MOST).select("anchor"), 16), "anchor")
    near = _around(docs, some, words_too).repartition("anchor").sortWithinPartitions("anchor", "first").mapInArrow(run, FOUND)
    out = alone.unionByName(near)
    huge = many.where(F.col("k") > MOST).select("anchor")
    if not huge.isEmpty():
        out = out.unionByName(_apart(_around(docs, classes.join(small(huge, 16), "anchor"), False)))
    return durable(out, "found"), classes


def passages(texts: DataFrame, bucket: Callable, words_too: bool, firsts: bool) -> DataFrame:
    """Passages of ``keyed`` documents, each there once, whose runs of LEAST words occur first in another place each, along one diagonal: SPANS, written.

    ``stop`` is the word after the last, ``last`` says whether that is the document's end. With ``firsts`` those
    that occur there first themselves are paired with the place where they occur last.
    """

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for all_rows in batches:
            for at in range(0, all_rows.num_rows, 8192):
                b = all_rows.slice(at, 8192)
                doc, key, word = of_places(b.column(0))
                anchored, _, hi, ends = unpacked(word)
                c0, c1, e_doc, e_key, e_start, a_doc, a_key, a_start = (x.to_numpy().astype(np.int64) for x in b.columns[1:])
                start, stop = anchored - LEFT + c0, anchored - LEFT + c1
                own = (e_key == key) & (e_start == start)
                keep = ~own | ((a_key != key) | (a_start != start)) & firsts
                o_key, o_doc, o_start = np.where(own, a_key, e_key), np.where(own, a_doc, e_doc), np.where(own, a_start, e_start)
                columns = (key, start - o_start, start, stop, (ends == 1) & (c1 == hi), o_key, o_doc, doc)
                yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in columns], ["key", "diagonal", "start", "stop", "last", "other_key", "other_doc", "doc"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None  # a document's rows go on in the next batch
        for b in batches:
            if not b.num_rows:
                continue
            key, diagonal, start, stop, last, o_key, o_doc, doc = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            rows = [key, doc, start.astype(np.int64), stop.astype(np.int64), last, o_key, o_doc, diagonal]
            if carry is not None:
                rows = [np.concatenate([c, r]) for c, r in zip(carry, rows, strict=True)]
            key, doc, start, stop, last, o_key, o_doc, diagonal = rows
            same = np.concatenate([[False], (key[1:] == key[:-1]) & (o_key[1:] == o_key[:-1]) & (diagonal[1:] == diagonal[:-1])])
            base = np.cumsum(~same) << 40
            reach = np.maximum.accumulate(base + stop)
            new = ~same
            new[1:] |= base[1:] + start[1:] > reach[:-1] + 1
            head = np.flatnonzero(new)
            end = np.concatenate([head[1:], [len(key)]])
            rows = [key[head], doc[head], start[head], reach[end - 1] - base[head], np.logical_or.reduceat(last, head), o_key[head], o_doc[head], diagonal[head]]
            carry = [x[-1:] for x in rows]
            yield _spans(*(x[:-1] for x in rows))
        if carry is not None:
            yield _spans(*carry)

    recurring = durable(_recurring(texts), "recurring")
    members = durable(_members(texts, recurring), "members")
    where, classes = found(texts, members, bucket, words_too)
    schema = "key bigint, diagonal bigint, start bigint, stop bigint, last boolean, other_key bigint, other_doc bigint, doc bigint"
    spans = members.join(where, ["anchor", "ctx"]).select("place", "c0", "c1", "e_doc", "e_key", "e_start", "a_doc", "a_key", "a_start").mapInArrow(placed, schema)
    order = ("key", "other_key", "diagonal", "start", "stop")
    out = durable(spans.repartition("key").sortWithinPartitions(*order).mapInArrow(merged, SPANS), "passages")
    forget(recurring, members, where, classes)
    return out


def _spans(key, doc, start, stop, last, o_key, o_doc, diagonal) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (key, doc, start, stop + LEAST, last, o_key, o_doc, start - diagonal)], ["key", "doc", "start", "stop", "last", "other_key", "other_doc", "other_start"])


def id_or_null(name: str, alias: str):
    """A document's id, null where it has none."""
    return F.when(F.col(name) != _LAST, F.col(name)).alias(alias)
