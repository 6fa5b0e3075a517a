"""Operator 4: related documents packed into windows along paths of a nearest-neighbour graph."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexivane.llm.graph import components
from lexivane.llm.neardup import shingles
from lexivane.llm.shared import durable, forget, row_key, runs, slices, small, utf8
from lexivane.llm.wordhash import SPACED, mix, words

#: Tokens (words) to a window, and neighbours of a document.
LENGTH, NEIGHBOURS = 2048, 4
#: Bins of a sketch, of which so many also bring documents together; the least likeness of neighbours (Jaccard, in ten thousandths).
BINS, SLOTS, LEAST_ALIKE = 128, 32, 600
#: Nodes that share a slot are compared all with all: up to FEW pair by pair, more of them with BLOCK at a time, and over PART in several tasks.
FEW, BLOCK, PART = 64, 4096, 1 << 16
#: Nodes to one walk: larger components are walked in parts, whose paths are then joined by walks over these.
WALK, HOPS = 1_000_000, 3
#: Documents to a lane, lanes at least, and steps of a path that stay in one lane. Lanes are filled side by side; windows go on from one to the next.
LANE, LANES, STEPS = 200_000, 64, 1 << 16
SCHEMA = "key bigint, doc_id bigint, n_tokens bigint, sketch binary"


def sketch(values: np.ndarray, count: np.ndarray) -> np.ndarray:
    """For each text the least of its shingles' hashes in each of BINS bins, 31 bits of it and a bit that says that there is one; 0 for an empty bin."""
    out = np.full(len(count) * BINS, 0xFFFFFFFF, np.uint32)
    h = mix(values * np.uint64(0x9E3779B97F4A7C15) + np.uint64(4))
    bin_ = np.repeat(np.arange(len(count)) * BINS, count) + (h & np.uint64(BINS - 1)).astype(np.int64)
    np.minimum.at(out, bin_, (h >> np.uint64(33)).astype(np.uint32))
    out[out != 0xFFFFFFFF] |= np.uint32(1 << 31)
    out[out == 0xFFFFFFFF] = 0
    return out.reshape(-1, BINS)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``key, doc_id, n_tokens, sketch`` of each text with a token; texts of signs alone have an empty sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for all_rows in batches:
            for b in slices(all_rows, 2):
                tokens = np.diff(words(*utf8(b.column(2)), SPACED).off)
                values, count = shingles(b.column(2))
                data = sketch(values, count)[count > 0].astype("<u4").tobytes()
                offsets = np.concatenate([[0], np.cumsum(np.where(count > 0, 4 * BINS, 0))]).astype(np.int32)
                s = pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(tokens), s], ["key", "doc_id", "n_tokens", "sketch"]).filter(pa.array(tokens > 0))

    return docs.select(row_key(id_col, text_col).alias("key"), docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, SCHEMA)


def _matrix(col: pa.Array, kind: str) -> np.ndarray:
    data, _ = utf8(col)
    return data.view(kind).reshape(-1, BINS)


def _number(bits: np.ndarray) -> np.ndarray:
    """How many of each row of BINS truth values are set."""
    return np.bitwise_count(np.packbits(bits, axis=1).view(np.uint64)).sum(1, dtype=np.int64)


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity in ten thousandths that rows of sketches show: bins in which they agree, of those that either has."""
    return _number((a == b) & (a > 0)) * 10_000 // np.maximum(_number((a > 0) | (b > 0)), 1)


def score(like: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """What a node's neighbours are ranked by: likeness, and of equals those that come next, cyclically; the same wherever two nodes meet."""
    return (like.astype(np.int64) << 49) | (~(v - u).view(np.uint64) >> np.uint64(15)).view(np.int64)


def _best(u: np.ndarray, v: np.ndarray, rank: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are the ``k`` of the greatest ``rank`` for their ``u``, a repeated pair once, and the place of each."""
    order = np.lexsort((v, -rank, u))
    new = np.ones(len(order), bool)
    new[1:] = (u[order][1:] != u[order][:-1]) | (v[order][1:] != v[order][:-1])
    order = order[new]
    first = np.flatnonzero(np.concatenate([[True], u[order][1:] != u[order][:-1]])) if len(order) else np.zeros(0, np.int64)
    place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return order[place < k], place[place < k]


def _few(s: np.ndarray, rep: np.ndarray, at: np.ndarray, size: np.ndarray, cut: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of small sets, each ``size`` rows from ``at`` on, all pairs at least LEAST_ALIKE, both ways: ``u, v, score``."""
    row = np.repeat(at - np.cumsum(size) + size, size) + np.arange(size.sum())
    others = np.repeat(at + size - 1, size) - row
    end = np.cumsum(others)
    for begin in range(0, int(end[-1]) if len(end) else 0, cut):
        pair = np.arange(begin, min(begin + cut, int(end[-1])))
        which = np.searchsorted(end, pair, "right")
        i, j = row[which], row[which] + 1 + pair - (end - others)[which]
        like = alike(s[i], s[j])
        some = like >= LEAST_ALIKE
        u, v, like = rep[i[some]], rep[j[some]], like[some]
        yield np.concatenate([u, v]), np.concatenate([v, u]), np.concatenate([score(like, u, v), score(like, v, u)])


def _nearest(s: np.ndarray, rep: np.ndarray, k: int, block: int, middle: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row the ``k`` others of the highest score, if at least LEAST_ALIKE: ``u, v, score``.

    All rows are compared with all, a few with ``block`` at a time; with ``middle``, those before it with those from it on.
    """
    n, high, few = len(s), len(s) if middle is None else middle, max(1, block // 32)
    rank, who = np.full((n, k), (LEAST_ALIKE << 49) - 1, np.int64), np.zeros((n, k), np.int64)
    full = (s > 0).astype(np.float32)
    count, columns = full.sum(1), np.ascontiguousarray(s.T)

    def take(row: np.ndarray, other: np.ndarray, like: np.ndarray) -> None:
        got = score(like, rep[row], rep[other])
        some = got >= rank[row, -1]
        row, other, got = row[some], rep[other[some]], got[some]
        order, place = _best(row, other, got, k)
        rows, at = np.unique(row[order], return_inverse=True)
        both = np.full((len(rows), 2 * k), -1, np.int64)
        name = np.zeros((len(rows), 2 * k), np.int64)
        both[:, :k], name[:, :k] = rank[rows], who[rows]
        both[at, k + place], name[at, k + place] = got[order], other[order]
        order = np.lexsort((name, -both), axis=1)[:, :k]
        rank[rows], who[rows] = np.take_along_axis(both, order, 1), np.take_along_axis(name, order, 1)

    def least(i: int, j: int) -> np.ndarray:
        return np.maximum(rank[i:j, -1] >> 49, LEAST_ALIKE).astype(np.float32)

    for x in range(0, high, few):
        x2 = min(x + few, high)
        for y in range(x if middle is None else middle, n, block):
            y2 = min(y + block, n)
            agree, same = np.zeros((x2 - x, y2 - y), np.uint8), np.empty((x2 - x, y2 - y), bool)
            for c in columns:
                np.equal(c[x:x2, None], c[None, y:y2], out=same)
                np.add(agree, same.view(np.uint8), out=agree)
            either = full[x:x2] @ full[y:y2].T
            np.subtract(count[x:x2, None] + count[None, y:y2], either, out=either)
            # bins that neither has were counted too; numbers are whole and small, so float32 is exact, and floors of its quotients are
            like = agree + (either - np.float32(BINS))
            like *= 10_000
            like /= either
            np.floor(like, out=like)
            if x == y:
                like[np.tril_indices(x2 - x)] = -1
            found = (like >= least(x, x2)[:, None]) | (like >= least(y, y2)[None, :])
            if k < min(like.shape) and np.count_nonzero(found) > 64 * len(like):
                # the k-th here is no more than the k-th of all
                by_row, by_column = np.partition(like, -k, axis=1)[:, -k], np.partition(like, -k, axis=0)[-k]
                found = (like >= np.maximum(least(x, x2), by_row)[:, None]) | (like >= np.maximum(least(y, y2), by_column)[None, :])
            i, j = np.nonzero(found)
            got = like[i, j].astype(np.int64)
            take(i + x, j + y, got)
            take(j + y, i + x, got)
    row, at = np.nonzero(rank >= LEAST_ALIKE << 49)
    return rep[row], who[row, at], rank[row, at]


def neighbours(nodes: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """For each of ``nodes`` (rep: bigint, sketch: binary; repeated rows are one) the ``k`` most like it: ``u, v, alike``.

    Bins are compared by 8 bits of their hashes, so of 255 that differ one is taken to agree. Nodes less alike than
    LEAST_ALIKE are no neighbours. Nodes meet where they agree in any of SLOTS bins, by all bits, and all that meet are compared.
    Only names of nodes go to where they meet; what lies under several bins alike is compared once, and
    sketches go only where there are others. Sets of over PART are parted, and each part compared with each, in tasks of their own.
    """

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for all_rows in batches:
            for at in range(0, all_rows.num_rows, 4096):
                b = all_rows.slice(at, 4096)
                rep, first = np.unique(b.column(0).to_numpy(), return_index=True)
                m = _matrix(b.column(1), "<u4")[first, :SLOTS]
                row, slot = np.nonzero(m)
                f = mix(m[row, slot].astype(np.uint64) << np.uint64(8) | slot.astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(f.view(np.int64)), pa.array(rep[row])], ["f", "rep"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in runs(batches):
            f, rep = b.column(0).to_numpy(), b.column(1).to_numpy()
            new = np.concatenate([[True], (f[1:] != f[:-1]) | (rep[1:] != rep[:-1])])
            f, rep = f[new], rep[new]
            at = np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]]))
            size = np.diff(np.append(at, len(f)))
            # sets that this takes for one would be compared as one, and lose nothing
            name = mix(np.add.reduceat(mix(rep.view(np.uint64)), at) + size.astype(np.uint64)).view(np.int64)
            met = np.repeat(size > 1, size)
            yield pa.RecordBatch.from_arrays([pa.array(rep[met]), pa.array(np.repeat(name, size)[met]), pa.array(np.repeat(size, size)[met])], ["rep", "f", "n"])

    def bytes_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _matrix(b.column(1), "<u4")
            low = np.where(m > 0, 1 + (m >> 3) % 255, 0).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.Array.from_buffers(pa.binary(BINS), len(m), [None, pa.py_buffer(low)]).cast(pa.binary())], ["rep", "sketch"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in runs(batches):
            f, part, rep, s = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(), _matrix(b.column(3), "u1")
            at = np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]]))
            size = np.diff(np.append(at, len(f)))
            two = part[at] != part[at + size - 1]
            few = (size <= FEW) & ~two
            found = list(_few(s, rep, at[few], size[few]))
            for i, n, parted in zip(at[~few].tolist(), size[~few].tolist(), two[~few].tolist(), strict=True):
                middle = int(np.searchsorted(part[i : i + n], part[i], "right")) if parted else None
                found.append(_nearest(s[i : i + n], rep[i : i + n], k, BLOCK, middle))
            if found:
                u, v, rank = (np.concatenate(x) for x in zip(*found, strict=True))
                best, _ = _best(u, v, rank, k)
                yield pa.RecordBatch.from_arrays([pa.array(x[best]) for x in (u, v, rank)], ["u", "v", "rank"])

    some = nodes.where(F.length("sketch") > 0).select("rep", "sketch")
    met = some.mapInArrow(slots, "f bigint, rep bigint").repartition("f").sortWithinPartitions("f", "rep").mapInArrow(sets, "rep bigint, f bigint, n bigint").repartition("rep").distinct()
    low = some.mapInArrow(bytes_, "rep bigint, sketch binary").repartition("rep").dropDuplicates(["rep"])
    parts = F.ceil(F.col("n") / PART).cast("int")
    part = F.pmod(F.xxhash64("rep"), parts).cast("int")
    # a set of p parts is under a key for each two of them, and each part with itself; a node is in p of these
    others = F.when(F.col("n") > PART, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.lit(0)))
    there = met.join(low, "rep").select("f", "n", F.when(F.col("n") > PART, part).otherwise(F.lit(0)).alias("part"), "rep", "sketch", F.explode(others).alias("other"))
    key = F.when(F.col("n") > PART, F.xxhash64("f", F.least("part", "other"), F.greatest("part", "other"))).otherwise(F.col("f"))
    found = there.select(key.alias("f"), "part", "rep", "sketch").repartition("f").sortWithinPartitions("f", "part", "rep").mapInArrow(meet, "u bigint, v bigint, rank bigint")
    best = Window.partitionBy("u").orderBy(F.desc("rank"), "v")
    return found.distinct().withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).select("u", "v", F.shiftright("rank", 49).cast("int").alias("alike"))


def walk(a: np.ndarray, b: np.ndarray, u: np.ndarray, v: np.ndarray, like: np.ndarray) -> list[list[tuple[int, bool]]]:
    """Paths over chains with the ends ``a`` and ``b`` (single nodes are both), along edges between ends: lists of chains, and whether each is reversed.

    A path begins at the unvisited chain of fewest edges, and goes on from the end that it leaves to the unvisited one most alike
    (of these that of fewest edges, then the lowest), which it enters at the edge's end, until there is none; then it goes on likewise from its other end.
    """
    single = a == b
    ends = np.concatenate([a, b[~single]])
    chain = np.concatenate([np.arange(len(a)), np.flatnonzero(~single)])
    order = np.argsort(ends, kind="stable")
    ends, chain = ends[order], chain[order]
    at, to = (np.minimum(np.searchsorted(ends, x), len(ends) - 1) for x in (u, v))
    inside = (ends[at] == u) & (ends[to] == v) & (chain[at] != chain[to])
    at, to, like = at[inside], to[inside], like[inside]
    degree = np.bincount(chain[at], minlength=len(a))
    order = np.lexsort((ends[to], degree[chain[to]], -like, at))
    to = to[order].tolist()
    begin = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(ends)))]).tolist()
    place = {x: i for i, x in enumerate(ends.tolist())}
    at_a, at_b, of = [place[x] for x in a.tolist()], [place[x] for x in b.tolist()], chain.tolist()
    seen, out = bytearray(len(a)), []

    def follow(end: int) -> list[tuple[int, int]]:
        """Chains onward from an end, with the end that each is entered at."""
        path = []
        while True:
            x = next((x for x in to[begin[end] : begin[end + 1]] if not seen[of[x]]), -1)
            if x < 0:
                return path
            c = of[x]
            seen[c] = 1
            path.append((c, x))
            end = at_b[c] if x == at_a[c] else at_a[c]

    for start in np.lexsort((a, degree)).tolist():
        if not seen[start]:
            seen[start] = 1
            on = follow(at_b[start])
            back = follow(at_a[start])
            out.append([(c, x == at_a[c] != at_b[c]) for c, x in reversed(back)] + [(start, False)] + [(c, x != at_a[c]) for c, x in on])
    return out


def _joined(chains: DataFrame, edges: DataFrame, parts: DataFrame) -> DataFrame:
    """Walks the chains of each part: ``chain, path, place, turned`` with ``path`` the first chain's; and ``a, b``, the ends of the path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches):
            part, chain, a, b, u, v, like = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])).tolist()
            rows = []
            for i, j in zip(cuts, cuts[1:], strict=False):
                names, first = np.unique(chain[i:j], return_index=True)
                ca, cb = a[i:j][first], b[i:j][first]
                for path in walk(ca, cb, u[i:j], v[i:j], like[i:j]):
                    c, turned = map(np.array, zip(*path, strict=True))
                    head, tail = (cb if turned[0] else ca)[c[0]], (ca if turned[-1] else cb)[c[-1]]
                    n = len(c)
                    rows.append((names[c], np.full(n, names[c[0]]), np.arange(n), turned, np.full(n, head), np.full(n, tail)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*rows, strict=True)], ["chain", "path", "place", "turned", "a", "b"])

    at = parts.join(chains, "chain")
    from_a, from_b = (at.join(edges, F.col(end) == F.col("u")).select("part", "chain", "a", "b", "u", "v", "alike") for end in ("a", "b"))
    rows = from_a.unionByName(from_b.where("a <> b"))
    return rows.repartition("part").sortWithinPartitions("part", "chain", "u", "v").mapInArrow(run, "chain bigint, path bigint, place bigint, turned boolean, a bigint, b bigint")


def _parts(edges: DataFrame, turn: int) -> tuple[DataFrame, bool]:
    """``chain, part`` of the chains with edges (u, v: both ways), written, and whether each part is a component.

    The chains of a component of over WALK take the least of their own and their neighbours' random labels, HOPS times, so that a part is
    what lies around some chain; one of over WALK is parted at random.
    """
    root = components(edges)
    size = root.groupBy("root").agg(F.count("*").alias("size"))
    large = durable(size.where(F.col("size") > WALK).select("root"), "large")
    if large.isEmpty():
        out = durable(root.select(F.col("node").alias("chain"), F.col("root").alias("part")), "parts")
        forget(root, large)
        return out, True
    label = root.join(small(large, 16).withColumn("big", F.lit(True)), "root", "left").select(F.col("node").alias("chain"), F.when(F.col("big"), F.xxhash64("node", F.lit(turn))).alias("label"), F.col("root").alias("part"))
    for _ in range(HOPS):
        near = edges.join(label.select(F.col("chain").alias("v"), F.col("label").alias("there")), "v").groupBy("u").agg(F.min("there").alias("least")).withColumnRenamed("u", "chain")
        label = durable(label.join(near, "chain", "left").select("chain", F.least("label", "least").alias("label"), "part"), "labels")
    label = label.select("chain", F.coalesce("label", "part").alias("label"))
    pieces = label.groupBy("label").agg(F.ceil(F.count("*") / WALK).alias("pieces"))
    out = durable(label.join(pieces, "label").select("chain", F.xxhash64("label", F.pmod(F.xxhash64("chain", F.lit(turn)), F.col("pieces"))).alias("part")), "parts")
    forget(root, large)
    return out, False


def _paths(edges: DataFrame) -> DataFrame:
    """``rep, path, step`` of the nodes that have an edge, written.

    Components of up to WALK nodes are walked whole. Of a larger one parts are, and then their paths are the chains of a graph of the edges between
    their ends, which is walked likewise, until no such edge is left. So an edge between parts counts as long as both its
    ends are ends of paths; what is lost is that a path may end where a single walk would have gone on into another part.
    """
    live = durable(edges.select("u", "v", "alike").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "alike")).distinct(), "both")
    chains = durable(live.select(F.col("u").alias("chain")).distinct().select("chain", F.col("chain").alias("a"), F.col("chain").alias("b")), "chains")
    steps = durable(chains.select(F.col("chain").alias("rep"), F.col("chain").alias("path"), F.lit(0).cast("bigint").alias("step")), "steps")
    for turn in itertools.count():
        between = durable(_chained(live, chains).select(F.col("c").alias("u"), F.col("d").alias("v")).distinct(), "between")
        parts, whole = _parts(between, turn)
        joined = durable(_joined(chains, live, parts), "joined")
        onto = joined.select(F.col("chain").alias("path"), F.col("path").alias("onto"), "place", "turned")
        size = steps.groupBy("path").agg(F.count("*").alias("n"))
        before = Window.partitionBy("onto").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
        base = onto.join(size, "path").select("path", "onto", "turned", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
        # the steps of a chain come after those of the chains before it, from its end if it was entered there
        step = F.when(F.col("onto").isNull(), F.col("step")).otherwise(F.col("base") + F.when(F.col("turned"), F.col("n") - 1 - F.col("step")).otherwise(F.col("step")))
        after = durable(steps.join(base, "path", "left").select("rep", F.coalesce("onto", "path").alias("path"), step.cast("bigint").alias("step")), "steps")
        merged = joined.select(F.col("path").alias("chain"), "a", "b").distinct()
        left = durable(chains.join(joined.select("chain"), "chain", "left_anti").unionByName(merged), "chains")
        go_on = live.limit(0) if whole else durable(_chained(live, left).select("u", "v", "alike"), "live")
        ended = whole or go_on.isEmpty()
        forget(between, parts, joined, steps, chains, live)
        steps, chains, live = after, left, go_on
        if ended:
            return steps


def _chained(edges: DataFrame, chains: DataFrame) -> DataFrame:
    """The edges between ends of different chains, and which: ``u, v, alike, c, d``."""
    end = chains.select("chain", F.explode(F.array_distinct(F.array("a", "b"))).alias("end"))
    here = edges.join(end, F.col("u") == F.col("end")).select("u", "v", "alike", F.col("chain").alias("c"))
    return here.join(end, F.col("v") == F.col("end")).where("c <> chain").select("u", "v", "alike", "c", F.col("chain").alias("d"))


def pack_related(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, k: int = NEIGHBOURS) -> DataFrame:
    """Windows of ``length`` tokens filled with related documents in turn: ``window_id, place, doc_id, first_token, n_tokens, path_id``.

    A row is a piece of a document: from its token ``first_token`` on, at ``place`` in the window. Tokens are
    words. Documents whose sketches of three-word shingles agree are neighbours (see ``neighbours``); those
    with equal sketches count as one node and stand side by side. Paths (see ``walk``) are laid end to end, so that all
    windows but the last are full and a document over a window's end goes on in the next. Each text
    with a token is placed exactly once, each of repeated rows too; null and empty texts aren't placed. A null
    id stays null. Of an empty table no window comes. The order is the same however the data are partitioned.
    """
    sk = durable(sketches(docs, id_col, text_col), "sketches")
    # a node's name is a hash of its sketch, so that documents need not be brought together to be named
    some = F.length("sketch") > 0
    at = sk.select("key", "doc_id", "n_tokens", F.when(some, F.xxhash64("sketch")).otherwise(F.col("key")).alias("rep"))
    edges = durable(neighbours(sk.where(some).select(F.xxhash64("sketch").alias("rep"), "sketch"), k), "neighbours")
    paths = _paths(edges)
    placed = at.join(paths, "rep", "left").select("key", "doc_id", "n_tokens", F.coalesce("path", "rep").alias("path"), F.coalesce("step", F.lit(0)).alias("step"), "rep")
    lanes = max(LANES, sk.count() // LANE)
    placed = placed.withColumn("lane", F.pmod(F.xxhash64("path", F.floor(F.col("step") / STEPS)), F.lit(lanes)))
    in_lane = Window.partitionBy("lane").orderBy("path", "step", "rep", F.col("doc_id").asc_nulls_last(), "key").rowsBetween(Window.unboundedPreceding, 0)
    placed = durable(placed.withColumn("stop", F.sum("n_tokens").over(in_lane)), "placed")
    forget(sk, edges, paths)
    before = Window.orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)  # over a row to each lane
    base = placed.groupBy("lane").agg(F.sum("n_tokens").alias("total")).withColumn("base", F.coalesce(F.sum("total").over(before), F.lit(0))).select("lane", "base")
    placed = placed.join(F.broadcast(base), "lane").withColumn("stop", F.col("base") + F.col("stop")).withColumn("start", F.col("stop") - F.col("n_tokens"))
    size = F.lit(length)
    pieces = placed.withColumn("window_id", F.explode(F.sequence((F.col("start") / size).cast("bigint"), ((F.col("stop") - 1) / size).cast("bigint"))))
    first, last = F.greatest("start", F.col("window_id") * size), F.least("stop", (F.col("window_id") + 1) * size)
    return pieces.select("window_id", (first - F.col("window_id") * size).alias("place"), "doc_id", (first - F.col("start")).alias("first_token"), (last - first).alias("n_tokens"), F.col("path").alias("path_id"))
