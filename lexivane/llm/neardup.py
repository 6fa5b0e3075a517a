"""Operator 8: near duplicates by MinHash signatures and a multi-index Hamming join."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivane.llm.graph import components
from lexivane.llm.shared import durable, row_key, runs, slices, small
from lexivane.llm.wordhash import mix, ngrams, normal_words, whole

#: Words to a shingle; slots of a signature, 16 bits each; slots in which near duplicates may differ.
SHINGLE, SLOTS, MAX_DISTANCE = 3, 30, 17
#: Chunks that a signature is split into. Of signatures within the distance some chunk has MAX_DISTANCE // CHUNKS errors at most.
CHUNKS = 6
#: Signatures that share a key and are compared in one task.
BUCKET = 8192
_rng = np.random.default_rng(8)
_A = _rng.integers(1, 1 << 62, SLOTS).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 62, SLOTS).astype(np.uint64)


def shingles(col: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of ``n`` words, a shorter text being one run, and how many each text has."""
    w = normal_words(col)
    size = np.diff(w.off)
    count = np.where(size >= n, size - n + 1, np.minimum(size, 1))
    out = np.zeros(int(count.sum()), np.uint64)
    out[np.repeat(size >= n, count)] = ngrams(w.hash, n)[whole(w.off, n)]
    short = np.flatnonzero((size > 0) & (size < n))
    at, value = w.off[short], np.zeros(len(short), np.uint64)
    for j in range(n - 1):
        more = size[short] > j
        value[more] = mix(value[more] * np.uint64(31) + w.hash[at[more] + j])
    out[(np.cumsum(count) - count)[short]] = value
    return out, count


def minhash(values: np.ndarray, count: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """16 bits of each slot's least hash, for the texts with any shingle."""
    begin = (np.cumsum(count) - count)[count > 0]
    out = np.zeros((len(begin), slots), np.uint16)
    for k in range(slots if len(begin) else 0):
        h = values * _A[k]
        h += _B[k]
        h ^= h >> np.uint64(31)
        out[:, k] = mix(np.minimum.reduceat(h, begin)) >> np.uint64(48)
    return out


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``key, doc_id, sig`` of each text with a word; ``key`` is the row's identity (see ``row_key``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for all_rows in batches:
            for b in slices(all_rows, 2):
                values, count = shingles(b.column(2))
                sig = minhash(values, count)
                some = pa.array(count > 0)
                data = pa.Array.from_buffers(pa.binary(2 * SLOTS), len(sig), [None, pa.py_buffer(sig.astype("<u2").tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).filter(some), b.column(1).filter(some), data], ["key", "doc_id", "sig"])

    return docs.select(row_key(id_col, text_col).alias("key"), docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, "key bigint, doc_id bigint, sig binary")


def _matrix(col: pa.Array) -> np.ndarray:
    col = col.fill_null(b"") if col.null_count else col
    off = np.frombuffer(col.buffers()[1], np.int32, len(col) + 1, 4 * col.offset)
    return np.frombuffer(col.buffers()[2], "<u2", (off[-1] - off[0]) // 2, off[0]).reshape(len(col), -1)


def chunk_keys(sig: np.ndarray, chunks: int = CHUNKS, errors: int = MAX_DISTANCE // CHUNKS) -> np.ndarray:
    """For each signature the keys under which it meets all others that differ in ``errors`` slots of some chunk at most.

    A key is a chunk's slots but for some ``errors`` of them, together with which chunk and slots those are; its low three bits name the chunk.
    """
    width = sig.shape[1] // chunks
    kept = list(combinations(range(width), width - errors))
    out = np.empty((len(sig), chunks * len(kept)), np.uint64)
    for c in range(chunks):
        part = sig[:, c * width : (c + 1) * width].astype(np.uint64)
        for m, slots in enumerate(kept):
            k = np.full(len(sig), c * len(kept) + m + 1, np.uint64)
            for s in slots:
                k = mix(k * np.uint64(0x10001) + part[:, s]) if len(slots) > 3 else k << np.uint64(16) | part[:, s]
            out[:, c * len(kept) + m] = mix(k) & ~np.uint64(7) | np.uint64(c)
    return out


def _keys(reps: DataFrame, errors: int, under: bool) -> DataFrame:
    """``k, rep`` of ``reps``, or, of those that come ``under`` a key ``k`` of their own, of that key's parts by the other chunks. With ``root`` if there is one."""
    extra = [c for c in ("root",) if c in reps.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for all_rows in batches:
            for at in range(0, all_rows.num_rows, 4096):
                b = all_rows.slice(at, 4096)
                k = chunk_keys(_matrix(b.column(1)), errors=errors)
                row = np.repeat(np.arange(len(k)), k.shape[1])
                if under:
                    above = b.column(2).to_numpy().view(np.uint64)[:, None]
                    other = ((k ^ above) & np.uint64(7) > 0).ravel()  # all agree in the chunk of the key above but for its errors
                    k, row = mix(k ^ above * np.uint64(0x9E3779B97F4A7C15)).ravel()[other], row[other]
                row = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(k.ravel().view(np.int64)), b.column(0).take(row), *(b.column(c).take(row) for c in extra)], ["k", "rep", *extra])

    return reps.select("rep", "sig", *(["k"] if under else []), *extra).mapInArrow(run, ", ".join(f"{c} bigint" for c in ("k", "rep", *extra)))


def _sets(keyed: DataFrame) -> DataFrame:
    """Sets of up to BUCKET ``reps`` that share a key (of several roots, if ``keyed`` has such), and the keys of larger ones, ``hot``, of which nothing is kept in memory."""
    rooted = "root" in keyed.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry, hot = None, None  # rows of a key that may go on; a key that is hot, so that its rows are passed over
        for b in itertools.chain(batches, [None]):
            cols = [c.to_numpy() for c in b.columns] if b is not None else None
            if cols is not None and hot is not None:
                keep = cols[0] != hot
                cols = [c[keep] for c in cols]
            if carry is not None:
                cols = [np.concatenate([x, y]) for x, y in zip(carry, cols, strict=True)] if cols is not None else carry
            carry = None
            if cols is None or not len(cols[0]):
                continue
            k = cols[0]
            edge = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1], [True]]))
            size = np.diff(edge)
            over = []
            if b is not None:
                if size[-1] > BUCKET:
                    hot = k[-1]
                    over.append(hot)
                else:
                    carry = [c[edge[-2] :] for c in cols]
                edge, size = edge[:-1], size[:-1]
            over += k[edge[:-1][size > BUCKET]].tolist()
            good = (size > 1) & (size <= BUCKET)
            if rooted and len(size):
                r = cols[2][: edge[-1]]
                good &= np.minimum.reduceat(r, edge[:-1]) != np.maximum.reduceat(r, edge[:-1])
            keep = np.repeat(good, size)
            offsets = np.concatenate([[0], np.cumsum(size[good]), np.full(len(over), size[good].sum())]).astype(np.int32)
            sets = pa.ListArray.from_arrays(pa.array(offsets), pa.array(cols[1][: len(keep)][keep]))
            yield pa.RecordBatch.from_arrays([sets, pa.array([None] * int(good.sum()) + over, pa.int64())], ["reps", "hot"])

    return durable(keyed.repartition("k").sortWithinPartitions("k", "rep").mapInArrow(run, "reps array<bigint>, hot bigint"), "sets")


def _rows(sets: DataFrame, reps: DataFrame) -> DataFrame:
    """``bucket, rep, sig`` of sets, each once however many keys have it."""
    once = sets.where("hot is null").select("reps").distinct()
    return once.select(F.xxhash64("reps").alias("bucket"), F.explode("reps").alias("rep")).join(reps.select("rep", "sig"), "rep")


def _blocks(members: DataFrame, pairs: bool) -> DataFrame:
    """``bucket, rep, sig`` of large sets (``k, rep, sig``) in blocks of about BUCKET; with ``pairs`` each two of a set's blocks together."""
    size = members.groupBy("k").agg(F.ceil(F.count("*") / (BUCKET / 2)).alias("parts"))
    part = F.pmod(F.xxhash64("rep", "k"), F.col("parts"))
    rows = members.join(small(size, 24), "k").withColumn("part", part)
    if not pairs:
        return rows.select(F.xxhash64("k", "part").alias("bucket"), "rep", "sig")
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    return rows.select(F.xxhash64("k", F.least("part", "with"), F.greatest("part", "with")).alias("bucket"), "rep", "sig")


def _tree(sig: np.ndarray, rep: np.ndarray, most: int) -> tuple[list, list, list]:
    """Edges that join whatever pairs within ``most`` join, by breadth-first search over all pairs."""
    left, a, b, d = np.arange(len(rep)), [], [], []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            far = (sig[left] != sig[i]).sum(1)
            near = far <= most
            found = left[near]
            left = left[~near]
            a += [int(rep[i])] * len(found)
            b += rep[found].tolist()
            d += far[near].tolist()
            queue += found.tolist()
    return a, b, d


def _verified(rows: DataFrame, most: int, every: bool) -> DataFrame:
    """``u, v, distance`` of each bucket's pairs within ``most``, or, unless ``every``, of as many as join whatever these join."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in runs(batches):
            k, rep, sig = b.column(0).to_numpy(), b.column(1).to_numpy(), _matrix(b.column(2))
            edge = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1], [True]]))
            size, edge = np.diff(edge), edge[:-1]
            two = edge[size == 2]
            d = (sig[two] != sig[two + 1]).sum(1)
            a, c, d = (x[d <= most].tolist() for x in (rep[two], rep[two + 1], d))
            for at, n in zip(edge[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                s, r = sig[at : at + n], rep[at : at + n]
                if every:
                    for i in range(n - 1):
                        far = (s[i + 1 :] != s[i]).sum(1)
                        j = np.flatnonzero(far <= most)
                        a += [int(r[i])] * len(j)
                        c += r[i + 1 :][j].tolist()
                        d += far[j].tolist()
                else:
                    x, y, z = _tree(s, r, most)
                    a += x
                    c += y
                    d += z
            u, v = np.array(a, np.int64), np.array(c, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v)), pa.array(d, pa.int32())], ["u", "v", "distance"])

    return rows.select("bucket", "rep", "sig").repartition("bucket").sortWithinPartitions("bucket", "rep").mapInArrow(verify, "u bigint, v bigint, distance int").distinct()


def _pairs(reps: DataFrame, most: int, every: bool) -> DataFrame:
    """Pairs of ``reps`` within ``most``: all, or, unless ``every``, as many as join whatever these join.

    Signatures that share a key are compared in one task, up to BUCKET of them. Of a key that more have, one pass joins what is near
    within blocks; those that are of several components still are parted by the keys of a second chunk, in which a pair has
    MAX_DISTANCE // (CHUNKS - 1) errors at most; and sets that are too large even so are compared block by block, all blocks with each other.
    """
    errors = MAX_DISTANCE // CHUNKS
    sets = _sets(_keys(reps, errors, False))
    near = _verified(_rows(sets, reps), most, every)
    hot = sets.where("hot is not null").select(F.col("hot").alias("k")).distinct()
    if hot.isEmpty():
        return near
    members = durable(_keys(reps, errors, False).join(small(hot, 16), "k"), "hot")
    # of keys with the same signatures, as those of a chunk that all agree in, one will do
    alike = members.groupBy("k").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("rep")).alias("x")).groupBy("n", "x").agg(F.min("k").alias("k")).select("k")
    members = members.join(small(durable(alike, "alike"), 16), "k").join(reps.select("rep", "sig"), "rep")
    if every:
        members = durable(members.withColumn("root", F.col("rep")), "members")
    else:
        near = durable(near.unionByName(_verified(_blocks(members, False), most, False)), "near")
        root = components(near.select("u", "v"))
        members = members.join(root, F.col("rep") == F.col("node"), "left").select("k", "rep", "sig", F.coalesce("root", "rep").alias("root"))
        several = members.groupBy("k").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("k")
        members = durable(members.join(small(durable(several, "several"), 16), "k"), "members")
    further = _keys(members, MAX_DISTANCE // (CHUNKS - 1), True)
    sets = _sets(further)
    near = near.unionByName(_verified(_rows(sets, reps), most, every))
    hot = sets.where("hot is not null").select(F.col("hot").alias("k")).distinct()
    if not hot.isEmpty():
        rest = further.select("k", "rep").distinct().join(small(hot, 16), "k").join(reps.select("rep", "sig"), "rep")
        near = near.unionByName(_verified(_blocks(rest, True), most, every))
    return near.distinct()


def hamming_pairs(reps: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """All pairs of ``reps`` (rep: bigint, sig: binary, both distinct) within the distance: ``u, v, distance``, u < v. None is missed."""
    if max_distance > MAX_DISTANCE:
        raise ValueError(f"the chunks guarantee distances up to {MAX_DISTANCE}")
    return _pairs(reps, max_distance, True)


def _rank() -> F.Column:
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("key"))


def _groups(docs: DataFrame, id_col: str, text_col: str, max_distance: int) -> tuple[DataFrame, DataFrame]:
    if max_distance > MAX_DISTANCE:
        raise ValueError(f"the chunks guarantee distances up to {MAX_DISTANCE}")
    sigs = durable(signatures(docs, id_col, text_col), "signatures")
    reps = durable(sigs.groupBy("sig").agg(F.min("key").alias("rep"), F.count("*").alias("n")), "reps")
    near = components(_pairs(reps, max_distance, False).select("u", "v"))
    of = reps.join(near, reps.rep == near.node, "left").where("n > 1 or root is not null").select("sig", F.coalesce("root", "rep").alias("root"))
    members = sigs.join(of, "sig").select("key", "doc_id", "root")
    firsts = members.groupBy("root").agg(F.min(_rank()).alias("first"), F.count("*").alias("n_docs"))
    return sigs, members.join(firsts, "root").select("key", "doc_id", F.col("first.key").alias("keep_key"), F.col("first.doc_id").alias("keep_doc_id"), "n_docs")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_distance: int = MAX_DISTANCE) -> DataFrame:
    """Documents that have a near duplicate: ``doc_id, keep_doc_id, n_docs``, the group's first document and size.

    A text's signature holds 16 bits of the least hash of its three-word shingles (case and punctuation
    aside) under each of 30 functions. Two texts are near duplicates if their signatures differ in
    ``max_distance`` slots at most; the join finds all such pairs, and a group is what they connect. Each group
    keeps its lowest doc_id, null ids last. Texts without a word, null or empty, are in no group, nor are texts
    without a near duplicate. Repeated rows form a group and appear each.

    Equal signatures are joined once for all, so thousands of copies cost no more than one. In a set of
    signatures under one key a search by distance follows the connections instead of listing all pairs; see ``_pairs`` for large sets.
    """
    return _groups(docs, id_col, text_col, max_distance)[1].select("doc_id", "keep_doc_id", "n_docs")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_distance: int = MAX_DISTANCE) -> DataFrame:
    """``docs``, all columns, with one document of each group of near duplicates: that of the lowest doc_id, null ids last.

    Texts without a word stay. Of repeated rows one stays; where they differ in other columns, that whose columns as JSON sort first.
    """
    sigs, groups = _groups(docs, id_col, text_col, max_distance)
    gone = durable(groups.where("key <> keep_key").select(F.col("key").alias("_lv_key")).distinct(), "gone")
    repeated = durable(sigs.groupBy(F.col("key").alias("_lv_key")).count().where("count > 1").select("_lv_key"), "repeated")
    out = docs.withColumn("_lv_key", row_key(id_col, text_col)).join(small(gone, 16), "_lv_key", "left_anti")  # else the texts are shuffled by key
    if not repeated.isEmpty():
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        first = out.join(small(repeated, 16), "_lv_key", "left_semi").groupBy("_lv_key").agg(F.min_by(row, F.to_json(row)).alias("_lv_row"))
        out = out.join(small(repeated, 16), "_lv_key", "left_anti").unionByName(first.select("_lv_key", *[F.col(f"_lv_row.`{c}`") for c in docs.columns]))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
