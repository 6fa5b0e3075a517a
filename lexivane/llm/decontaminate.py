"""Operator 5: benchmark decontamination by a generalised suffix automaton of the test items."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivane.llm.shared import BROADCAST_BYTES, durable, forget, resized, slices
from lexivane.llm.wordhash import ALNUM, Words, mix, normal_words, spaced, words

#: A match of this many words is a leak.
MAX_WORDS = 10
#: So is a match of this share of an item's words, if it has ``LEAST_WORDS``.
MAX_COVERAGE = 0.6
LEAST_WORDS = 5
#: Words of test items to one automaton, which has at most twice as many states and three times as many transitions, under 20 MB
#: to send. More items make more automata, each of which passes over the documents; what is found stays the same.
SHARD_WORDS = 300_000
_NONE = 1 << 62
LEAKS = "doc_id bigint, item_ids array<bigint>, n_spans bigint, removed_words bigint, longest_match bigint, text string"


@dataclass
class Automaton:
    """Suffix automaton of several items' words. ``shortest`` and ``item``: of the items that hold a state's strings, the one of fewest words, the first of these."""

    next: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    best: list[tuple[int, int]] = field(default_factory=lambda: [(_NONE, _NONE)])

    def _state(self, length: int, link: int, nexts: dict[int, int]) -> int:
        self.next.append(nexts)
        self.link.append(link)
        self.length.append(length)
        self.best.append((_NONE, _NONE))
        return len(self.next) - 1

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            q = self.next[last][w]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        cur, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return cur

    def _split(self, p: int, w: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def add(self, item: int, hashes: list[int]) -> None:
        last, at = 0, []
        for w in hashes:
            last = self._extend(last, w)
            at.append(last)
        for s in at:
            self.best[s] = min(self.best[s], (len(hashes), item))

    def finish(self) -> None:
        for s in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            self.best[self.link[s]] = min(self.best[self.link[s]], self.best[s])

    def longest(self, hashes: list[int]) -> Iterator[tuple[int, int]]:
        """After each word: the state and length of the longest string of the items that ends there."""
        s = n = 0
        nexts, link, length = self.next, self.link, self.length
        for w in hashes:
            t = nexts[s].get(w)
            while t is None and s:
                s = link[s]
                n = length[s]
                t = nexts[s].get(w)
            if t is None:
                n = 0
            else:
                s = t
                n += 1
            yield s, n


class Scanner:
    """An automaton with its limits in flat arrays, and a filter of word pairs that lets every string over the limits through.

    ``keys`` are the transitions, a state's number times the number of words and the word's rank, in order, and ``targets`` where they lead.
    """

    def __init__(self, items: list[tuple[int, np.ndarray]], max_words: int, max_coverage: float, least: int):
        if least < 2 or max_words < 2:
            raise ValueError("limits must be 2 words at least")
        a, pairs = Automaton(), np.zeros(1 << 22, bool)
        for item, h in items:
            a.add(item, h.tolist())
            pairs[_pair(h)] = True
        a.finish()
        self.max_words, self.max_coverage, self.least = max_words, max_coverage, least
        self.pairs = np.packbits(pairs)
        self.need = max(2, min([max_words, *(max(least, -int(-max_coverage * len(h) // 1)) for _, h in items if len(h))]))
        self.words = np.unique(np.concatenate([h for _, h in items] or [np.zeros(0, np.uint64)]))
        rank = {w: i for i, w in enumerate(self.words.tolist())}
        moves = sorted((s * len(rank) + rank[w], t) for s, nexts in enumerate(a.next) for w, t in nexts.items())
        self.keys, self.targets = np.array([k for k, _ in moves], np.int64), np.array([t for _, t in moves], np.int32)
        self.link, self.length = np.array(a.link, np.int32), np.array(a.length, np.int32)
        self.size, self.item = (np.array(x, np.int64) for x in zip(*a.best, strict=True))
        #: For each state the longest of its strings' proper suffixes that reach ``max_coverage`` of an item of their own, as a state, or 0.
        self.inner = np.zeros(len(a.link), np.int32)
        for s in np.argsort(self.length, kind="stable")[1:].tolist():
            up = a.link[s]
            self.inner[s] = up if up and self._covers(a.length[up], a.best[up][0]) else self.inner[up]
        self._moves: dict[int, int] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_moves": None}

    def nbytes(self) -> int:
        """Bytes that a copy of it takes to send."""
        return sum(x.nbytes for x in self.__dict__.values() if isinstance(x, np.ndarray))

    def _covers(self, n: int, size: int) -> bool:
        return n >= self.least and n >= self.max_coverage * size

    def _longest(self, ranks: list[int]) -> Iterator[tuple[int, int]]:
        """After each word (its rank, -1 for one that no item has) the state and length of the longest string of the items that ends there."""
        s = n = 0
        moves, size = self._moves, len(self.words)
        for w in ranks:
            if w < 0:
                s = n = 0
                yield 0, 0
                continue
            t = moves.get(s * size + w)
            while t is None and s:
                s = self._up[s]
                n = self._len[s]
                t = moves.get(s * size + w)
            if t is None:
                n = 0
            else:
                s = t
                n += 1
            yield s, n

    def spans(self, w: Words) -> list[tuple[int, int, int, int, int]]:
        """Document, first word, words, and the item's words and id, of each match over a limit that no longer one holds."""
        if len(w.hash) < self.need or not len(self.words):
            return []
        if self._moves is None:  # once in each process
            self._moves = dict(zip(self.keys.tolist(), self.targets.tolist(), strict=True))
            self._up, self._len, self._in = self.link.tolist(), self.length.tolist(), self.inner.tolist()
            self._hit = np.unpackbits(self.pairs).view(bool)
        hit = self._hit[_pair(w.hash)]
        edge = w.off[1:-1]
        hit[edge[(edge > 0) & (edge <= len(hit))] - 1] = False
        step = np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))
        begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1) + 1
        keep = end - begin >= self.need
        begin, end = begin[keep], end[keep]
        out, least = [], min(self.least, self.max_words)
        for b, e, d in zip(begin.tolist(), end.tolist(), (np.searchsorted(w.off, begin, "right") - 1).tolist(), strict=True):
            h = w.hash[b:e]
            rank = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
            base, found = int(w.off[d]), []
            for i, (s, n) in enumerate(self._longest(np.where(self.words[rank] == h, rank, -1).tolist()), b):
                if n < least:
                    continue
                if not (n >= self.max_words or self._covers(n, int(self.size[s]))):
                    s = self._in[s]  # a shorter item that a longer one's words go on before
                    n = self._len[s]
                if s:
                    found.append((d, i - n + 1 - base, n, int(self.size[s]), int(self.item[s])))
            out += found
        return out


def maximal(spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Of spans (first, words, item's words, item) those that no other holds, and of equal ones that of the shortest item, then the lowest."""
    out, reach = [], -1
    for x in sorted(set(spans), key=lambda x: (x[0], -x[1], x[2], x[3])):
        if x[0] + x[1] > reach:
            out.append(x)
            reach = x[0] + x[1]
    return out


def _pair(h: np.ndarray) -> np.ndarray:
    return (mix(h[:-1] * np.uint64(3) + h[1:]) >> np.uint64(42)).astype(np.int64)


def scanners(benchmark: DataFrame, id_col: str, text_col: str, max_words: int, max_coverage: float, least: int) -> Iterator[Scanner]:
    """Automata of the items in turn, none over more than ``SHARD_WORDS`` words and an item."""
    items, size = [], 0
    rows = benchmark.select(benchmark[id_col].cast("bigint").alias("item"), benchmark[text_col].cast("string").alias("text")).where("text is not null").distinct().orderBy("item", "text")
    for item, text in rows.toLocalIterator():
        items.append((-1 if item is None else item, normal_words(pa.array([text])).hash))
        size += len(items[-1][1])
        if size > SHARD_WORDS:
            yield Scanner(items, max_words, max_coverage, least)
            items, size = [], 0
    if items:
        yield Scanner(items, max_words, max_coverage, least)


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans (first word, words), a blank in the place of each run."""
    data = text.encode()
    w = words(spaced(np.frombuffer(data, np.uint8)), np.array([0, len(data)]), ALNUM)
    out, at = [], 0
    for first, n in sorted(spans):
        b, e = int(w.start[first]), int(w.end[first + n - 1])
        if b > at:
            out.append(data[at:b].rstrip(b" "))
        at = max(at, e)
    out.append(data[at:].lstrip(b" "))
    return b" ".join(x for x in out if x).decode()


Spans = dict[int, list[tuple[int, int, int, int]]]


def _scanned(docs: DataFrame, text_col: str, found: Iterator[Scanner], make: Callable[[pa.RecordBatch, Spans], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``make`` over slices of ``docs`` and the maximal spans of their rows, by all automata together.

    One automaton goes over the documents as they pass. Several go over them in turn and leave their spans, which are then
    joined to the texts by a hash of these; so what is found doesn't depend on how the items were shared out.
    """
    at, n, names = docs.columns.index(text_col), len(docs.columns), list(docs.columns)

    def spans_of(scanner: Scanner, col: pa.Array) -> Spans:
        by: Spans = {}
        for d, *span in scanner.spans(normal_words(col)):
            by.setdefault(d, []).append(tuple(span))
        return by

    first, second = next(found), next(found, None)
    if second is None:
        shared = docs.sparkSession.sparkContext.broadcast(first)  # SHARD_WORDS and an item at most, so of a size that is known

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for b in slices(whole, at):
                    yield from make(b, {d: maximal(s) for d, s in spans_of(shared.value, b.column(at)).items()})

        return docs.mapInArrow(run, schema)

    def leave(shared) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for b in slices(whole, 1):
                    rows = [(b.column(0)[d].as_py(), *x) for d, s in spans_of(shared.value, b.column(1)).items() for x in s]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["_lv_text", "first", "n", "size", "item"])

        return run

    key = F.xxhash64(F.col(f"`{text_col}`").cast("string"))
    texts, parts = docs.select(key.alias("key"), F.col(f"`{text_col}`").cast("string").alias("text")), []
    for scanner in chain((first, second), found):  # one at a time in the driver and the executors
        shared = docs.sparkSession.sparkContext.broadcast(scanner)
        parts.append(durable(texts.mapInArrow(leave(shared), "_lv_text bigint, first bigint, n bigint, size bigint, item bigint").distinct(), "leaks"))
        shared.destroy()
    spans = durable(reduce(DataFrame.unionByName, parts).groupBy("_lv_text").agg(F.collect_list(F.struct("first", "n", "size", "item")).alias("_lv_spans")), "spans")
    forget(*parts)
    cuts = spans.agg(F.coalesce(F.sum(16 + 32 * F.size("_lv_spans")), F.lit(0))).first()[0]
    joined = docs.withColumn("_lv_text", key).join(F.broadcast(spans) if cuts <= BROADCAST_BYTES else spans, "_lv_text", "left")

    def after(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, at):
                by = {d: maximal([tuple(x.values()) for x in s]) for d, s in enumerate(b.column(n).to_pylist()) if s}
                yield from make(pa.RecordBatch.from_arrays(b.columns[:n], names), by)

    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], "_lv_spans").mapInArrow(after, schema)


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", max_words: int = MAX_WORDS, max_coverage: float = MAX_COVERAGE, least: int = LEAST_WORDS
) -> DataFrame:
    """The documents that hold passages of test items: ``doc_id, item_ids, n_spans, removed_words, longest_match, text``, the text without them.

    Words are compared without case and punctuation. The automaton gives after each word the longest match
    with any item; a match is a leak if it has ``max_words`` words, or ``least`` words and ``max_coverage``
    of the words of the shortest item that holds it (``item_ids`` names that item). Where the longest is none, the
    longest of its ends that is a leak counts, so items within others' words are found too; leaks within longer ones are not counted. Clean documents, null and
    empty texts among them, give no row; repeated rows give a row each; null items are left out and a null
    item_id reads -1. An empty benchmark or corpus gives no rows. No shuffle of texts for a benchmark of up to ``SHARD_WORDS``; a
    larger one takes several automata, one pass over the documents each, with the same result.
    """

    def make(b: pa.RecordBatch, by: Spans) -> Iterator[pa.RecordBatch]:
        rows = []
        for d, spans in sorted(by.items()):
            covered = set().union(*(range(f, f + n) for f, n, _, _ in spans))
            rows.append((b.column(0)[d].as_py(), sorted({i for *_, i in spans}), len(spans), len(covered), max(n for _, n, _, _ in spans), cut(b.column(1)[d].as_py(), [s[:2] for s in spans])))
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(_LEAKS.names, r, strict=True)) for r in rows], _LEAKS)

    found = scanners(benchmark, item_col, "text", max_words, max_coverage, least)
    if benchmark.where(benchmark["text"].isNotNull()).isEmpty():
        return docs.sparkSession.createDataFrame([], LEAKS)
    return _scanned(docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text")), "text", found, make, LEAKS)


_LEAKS = pa.schema([("doc_id", pa.int64()), ("item_ids", pa.list_(pa.int64())), ("n_spans", pa.int64()), ("removed_words", pa.int64()), ("longest_match", pa.int64()), ("text", pa.string())])


def remove_leaks(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", max_words: int = MAX_WORDS, max_coverage: float = MAX_COVERAGE, least: int = LEAST_WORDS, size_col: str | None = None
) -> DataFrame:
    """``docs``, all columns, with the words of each leak (see ``find_leaks``) taken out of the text; ``size_col`` names one to hold the characters left.

    Texts without a leak, null and empty ones too, stay as they are; documents of which nothing but white
    space is left after a removal go. Repeated rows and null ids are treated like any other. An empty benchmark takes nothing out.
    """
    at, columns = docs.columns.index(text_col), list(docs.columns)

    def make(b: pa.RecordBatch, by: Spans) -> Iterator[pa.RecordBatch]:
        if by:
            text = b.column(at).to_pylist()
            for d, spans in by.items():
                text[d] = cut(text[d], [s[:2] for s in spans])
            b = pa.RecordBatch.from_arrays([pa.array(text, b.column(at).type) if i == at else c for i, c in enumerate(b.columns)], columns)
            b = b.filter(pa.array([d not in by or bool(text[d].strip()) for d in range(len(text))]))
        yield b

    found = scanners(benchmark, item_col, "text", max_words, max_coverage, least)
    nothing = benchmark.where(benchmark["text"].isNotNull()).isEmpty()
    return resized(docs if nothing else _scanned(docs, text_col, found, make, docs.schema), text_col, size_col)
