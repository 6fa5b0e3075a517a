"""Operator 9: repeated passages by seeds and their extension."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivane.llm.anchors import LEFT, id_or_null, keyed, of_places, passages, rle, run_hashes, unpacked
from lexivane.llm.shared import durable, once, slices, small, utf8
from lexivane.llm.wordhash import words

ROWS = "doc bigint, start_word bigint, n_words bigint, other_doc bigint, other_start_word bigint"


def seeds(b: pa.RecordBatch) -> pa.RecordBatch:
    """Of each run of words around an anchor the first and the last place, where that is more than one.

    Runs are matched by sorting their hashes, so no pairs are listed however many there are.
    """
    anchor, ctx = b.column(0).to_numpy(), b.column(1).to_numpy()
    h, n = run_hashes(b.column(4))
    row = np.repeat(np.arange(len(n)), n)
    places = []
    for col in (b.column(2), b.column(3)):
        doc, key, word = of_places(col)
        at, lo, _, _ = unpacked(word)
        c = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + lo[row]
        places.append((doc[row], key[row], at[row] - LEFT + c))
    ends = []
    for (doc, key, start), last in zip(places, (False, True), strict=True):
        order = np.lexsort((start, key, doc, h))
        edge = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1], [True]]))
        pick = order[edge[1:] - 1 if last else edge[:-1]]
        of = np.empty(len(h), np.int64)
        of[order] = np.repeat(pick, np.diff(edge))
        ends.append(tuple(x[of] for x in (doc, key, start)))
    e, a = ends
    keep = np.flatnonzero((e[1] != a[1]) | (e[2] != a[2]))
    keep = keep[np.lexsort((c[keep], row[keep]))]
    return rle(anchor[row[keep]], ctx[row[keep]], c[keep], tuple(x[keep] for x in e), tuple(x[keep] for x in a))


def extended(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """Each span made longer to both sides as far as its document and the other agree, word by word: ROWS.

    Spans of the same two documents are taken in turn, and left out within what one before holds after extension, as most of a
    periodic text's are. They share one row, so each text of a pair is read once. Texts of documents in no
    pair aren't moved; those of one document in many pairs are, and adaptive execution splits such joins.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 2):
                w, v = words(*utf8(b.column(2))), words(*utf8(b.column(3)))
                rows = []
                for i, spans in enumerate(b.column(4).to_pylist()):
                    x, y = w.hash[w.off[i] : w.off[i + 1]], v.hash[v.off[i] : v.off[i + 1]]
                    reach = -1  # of the rows so far, which all begin before
                    for s, e, t in sorted((z["start"], z["stop"], z["other_start"]) for z in spans):
                        if e <= reach:
                            continue
                        back, on = min(s, t), min(len(x) - e, len(y) - t - e + s)
                        back = _agree(x[s - back : s][::-1], y[t - back : t][::-1])
                        on = _agree(x[e : e + on], y[t + e - s : t + e - s + on])
                        reach = max(reach, e + on)
                        rows.append((b.column(0)[i].as_py(), s - back, e - s + back + on, b.column(1)[i].as_py(), t - back))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["doc", "start_word", "n_words", "other_doc", "other_start_word"])

    pairs = durable(spans.groupBy("key", "doc", "other_key", "other_doc").agg(F.collect_list(F.struct("start", "stop", "other_start")).alias("spans")), "pairs")
    ids = durable(pairs.select(F.col("key").alias("in_key")).unionByName(pairs.select(F.col("other_key").alias("in_key"))).distinct(), "keys")
    texts = docs.join(small(ids, 16), F.col("key") == F.col("in_key"), "left_semi")
    mine, others = texts.select("key", "text"), texts.select(F.col("key").alias("other_key"), F.col("text").alias("other_text"))
    return pairs.join(mine, "key").join(others, "other_key").select("doc", "other_doc", "text", "other_text", "spans").mapInArrow(run, ROWS)


def _agree(x: np.ndarray, y: np.ndarray) -> int:
    differs = np.flatnonzero(x != y)
    return int(differs[0]) if len(differs) else len(x)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Maximal repeats of 50 words and more: ``doc_id, start_word, n_words, other_doc_id, other_start_word``.

    Words are what white space parts. A row says that a passage of a document is word for word that at
    ``other_start_word`` of another (or of the same), and that both differ, or one ends, just before and just after.
    Each run of 50 words that occurs more than once is in a row, of every document that has it: the other place
    is in the document where the run occurs first, by doc_id and word; for that first place itself, in the one where the run occurs last.
    No row lies within another of the same two documents that begins before. So copies of a passage, however many, are all linked with the first one, and through it with each other, without listing pairs.
    Repeated rows count as one document; null, empty and short texts give no rows; a null id is the last.

    Documents meet on winnowed anchors: each run of 50 words holds one that all its copies share. The seeds around
    an anchor are followed from anchor to anchor along one diagonal, and then extended in the texts.
    """
    texts = once(keyed(docs, id_col, text_col))
    spans = passages(texts, seeds, False, True)
    closed = F.col("last") & (F.col("start") == 0)  # whole documents, as copies are
    rows = spans.where(closed).select("doc", F.col("start").alias("start_word"), (F.col("stop") - F.col("start")).alias("n_words"), "other_doc", F.col("other_start").alias("other_start_word"))
    rows = rows.unionByName(extended(spans.where(~closed), texts))
    return rows.select(id_or_null("doc", "doc_id"), "start_word", "n_words", id_or_null("other_doc", "other_doc_id"), "other_start_word")
