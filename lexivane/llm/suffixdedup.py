"""Operator 3: repeated passages by longest-previous-factor arrays over sorted suffixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivane.llm.anchors import LEAST, LEFT, SPAN, id_or_null, keyed, of_places, passages, rle, unpacked
from lexivane.llm.shared import BROADCAST_BYTES, durable, forget, once, resized, row_key, runs, slices, utf8
from lexivane.llm.wordhash import SPACED, mix, powers, words

_Q = np.uint64(0x8CB92BA72F3D8DD7)
_LEVELS = (1, 2, 4, 8, 16, 32)
_SPACES = " \t\n\v\f\r\x1c\x1d\x1e\x1f"


def prefix_ranks(m: np.ndarray) -> list[np.ndarray]:
    """By prefix doubling, the order of the 1, 2, 4 ... 32 symbols from each place of each row; nothing comes before all."""
    _, r = np.unique(m, return_inverse=True)
    ranks = [r.reshape(m.shape).astype(np.int64)]
    for step in _LEVELS[:-1]:
        _, r = np.unique(_paired(ranks[-1], step), return_inverse=True)
        ranks.append(r.reshape(m.shape))
    return ranks


def _paired(r: np.ndarray, step: int) -> np.ndarray:
    key = (r + 1) << 32
    key[:, :-step] |= r[:, step:] + 1
    return key


def nearest_smaller(value: np.ndarray) -> np.ndarray:
    """For each place the last one before it with a smaller value, or -1, all places at once by jumping along what is known."""
    low = np.concatenate([value, [np.iinfo(np.int64).min]])  # place -1
    at = np.arange(-1, len(value) - 1)
    todo = np.arange(len(value))
    while len(todo := todo[low[at[todo]] >= value[todo]]):
        at[todo] = at[at[todo]]
    return at


def common(ranks: list[np.ndarray], i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of the suffixes at the flat places i and j, ``most`` at most."""
    n = np.zeros(len(i), np.int64)
    for level in (5, 5, 4, 3, 2, 1, 0):
        step = _LEVELS[level]
        fits = np.flatnonzero(n + step <= most)
        flat = ranks[level].ravel()
        n[fits[flat[i[fits] + n[fits]] == flat[j[fits] + n[fits]]]] += step
    return n


def _row_hash(m: np.ndarray) -> np.ndarray:
    return mix((m.astype(np.uint64) * powers(_Q, m.shape[1])).sum(1))


def _by(major: np.ndarray, minor: np.ndarray) -> np.ndarray:
    """Order by two keys, by one sort of both in one number where they fit."""
    low = minor.min()
    bits = int(minor.max() - low).bit_length()
    if int(major.max()).bit_length() + bits < 63:
        return np.argsort(major << bits | minor - low)
    return np.lexsort((minor, major))


def longest_previous(m: np.ndarray, position: np.ndarray, within: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longest previous factors of LEAST symbols and more.

    ``m`` has a row of symbols to each context, 0 for none; ``position`` orders the places of the text that its
    symbols come from; ``within`` can leave places out. Gives flat places, the lengths of their longest factor that also begins at a smaller
    position, and where: the better of the previous and the next smaller position in suffix order.
    """
    # rows of equal symbols, as whole copies have, are sorted once
    _, one, same = np.unique(_row_hash(m), return_index=True, return_inverse=True)
    ranks = prefix_ranks(m[one])
    last, starts = ranks[5], SPAN - LEAST + 1
    first, second = last[:, :starts], last[:, LEAST - 32 : LEAST - 32 + starts]
    beyond = np.concatenate([last[:, 32:] + 1, np.zeros((len(last), max(0, starts + 32 - SPAN)), np.int64)], axis=1)[:, :starts]
    _, kind = np.unique(first << 32 | second, return_inverse=True)
    _, full = np.unique(first << 32 | beyond, return_inverse=True)
    kind, full = kind.reshape(first.shape), full.reshape(first.shape)
    valid = (m[:, :starts] != 0) & (m[:, LEAST - 1 : LEAST - 1 + starts] != 0)
    row, col = np.nonzero(valid if within is None else valid & within)
    kinds = kind[same[row], col]
    keep = np.bincount(kinds)[kinds] > 1 if len(row) else valid[:0, 0]  # others share no LEAST symbols with any
    row, col = row[keep], col[keep]
    flat = row * SPAN + col
    if not len(flat):
        return flat, flat, flat
    pos, full = position[row, col], full[same[row], col]
    order = _by(full, pos)  # suffix order
    row, col, flat, pos = row[order], col[order], flat[order], pos[order]
    full = full[order]
    room = np.cumsum((m != 0)[:, ::-1], axis=1)[:, ::-1].ravel()[flat]  # documents have no gaps
    best, where = np.zeros(len(flat), np.int64), np.zeros(len(flat), np.int64)
    new = np.concatenate([[True], full[1:] != full[:-1]])
    head = np.flatnonzero(new)
    # of suffixes that agree as far as the order goes, each but the first has a smaller position just before it
    apart = np.concatenate([[True], new[1:] | (pos[1:] != pos[:-1])])
    before = np.maximum.accumulate(np.where(apart, np.arange(len(pos)), 0)) - 1
    some = np.flatnonzero(before >= np.repeat(head, np.diff(np.concatenate([head, [len(pos)]]))))
    where[some] = before[some]
    best[some] = np.minimum(np.minimum(room[some], room[where[some]]), np.minimum(64, SPAN - np.maximum(col[some], col[where[some]])))
    # the first ones look at the others' first ones on both sides
    least, at = pos[head], same[row[head]] * SPAN + col[head]
    for other in (nearest_smaller(least), len(head) - 1 - nearest_smaller(least[::-1])[::-1]):
        i = np.flatnonzero((other >= 0) & (other < len(head)))
        j = other[i]
        n = common(ranks, at[i], at[j], np.minimum(room[head[i]], room[head[j]]))
        better = (n > best[head[i]]) | (n == best[head[i]]) & (n > 0) & (least[j] < pos[where[head[i]]])
        best[head[i[better]]] = n[better]
        where[head[i[better]]] = head[j[better]]
    found = np.flatnonzero(best >= LEAST)
    return flat[found], best[found], flat[where[found]]


def earlier(b: pa.RecordBatch) -> pa.RecordBatch:
    """Of each run of words around an anchor the first place, where it has more than one: the end of the chain of its longest previous factors.

    A factor of LEAST words and more leads to a smaller position of the same run of words, so following factors leads to the first.
    """
    anchor, ctx = b.column(0).to_numpy(), b.column(1).to_numpy()
    m = utf8(b.column(4))[0].view("<u4").reshape(-1, SPAN)
    doc, key, word = of_places(b.column(2))
    at, lo, hi, _ = unpacked(word)
    order = np.lexsort((key, doc))
    step = np.concatenate([[False], (doc[order][1:] != doc[order][:-1]) | (key[order][1:] != key[order][:-1])])
    rank = np.empty(len(doc), np.int64)
    rank[order] = np.cumsum(step)
    position = (rank << (int(at.max()) + SPAN).bit_length() | at)[:, None] + np.arange(SPAN)
    c = np.arange(SPAN - LEAST + 1)
    within = (c >= lo[:, None]) & (c <= hi[:, None])
    flat, _, where = longest_previous(m, position, within)
    link = np.arange(m.size)
    link[flat] = where
    while (link[link[flat]] != link[flat]).any():
        link[flat] = link[link[flat]]
    # contexts of more than one document have runs with no factor too, at the first of these
    other_doc, other_key, other_word = of_places(b.column(3))
    plural = (other_key != key) | (other_word != word)
    row, c = np.nonzero(within)
    root = link[row * SPAN + c]
    keep = (root != row * SPAN + c) | plural[row]
    row, c, root = row[keep], c[keep], root[keep]
    r = root // SPAN
    e = (doc[r], key[r], at[r] - LEFT + root % SPAN)
    return rle(anchor[row], ctx[row], c, e, (doc[row], key[row], at[row] - LEFT + c))


def _later(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return passages(once(keyed(docs, id_col, text_col)), earlier, True, False)


def later_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Passages of 50 words and more that occur before: ``doc_id, start_word, n_words, first_doc_id, first_start_word``.

    Words are what white space parts. A row's words are those at ``first_start_word`` of the other document (or of the same
    one), and each run of 50 of them occurs there first of all: in the document of lowest doc_id (null ids come last), at the
    earliest word. So the first copy of anything is never reported, and all others are; where a passage was put together of several,
    it has a row for each, which overlap by up to 49 words. Repeated rows count as one document; null, empty and short texts give no rows.

    Suffixes are compared only where they can agree on 50 words: each such run holds a winnowed anchor, and
    suffixes around the same anchor are sorted together, by prefix doubling.
    """
    spans = _later(docs, id_col, text_col)
    return spans.select(id_or_null("doc", "doc_id"), F.col("start").alias("start_word"), (F.col("stop") - F.col("start")).alias("n_words"), id_or_null("other_doc", "first_doc_id"), F.col("other_start").alias("first_start_word"))


def drop_later_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = None) -> DataFrame:
    """``docs``, all columns, without the words of ``later_copies``; ``size_col`` names one to hold the characters left, others are untouched.

    Texts of which no word is left go; others stay, null and empty ones too. Repeated rows count as one document: all of them stay
    or go alike.
    """
    spans = _later(docs, id_col, text_col)

    def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in runs(batches):
            key, start, stop = (c.to_numpy() for c in b.columns)
            base = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]])) << 40
            reach = np.maximum.accumulate(base + stop)
            head = np.flatnonzero(np.concatenate([[True], base[1:] + start[1:] > reach[:-1]]))
            end = np.concatenate([head[1:], [len(key)]])
            yield pa.RecordBatch.from_arrays([pa.array(key[head]), pa.array(start[head]), pa.array(reach[end - 1] - base[head])], ["_lv_key", "start", "stop"])

    cuts = spans.select("key", "start", "stop").repartition("key").sortWithinPartitions("key", "start").mapInArrow(united, "_lv_key bigint, start bigint, stop bigint")
    cuts = durable(cuts.groupBy("_lv_key").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("_lv_cut")), "cuts")
    size = cuts.agg(F.coalesce(F.sum(16 + 16 * F.size("_lv_cut")), F.lit(0))).first()[0]
    forget(spans)
    if size <= BROADCAST_BYTES:
        cuts = F.broadcast(cuts)
    at, columns = docs.columns.index(text_col), list(docs.columns)

    def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, at):
                spans, text = b.column(len(columns)), b.column(at)
                if spans.null_count < len(spans):
                    hit = np.flatnonzero(~np.asarray(spans.is_null()))
                    new = text.to_pylist()
                    for i in hit.tolist():
                        new[i] = _cut(new[i], [(x["start"], x["stop"]) for x in spans[i].as_py()])
                    text = pa.array(new, text.type)
                    keep = np.ones(len(text), bool)
                    keep[hit] = [bool(new[i].strip(_SPACES)) for i in hit.tolist()]
                    b = pa.RecordBatch.from_arrays([text if i == at else b.column(i) for i in range(len(columns))], columns).filter(pa.array(keep))
                yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(columns))], columns)

    out = docs.withColumn("_lv_key", row_key(id_col, text_col)).join(cuts, "_lv_key", "left")
    return resized(out.select(*[F.col(f"`{c}`") for c in columns], "_lv_cut").mapInArrow(without, docs.schema), text_col, size_col)


def _cut(text: str, spans: list[tuple[int, int]]) -> str:
    data = text.encode()
    w = words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), SPACED)
    out, at = [], 0
    for first, stop in sorted(spans):
        out.append(data[at : max(at, int(w.start[first]))])
        at = max(at, int(w.start[stop]) if stop < len(w.start) else len(data))
    return b"".join([*out, data[at:]]).decode()


ORACLE = f"""
WITH t AS (SELECT *, regexp_extract_all(text, '\\S+') AS words, regexp_extract_all(text, '\\S+\\s*') AS parts, regexp_extract(text, '^\\s*') AS head FROM documents),
r AS (SELECT doc_id, i, doc_id * 100000000 + i AS place, array_to_string(words[i:i + {LEAST - 1}], ' ') AS run FROM (SELECT doc_id, words, unnest(range(1, len(words) - {LEAST - 2})) AS i FROM t WHERE len(words) >= {LEAST})),
f AS (SELECT run, min(place) AS first FROM r GROUP BY run HAVING count(*) > 1),
later AS (SELECT doc_id, i FROM r JOIN f USING (run) WHERE place > first),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {LEAST})) AS p FROM later),
p AS (SELECT doc_id, head, unnest(parts) AS part, unnest(range(1, len(parts) + 1)) AS p FROM t WHERE doc_id IN (SELECT doc_id FROM later)),
k AS (SELECT p.doc_id, head || string_agg(part, '' ORDER BY p.p) AS text FROM p ANTI JOIN gone ON gone.doc_id = p.doc_id AND gone.p = p.p GROUP BY p.doc_id, head)
SELECT doc_id, text, lang, source, CAST(length(text) AS BIGINT) AS n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM later)
UNION ALL SELECT d.doc_id, k.text, d.lang, d.source, CAST(length(k.text) AS BIGINT) FROM documents d JOIN k USING (doc_id)
"""
