"""Operator 10: toxicity by a weighted lexicon, matched by Aho-Corasick after folding disguises."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivane.llm.neardup import drop_near_duplicates
from lexivane.llm.shared import durable, slices, utf8

#: Whole words and their weights, after folding.
LEXICON = {
    "idiot": 1.0, "idiots": 1.0, "idiotic": 0.8, "moron": 1.0, "morons": 1.0, "moronic": 0.8, "scum": 1.0, "scumbag": 1.0, "loser": 0.8, "losers": 0.8, "clown": 0.7, "clowns": 0.7,
    "trash": 0.7, "pathetic": 0.8, "worthless": 0.9, "stupid": 0.9, "stupidity": 0.6, "disgusting": 0.8, "imbecile": 1.0, "imbeciles": 1.0, "dumbass": 1.0, "dimwit": 0.9, "halfwit": 0.9, "nitwit": 0.9,
    "vermin": 1.0, "filth": 0.8, "degenerate": 0.8, "lowlife": 1.0, "bastard": 1.0, "bastards": 1.0, "asshole": 1.0, "assholes": 1.0, "bitch": 1.0, "bitches": 1.0, "fuck": 1.0, "fucking": 1.0, "fucker": 1.0,
    "shithead": 1.0, "bullshit": 0.8, "dickhead": 1.0, "cretin": 0.9, "dumb": 0.7, "jackass": 0.9, "kill yourself": 2.0, "shut up": 0.7, "piece of shit": 1.5, "nobody likes you": 1.2,
    "dummkopf": 1.0, "vollidiot": 1.0, "arschloch": 1.0, "drecksack": 1.0, "abschaum": 1.0, "connard": 1.0, "connasse": 1.0, "salaud": 1.0, "abruti": 1.0, "idiota": 1.0, "idiotas": 1.0, "estupido": 0.9, "estupida": 0.9, "gilipollas": 1.0, "pendejo": 1.0, "imbecil": 1.0,
}
#: Phrases within which nothing counts.
EXCEPTIONS = ("trash can", "trash cans", "trash bin", "trash bag", "trash collection", "clown fish", "clown car", "clown shoes", "circus clown", "sore loser", "loser bracket", "moron test", "dumb bell", "dumb waiter", "dumb terminal", "the idiot by dostoevsky", "shut up shop", "pathetic fallacy", "degenerate case", "degenerate matter")
#: Weight to a hundred words that makes a document toxic, and the least weight in all.
RATE, LEAST = 0.1, 0.7
#: The bound of the labelled sample that words are learned from; documents of it that a word must mark; how much oftener in toxic ones; its weight.
LABEL_ROWS, LEAST_MARKED, LEAST_RATIO, LEARNED = 20_000, 6, 30.0, 0.45
SCHEMA = "doc_id bigint, score double, weight double, n_hits bigint, n_words bigint"
_CYRILLIC_GREEK = dict(zip("абвгдеёзіїјкмнорсѕтухԁһոսαβεικνορτυχγηω", "abbrdeesiijkmhopcstyxdhnuabeikvoptuxynw", strict=True))
_DIGITS = dict(zip(b"0134578@$", b"oieastbas", strict=True))


def _two_byte() -> np.ndarray:
    """For each code point under 0x800 the letter that it passes for, or 0."""
    table = np.zeros(0x800, np.uint8)
    for cp in range(0x80, 0x800):
        c = chr(cp).lower()
        c = _CYRILLIC_GREEK.get(c[0]) or unicodedata.normalize("NFKD", c)[0]
        c = {"ø": "o", "ł": "l", "đ": "d", "ı": "i", "ß": "s"}.get(c, c)
        if c.isascii() and c.isalpha():
            table[cp] = ord(c)
    return table


_TWO = _two_byte()
#: For each code point under 0x800 its lower case, where that is under 0x800 too.
_SMALL = np.array([ord(c) if len(c := chr(cp).lower()) == 1 and 0x80 <= ord(c) < 0x800 else cp for cp in range(0x800)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[[*range(97, 123), *range(128, 256)]] = True
_SUB = np.zeros(256, np.uint8)
for _k, _v in _DIGITS.items():
    _SUB[_k] = _v
_EURO = (0xE2, 0x82, 0xAC)


def fold(buf: np.ndarray, off: np.ndarray, plain: bool = True, tails: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Texts as words of plain letters, one blank between them and at either end, and their offsets.

    Case, accents and look-alike letters of other scripts are folded (without ``plain`` case only); invisible characters go; digits and
    signs that stand for letters become these if a letter follows, as in ``1d10t`` or ``$tupid``, and are
    blanks otherwise, as in ``stupid$$$``; with ``tails`` they also do if one goes before, as in ``dumba$$``.
    """
    buf, gone = _LOWER[buf], np.zeros(len(buf), bool)
    if len(buf) and buf.max() >= 0x80:
        at = np.flatnonzero((buf >= 0xC2) & (buf <= 0xDF))
        cp = (buf[at].astype(np.int64) & 31) << 6 | buf[at + 1] & 63
        known = (_TWO[cp] > 0) & plain
        if not plain:
            small = _SMALL[cp]
            buf[at], buf[at + 1] = 0xC0 | small >> 6, 0x80 | small & 63
        buf[at[known]] = _TWO[cp[known]]
        gone[at[known] + 1] = True
        gone[(soft := at[cp == 0xAD])] = gone[soft + 1] = True
        blank = at[(cp < 0xC0) & (cp != 0xAD) & ~known]
        buf[blank] = buf[blank + 1] = 32
        at = np.flatnonzero((buf >= 0xE0) & (buf <= 0xEF))
        cp = (buf[at].astype(np.int64) & 15) << 12 | (buf[at + 1].astype(np.int64) & 63) << 6 | buf[at + 2] & 63
        wide = (cp >= 0xFF01) & (cp <= 0xFF5E)
        buf[at[wide]] = _LOWER[cp[wide] - 0xFEE0]
        gone[at[wide] + 1] = gone[at[wide] + 2] = True
        none = at[(cp >= 0x200B) & (cp <= 0x200D) | (cp == 0x2060) | (cp == 0xFEFF)]
        gone[none] = gone[none + 1] = gone[none + 2] = True
        blank = at[(cp >= 0x2000) & (cp <= 0x206F) & (cp != 0x2060) & ~((cp >= 0x200B) & (cp <= 0x200D)) | (cp == 0x3000)]
        buf[blank] = buf[blank + 1] = buf[blank + 2] = 32
        if gone.any():
            off = off - np.concatenate([[0], np.cumsum(gone)])[off]
            buf = buf[~gone]
    sub = _SUB[buf] > 0
    if sub.any():
        step = np.diff(np.concatenate([[False], sub, [False]]).astype(np.int8))
        s, e = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        follows = e < len(buf)
        follows[follows] = _LETTER[buf[e[follows]]]
        follows &= off[np.searchsorted(off, e - 1, "right")] > e  # within the document
        if tails:
            goes = s > 0
            goes[goes] = _LETTER[buf[s[goes] - 1]]
            follows |= goes & (off[np.searchsorted(off, s, "right") - 1] < s)
        inside = np.zeros(len(buf) + 1, np.int8)
        inside[s[follows]], inside[e[follows]] = 1, -1
        put = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
        buf[put] = _SUB[buf[put]]
    letter = _LETTER[buf]
    buf[~letter] = 32
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of each run of blanks the first
    head = off[:-1][off[:-1] < len(buf)]
    keep[head] = letter[head]
    off = np.concatenate([[0], np.cumsum(keep)])[off]
    return np.insert(np.insert(buf[keep], off[:-1], 32), np.arange(len(off) - 1) + off[1:] + 1, 32), off + 2 * np.arange(len(off))


@lru_cache(4)
def _automaton(lexicon: tuple, exceptions: tuple):
    import ahocorasick

    a = ahocorasick.Automaton()
    for phrase in exceptions:
        a.add_word(f" {phrase} ", (None, len(phrase)))
    for phrase, weight in lexicon:
        key = f" {phrase} ".encode().decode("latin-1")  # as the folded bytes are read
        a.add_word(key, (weight, len(key) - 2))
    a.make_automaton()
    return a


def hits(text: str, automaton) -> list[tuple[int, float]]:
    """Place and weight of each match in a folded text that no exception's match holds."""
    if not len(automaton):
        return []
    found, safe = [], []
    for end, (weight, n) in automaton.iter(text):
        (safe if weight is None else found).append((end - n, end, weight))
    if not safe or not found:
        return [(s, w) for s, _, w in found]
    begin, end = np.array(sorted((a, b) for a, b, _ in safe)).T
    reach = np.maximum.accumulate(end)  # the furthest end of the exceptions that begin so far
    s, e = np.array([(s, e) for s, e, _ in found]).T
    at = np.searchsorted(begin, s, "right") - 1
    held = (at >= 0) & (reach[at] >= e)
    return [(s, w) for (s, _, w), h in zip(found, held.tolist(), strict=True) if not h]


def _word_starts(buf: np.ndarray) -> np.ndarray:
    starts = _LETTER[buf]
    starts[1:] &= ~_LETTER[buf[:-1]]
    return starts


def _tailed(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The rows in which a digit or sign that stands for a letter comes right after a letter."""
    at = np.flatnonzero((_SUB[buf[1:]] > 0) & (_LETTER[_LOWER[buf[:-1]]] | (_SUB[buf[:-1]] > 0)))
    return np.unique(np.searchsorted(off, at, "right") - 1)


def counted(col: pa.Array, automaton) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, word of the row and weight of each match of a lexicon, and how many words each row has.

    Texts are read twice where signs at the end of a word may be letters or none; a word counts once, as what weighs most.
    """
    best: dict[tuple[int, int], float] = {}
    n = np.zeros(len(col), np.int64)
    for tails in (False, True):
        rows = np.arange(len(col)) if not tails else _tailed(*utf8(col))
        if not len(rows):
            break
        buf, off = fold(*utf8(col.take(pa.array(rows)) if tails else col), tails=tails)
        total = np.concatenate([[0], np.cumsum(_word_starts(buf))])
        if not tails:
            n = np.diff(total[off])
        for place, w in hits(buf.tobytes().decode("latin-1"), automaton):
            r = int(np.searchsorted(off, place, "right")) - 1
            key = (int(rows[r]), int(total[place] - total[off[r]]))
            best[key] = max(best.get(key, 0.0), w)
    if not best:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0), n
    at = np.array(list(best))
    return at[:, 0], at[:, 1], np.array(list(best.values())), n


def learn_lexicon(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = LABEL_ROWS) -> dict[str, float]:
    """Words that labels show to mark toxic documents, in any language, each with the weight LEARNED; two are needed to make a document toxic.

    The sample is the ``rows`` labelled documents whose ids hash lowest, one of each group of near duplicates, as
    copies say nothing more. A word is taken if LEAST_MARKED toxic ones hold it, and LEAST_RATIO times as large a
    share of these as of the others. Null labels and ids are left out; without labels of both kinds nothing is learned.
    """
    known = labels.select(labels[id_col].cast("bigint").alias("doc_id"), labels[label_col].cast("int").alias("toxic")).dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    sample = drop_near_duplicates(durable(texts.join(F.broadcast(known), "doc_id"), "labelled"))  # ``rows`` ids at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 0):
                buf, off = fold(*utf8(b.column(0)), plain=False)
                found = [(w, t) for i, j, t in zip(off, off[1:], b.column(1).to_pylist(), strict=False) for w in {*buf[i:j].tobytes().split()}]
                yield pa.RecordBatch.from_arrays([pa.array([w.decode(errors="replace") for w, _ in found], pa.string()), pa.array([t for _, t in found], pa.int32())], ["word", "toxic"])

    sample = durable(sample, "sample")
    total = {bool(t): n for t, n in sample.groupBy(F.col("toxic") > 0).count().collect()}
    if len(total) < 2:
        return {}
    counts = sample.select("text", "toxic").mapInArrow(run, "word string, toxic int").groupBy("word").agg(F.sum((F.col("toxic") > 0).cast("int")).alias("a"), F.sum((F.col("toxic") <= 0).cast("int")).alias("b"))
    marks = counts.where((F.col("a") >= LEAST_MARKED) & (F.col("a") / total[True] >= LEAST_RATIO * (F.col("b") + 0.5) / total[False]))
    return {r["word"]: LEARNED for r in marks.select("word").collect()}


def score_toxicity(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lexicon: dict[str, float] | None = None, learned: dict[str, float] | None = None, exceptions: tuple[str, ...] = EXCEPTIONS, rate: float = RATE, least: float = LEAST, only_toxic: bool = True
) -> DataFrame:
    """Toxic documents: ``doc_id, score, weight, n_hits, n_words``, by the lexicon's words in each.

    ``weight`` sums the weights of the matches outside exception phrases, ``score`` is that to a hundred
    words; a document is toxic from ``rate`` and ``least`` on. ``only_toxic=False`` gives all documents.
    A null or empty text scores 0; repeated rows give a row each; a null id stays null. A lexicon's
    phrases are in plain lower-case letters with single blanks; ``learned`` words (see ``learn_lexicon``) keep their
    accents, and those of the lexicon are not counted again. One narrow pass: no shuffle.
    """
    words = LEXICON if lexicon is None else lexicon
    extra = tuple(sorted((w, x) for w, x in (learned or {}).items() if w not in words))
    words = tuple(sorted(words.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexical, marks = (_automaton(w, tuple(exceptions)) if w else None for w in (words, extra))
        for whole in batches:
            for b in slices(whole, 1):
                n = b.num_rows
                weight, count = np.zeros(n), np.zeros(n, np.int64)
                d, _, w, size = counted(b.column(1), lexical or _automaton((), ()))
                np.add.at(weight, d, w)
                np.add.at(count, d, 1)
                if marks:
                    buf, off = fold(*utf8(b.column(1)), plain=False)
                    if h := hits(buf.tobytes().decode("latin-1"), marks):
                        place, w = map(np.array, zip(*h, strict=True))
                        d = np.searchsorted(off, place, "right") - 1
                        np.add.at(weight, d, w)
                        np.add.at(count, d, 1)
                score = np.round(100 * weight / np.maximum(size, 1), 6)
                keep = (score >= rate) & (weight >= least) if only_toxic else np.ones(n, bool)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array(np.round(weight, 6)), pa.array(count), pa.array(size)], ["doc_id", "score", "weight", "n_hits", "n_words"]).filter(pa.array(keep))

    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, SCHEMA)
