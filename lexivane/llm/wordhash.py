"""Vectorised words: spans, 64-bit hashes and rolling n-gram hashes over whole buffers of text."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lexivane.llm.shared import utf8

_rng = np.random.default_rng(20240611)
_BYTE = _rng.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_Q = np.uint64(0xD1B54A32D192ED03)
_Q_INV = np.uint64(pow(int(_Q), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}

#: Bytes of words: all but ASCII white space.
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = False
#: Bytes of words: ASCII letters and digits, and all of UTF-8's other bytes.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1), modulo 2 ** 64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = np.cumprod(have)
        if n < 1 << 24:
            _powers[int(base)] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads each 64-bit value over all its bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


@dataclass
class Words:
    """Words of a run of documents: byte spans, hashes, and the n + 1 offsets of the documents' words."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    off: np.ndarray

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.off) - 1), np.diff(self.off))


def words(buf: np.ndarray, off: np.ndarray, table: np.ndarray = SPACED) -> Words:
    """Maximal runs of ``table``'s bytes, none across documents."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(z, z, np.zeros(0, np.uint64), np.zeros(len(off), np.int64))
    inside = table[buf]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = off[1:] > off[:-1]
    at = off[:-1][full]
    first[at] = inside[at]
    at = off[1:][full] - 1
    last[at] = inside[at]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[buf] * powers(_P, n), out=total[1:])
    h = mix((total[e] - total[s]) * powers(_P_INV, n)[s])
    return Words(s, e, h, np.searchsorted(s, off))


def spaced(buf: np.ndarray) -> np.ndarray:
    """The bytes with Unicode's general punctuation, its spaces and Latin-1's signs made blank."""
    buf = buf.copy()
    at = np.flatnonzero(buf[:-1] == 0xC2)
    at = at[(buf[at + 1] < 0xC0) & ~np.isin(buf[at + 1], (0xAA, 0xB5, 0xBA))]
    buf[at] = buf[at + 1] = 32
    at = np.flatnonzero((buf[:-2] == 0xE2) & (buf[1:-1] == 0x80) | (buf[:-2] == 0xE3) & (buf[1:-1] == 0x80)) if len(buf) > 2 else at[:0]
    buf[at] = buf[at + 1] = buf[at + 2] = 32
    return buf


def normal_words(col: pa.Array) -> Words:
    """Words without case or punctuation."""
    buf, off = utf8(pc.utf8_lower(col))
    return words(spaced(buf), off, ALNUM)


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` hashes that begin at each place; those that would pass the end are left out."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(_Q, len(h)), out=total[1:])
    return mix((total[n:] - total[:-n]) * powers(_Q_INV, len(h))[: len(h) - n + 1])


def whole(off: np.ndarray, n: int) -> np.ndarray:
    """Of the places at which ``ngrams`` begin, which lie within one document."""
    total = int(off[-1])
    if total < n:
        return np.zeros(0, bool)
    left = np.repeat(off[1:], np.diff(off)) - np.arange(total)
    return left[: total - n + 1] >= n
