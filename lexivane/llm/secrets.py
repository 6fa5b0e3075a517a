"""Operator 6: secret scans by sliding-window entropy."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexivane.llm.shared import resized, slices, utf8

#: Characters to a window, and the fewest of a candidate.
WINDOW = 20
#: Bits a character of a window that make a secret, by class of the candidate's characters.
LIMITS = {"hex": 3.0, "alnum": 3.7, "base64": 3.8, "upper": 3.0, "lower": 3.2, "letters": 3.4}
#: Whole candidates that are no secrets, and words before them that say so.
ALLOWED = (
    r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}",  # UUID
    r"(?:[A-Za-z0-9]*(?:EXAMPLE|example|sample|SAMPLE|xxxx|XXXX)[A-Za-z0-9+/=_-]*)",
    r"(?:0123456789|abcdefghij|ABCDEFGHIJ)[A-Za-z0-9+/=_-]*",
    r"sha(?:1|256|384|512)-[A-Za-z0-9+/=]+",
)
ALLOWED_BEFORE = r"(?:commit|revision|fingerprint|checksum|md5|sha-?1|sha-?256|sha-?512|etag|integrity)[\s:=\"']{1,4}$"
#: Classes of which words, numbers and paths are no secrets, see ``readable``.
WORDY = ("upper", "lower", "letters")
SCHEMA = "doc_id bigint, start_byte bigint, n_bytes bigint, kind string, entropy double, from_byte bigint, to_byte bigint"
MARK = "<secret>"
_IN, _DIGIT, _UPPER, _LOWER, _HEX = (np.zeros(256, bool) for _ in range(5))
_DIGIT[48:58] = _UPPER[65:91] = _LOWER[97:123] = True
_HEX[[*range(48, 58), *range(65, 71), *range(97, 103)]] = True
_IN[[*b"+/=_-"]] = True
_IN |= _DIGIT | _UPPER | _LOWER
_PLAIN = _DIGIT | _UPPER | _LOWER
_UUID = re.compile(ALLOWED[0])
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[A-Z]|[0-9]+")
#: Consonants that stand together in words, taken for one.
_CLUSTERS = re.compile(r"sch|chr|str|[cst]h|ph|pf|ck|h[lmnr]|n[dgkt]|s[pt]|t[sz]|qu|[rl][dgkmnst]|[bcdfgkpt][lr]|([b-df-hj-np-tv-z])\1")


def windows(data: bytes, size: int = WINDOW) -> list[float]:
    """Shannon entropy, in bits a character, of each window of ``size``: counts change by the character that comes and the one that goes."""
    f = [0.0] + [c * math.log2(c) for c in range(1, size + 2)]
    count, total, out, top = [0] * 256, 0.0, [], math.log2(size)
    for i, c in enumerate(data):
        k = count[c] = count[c] + 1
        total += f[k] - f[k - 1]
        if i >= size:
            k = count[data[i - size]] = count[data[i - size]] - 1
            total += f[k] - f[k + 1]
        if i >= size - 1:
            out.append(top - total / size)
    return out


def candidates(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Document, first byte, end and class of each run of key characters that is long and mixed enough."""
    inside = np.concatenate([[False], _IN[buf], [False]])
    edge = np.diff(inside.astype(np.int8))
    cuts = off[1:-1]
    s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    cuts = cuts[(cuts > 0) & (cuts < len(buf))]
    cuts = np.unique(cuts[inside[cuts] & inside[cuts + 1]])  # runs over the edge of two documents
    s, e = np.sort(np.concatenate([s, cuts])), np.sort(np.concatenate([e, cuts]))
    keep = e - s >= WINDOW
    s, e = s[keep], e[keep]

    def some(table: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(table[buf])])
        return total[e] - total[s]

    if not len(s):
        return s, s, e, []
    digits, upper, lower, n = some(_DIGIT), some(_UPPER), some(_LOWER), e - s
    hexes = (some(_HEX) == n) & (digits > 0) & (digits < n)
    mixed = (digits > 0) & (upper > 0) & (lower > 0) & ~hexes
    plain = some(_PLAIN) == n
    keep = hexes | (upper + lower > 0)
    kind = np.where(hexes, "hex", np.where(mixed, np.where(plain, "alnum", "base64"), np.where(digits == 0, "letters", np.where(upper > 0, "upper", "lower"))))
    return np.searchsorted(off, s[keep], "right") - 1, s[keep], e[keep], kind[keep].tolist()


def readable(run: str) -> bool:
    """Whether a run is put together of numbers and of what can be spoken, as names, slugs and paths are."""
    run = _UUID.sub("", run)
    if any(len(p) >= WINDOW and re.search("[a-zA-Z][0-9]+[a-zA-Z]", p) for p in re.split("[+/=_-]", run)):
        return False
    parts = _PARTS.findall(run)
    words = [p.lower() for p in parts if not p.isdigit()]
    if len(parts) > 2 and 10 * sum(map(len, parts)) < 33 * len(parts):  # many changes of case and class
        return False
    for w in words:
        vowels = len(re.findall("[aeiouy]", w))
        if len(w) > 4 and (vowels < 0.28 * len(w) - 1 or re.search("[b-df-hj-np-tv-xz]{4}", _CLUSTERS.sub("t", w))):
            return False
    return True


class Scan:
    def __init__(self, allowed: tuple[str, ...], before: str, limits: dict[str, float] | None):
        self.allowed, self.before, self.limits = re.compile("|".join(f"(?:{x})" for x in allowed) or r"(?!)"), re.compile(before or r"(?!)", re.IGNORECASE), LIMITS | (limits or {})

    def __call__(self, col: pa.Array) -> Iterator[tuple[int, int, int, str, float, int, int]]:
        """Document, first byte and end in its text, class, highest entropy, and the union of the windows over the limit."""
        buf, off = utf8(col)
        for d, s, e, kind in zip(*(x if isinstance(x, list) else x.tolist() for x in candidates(buf, off)), strict=True):
            data = buf[s:e].tobytes()
            h = windows(data)
            if kind in WORDY:  # such keys hold no slash, what holds one is a path
                h = [0.0 if b"/" in data[i : i + WINDOW] else x for i, x in enumerate(h)]
            over = [i for i, x in enumerate(h) if x >= self.limits[kind]]
            if not over or self.allowed.fullmatch(data.decode()) or kind in WORDY and readable(data.decode()) or self.before.search(buf[max(int(off[d]), s - 24) : s].tobytes().decode(errors="replace")):
                continue
            base = int(off[d])
            yield d, s - base, e - base, kind, max(h), s - base + over[0], s - base + over[-1] + WINDOW


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allowed: tuple[str, ...] = ALLOWED, allowed_before: str = ALLOWED_BEFORE, limits: dict[str, float] | None = None) -> DataFrame:
    """Strings that look like keys: ``doc_id, start_byte, n_bytes, kind, entropy, from_byte, to_byte``.

    Candidates are runs of letters, digits and ``+/=_-`` of 20 or more with a letter: hexadecimal with digits, of
    all of upper case, lower case and digits, or (``upper``, ``lower``, ``letters``) of less, if they aren't ``readable``
    (windows of these with a slash don't count). Digits and signs alone are left out. One is a secret if the entropy
    of any window of 20 reaches the limit of its class (``entropy`` is the highest, ``from_byte`` to ``to_byte`` the union of the
    windows that reach it), unless it matches ``allowed`` or follows ``allowed_before``. Offsets are bytes of
    the text in UTF-8. The secret itself isn't returned. Null and empty texts give no rows; repeated rows give
    theirs each; a null id stays null. One narrow pass: no shuffle.
    """
    scan = Scan(allowed, allowed_before, limits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 1):
                if rows := list(scan(b.column(1))):
                    d, s, e, kind, h, f, t = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(d, pa.int64())), pa.array(s, pa.int64()), pa.array([y - x for x, y in zip(s, e, strict=True)], pa.int64()), pa.array(kind), pa.array([round(x, 6) for x in h]), pa.array(f, pa.int64()), pa.array(t, pa.int64())],
                        ["doc_id", "start_byte", "n_bytes", "kind", "entropy", "from_byte", "to_byte"],
                    )

    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, SCHEMA)


def redact_secrets(docs: DataFrame, text_col: str = "text", allowed: tuple[str, ...] = ALLOWED, allowed_before: str = ALLOWED_BEFORE, limits: dict[str, float] | None = None, size_col: str | None = None) -> DataFrame:
    """``docs``, all rows and columns, with ``<secret>`` for each string that ``find_secrets`` reports; ``size_col`` names one to hold the characters there are then.

    Null and empty texts stay as they are, and so do repeated rows and null ids; an empty table stays empty. A text is rebuilt once,
    however long it is and however many secrets it has.
    """
    at, columns, scan = docs.columns.index(text_col), list(docs.columns), Scan(allowed, allowed_before, limits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, at):
                if rows := list(scan(b.column(at))):
                    text, cuts = b.column(at).to_pylist(), {}
                    for d, first, stop, *_ in rows:
                        cuts.setdefault(d, []).append((first, stop))
                    for d, spans in cuts.items():
                        data, parts, end = text[d].encode(), [], 0
                        for first, stop in spans:
                            parts += [data[end:first], MARK.encode()]
                            end = stop
                        text[d] = b"".join([*parts, data[end:]]).decode()
                    b = pa.RecordBatch.from_arrays([pa.array(text, b.column(at).type) if i == at else c for i, c in enumerate(b.columns)], columns)
                yield b

    out = docs.mapInArrow(run, docs.schema)
    return resized(out, text_col, size_col)
