"""Slow and plain versions of the operators, to hold them against."""

import math
import re
from collections import Counter, defaultdict


def components(nodes, pairs):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def runs_of(words, n):
    return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]


SPACES = " \t\n\v\f\r\x1c\x1d\x1e\x1f"


def split(text):
    return [w for w in re.split(f"[{SPACES}]+", text or "") if w]


def repeats(texts, n):
    """Later copies, and all repeats, as the two operators define them: document, first word, words, the other document, and its first word."""
    words = {d: split(t) for d, t in texts.items()}
    where = defaultdict(list)
    for d in sorted(words):
        for i, r in enumerate(runs_of(words[d], n)):
            where[r].append((d, i))
    first, last = {}, {}
    for places in where.values():
        if len(places) > 1:
            for p in places:
                first[p], last[p] = places[0], places[-1]

    def chained(firsts):
        on = defaultdict(list)
        for d, i in sorted(first):
            other = first[d, i]
            if other == (d, i):
                if not firsts:
                    continue
                other = last[d, i]
            on[d, other[0], i - other[1]].append(i)
        out = set()
        for (d, o, diagonal), starts in on.items():
            for k, i in enumerate(starts):
                if not k or starts[k - 1] != i - 1:
                    begin = i
                if k + 1 == len(starts) or starts[k + 1] != i + 1:
                    out.add((d, begin, i - begin + n, o, begin - diagonal))
        return out

    every, reach = set(), {}
    for d, s, k, o, t in sorted(chained(True)):
        x, y = words[d], words[o]
        if s + k <= reach.get((d, o), -1):
            continue
        while s and t and x[s - 1] == y[t - 1]:
            s, t, k = s - 1, t - 1, k + 1
        while s + k < len(x) and t + k < len(y) and x[s + k] == y[t + k]:
            k += 1
        reach[d, o] = max(reach.get((d, o), -1), s + k)
        every.add((d, s, k, o, t))
    return chained(False), every


def entropy(s):
    return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values())


def longest_matches(words, items):
    """After each word the length of the longest run that ends there and is in some item."""
    subs = {tuple(t[i:j]) for t in items for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    out = []
    for e in range(1, len(words) + 1):
        out.append(max((n for n in range(1, e + 1) if tuple(words[e - n : e]) in subs), default=0))
    return out
