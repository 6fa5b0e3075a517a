from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lexivane.llm import packing
from lexivane.llm.shared import durable
from tests.llm.fixtures import odd_rows, prose, row, table


def check(rows, out, length):
    """Every token once, windows full but the last, pieces in order."""
    size = Counter()
    for r in rows:
        size[r[0]] += len((r[1] or "").split())
    placed = Counter()
    fill = Counter()
    for r in out:
        placed[r["doc_id"]] += r["n_tokens"]
        fill[r["window_id"]] += r["n_tokens"]
        assert r["place"] + r["n_tokens"] <= length
    assert placed == Counter({d: n for d, n in size.items() if n})
    if fill:
        last = max(fill)
        assert sorted(fill) == list(range(last + 1))
        assert all(n == length for w, n in fill.items() if w != last)
    taken = sorted((r["window_id"], r["place"], r["n_tokens"]) for r in out)
    for (w, p, n), (w2, p2, _) in zip(taken, taken[1:], strict=False):
        assert (w2, p2) == (w, p + n) or (w2, p2) == (w + 1, 0)


def test_packing(spark):
    rows = []
    for i in range(12):
        words = prose(i, 90).split()
        rows += [row(10 * i + j, " ".join(words[: 60 + 5 * j] + [f"only{i}{j}{k}" for k in range(10)])) for j in range(4)]
    rows += [row(1000 + i, prose(500 + i, 40)) for i in range(10)]
    out = packing.pack_related(table(spark, rows), length=64).collect()
    check(rows, out, 64)
    paths = {}
    for r in out:
        paths.setdefault(r["path_id"], set()).add(r["doc_id"])
    related = [p for p in paths.values() if len(p) > 1]
    assert {frozenset(p) for p in related} == {frozenset(10 * i + j for j in range(4)) for i in range(12)}
    again = packing.pack_related(table(spark, rows).repartition(7), length=64).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_odd(spark):
    rows = odd_rows()
    out = packing.pack_related(table(spark)).collect()
    kept = [r for r in rows if r[1]]
    check([(r[0], r[1].replace(" ", "_")) for r in kept], out, packing.LENGTH)
    assert packing.pack_related(table(spark, [])).count() == 0
    assert packing.pack_related(table(spark, [row(1, None), row(2, " ")])).count() == 0
    signs = [row(1, "!!! ???"), row(2, "--"), row(3, "words here now")]
    check(signs, packing.pack_related(table(spark, signs)).collect(), packing.LENGTH)


def jaccard(docs):
    """Of each document of ``docs`` (doc_id, text) the shingles, and a function for one's similarity with all."""
    values, count = packing.shingles(pa.array([t for _, t in docs]))
    sets = [np.unique(x) for x in np.split(values, np.cumsum(count)[:-1])]
    order = np.argsort(flat := np.concatenate(sets), kind="stable")
    at, flat, size = np.repeat(np.arange(len(sets)), [len(x) for x in sets])[order], flat[order], np.array([len(x) for x in sets])

    def similarity(i):
        shared = np.zeros(len(sets))
        for a, b in zip(np.searchsorted(flat, sets[i]), np.searchsorted(flat, sets[i], "right"), strict=True):
            shared[at[a:b]] += 1
        shared /= np.maximum(size + size[i] - shared, 1)
        shared[i] = 0
        return shared

    return similarity


def links(spark, docs, sample, least):
    """How many of the sample's nearest by the texts' shingles, with a similarity of ``least``, the graph has, and how many it has as good within a tenth."""
    ids = {d: i for i, (d, _) in enumerate(docs)}
    sk = packing.sketches(spark.createDataFrame(docs, "doc_id bigint, text string")).where("length(sketch) > 0")
    nodes = durable(sk.groupBy("sketch").agg(F.min("key").alias("rep"), F.min_by("doc_id", "key").alias("doc_id")), "nodes")
    names = {r["rep"]: ids[r["doc_id"]] for r in nodes.select("rep", "doc_id").collect()}
    got = {}
    for e in packing.neighbours(nodes.select("rep", "sketch")).collect():
        got.setdefault(names[e["u"]], []).append(names[e["v"]])
    similarity, want, hit, near = jaccard(docs), 0, 0, 0
    for i in sample:
        s = similarity(i)
        best = np.sort(s[list(names.values())])[::-1][: packing.NEIGHBOURS]
        best = best[best >= least]
        have = np.sort(np.concatenate([s[got.get(i, [])], np.zeros(len(best))]))[::-1][: len(best)]
        want, hit, near = want + len(best), hit + (have >= best[-1:].sum() - 1e-9).sum(), near + (have >= 0.9 * best).sum()
    return hit / want, near / want


def test_recall(spark):
    """Neighbours against brute force over the texts' shingles."""
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").dropDuplicates(["text"]).orderBy("doc_id").collect()]
    sample = np.random.default_rng(0).choice(len(docs), 600, replace=False)
    exact, near = links(spark, docs, sample, 0.15)
    assert exact >= 0.9
    assert near >= 0.95
    assert links(spark, docs, sample, 0.1)[1] >= 0.9


def test_recall_of_a_hot_slot(spark, monkeypatch):
    """Boilerplate in all of many documents, far over what is compared at once, and pairs that are alike beside."""
    monkeypatch.setattr(packing, "BLOCK", 128)
    same = prose("same", 60)
    docs = [(i, f"{same} {prose(i // 3, 100, 10**6)} {prose(10_000 + i, 20, 10**6)}") for i in range(3000)]
    exact, near = links(spark, docs, range(0, 3000, 10), 0.5)
    assert exact >= 0.9
    assert near >= 0.9


def nearest_of(m, reps):
    """Of every node the likenesses of its nearest among all that share a bin with it, and these, by comparing all with all."""
    low = np.where(m > 0, 1 + (m >> 3) % 255, 0).astype(np.uint8)
    out = {}
    for i, u in enumerate(reps):
        met = ((m[:, : packing.SLOTS] == m[i, : packing.SLOTS]) & (m[:, : packing.SLOTS] > 0)).any(1)
        like = packing.alike(low, np.broadcast_to(low[i], low.shape))
        some = [j for j in np.flatnonzero(met & (like >= packing.LEAST_ALIKE)).tolist() if j != i]
        best = sorted(some, key=lambda j: (-like[j], ((reps[j] - u) % 2**64) >> 15, reps[j]))[: packing.NEIGHBOURS]
        if best:
            out[u] = [(int(like[j]), reps[j]) for j in best]
    return out


def neighbours_of(spark, docs):
    """What the graph has, and what it has to have, likewise."""
    sk = packing.sketches(spark.createDataFrame(docs, "doc_id bigint, text string")).where("length(sketch) > 0")
    nodes = durable(sk.groupBy("sketch").agg(F.min("key").alias("rep")).select("rep", "sketch"), "nodes")
    got = {}
    for e in packing.neighbours(nodes).collect():
        got.setdefault(e["u"], []).append((e["alike"], e["v"]))
    rows = nodes.collect()
    return got, nearest_of(np.stack([np.frombuffer(bytes(r["sketch"]), "<u4") for r in rows]), [r["rep"] for r in rows])


def hot(n):
    """Documents with boilerplate in common, in threes that are more alike, a few short."""
    same = prose("same", 60)
    return [(i, f"{same} {prose(i // 3, 100 if i % 7 else 3, 10**6)} {prose(10_000 + i, 20, 10**6)}") for i in range(n)]


def test_hot_slots_lose_no_partner(spark, monkeypatch):
    """Where far more nodes share a bin than are compared at once, each still has its nearest of all of them."""
    monkeypatch.setattr(packing, "BLOCK", 128)
    got, want = neighbours_of(spark, hot(900))
    assert {u: sorted((a for a, _ in x), reverse=True) for u, x in got.items()} == {u: [a for a, _ in x] for u, x in want.items()}


def test_parted_sets_lose_no_partner(spark, monkeypatch):
    """Sets compared in several tasks, and small ones, pair by pair or not: the same neighbours, those of equals that come next too."""
    docs = hot(500) + [(1000 + i, prose(f"{i // 5}", 40 + i % 5, 10**6)) for i in range(100)]
    for few, block, part in ((64, 4096, 1 << 16), (2, 50, 90), (1000, 4096, 1 << 16)):
        for name, value in (("FEW", few), ("BLOCK", block), ("PART", part)):
            monkeypatch.setattr(packing, name, value)
        got, want = neighbours_of(spark, docs)
        assert {u: sorted(x) for u, x in got.items()} == {u: sorted(x) for u, x in want.items()}


def test_equally_alike(spark):
    """Of many that are equally alike the nearest are those that come next, whatever sets they meet in."""
    n, k = 300, packing.NEIGHBOURS
    rng = np.random.default_rng(3)
    rep = np.sort(rng.integers(-(2**63), 2**63 - 1, n))
    s = np.zeros((n, packing.BINS), np.uint8)
    s[:, 0], s[:, 1] = 7, np.arange(n) % 255 + 1
    u, v, _ = packing._nearest(s[:255], rep[:255], k, 64)
    assert {(a, b) for a, b in zip(u.tolist(), v.tolist(), strict=True)} == {(int(rep[i]), int(rep[(i + j) % 255])) for i in range(255) for j in range(1, k + 1)}
    assert [x.tolist() for x in packing._nearest(s[:1], rep[:1], k, 64)] == [[], [], []]


def chains(u, v, w):
    nodes = np.unique(u)
    return [[int(nodes[c]) for c, _ in p] for p in packing.walk(nodes, nodes, u, v, w)]


def test_walk():
    # 1 - 2 - 3 - 4 and 3 - 5, where 3 and 5 are more alike
    pairs = {(1, 2): 3, (2, 3): 3, (3, 4): 1, (3, 5): 9}
    both = sorted([(a, b, w) for (a, b), w in pairs.items()] + [(b, a, w) for (a, b), w in pairs.items()])
    u, v, w = map(np.array, zip(*both, strict=True))
    assert chains(u, v, w) == [[1, 2, 3, 5], [4]]


def test_walk_against_plain():
    rng = np.random.default_rng(2)
    for _ in range(50):
        n = int(rng.integers(2, 30))
        pairs = {tuple(sorted(rng.choice(n, 2, replace=False).tolist())): int(rng.integers(1, 5)) for _ in range(2 * n)}
        near = {i: {} for i in range(n)}
        for (a, b), x in pairs.items():
            near[a][b] = near[b][a] = x
        nodes = [i for i in near if near[i]]
        left, want = set(nodes), []
        for start in sorted(nodes, key=lambda i: (len(near[i]), i)):
            if start not in left:
                continue
            left.discard(start)
            ends = []
            for _ in range(2):
                path, here = [], start
                while some := [x for x in near[here] if x in left]:
                    here = min(some, key=lambda x: (-near[here][x], len(near[x]), x))
                    left.discard(here)
                    path.append(here)
                ends.append(path)
            want.append([*reversed(ends[1]), start, *ends[0]])
        u, v, w = map(np.array, zip(*sorted([(a, b, x) for (a, b), x in pairs.items()] + [(b, a, x) for (a, b), x in pairs.items()]), strict=True))
        assert chains(u, v, w) == want


def test_walk_over_chains():
    """Chains 1..2 and 3..4 joined at the ends 2 and 4: the second is entered at its end, so it is reversed."""
    a, b = np.array([1, 3]), np.array([2, 4])
    assert packing.walk(a, b, np.array([2, 4]), np.array([4, 2]), np.array([5, 5])) == [[(0, False), (1, True)]]
    assert packing.walk(a, b, np.array([1, 4]), np.array([4, 1]), np.array([5, 5])) == [[(1, False), (0, False)]]
    assert packing.walk(a, b, np.array([1, 3]), np.array([3, 1]), np.array([5, 5])) == [[(1, True), (0, False)]]


def test_large_components_are_joined_again(spark, monkeypatch):
    """Walked in parts of a few nodes, as many neighbours are side by side as in one walk, or nearly."""
    base = [prose(f"b{i}", 40, 10**6).split() for i in range(121)]
    docs = [row(i, " ".join(base[i] + base[i + 1])) for i in range(120)]  # a line of documents, each like the next

    def side_by_side():
        paths = {}
        for r in packing.pack_related(table(spark, docs), length=10**6).orderBy("window_id", "place").collect():
            paths.setdefault(r["path_id"], []).append(r["doc_id"])
        return sum(abs(a - b) == 1 for p in paths.values() for a, b in zip(p, p[1:], strict=False))

    whole = side_by_side()
    assert whole == 119
    monkeypatch.setattr(packing, "WALK", 10)
    assert side_by_side() >= 0.95 * whole
    out = packing.pack_related(table(spark, docs), length=50).collect()
    check(docs, out, 50)


def test_windows_against_brute_force(spark):
    """Windows cut the laid-out tokens every ``length``, whatever the number of lanes."""
    rows = [row(i, prose(i // 2, 30 + i, 10**6)) for i in range(25)]
    out = sorted((r["window_id"], r["place"], r["doc_id"], r["first_token"], r["n_tokens"]) for r in packing.pack_related(table(spark, rows), length=37).collect())
    order = list(dict.fromkeys(r[2] for r in out))
    want, at = [], 0
    for d in order:
        n, first = 30 + d, 0
        while n:
            k = min(n, 37 - at % 37)
            want.append((at // 37, at % 37, d, first, k))
            at, first, n = at + k, first + k, n - k
    assert out == want
