"""Operator 7: language identification by a convolutional network over bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexivane.llm.shared import durable, slices, small, utf8

#: Bytes to a window, bytes that windows overlap, numbers of an embedding, widths of filters, filters of each width.
WINDOW, OVERLAP, DEPTH, WIDTHS, FILTERS = 128, 4, 8, (2, 3, 4, 5), 8
#: The bound of the training sample: labelled documents of each language, and windows of each of these.
TRAIN_ROWS, TRAIN_WINDOWS = 400, 6
EPOCHS, BATCH, RATE, SEED = 6, 64, 0.003, 7
SCHEMA = "doc_id bigint, language string, probability double, n_windows bigint"
_WIDE, _ALL = max(WIDTHS), len(WIDTHS) * FILTERS
_MASK = np.zeros((_WIDE * DEPTH, _ALL), np.float32)
for _i, _w in enumerate(WIDTHS):
    _MASK[: _w * DEPTH, _i * FILTERS : (_i + 1) * FILTERS] = 1


@dataclass
class Network:
    """Embedding, filters of all widths as one matrix (zero past a filter's width), and the output layer."""

    languages: list[str]
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def columns(self, windows: np.ndarray) -> np.ndarray:
        """For each place of each window the embeddings of the widest filter's bytes."""
        x = self.embed[windows]
        return sliding_window_view(x, _WIDE, axis=1).transpose(0, 1, 3, 2).reshape(len(x), -1, _WIDE * DEPTH)

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        a = self.columns(windows)
        return np.maximum((a.reshape(-1, a.shape[2]) @ self.filters).reshape(len(a), a.shape[1], -1).max(1) + self.bias, 0)

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        z = self.pooled(windows) @ self.out + self.out_bias
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))


def cut_windows(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of each text, the last one filled up with zeros, how many each text has, and each one's own bytes."""
    size, stride = np.diff(off), WINDOW - OVERLAP
    count = np.where(size > 0, np.maximum(1, -(-(size - OVERLAP) // stride)), 0)
    d = np.repeat(np.arange(len(size)), count)
    begin = (np.arange(len(d)) - np.repeat(np.cumsum(count) - count, count)) * stride
    own = np.minimum(WINDOW, size[d] - begin)
    at = (off[d] + begin)[:, None] + np.arange(WINDOW)
    inside = np.arange(WINDOW) < own[:, None]
    return np.where(inside, buf[np.where(inside, at, 0)], 0).astype(np.uint8) if len(d) else np.zeros((0, WINDOW), np.uint8), count, own


def fit(windows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """Trains by Adam on windows and the places of their languages."""
    rng = np.random.default_rng(seed)
    draw = lambda *s, scale: rng.normal(0, scale, s).astype(np.float32)
    net = Network(languages, draw(256, DEPTH, scale=0.5), draw(_WIDE * DEPTH, _ALL, scale=0.2) * _MASK, np.zeros(_ALL, np.float32), draw(_ALL, len(languages), scale=0.2), np.zeros(len(languages), np.float32))
    net.embed[0] = 0
    names = ("embed", "filters", "bias", "out", "out_bias")
    first, second, step = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), BATCH):
            x, y = windows[order[at : at + BATCH]], labels[order[at : at + BATCH]]
            a = net.columns(x)
            z = (a.reshape(-1, a.shape[2]) @ net.filters).reshape(len(a), a.shape[1], -1)
            where = z.argmax(1)
            top = np.take_along_axis(z, where[:, None], 1)[:, 0] + net.bias
            h = np.maximum(top, 0)
            s = h @ net.out + net.out_bias
            p = np.exp(s - s.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p /= len(y)
            g = (p @ net.out.T) * (top > 0)
            seen = a[np.arange(len(a))[:, None], where]
            grad = {"out": h.T @ p, "out_bias": p.sum(0), "bias": g.sum(0), "filters": np.einsum("bfk,bf->kf", seen, g) * _MASK, "embed": np.zeros_like(net.embed)}
            back = (g[:, :, None] * net.filters.T).reshape(len(a), _ALL, _WIDE, DEPTH)
            bytes_at = x[np.arange(len(a))[:, None, None], where[:, :, None] + np.arange(_WIDE)]
            np.add.at(grad["embed"], bytes_at, back)
            grad["embed"][0] = 0
            step += 1
            for k in names:
                first[k] = 0.9 * first[k] + 0.1 * grad[k]
                second[k] = 0.999 * second[k] + 0.001 * grad[k] ** 2
                setattr(net, k, (getattr(net, k) - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32))
    return net


def sample(docs: DataFrame, id_col: str, text_col: str, label_col: str, rows: int) -> DataFrame:
    """``rows`` labelled documents of each language, those whose ids and texts hash lowest, or all if there are fewer: ``label, text``, written.

    Repeated rows count as one. Hashes over what a language's number of rows makes nearly certain to be too high are looked at only where
    the others, once repeated rows are put together, turn out to be too few; so the sample is the same as without that bound.
    """
    label, text = docs[label_col].cast("string"), docs[text_col].cast("string")
    slim = docs.where(label.isNotNull() & (F.length(text) > 0)).select(label.alias("label"), text.alias("text"), F.xxhash64(docs[id_col], text).alias("h"))
    sizes = durable(slim.groupBy("label").agg(F.count("*").alias("size")).withColumn("share", (2 * rows + 100) / F.col("size")), "languages")

    def lowest(some: DataFrame) -> DataFrame:
        once = some.select("label", "text", "h").dropDuplicates(["label", "h"])
        return once.withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy("h"))).where(F.col("n") <= rows).select("label", "text")

    low = slim.join(small(sizes, 64), "label").where(F.col("h") / 2.0**64 + 0.5 < F.col("share"))
    chosen = durable(lowest(low), "sample")
    have = chosen.groupBy("label").agg(F.count("*").alias("have"))
    few = durable(sizes.join(have, "label", "left").where((F.coalesce("have", F.lit(0)) < rows) & (F.col("share") < 1)).select("label"), "few")
    if few.isEmpty():
        return chosen
    few = small(few, 64)
    return durable(chosen.join(few, "label", "left_anti").unionByName(lowest(slim.join(few, "label"))), "sample")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", rows: int = TRAIN_ROWS, windows: int = TRAIN_WINDOWS) -> Network | None:
    """A network for the languages of ``label_col``, from ``windows`` windows of each of ``rows`` documents of each at most; none without labels.

    Null labels, null and empty texts teach nothing; repeated rows count as one.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w, count, _ = cut_windows(*utf8(b.column(1)))
            begin, label, out = np.cumsum(count) - count, [], []
            for i, (n, seed) in enumerate(zip(count.tolist(), b.column(2).to_pylist(), strict=True)):
                some = np.random.default_rng(seed & (1 << 62) - 1).permutation(n)[:windows]
                out += [x.tobytes() for x in w[begin[i] + some]]
                label += [b.column(0)[i]] * len(some)
            yield pa.RecordBatch.from_arrays([pa.array([x.as_py() for x in label], pa.string()), pa.array(out, pa.binary())], ["label", "window"])

    # only the windows come to the driver, not the texts
    chosen = sample(docs, id_col, text_col, label_col, rows).select("label", "text", F.xxhash64("text").alias("seed"))
    data = chosen.mapInArrow(cut, "label string, window binary").toPandas().sort_values(["label", "window"], key=lambda c: c.map(bytes) if c.name == "window" else c)
    if data.empty:
        return None
    languages = sorted(data.label.unique())
    x = np.frombuffer(b"".join(data.window), np.uint8).reshape(-1, WINDOW)
    return fit(x, np.array([languages.index(v) for v in data.label]), languages)


def identify(docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The language of each text: ``doc_id, language, probability, n_windows``.

    All of a text goes through the network, in windows of 128 bytes; their log-probabilities, weighted by the
    bytes that each holds, are averaged, and ``probability`` is the best language's share of the result. Each
    row in gives a row out, repeated rows and null ids too. A null or empty text has no window, and no
    language; without a network (no labelled rows) none has. One narrow pass: no shuffle. The network's size is fixed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for all_rows in batches:
            for b in slices(all_rows, 1, 1 << 18):
                w, count, own = cut_windows(*utf8(b.column(1)))
                n = len(count)
                if network is None:
                    best, share = pa.nulls(n, pa.string()), pa.nulls(n, pa.float64())
                else:
                    lp = np.concatenate([network.log_probabilities(w[i : i + 256]) for i in range(0, len(w), 256)] or [np.zeros((0, len(network.languages)))]) * own[:, None]
                    total = np.zeros((n, len(network.languages)))
                    some = count > 0
                    begin = (np.cumsum(count) - count)[some]
                    if len(begin):
                        total[some] = np.add.reduceat(lp, begin) / np.add.reduceat(own, begin)[:, None]
                    p = np.exp(total - total.max(1, keepdims=True))
                    p /= p.sum(1, keepdims=True)
                    best = pa.array([network.languages[i] for i in p.argmax(1)], pa.string(), mask=~some)
                    share = pa.array(np.round(p.max(1), 6), mask=~some)
                yield pa.RecordBatch.from_arrays([b.column(0), best, share, pa.array(count)], ["doc_id", "language", "probability", "n_windows"])

    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, SCHEMA)
