"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad. Its features are shares of character kinds, length, repeated words and repeated lines,
for the line itself and for its two neighbours; a 2 x 2 matrix couples the labels of consecutive lines. A document's score
is the mean of its lines' forward-backward marginals for "good", weighted by length. The model has a few dozen weights.

It is trained in numpy on at most ``SAMPLE`` labelled documents, picked by hash of their id among those that are not held
out; features of the sample are computed on the executors. Scoring streams over all texts.

Defined results: a null or empty text is one empty line and gets a score like any other; repeated rows get equal scores; a
null id counts as not held out and is never a label; a document with conflicting labels counts as bad; without labels of
both classes the score is the share of label 1 (1.0 without any). Only the key and ``text`` are read, so language, source
and ids are no inputs of a score.
"""
from __future__ import annotations

import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from patronage.llm.shared import text_batches

#: Most labelled documents that a model is trained on.
SAMPLE, STEPS, FOLDS = 3000, 150, 5
KINDS = 9


def _kinds() -> np.ndarray:
    kind = np.zeros(256, dtype=np.uint8)  # 0: other signs and control characters
    kind[list(range(97, 123))] = 1
    kind[list(range(65, 91))] = 2
    kind[list(range(48, 58))] = 3
    kind[[9, 11, 12, 13, 32]] = 4
    kind[[44, 46, 59, 58, 63, 39, 45]] = 5
    kind[list(b"#$%&*@^~_=+<>{}[]\\`")] = 6
    kind[list(b"|!")] = 7
    kind[128:] = 8
    return kind


KIND = _kinds()


def line_features(texts: list) -> tuple:
    """(features, lengths, lines per text): one row of own features per line, all texts one after another."""
    data = [t.encode() for t in texts]
    lines = [x.split(b"\n") for x in data]
    counts = np.array([len(x) for x in lines])
    flat = [x for own in lines for x in own]
    sizes = np.array([len(x) for x in flat])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    kinds = KIND[np.frombuffer(b"\n".join(flat) + b"\n", dtype=np.uint8)]
    n = np.maximum(sizes, 1)
    share = np.stack([np.add.reduceat(kinds == k, starts, dtype=np.int64) / n for k in range(KINDS)], axis=1)
    share[:, 0] -= 1 / n  # the line end counts as kind 0
    words = [x.split() for x in flat]
    n_words = np.array([len(w) for w in words])
    repeats = np.array([sum(map(operator.eq, w, w[1:])) for w in words]) / np.maximum(n_words, 1)
    lone = np.array([len(set(w)) for w in words]) / np.maximum(n_words, 1)
    again = np.concatenate([[x == y for x, y in zip(own, [None, *own])] for own in lines]).astype(float)
    ends = np.array([x[-1:] in (b".", b"?", b"!") for x in flat], dtype=float)
    own = np.column_stack([share, np.log1p(sizes), np.log1p(n_words), np.minimum(sizes / np.maximum(n_words, 1), 40) / 10, repeats, 1 - lone, again, ends, sizes == 0])
    return own, sizes, counts


def with_neighbours(own: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and of the line behind (zeros outside the text), and a constant."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    before[first], after[first + counts - 1] = 0, 0
    return np.column_stack([own, before, after, np.ones(len(own))])


class Chains:
    """Forward-backward over many chains at once, step by step over the line numbers."""

    def __init__(self, counts: np.ndarray):
        first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        order = np.argsort(-counts, kind="stable")
        self.first, self.last = first, first + counts - 1
        starts, sizes = first[order], counts[order]
        most = int(sizes[0]) if len(sizes) else 0
        alive = np.searchsorted(-sizes, -np.arange(most), side="left")
        self.at = [starts[:k] + t for t, k in enumerate(alive)]

    def run(self, s: np.ndarray, t: np.ndarray) -> tuple:
        """(forward, backward) log sums, both (lines, 2); ``s``: score of label 1 per line, ``t``: transition scores."""
        f, b = np.zeros((len(s), 2)), np.zeros((len(s), 2))
        f[:, 1] = s
        for at in self.at[1:]:
            past = f[at - 1]
            f[at, 0] = np.logaddexp(past[:, 0] + t[0, 0], past[:, 1] + t[1, 0])
            f[at, 1] = s[at] + np.logaddexp(past[:, 0] + t[0, 1], past[:, 1] + t[1, 1])
        for at in reversed(self.at[1:]):
            on = b[at, 1] + s[at]
            b[at - 1, 0] = np.logaddexp(t[0, 0] + b[at, 0], t[0, 1] + on)
            b[at - 1, 1] = np.logaddexp(t[1, 0] + b[at, 0], t[1, 1] + on)
        return f, b


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def train(parts: list, labels: np.ndarray, steps: int = STEPS) -> dict:
    """Weights from (own features, counts) of documents and their labels; every line carries its document's label."""
    if len(labels) == 0 or labels.min() == labels.max():
        return {"share": float(labels.mean()) if len(labels) else 1.0}
    own, counts = np.concatenate([x for x, _ in parts]), np.concatenate([c for _, c in parts])
    x = with_neighbours(own, counts)
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    mean[-1], spread[-1] = 0, 1
    x = (x - mean) / spread
    doc = np.repeat(np.arange(len(counts)), counts)
    y, weight = labels[doc].astype(float), (1 / counts)[doc]
    chains, inner = Chains(counts), np.ones(len(x), dtype=bool)
    inner[chains.last] = False
    here = np.flatnonzero(inner)
    w, t = np.zeros(x.shape[1]), np.zeros((2, 2))
    m = [np.zeros_like(w), np.zeros_like(t)], [np.zeros_like(w), np.zeros_like(t)]
    told = np.zeros((2, 2))
    np.add.at(told, (y[here].astype(int), y[here + 1].astype(int)), weight[here])
    for step in range(1, steps + 1):
        s = x @ w
        f, b = chains.run(s, t)
        z = np.logaddexp(f[chains.last, 0], f[chains.last, 1])[doc]
        good = np.exp(f[:, 1] + b[:, 1] - z)
        expected = np.array([[(np.exp(f[here, i] + t[i, j] + (s[here + 1] if j else 0) + b[here + 1, j] - z[here]) * weight[here]).sum() for j in (0, 1)] for i in (0, 1)])
        grads = (x.T @ (weight * (y - good)) / len(counts) - 1e-4 * w, (told - expected) / len(counts) - 1e-3 * t)
        for k, (p, g) in enumerate(zip((w, t), grads)):
            m[0][k][:] = 0.9 * m[0][k] + 0.1 * g
            m[1][k][:] = 0.99 * m[1][k] + 0.01 * g * g
            p += 0.1 * (m[0][k] / (1 - 0.9**step)) / (np.sqrt(m[1][k] / (1 - 0.99**step)) + 1e-8)
    return {"w": w, "t": t, "mean": mean, "spread": spread}


def scores(texts: list, model: dict) -> np.ndarray:
    """Scores of texts: line marginals weighted by length + 1."""
    if "share" in model:
        return np.full(len(texts), model["share"])
    own, sizes, counts = line_features(texts)
    s = (with_neighbours(own, counts) - model["mean"]) / model["spread"] @ model["w"]
    chains = Chains(counts)
    f, b = chains.run(s, model["t"])
    good = _sigmoid(f[:, 1] + b[:, 1] - f[:, 0] - b[:, 0])
    weight = sizes + 1.0
    return np.clip(np.add.reduceat(good * weight, chains.first) / np.add.reduceat(weight, chains.first), 0.0, 1.0)


def held_out(key: str) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _sampled(batches):
    for batch, texts in text_batches(batches):
        rows = [line_features([t]) for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("key"), pa.array([own.astype(np.float32).tobytes() for own, _, _ in rows], pa.binary())], names=["label", "key", "own"])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> dict:
    """The model for ``docs`` (key, text) from ``labels`` (key, label 0 or 1), never from held-out documents."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(key)).groupBy(F.col(key).alias("k")).agg(F.min(F.col(label).cast("int")).alias("label"))
    picked = known.join(docs.select(F.col(key).alias("k")).distinct(), "k", "left_semi").orderBy(F.xxhash64("k"), "k").limit(sample)
    rows = docs.select(F.col(key).alias("key"), "text").join(F.broadcast(picked), F.col("key") == F.col("k")).select("label", F.col("key").cast("string").alias("key"), "text")
    got = sorted({(r.key, r.label, bytes(r.own)) for r in rows.mapInArrow(_sampled, "label int, key string, own binary").collect()})
    width = line_features([""])[0].shape[1]
    own = [np.frombuffer(x, dtype=np.float32).reshape(-1, width).astype(float) for _, _, x in got]
    return train([(x, np.array([len(x)])) for x in own], np.array([y for _, y, _ in got]))


def score(docs: DataFrame, model: dict, to: str = "score") -> DataFrame:
    """All rows of ``docs`` with a score in column ``to``; other columns pass through, an own one of that name is replaced."""
    base = docs.drop(to)
    names = base.columns

    def run(batches):
        for batch, texts in text_batches(batches):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(scores(texts, model), pa.float64())], names=[*names, to])

    return base.mapInArrow(run, StructType([*base.schema.fields, StructField(to, DoubleType(), False)]))
