"""Quality classifier on random-indexing word vectors.

A word gets a sparse random index vector out of its hash; its word vector is the sum of the index vectors of
its neighbours in the sample. So do the shapes of words (case, digits, marks; a repeated word has a shape of its
own). A document is the mean of its words' and of its shapes' vectors; a two-layer network in numpy turns that
into a probability, whose temperature is set on sampled documents that the network was not fitted on.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklane.llm import memory
from tracklane.llm.labels import sample

AGAIN = "<again>"
_UPPER, _LOWER, _DIGIT = re.compile(r"[^\W\d_a-zß-öø-ÿ]+"), re.compile(r"[^\W\d_A-Z]+"), re.compile(r"\d+")
_MARKS = re.compile(r"(.)\1+")


@dataclass(frozen=True)
class QualityFit:
    """``rows`` bounds the labelled sample, ``words`` and ``shapes`` the vocabulary learned from it (the most
    frequent ones); others share one vector of each kind."""

    rows: int = 4000
    words: int = 20_000
    shapes: int = 1000
    width: int = 32
    ones: int = 4
    reach: int = 2
    hidden: int = 16
    rounds: int = 400
    rate: float = 0.02
    decay: float = 1e-4
    held_back: int = 5
    seed: int = 5


def shape(piece: str) -> str:
    """Letters become A or a, digits 0; what repeats is written once."""
    return _MARKS.sub(r"\1", _DIGIT.sub("0", _LOWER.sub("a", _UPPER.sub("A", piece))))[:12]


def index_vector(name: str, fit: QualityFit) -> np.ndarray:
    rng = np.random.default_rng(zlib.crc32(name.encode()) + fit.seed)
    out = np.zeros(fit.width)
    out[rng.choice(fit.width, fit.ones, replace=False)] = rng.choice([-1.0, 1.0], fit.ones)
    return out


def context_vectors(rows: list[np.ndarray], names: list[str], fit: QualityFit) -> np.ndarray:
    """A vector per name: its own index vector and the mean of its neighbours', at unit length. ``rows`` holds
    the names of each document by number."""
    own = np.stack([index_vector(n, fit) for n in names])
    total, seen = np.zeros_like(own), np.zeros(len(names))
    for ids in rows:
        for d in range(1, fit.reach + 1):
            left, right = ids[:-d], ids[d:]
            if len(left):
                np.add.at(total, left, own[right])
                np.add.at(total, right, own[left])
                np.add.at(seen, left, 1)
                np.add.at(seen, right, 1)
    both = own + total / np.maximum(seen, 1)[:, None]
    return both / np.maximum(np.linalg.norm(both, axis=1, keepdims=True), 1e-9)


class Model:
    """Vocabulary, vectors and network; ``pool`` makes the input of the network out of a whole text."""

    def __init__(self, fit: QualityFit, words: list[str], shapes: list[str], vectors: tuple, layers: list, limit: int = 400_000):
        self.fit, self.words, self.shapes, self.vectors, self.layers, self.limit = fit, words, shapes, vectors, layers, limit
        self._word, self._shape = {w: i for i, w in enumerate(words)}, {s: i for i, s in enumerate(shapes)}
        self._known: dict[str, int] = {}

    def numbers(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Word and shape numbers of the pieces of a text; 0 stands for the unknown."""
        known, many = self._known, len(self.shapes)
        if len(known) > self.limit:
            known.clear()
        for p in pieces:
            if p not in known:
                known[p] = self._word.get(p.lower(), 0) * many + self._shape.get(shape(p), 0)
        both = np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))
        words, shapes = np.divmod(both, many)
        again = np.fromiter(map(str.__eq__, pieces[1:], pieces), bool, len(pieces) - 1)
        shapes[1:][again] = self._shape.get(AGAIN, 0)
        return words, shapes

    def pool(self, text: str | None) -> np.ndarray:
        pieces = (text or "").split()
        if not pieces:
            return np.zeros(2 * self.fit.width + 1)
        sums = []
        for ids, vectors in zip(self.numbers(pieces), self.vectors):
            sums.append(vectors[ids].mean(0))
        return np.concatenate([*sums, [1.0]])

    def logits(self, inputs: np.ndarray) -> np.ndarray:
        center, spread, w1, b1, w2, b2, temperature = self.layers
        return (np.maximum((inputs - center) / spread @ w1 + b1, 0) @ w2 + b2) / temperature

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        odds = self.logits(np.stack([self.pool(t) for t in texts]))
        return 1 / (1 + np.exp(np.clip(odds[:, 0] - odds[:, 1], -40, 40)))


def fit_model(texts: list[str], labels: np.ndarray, fit: QualityFit) -> Model:
    """With one class, or none, every text gets the share of label 1 (1 without labels: nothing is rejected)."""
    size = 2 * fit.width + 1
    if len(set(labels.tolist())) < 2:
        edge = float(np.clip(labels.mean() if len(labels) else 1.0, 1e-6, 1 - 1e-6))
        flat = np.zeros((1, fit.width))
        layers = [0.0, 1.0, np.zeros((size, 1)), np.zeros(1), np.zeros((1, 2)), np.array([0.0, np.log(edge / (1 - edge))]), 1.0]
        return Model(fit, [""], [""], (flat, flat), layers)
    counts: Counter[str] = Counter()
    for t in texts:  # texts are split again where their words are needed: held at once, all words are many times as large
        counts.update(t.split())
    words, shapes = Counter(), Counter()
    for p, n in counts.items():
        words[p.lower()] += n
        shapes[shape(p)] += n
    del counts
    first = lambda counts, n: [k for k, m in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:n] if m > 1]
    words, shapes = ["", *first(words, fit.words)], ["", AGAIN, *first(shapes, fit.shapes)]
    model = Model(fit, words, shapes, (), [])
    numbers = [tuple(n.astype(np.int32) for n in model.numbers(c)) for t in texts if (c := t.split())]
    model.vectors = tuple(context_vectors([n[k] for n in numbers], names, fit) for k, names in enumerate((words, shapes)))
    del numbers
    inputs = np.stack([model.pool(t) for t in texts])

    back = np.arange(len(texts)) % fit.held_back == 0
    if len(set(labels[back].tolist())) < 2 or len(set(labels[~back].tolist())) < 2:
        back = np.zeros(len(texts), bool)
    rng = np.random.default_rng(fit.seed)
    center, spread = inputs.mean(0), inputs.std(0) + 1e-3
    x, y = ((inputs - center) / spread)[~back], np.eye(2)[labels[~back]]
    w1, b1 = rng.normal(0, size**-0.5, (size, fit.hidden)), np.zeros(fit.hidden)
    w2, b2 = rng.normal(0, fit.hidden**-0.5, (fit.hidden, 2)), np.zeros(2)
    values = [w1, b1, w2, b2]
    held = [[np.zeros_like(v), np.zeros_like(v)] for v in values]
    for step in range(1, fit.rounds + 1):
        inner = np.maximum(x @ w1 + b1, 0)
        odds = inner @ w2 + b2
        odds = np.exp(odds - odds.max(1, keepdims=True))
        slope = (odds / odds.sum(1, keepdims=True) - y) / len(x)
        deep = slope @ w2.T * (inner > 0)
        slopes = [x.T @ deep + fit.decay * w1, deep.sum(0), inner.T @ slope + fit.decay * w2, slope.sum(0)]
        for value, s, (m, v) in zip(values, slopes, held):
            m += 0.1 * (s - m)
            v += 0.01 * (s * s - v)
            value -= fit.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    model.layers = [center, spread, w1, b1, w2, b2, 1.0]
    judged = back if back.any() else ~back
    model.layers[-1] = _temperature(model.logits(inputs[judged]), labels[judged])
    return model


def _temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The one of a grid with the least log-loss."""

    def loss(t: float) -> float:
        odds = logits / t
        top = odds.max(1)
        return float((top + np.log(np.exp(odds - top[:, None]).sum(1)) - odds[np.arange(len(labels)), labels]).mean())

    return min(np.geomspace(0.25, 20, 80), key=loss)


def train(docs: DataFrame, labels: DataFrame, fit: QualityFit = QualityFit(), label: str = "quality") -> bytes:
    """The pickled numbers of a fitted model, made in one task from the bounded sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory.drop()
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))]
        rows.sort(key=lambda r: (r[2], r[0] or ""))
        m = fit_model([r[0] or "" for r in rows], np.array([r[1] for r in rows], int), fit)
        yield pa.record_batch([pa.array([pickle.dumps((m.words, m.shapes, m.vectors, m.layers))], pa.binary())], names=["model"])

    made = sample(docs, labels, label, fit.rows).repartition(1).mapInArrow(run, "model binary").first()
    return made[0] if made else next(run(iter([]))).column(0)[0].as_py()


def score(docs: DataFrame, model: bytes, fit: QualityFit = QualityFit(), text: str = "text", name: str = "score") -> DataFrame:
    """Adds ``name``, 0 to 1. A null or empty text is scored like any other; rows stay as they are."""
    kept = [c for c in docs.columns if c != name]
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the vocabulary

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memory.drop()
        fitted = Model(fit, *pickle.loads(sent.value))
        for texts in batches:
            yield pd.Series(fitted.scores(texts.tolist()), dtype="float64")

    return docs.select(*kept, F.pandas_udf(run, "double")(F.col(text)).alias(name))
