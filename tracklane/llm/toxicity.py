"""Toxicity by subword bags: embeddings of character n-grams, averaged, under a linear softmax.

A word is the mean of the embeddings of its character n-grams, a passage the mean of its words; embeddings and
softmax weights are learned together in numpy. A misspelt or unseen word shares n-grams with known ones. The
passages of a labelled document carry its label in training. A document's score comes from its most toxic
passage, so a long text hides nothing; a second small fit turns it into a probability.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklane.llm import memory
from tracklane.llm.labels import sample

EDGES = ".,;:!?\"'()[]{}<>|*%$#&"


@dataclass(frozen=True)
class ToxicityFit:
    """``rows`` bounds the labelled sample, ``passages`` what is used of it in each class; an n-gram counts if it
    stands in ``holders`` documents of the sample (fewer in small samples). A word's
    n-grams weigh as those of ``fewest`` at least, so that a short word does not hang on one of them."""

    rows: int = 4000
    passages: int = 40_000
    passage_words: int = 6
    holders: int = 12
    shortest: int = 3
    longest: int = 5
    fewest: int = 10
    buckets: int = 1 << 16
    width: int = 4
    rounds: int = 50
    rate: float = 0.1
    decay: float = 1e-5
    seed: int = 11


def grams(words: list[str], fit: ToxicityFit) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of the n-grams of each word between its edges, and of each word itself, by word.

    Hashes are polynomials of code points, so all words are done in a few passes over one array."""
    bodies = [f"<{w.strip(EDGES).lower()}>" for w in words]
    points = np.frombuffer("".join(bodies).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(bodies)), sizes)
    left = ends[owner] - np.arange(len(points))  # characters up to the end of the word
    rolled, owners, hashes = np.zeros(len(points), np.uint32), [], []
    for n in range(1, fit.longest + 1):
        moved = np.zeros(len(points), np.uint32)
        moved[: max(0, len(points) - n + 1)] = points[n - 1 :]
        rolled = rolled * np.uint32(0x01000193) + moved
        if n >= fit.shortest:
            at = np.flatnonzero((left >= n) & (n < sizes[owner]))
            owners.append(owner[at])
            hashes.append(rolled[at] + np.uint32(n))
    place = (np.arange(len(points)) - (ends - sizes)[owner]).astype(np.uint32)
    whole = points * (place * np.uint32(0x9E3779B1) + np.uint32(0x85EBCA6B))
    owners.append(np.arange(len(bodies)))
    hashes.append(np.add.reduceat(whole, ends - sizes, dtype=np.uint32) if len(bodies) else np.zeros(0, np.uint32))
    owners, mixed = np.concatenate(owners), np.concatenate(hashes)
    mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    mixed = (mixed ^ (mixed >> np.uint32(12))) & np.uint32(fit.buckets - 1)
    order = np.argsort(owners, kind="stable")
    return owners[order], mixed[order].astype(np.int64)


def _blocks_of_grams(words: list[str], fit: ToxicityFit, block: int = 1 << 12) -> tuple[np.ndarray, np.ndarray]:
    """``grams`` a block of words at a time and as short numbers, for vocabularies."""
    owners, buckets = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for at in range(0, len(words), block):
        owner, bucket = grams(words[at : at + block], fit)
        owners.append((owner + at).astype(np.int32))
        buckets.append(bucket.astype(np.int32))
    return np.concatenate(owners), np.concatenate(buckets)


class Scorer:
    """Passage logits of whole texts. A word's part of a logit is the mean of its n-grams' parts."""

    def __init__(self, fit: ToxicityFit, parts: np.ndarray, bias: float, scale: float, shift: float, limit: int = 1_000_000):
        self.fit, self.parts, self.bias, self.scale, self.shift, self.limit = fit, parts, bias, scale, shift, limit
        self.known: dict[str, float] = {}

    def _learn(self, lists: list[list[str]]) -> None:
        """Parts of the words not met before; a full memory is emptied."""
        used = set().union(*lists)
        new = used.difference(self.known)
        if len(self.known) + len(new) > self.limit:
            self.known.clear()
            new = used
        words = list(new)
        owner, bucket = grams(words, self.fit)
        counts = np.maximum(np.bincount(owner, minlength=len(words)), self.fit.fewest)
        self.known.update(zip(words, (np.bincount(owner, self.parts[bucket], len(words)) / counts).tolist()))

    def logits(self, texts: list[str | None]) -> np.ndarray:
        """The highest passage logit of each text; passages overlap by half. A text without words has the bias alone."""
        out = np.full(len(texts), self.bias)
        n = self.fit.passage_words
        for at in range(0, len(texts), 64):
            lists = [(t or "").split() for t in texts[at : at + 64]]
            self._learn(lists)
            for i, words in enumerate(lists, at):
                if words:
                    sums = np.concatenate([[0.0], np.cumsum(np.fromiter(map(self.known.__getitem__, words), float, len(words)))])
                    starts = np.arange(0, max(1, len(words) - n // 2), n // 2)
                    ends = np.minimum(starts + n, len(words))
                    out[i] += ((sums[ends] - sums[starts]) / (ends - starts)).max()
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(texts) + self.shift, -40, 40)))

    def score(self, text: str | None) -> float:
        return float(self.scores([text])[0])


def _adam(step: int, value: np.ndarray, slope: np.ndarray, held: list[np.ndarray], rate: float) -> None:
    held[0] += 0.1 * (slope - held[0])
    held[1] += 0.01 * (slope * slope - held[1])
    value -= rate * (held[0] / (1 - 0.9**step)) / (np.sqrt(held[1] / (1 - 0.99**step)) + 1e-8)


def fit_model(texts: list[str], labels: np.ndarray, fit: ToxicityFit) -> Scorer:
    """Embeddings and softmax by full gradients over the passages; then scale and shift on whole documents.
    With one class, or none, every text gets the share of label 1 (0 without labels)."""
    rng = np.random.default_rng(fit.seed)
    if len(set(labels.tolist())) < 2:
        share = float(labels.mean()) if len(labels) else 0.0
        edge = float(np.clip(share, 1e-6, 1 - 1e-6))
        return Scorer(fit, np.zeros(fit.buckets), 0.0, 1.0, float(np.log(edge / (1 - edge))))
    vocabulary: dict[str, int] = {}
    rows = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in t.split()], np.int64) for t in texts]
    many = len(vocabulary)
    gram_word, gram = _blocks_of_grams(list(vocabulary), fit)
    gram_size = np.maximum(np.bincount(gram_word, minlength=many), fit.fewest).astype(float)
    # N-grams of few documents say nothing about others; their embeddings stay zero.
    first_gram = np.searchsorted(gram_word, np.arange(many + 1))
    holders = np.zeros(fit.buckets, np.int64)
    for r in rows:
        held = [gram[first_gram[w] : first_gram[w + 1]] for w in np.unique(r)]
        holders[np.unique(np.concatenate(held or [gram[:0]]))] += 1
    common = holders >= min(fit.holders, max(2, len(texts) // 20))
    numbers = np.cumsum(common) - 1
    used = common[gram]
    gram, gram_word = numbers[gram[used]], gram_word[used].astype(np.int64)

    n = fit.passage_words
    starts = [(d, at) for d, r in enumerate(rows) for at in range(0, len(r), n)]
    mark = labels[[d for d, _ in starts]]
    chosen = np.concatenate([rng.permutation(np.flatnonzero(mark == v))[: fit.passages] for v in (0, 1)])
    passages, target = [rows[starts[i][0]][starts[i][1] : starts[i][1] + n] for i in chosen], np.eye(2)[mark[chosen]]
    word, sizes = np.concatenate(passages), np.array([len(p) for p in passages], float)
    in_passage, first = np.repeat(np.arange(len(passages)), [len(p) for p in passages]), np.cumsum([0, *map(len, passages)])[:-1]
    share = (target / (2 * target.sum(0))).sum(1, keepdims=True)

    embed = rng.normal(0, 0.01, (int(common.sum()), fit.width))
    weight, bias = rng.normal(0, 0.3, (fit.width, 2)), np.zeros(2)
    state = [[np.zeros_like(v), np.zeros_like(v)] for v in (embed, weight, bias)]

    def total(where: np.ndarray, values: np.ndarray, source: np.ndarray, count: int) -> np.ndarray:
        # Column by column: an n-gram's row for each word that has it would be several times as large as the sample.
        return np.stack([np.bincount(where, values[:, j][source], count) for j in range(fit.width)], 1)

    for step in range(1, fit.rounds + 1):
        words = total(gram_word, embed, gram, many) / gram_size[:, None]
        bag = np.add.reduceat(words[word], first) / sizes[:, None]
        logits = bag @ weight + bias
        odds = np.exp(logits - logits.max(1, keepdims=True))
        slope = (odds / odds.sum(1, keepdims=True) - target) * share
        of_word = total(word, slope @ weight.T / sizes[:, None], in_passage, many) / gram_size[:, None]
        of_gram = total(gram, of_word, gram_word, len(embed))
        for value, s, held in ((embed, of_gram, state[0]), (weight, bag.T @ slope, state[1]), (bias, slope.sum(0), state[2])):
            _adam(step, value, s + fit.decay * value, held, fit.rate)
    embed, small_ones = np.zeros((fit.buckets, fit.width)), embed
    embed[common] = small_ones
    turn = weight[:, 1] - weight[:, 0]
    scorer = Scorer(fit, embed @ turn, float(bias[1] - bias[0]), 1.0, 0.0)
    scorer.scale, scorer.shift = _scaled(scorer.logits(texts), labels)
    return scorer


def _scaled(logits: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Scale and shift of a sigmoid that is 0.5 where the classes part best: the cut with the least sum of both
    error rates, nearer to label 0 in the gap around it."""
    order = np.argsort(logits, kind="stable")
    x, y = logits[order], labels[order]
    missed = np.concatenate([[0], np.cumsum(y == 1)]) / (y == 1).sum()
    false = 1 - np.concatenate([[0], np.cumsum(y == 0)]) / (y == 0).sum()
    at = int(np.argmin((missed + false)[1:-1])) + 1 if len(x) > 1 else 0
    cut = 0.7 * x[max(at - 1, 0)] + 0.3 * x[min(at, len(x) - 1)]
    gap = max(float(np.median(x[y == 1]) - np.median(x[y == 0])), 1e-6)
    return 8 / gap, -8 / gap * float(cut)


def train(docs: DataFrame, labels: DataFrame, fit: ToxicityFit = ToxicityFit(), label: str = "toxic") -> bytes:
    """The pickled numbers of a fitted model, made in one task from the bounded sample; a few MB at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory.drop()
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))]
        rows.sort(key=lambda r: (r[2], r[0] or ""))
        s = fit_model([r[0] or "" for r in rows], np.array([r[1] for r in rows], int), fit)
        numbers = (s.parts.astype(np.float32), s.bias, s.scale, s.shift)
        yield pa.record_batch([pa.array([pickle.dumps(numbers)], pa.binary())], names=["model"])

    made = sample(docs, labels, label, fit.rows).repartition(1).mapInArrow(run, "model binary").first()
    return made[0] if made else next(run(iter([]))).column(0)[0].as_py()


def score(docs: DataFrame, model: bytes, fit: ToxicityFit = ToxicityFit(), text: str = "text", name: str = "score") -> DataFrame:
    """Adds ``name``, 0 to 1. A null or empty text is scored like any other; rows stay as they are."""
    kept = [c for c in docs.columns if c != name]
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the number of buckets

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memory.drop()
        parts, bias, scale, shift = pickle.loads(sent.value)
        scorer = Scorer(fit, parts.astype(float), bias, scale, shift)
        for texts in batches:
            yield pd.Series(scorer.scores(texts.tolist()), dtype="float64")

    return docs.select(*kept, F.pandas_udf(run, "double")(F.col(text)).alias(name))
