"""Quality by positive-unlabelled learning (operator 7).

Trusted positives are labelled documents of quality 1; unlabelled ones are web texts of the same corpus, of which no
label is read. A small network over statistics of the text minimises the non-negative unbiased risk: the positive
risk weighted with the class prior, plus the part of the unlabelled risk that the prior does not explain, held at 0
from below. The prior is estimated first: a classifier of positives against unlabelled texts gives scores, and the
prior is the least ratio, over score thresholds, of the unlabelled to the positive texts below or above it.

Fitted on at most POSITIVES and UNLABELLED texts; every whole text is scored, without a shuffle.

Defined results: a null or empty text has the statistics of no words and a score like any other; without positives
every score is 0.5; repeated rows repeat their results; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import _texts
from .common import map_arrow, text_input
from .labelled import held_out, labelled_texts, web_texts

#: Texts that the model is fitted on, at most.
POSITIVES, UNLABELLED = 3000, 6000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 16, 80, 256, 0.01, 1e-4
#: Part of a sample that a threshold must leave for its ratio to count in the prior's estimate.
PRIOR_PART = 0.2
THRESHOLD = 0.3

_symbols = re.compile(r"[#*$%&|<>{}\[\]\\^~=_]").findall
_upper = re.compile(r"[A-Z]").findall
_digits = re.compile(r"[0-9]").findall
_marks = re.compile(r"[!?]").findall
SCORED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())])


def statistics(text: str) -> list[float]:
    """Statistics of the whole text, each of about unit size; none grows with its length but the first."""
    words = text.split()
    n, chars = len(words), max(1, len(text))
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    stay = sum(a == b for a, b in zip(words, words[1:], strict=False))
    pairs = Counter(zip(words, words[1:], strict=False))
    twice = sum(c for c in pairs.values() if c > 1)
    return [
        np.log1p(n) / 4,
        min(4.0, sum(map(len, words)) / max(1, n) / 3),
        np.log1p(100 * len(_symbols(text)) / chars),
        np.log1p(100 * text.count("|") / chars),
        5 * len(_upper(text)) / chars,
        np.log1p(100 * len(_digits(text)) / chars),
        np.log1p(100 * len(_marks(text)) / chars),
        max(counts.values(), default=0) / (n + 5) * 5,
        stay / (n + 5) * 5,
        twice / (n + 5) * 2,
        (1 - len(set(lines)) / max(1, len(lines))) * 5,
        np.log1p(100 * text.count(".") / chars),
        np.log1p(100 * text.count(",") / chars),
    ]


class Network:
    """One hidden layer, trained by Adam; positive output for quality 1."""

    def __init__(self, inputs: int, rng: np.random.Generator):
        self.p = [rng.normal(0, 0.3, (inputs, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.zeros(1)]
        self.m, self.v, self.t = [np.zeros_like(x) for x in self.p], [np.zeros_like(x) for x in self.p], 0

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def step(self, x: np.ndarray, pull: np.ndarray) -> None:
        """pull: derivative of the loss by each output."""
        h = np.tanh(x @ self.p[0] + self.p[1])
        back = pull[:, None] * self.p[2] * (1 - h * h)
        grads = [x.T @ back + DECAY * self.p[0], back.sum(0), h.T @ pull + DECAY * self.p[2], pull.sum(keepdims=True)]
        self.t += 1
        for k, g in enumerate(grads):
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            self.p[k] = self.p[k] - RATE * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _epochs(np_: int, nu: int, rng: np.random.Generator, epochs: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Batches of rows of the positives and of the unlabelled, the same part of each."""
    steps = max(1, nu // BATCH)
    for _ in range(epochs):
        yield from zip(np.array_split(rng.permutation(np_), steps), np.array_split(rng.permutation(nu), steps), strict=True)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, rng: np.random.Generator) -> float:
    """Share of positives among the unlabelled: no score set can be rarer among them than the prior allows."""
    net = Network(positive.shape[1], rng)
    half_p, half_u = len(positive) // 2, len(unlabelled) // 2
    for i, j in _epochs(half_p, half_u, rng, EPOCHS // 3):
        if len(i) and len(j):
            x = np.concatenate([positive[i], unlabelled[j]])
            pull = np.concatenate([(_sigmoid(net(positive[i])) - 1) / len(i), _sigmoid(net(unlabelled[j])) / len(j)])
            net.step(x, pull)
    p, u = np.sort(net(positive[half_p:])), np.sort(net(unlabelled[half_u:]))
    if not len(p) or not len(u):
        return 0.5
    cuts = p[(np.arange(1, 100) / 100 * len(p)).astype(int)]
    above_p, above_u = 1 - np.searchsorted(p, cuts) / len(p), 1 - np.searchsorted(u, cuts) / len(u)
    use = above_p >= PRIOR_PART
    return float(np.clip(np.min(above_u[use] / above_p[use], initial=1.0), 0.05, 0.98))


class Model:
    def __init__(self, network: Network | None, mean: np.ndarray, scale: np.ndarray, prior: float):
        self.network, self.mean, self.scale, self.prior = network, mean, scale, prior

    def score(self, rows: list[list[float]]) -> np.ndarray:
        if self.network is None or not rows:
            return np.full(len(rows), 0.5)
        return _sigmoid(self.network((np.array(rows) - self.mean) / self.scale))


def pulls(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray, bool]:
    """Derivatives by the outputs of positives and unlabelled, and whether the negatives' part of the risk is positive.

    Logistic loss: positives as 1 and, subtracted, as 0; unlabelled as 0. Where the negatives' part falls below zero,
    training steps back along it instead.
    """
    sp, su = _sigmoid(zp), _sigmoid(zu)
    negative_risk = -np.log1p(-np.minimum(su, 1 - 1e-9)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-9)).mean()
    if negative_risk >= 0:
        return prior * (sp - 1) / len(zp) - prior * sp / len(zp), su / len(zu), True
    return prior * sp / len(zp), -su / len(zu), False


def train(positives: list[str], unlabelled: list[str], seed: int = 1) -> Model:
    if not positives or not unlabelled:
        return Model(None, np.zeros(1), np.ones(1), 0.5)
    rng = np.random.default_rng(seed)
    p, u = np.array([statistics(t) for t in positives]), np.array([statistics(t) for t in unlabelled])
    mean, scale = u.mean(0), u.std(0) + 0.05
    p, u = (p - mean) / scale, (u - mean) / scale
    p, u = p[rng.permutation(len(p))], u[rng.permutation(len(u))]
    prior = estimate_prior(p, u, rng)
    net = Network(p.shape[1], rng)
    for i, j in _epochs(len(p), len(u), rng, EPOCHS):
        if not len(i) or not len(j):
            continue
        pull_p, pull_u, _ = pulls(net(p[i]), net(u[j]), prior)
        net.step(np.concatenate([p[i], u[j]]), np.concatenate([pull_p, pull_u]))
    return Model(net, mean, scale, prior)


def fit(documents: DataFrame, labels: DataFrame) -> Model:
    trusted = [t for t, y in labelled_texts(documents, labels.where(F.col("quality") == 1), "quality", POSITIVES) if y == 1]
    return train(trusted, web_texts(documents, UNLABELLED))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every whole text. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = model.score([statistics(t or "") for t in _texts(b.column(1))])
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(scores, pa.float64())], SCORED.names)

    return map_arrow(text_input(documents), run, SCORED)


def scored(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    rows = score(documents, fit(documents, labels))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
