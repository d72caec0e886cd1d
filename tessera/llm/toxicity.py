"""Toxicity by subword bags (operator 3).

A word's vector is the mean of the vectors of its character n-grams and of itself, hashed into one table, so unseen
misspellings share most of a known word's vectors. The vectors of SEGMENT consecutive words are averaged into a
linear softmax. A document is toxic if one of its segments is (noisy or), so a few words count in a long text as they
do in a short one; bags are short, as the words around a toxic one would else weigh against it. Embeddings and softmax are trained jointly, with Adagrad in numpy, on at most PER_CLASS labelled
documents of each class; every whole text is scored, without a shuffle.

Because the layers above the embeddings are linear, a word comes down to one number, the softmax's log-odds of its
mean vector, and a worker keeps those of frequent words in a bounded cache.

Defined results: a null or empty text has no segment and scores 0; without training rows of both classes every score
is 0; repeated rows repeat their results; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import _texts
from .common import map_arrow, text_input, text_slices
from .labelled import held_out, labelled_texts
from .shingles import _STEP, mix

#: Labelled documents of each class that the model is fitted on, at most.
PER_CLASS = 3000
BUCKETS, DIMENSIONS = 1 << 17, 8
GRAMS = (3, 4, 5, 6)
#: Words in a bag, and what a toxic document counts against a clean one (there are some eight clean ones for each).
SEGMENT, TOXIC_WEIGHT = 2, 4.0
EPOCHS, BATCH, RATE, START_BIAS = 6, 32, 0.5, -4.0
#: Steps that training takes at least, however few rows there are.
LEAST_STEPS = 400
THRESHOLD = 0.5
#: Longest part of a word that makes n-grams in one piece; longer "words" are cut.
WORD_CHARS = 40
#: Words whose log-odds a worker remembers before it starts anew.
CACHE_WORDS = 400_000

_words = re.compile(r"\w+").findall
SCORED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())])


def words_of(text: str) -> list[str]:
    """Lower-cased words; very long runs of letters are cut into parts, so none is left out."""
    return [w if len(w) <= WORD_CHARS else w[i : i + WORD_CHARS] for w in _words(text.lower()) for i in range(0, len(w), WORD_CHARS)]


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and of their character n-grams (with marks for a word's ends), and the words' numbers."""
    points = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.array([len(w) + 2 for w in words], np.int64)
    starts = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(points)) - starts[owner]
    left = lengths[owner] - place
    whole = mix(np.add.reduceat(mix(points + place.astype(np.uint64) * _STEP), starts)) if len(words) else points
    buckets, owners = [whole], [np.arange(len(words))]
    h = np.zeros(len(points), np.uint64)
    for k in range(min(max(GRAMS), len(points))):
        h[: len(points) - k] = h[: len(points) - k] * _STEP + points[k:] + np.uint64(1)
        if k + 1 in GRAMS:
            inside = left > k
            buckets.append(mix(h[inside] + np.uint64(k)))
            owners.append(owner[inside])
    return (np.concatenate(buckets) % np.uint64(BUCKETS)).astype(np.int32), np.concatenate(owners)


class Model:
    """Log-odds of each bucket, and the bias of a segment."""

    def __init__(self, buckets: np.ndarray, bias: float):
        self.buckets, self.bias = buckets, bias

    def words(self, words: list[str]) -> list[float]:
        """Log-odds of the words' mean vectors."""
        if not words:
            return []
        buckets, owner = grams_of(words)
        return (np.bincount(owner, self.buckets[buckets], len(words)) / np.bincount(owner, minlength=len(words))).tolist()

    def score(self, values: list[float]) -> float:
        """Noisy or over a text's segments, given its words' log-odds."""
        if not values:
            return 0.0
        v = np.array(values)
        cut = np.arange(0, len(v), SEGMENT)
        z = np.add.reduceat(v, cut) / np.diff(np.append(cut, len(v))) + self.bias
        return float(-np.expm1(-np.logaddexp(0.0, z).sum()))


def train(rows: list[tuple[str, int]], seed: int = 1) -> Model:
    if len({y for _, y in rows}) < 2:
        return Model(np.zeros(BUCKETS, np.float32), -np.inf)
    rng = np.random.default_rng(seed)
    number: dict[str, int] = {}
    docs = [np.array([number.setdefault(w, len(number)) for w in words_of(t)], np.int64) for t, _ in rows]
    labels = np.array([y for _, y in rows])
    grams, owner = grams_of(list(number))
    grams = grams[np.argsort(owner, kind="stable")]
    begin = np.append(0, np.cumsum(np.bincount(owner, minlength=len(number))))
    e = rng.normal(0, 0.3, (BUCKETS, DIMENSIONS)).astype(np.float32)
    w, bias = np.zeros((DIMENSIONS, 2), np.float32), np.array([0.0, START_BIAS])
    w[0, 1] = 0.5
    seen_e, seen_w, seen_b = np.full(BUCKETS, 1e-3, np.float32), np.full_like(w, 1e-3), np.full(2, 1e-3)
    for _ in range(max(EPOCHS, -(-LEAST_STEPS * BATCH // len(docs)))):
        order = rng.permutation(len(docs))
        for a in range(0, len(order), BATCH):
            batch = [k for k in order[a : a + BATCH] if len(docs[k])]
            if not batch:
                continue
            words = np.concatenate([docs[k] for k in batch])
            used, place = np.unique(words, return_inverse=True)
            sizes = begin[used + 1] - begin[used]
            at = np.repeat(begin[used] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            bucket = grams[at]
            vectors = np.add.reduceat(e[bucket], np.cumsum(sizes) - sizes) / sizes[:, None]
            lengths = np.array([len(docs[k]) for k in batch])
            cut = np.concatenate([np.arange(0, n, SEGMENT) + s for n, s in zip(lengths, np.cumsum(lengths) - lengths, strict=True)])
            filled = np.diff(np.append(cut, len(words)))
            mean = np.add.reduceat(vectors[place], cut) / filled[:, None]
            owner = np.repeat(np.arange(len(batch)), -(-lengths // SEGMENT))
            z = mean @ w + bias
            z = z[:, 1] - z[:, 0]  # softmax of two classes
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            clean = np.exp(np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-9)), len(batch)))
            toxic = np.maximum(1 - clean, 1e-6)
            pull = np.where(labels[batch] == 1, -TOXIC_WEIGHT * clean / toxic, 1.0)
            g = p * pull[owner]  # of the loss by each segment's log-odds
            gw = np.stack([-(g @ mean), g @ mean], axis=1)
            gb = np.array([-g.sum(), g.sum()])
            away = w[:, 1] - w[:, 0]
            by_word = np.bincount(place, np.repeat(g / filled, filled), len(used)) / sizes
            by_bucket = np.bincount(bucket, np.repeat(by_word, sizes), BUCKETS).astype(np.float32)
            hit = np.flatnonzero(by_bucket)
            seen_e[hit] += by_bucket[hit] ** 2
            e[hit] -= (RATE * by_bucket[hit] / np.sqrt(seen_e[hit]))[:, None] * away
            seen_w += gw**2
            w -= (RATE * 0.2 * gw / np.sqrt(seen_w)).astype(np.float32)
            seen_b += gb**2
            bias -= RATE * 0.2 * gb / np.sqrt(seen_b)
    away = w[:, 1] - w[:, 0]
    return Model((e @ away).astype(np.float32), float(bias[1] - bias[0]))


def fit(documents: DataFrame, labels: DataFrame) -> Model:
    return train(labelled_texts(documents, labels, "toxic", PER_CLASS))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every whole text. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in batches:
            for b in text_slices(batch, limit=1 << 20):
                texts = [words_of(t) if t else [] for t in _texts(b.column(1))]
                if len(known) > CACHE_WORDS:
                    known.clear()
                new = list({w for t in texts for w in t if w not in known})
                known.update(zip(new, model.words(new), strict=True))
                scores = [model.score(list(map(known.__getitem__, t))) for t in texts]
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(scores, pa.float64())], SCORED.names)

    return map_arrow(text_input(documents), run, SCORED)


def scored(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    rows = score(documents, fit(documents, labels))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
