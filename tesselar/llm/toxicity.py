"""Toxicity by a factorization machine over hashed terms.

Terms are words and word beginnings, hashed into buckets.  A document is the set of its buckets.  The machine learns a
weight and a short vector for every bucket of its training rows; products of vectors score pairs of terms that stand in
one text, so a pair can tell what neither term tells alone.

Weights move by Adam, each as fast as its bucket alone speaks for a class, so chance finds among rare words stay near
zero; vectors move by plain gradient steps of bounded length and decay, which only pairs that recur outgrow.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselar.llm.common import AZ_LOWER, cut, held_out

# Labelled rows that the machine is fitted on at most (the first in hash order), and the hash space.
TRAIN_ROWS, BUCKETS = 8_000, 1 << 20
FACTORS, EPOCHS, BATCH, SEED, SPREAD = 8, 30, 256, 7, 0.02
# Steps of weights and vectors, how both fade, and how much more a toxic row counts.
WEIGHT_RATE, VECTOR_RATE, SLOWING, WEIGHT_DECAY, VECTOR_DECAY, TOXIC_SHARE = 0.05, 0.3, 0.05, 1e-4, 0.03, 4.0
# z of the log odds ratio at which a weight moves at full speed, and how steeply speed falls below it.
TRUSTED, STEEPNESS = 3.5, 6
# Terms of a text up to which its pairs count in full, the share of rows that tells when to stop, and for how many passes
# they may show no progress.
PAIR_TERMS, CHECKED, PATIENCE = 200, 0.1, 4
PREFIXES = (3, 4, 5, 6)
THRESHOLD = 0.7
# Words that a task remembers the buckets of; a forgotten word is hashed again.
CACHE_WORDS = 1 << 18
# Texts whose margins are taken together.
CHUNK = 256

_WORD = re.compile(r"[^\W\d_]+")


def word_buckets(word: str) -> list[int]:
    terms = [word, *("^" + word[:n] for n in PREFIXES if len(word) >= n)]
    return [zlib.crc32(t.encode("utf-8", "surrogatepass")) % BUCKETS for t in terms]


class Terms:
    """Text → sorted different buckets; with ``place`` (bucket → row of the model, −1 for none) the model's rows."""

    def __init__(self, place: np.ndarray | None = None):
        self.place, self.known = place, {}

    def of_word(self, word: str) -> tuple[int, ...]:
        found = self.known.get(word)
        if found is None:
            found = word_buckets(word)
            if self.place is not None:
                found = [r for r in self.place[found].tolist() if r >= 0]
            if len(self.known) >= CACHE_WORDS:
                self.known.clear()
            self.known[word] = found = tuple(found)
        return found

    def __call__(self, text: str | None) -> np.ndarray:
        of_word = self.of_word
        some = {b for word in set(_WORD.findall((text or "").translate(AZ_LOWER))) for b in of_word(word)}
        return np.sort(np.fromiter(some, dtype=np.int32, count=len(some)))


def training_labels(labels: DataFrame, train_rows: int) -> DataFrame:
    """One label per trained document: toxic if any of its rows says so.  Rows with a NULL id or label are left out."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"), 3, 1))
    one = usable.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)


class Machine(NamedTuple):
    """Bias, and the bucket, weight and vector of every row of the model."""

    bias: float
    buckets: np.ndarray
    weights: np.ndarray
    vectors: np.ndarray

    def margins(self, rows: list[np.ndarray]) -> np.ndarray:
        """Log odds of texts given by rows of the model."""
        parts = [np.zeros(0)]
        for i in range(0, len(rows), CHUNK):
            some = rows[i : i + CHUNK]
            at = np.concatenate(some)
            # One row more, so that a text may be empty.
            w, v = np.append(self.weights[at], 0.0), np.concatenate((self.vectors[at], np.zeros((1, self.vectors.shape[1]))))
            parts.append(_margins(self.bias, w, v, np.array([len(r) for r in some], dtype=np.int64))[0])
        return np.concatenate(parts)


def _margins(bias: float, w: np.ndarray, v: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Margins, sums of vectors and weight of the pairs per text; ``w`` and ``v`` have one row more than the texts."""
    first = np.cumsum(size) - size
    some = size > 0
    sums = lambda x: np.add.reduceat(x, first, axis=0) * (some[:, None] if x.ndim == 2 else some)
    s, pairs = sums(v), 1.0 / np.maximum(1.0, size / PAIR_TERMS)
    return bias + sums(w) + 0.5 * pairs * ((s * s).sum(axis=1) - sums((v * v).sum(axis=1))), s, pairs


def _speeds(rows: list[np.ndarray], y: np.ndarray, n: int) -> np.ndarray:
    """How fast each weight may move: by the z of the bucket's log odds ratio, never quite zero."""
    pos, neg, other = np.zeros(n), np.zeros(n), np.zeros(n)
    for row, label in zip(rows, y):
        # A bucket stands once in a row.
        (pos if label == 1 else neg if label == 0 else other)[row] += 1
    rest_p, rest_n = y.sum() - pos, (y == 0).sum() - neg
    odds = np.log((pos + 0.5) / (rest_p + 0.5)) - np.log((neg + 0.5) / (rest_n + 0.5))
    return np.minimum(1.0, (np.abs(odds) / np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5)) / TRUSTED) ** STEEPNESS)


def fit(rows: list[np.ndarray], y: np.ndarray, factors: int = FACTORS) -> Machine:
    """Logistic loss over sparse rows of buckets; 0/1 features make x² = x.  The best pass by rows set aside counts."""
    rng = np.random.default_rng(SEED)
    size = np.array([len(r) for r in rows])
    # One entry per bucket of the hash space; no array has one per term of all rows.
    place = np.zeros(BUCKETS, dtype=np.int32)
    for row in rows:
        place[row] = 1
    buckets = np.flatnonzero(place)
    n = len(buckets)
    place[buckets] = np.arange(n)
    rows = [place[row] for row in rows]
    speed = _speeds(rows, y, n)
    order = rng.permutation(len(rows))
    aside, used = order[: int(CHECKED * len(rows))], order[int(CHECKED * len(rows)) :]
    batches = []
    for at in range(0, len(used), BATCH):
        some = used[at : at + BATCH]
        here, inverse = np.unique(np.concatenate([rows[i] for i in some]), return_inverse=True)
        batches.append((some, here, inverse.astype(np.int32)))
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias, w, v = np.log(share / (1 - share)), np.zeros(n), rng.normal(0, SPREAD, (n, factors))
    # Adam's running means, of the bias last.
    mean, square, step = np.zeros(n + 1), np.zeros(n + 1), 0
    best, kept, idle = np.inf, None, 0

    def move(at: np.ndarray, g: np.ndarray) -> np.ndarray:
        mean[at] += 0.1 * (g - mean[at])
        square[at] += 0.001 * (g * g - square[at])
        return mean[at] / (1 - 0.9**step) / (np.sqrt(square[at] / (1 - 0.999**step)) + 1e-8)

    for epoch in range(EPOCHS):
        pace = 1.0 / (1.0 + SLOWING * epoch)
        for b in rng.permutation(len(batches)):
            some, here, inverse = batches[b]
            count, wide = size[some], len(here)
            m, s, pairs = _margins(bias, np.append(w[here][inverse], 0.0), np.concatenate((v[here][inverse], np.zeros((1, factors)))), count)
            g = (1 / (1 + np.exp(-np.clip(m, -30, 30))) - y[some]) * np.where(y[some] > 0, TOXIC_SHARE, 1.0) / len(some)
            text = np.repeat(np.arange(len(some)), count)
            # Without any term in the batch the counts would be whole numbers.
            total = lambda x: np.bincount(inverse, weights=x[text], minlength=wide).astype(np.float64)  # noqa: B023, E731
            of_pairs = g * pairs
            gv = np.stack([total(of_pairs * s[:, f]) for f in range(factors)], axis=1) if factors else np.zeros((wide, 0))
            gv -= total(of_pairs)[:, None] * v[here]
            step += 1
            bias -= pace * WEIGHT_RATE * move(np.array([n]), np.array([g.sum()]))[0]
            w[here] -= WEIGHT_DECAY * w[here] + pace * WEIGHT_RATE * speed[here] * move(here, total(g))
            v[here] -= pace * VECTOR_RATE * gv / max(1.0, np.sqrt((gv * gv).sum()))
            v *= 1.0 - pace * VECTOR_RATE * VECTOR_DECAY
        now = Machine(float(bias), buckets, w, v)
        if len(aside):
            z = now.margins([rows[i] for i in aside])
            loss = np.logaddexp(0, np.where(y[aside] > 0, -z, z)).mean()
            idle = 0 if loss < best else idle + 1
        if not len(aside) or loss < best:
            best, kept = loss if len(aside) else best, Machine(float(bias), buckets, w.copy(), v.copy())
        if idle > PATIENCE:
            break
    return kept


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, factors: int = FACTORS) -> Machine:
    """Fit on ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``.

    The sample has at most ``train_rows`` documents, one row each (the least text of a repeated id); it is the only bound.
    One task fits the machine on the different buckets of those rows.  Without any usable label every score is one half.
    """
    chosen_rows = cut(training_labels(labels, train_rows), "toxic-labels")
    # At most train_rows pairs of numbers.
    found = docs.select("doc_id", "text").join(F.broadcast(chosen_rows), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    sample = cut(found.select("text", "toxic"), "toxic-sample")

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms = Terms()
        for batch in batches:
            yield pd.DataFrame({"x": [terms(t).tobytes() for t in batch["text"]], "y": batch["toxic"]})

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [row for batch in batches for row in zip(batch["x"], batch["y"])]
        if rows:
            # The rows arrive in any order; sorting makes the fit repeatable.
            rows.sort()
            m = fit([np.frombuffer(x, dtype=np.int32) for x, _ in rows], np.array([float(y) for _, y in rows]), factors)
            yield pd.DataFrame({"bias": [m.bias], "b": [m.buckets.astype(np.int32).tobytes()], "w": [m.weights.astype(np.float32).tobytes()], "v": [m.vectors.astype(np.float32).tobytes()]})

    small = sample.mapInPandas(reduce, "x binary, y int")
    got = small.repartition(1).mapInPandas(learn, "bias double, b binary, w binary, v binary").collect()
    if not got:
        return Machine(0.0, np.zeros(0, dtype=np.int32), np.zeros(0), np.zeros((0, factors)))
    number = lambda c, kind: np.frombuffer(got[0][c], dtype=kind)
    return Machine(got[0]["bias"], number("b", np.int32), number("w", np.float32), number("v", np.float32).reshape(-1, factors) if factors else np.zeros((len(number("b", np.int32)), 0)))


def score(docs: DataFrame, model: Machine) -> DataFrame:
    """All columns of ``docs`` plus toxicity (double, 0 to 1), which replaces a column of that name.

    Whole texts are read; NULL and empty texts get the score of a text without any term.  Nothing but the text enters
    the score.  Repeated rows get equal scores; an empty table gives an empty result.
    """
    docs = docs.drop("toxicity")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def toxicity(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = shared.value
        place = np.full(BUCKETS, -1, dtype=np.int32)
        place[machine.buckets] = np.arange(len(machine.buckets))
        terms = Terms(place)
        for batch in texts:
            z = [machine.margins([terms(t) for t in batch.iloc[i : i + CHUNK]]) for i in range(0, len(batch), CHUNK)]
            yield pd.Series(1 / (1 + np.exp(-np.clip(np.concatenate(z), -500, 500))) if z else [], dtype=np.float64)

    return docs.withColumn("toxicity", toxicity(F.col("text")))
