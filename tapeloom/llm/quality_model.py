"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Features of a text are hashes of its word n-grams, of n-grams of word shapes (case,
digits, symbols) and of whether an n-gram has stood in the text before.  A score is
a sparse dot product.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, held_out, small_batches, teaches, texts_of
from .quality_rules import sample_labels

BITS = 18
MAX_TRAIN = 4096  # labelled documents that a model is fitted on
EPOCHS = 4
PREDICT_AT = 0.7
_CACHE = 200_000  # words whose hash and shape a task remembers at once
_A, _B, _C = (np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_SYMBOL, _DIGIT, _UPPER, _LETTER = (re.compile(p) for p in (rb"[^\x80-\xffA-Za-z0-9.,;:!?'\"()-]", rb"[0-9]", rb"^[^a-z]*[A-Z][^a-z]*$", rb"[A-Za-z\x80-\xff]"))


def shape(word: bytes) -> int:
    """0-15: has a symbol, has a digit, is upper case throughout (two letters at least), has a letter."""
    return bool(_SYMBOL.search(word)) | 2 * bool(_DIGIT.search(word)) | 4 * bool(len(word) > 1 and _UPPER.match(word)) | 8 * bool(_LETTER.search(word))


class Hasher:
    """Feature numbers and weights of a text."""

    def __init__(self):
        self.place: dict[bytes, int] = {}
        self.hashes = np.zeros(_CACHE, np.uint64)
        self.shapes = np.zeros(_CACHE, np.uint64)

    def _known(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hash and shape of each word; each distinct word is looked at once until the cache is full."""
        place = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        hashes, shapes = self.hashes[place], self.shapes[place]
        for i in np.flatnonzero(place < 0).tolist():
            w = words[i]
            hashes[i], shapes[i] = xxhash.xxh3_64_intdigest(w.lower()), shape(w)
            if w not in self.place:
                if len(self.place) >= _CACHE:
                    self.place.clear()
                k = self.place[w] = len(self.place)
                self.hashes[k], self.shapes[k] = hashes[i], shapes[i]
        return hashes, shapes

    def __call__(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        """Every group of features weighs its share among the group's features; a bias stands in front."""
        words = (text or b"").split()
        shift = np.uint64(64 - BITS)
        at, weight = [np.zeros(1, np.int64)], [np.ones(1)]
        if words:
            one, shapes = self._known(words)
            two = one[:-1] * _A + one[1:] + _B
            shape_two = shapes[:-1] * np.uint64(16) + shapes[1:]
            _, first, group = np.unique(two, return_index=True, return_inverse=True)
            again = (np.arange(len(two)) != first[group]).astype(np.uint64)  # not the first of its kind
            for k, h in enumerate((one, two, shapes, shape_two, again, again[:-1] * np.uint64(2) + again[1:])):
                if len(h):
                    at.append((((h + np.uint64(k)) * _A ^ _C) * _B >> shift).astype(np.int64))
                    weight.append(np.full(len(h), (1.0 if k < 2 else 4.0) / len(h)))
        return np.concatenate(at), np.concatenate(weight)


def combined(at: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    index, group = np.unique(at, return_inverse=True)
    return index, np.bincount(group, weight)


def ftrl(examples: list[tuple[np.ndarray, np.ndarray, float]], epochs: int = EPOCHS, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01) -> np.ndarray:
    """Weights after the examples in their order, each epoch anew."""
    z, n, w = (np.zeros(1 << BITS) for _ in range(3))
    for _ in range(epochs):
        for at, x, y in examples:
            zi, ni = z[at], n[at]
            wi = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
            g = (1 / (1 + np.exp(-np.clip(wi @ x, -35, 35))) - y) * x
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[at] = zi + g - sigma * wi
            n[at] = ni + g * g
    active = np.abs(z) > l1
    w[active] = -(z[active] - np.sign(z[active]) * l1) / ((beta + np.sqrt(n[active])) / alpha + l2)
    return w


@dataclass
class QualityModel:
    weights: np.ndarray

    def score(self, hasher: Hasher, text: bytes | None) -> float:
        at, x = hasher(text)
        return float(1 / (1 + np.exp(-np.clip(self.weights[at] @ x, -35, 35))))


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> QualityModel:
    """Fit on at most ``max_train`` labelled documents that are not held out, the whole text of each.

    The sample is hashed where it is read and trained in one task, in the order of
    hashed ids; only non-zero weights (at most 2^18) reach the driver.  Without
    labels all weights are 0 and every score is 0.5.
    """
    small_batches(docs.sparkSession)
    chosen = sample_labels(labels.where(teaches(F.col("doc_id"))), "quality", max_train)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y")  # at most max_train ids

    def features(parts):
        hasher = Hasher()
        for b in batches(parts):
            got = [combined(*hasher(t)) for t in texts_of(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array([g[0] for g in got], pa.list_(pa.int64())), pa.array([g[1] for g in got], pa.list_(pa.float64()))], names=["doc_id", "y", "at", "x"])

    def train(parts):
        examples = [(np.array(a), np.array(x), y) for b in parts for a, x, y in zip(b.column("at").to_pylist(), b.column("x").to_pylist(), b.column("y").to_pylist())]
        w = ftrl(examples)
        used = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(w[used])], names=["at", "w"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("y", T.DoubleType()), T.StructField("at", T.ArrayType(T.LongType())), T.StructField("x", T.ArrayType(T.DoubleType()))])
    one_each = rows.mapInArrow(features, schema).groupBy("doc_id").agg(F.min(F.struct("at", "x", "y")).alias("r"))
    hashed = one_each.select("doc_id", "r.*")  # of several texts of one id the smallest, so that reruns agree
    ordered = hashed.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")
    weights = np.zeros(1 << BITS)
    for r in ordered.select("y", "at", "x").mapInArrow(train, "at bigint, w double").collect():
        weights[r["at"]] = r["w"]
    return QualityModel(weights)


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """Per document ``doc_id``, ``held_out``, ``score`` and ``predicted`` (1 from a score of 0.7).

    Null and empty texts have the bias alone.  One row per input row; only the
    text is read, and nothing is shuffled.
    """
    small_batches(docs.sparkSession)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(parts):
        hasher, model = Hasher(), shared.value
        for b in batches(parts):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([model.score(hasher, t) for t in texts_of(b.column("text"))], pa.float64())], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, schema)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"))
