"""Quality rules: fixed base rules and gradient-boosted trees over statistics of a text.

Trees are grown with numpy on a bounded labelled sample and flattened into arrays
of nodes; a batch of documents is scored by walking all rows down all trees at
once.  Chosen statistics may only lower the score (monotonic constraints).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, small_batches, texts_of

MAX_TRAIN = 4096  # labelled documents that the trees are grown on
KEEP_AT = 0.5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "upper", "digits", "distinct", "line_words")
#: -1: a larger value never raises the score; 0: free.
MONOTONE = (0, 0, -1, -1, -1, -1, 0, 0, 0)
_SPACE = re.compile(rb"[\x20\x09-\x0d]+")
_NO_SYMBOL = bytes(b for b in range(256) if b not in b"#*$%&|<>")
_NO_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
_NO_DIGIT = bytes(b for b in range(256) if not 48 <= b <= 57)
_TRAIL = bytes(range(0x80, 0xC0))


def repeated_words(words: list[bytes], n: int = 3) -> int:
    """Words inside n-word windows that occur twice or more in the text."""
    if len(words) <= n:
        return 0
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    distinct, gram = len(ids), code
    for k in range(1, n):
        gram = gram[: len(code) - k] * distinct + code[k:]
        _, gram = np.unique(gram, return_inverse=True)
    at = np.flatnonzero(np.bincount(gram)[gram] > 1)
    hit = np.zeros(len(words), bool)
    for k in range(n):
        hit[at + k] = True
    return int(hit.sum())


def statistics(text: bytes | None) -> tuple[list[int], list[float]]:
    """The counts of the contract and the features of the trees."""
    text = text or b""
    words = text.split()  # of bytes: at ASCII white space only
    n = len(words)
    packed = b"".join(words)
    chars = len(packed.translate(None, _TRAIL))
    symbols = len(text.translate(None, _NO_SYMBOL))
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(words)
    per, per_char = max(n, 1), max(chars, 1)
    features = [
        float(np.log1p(n)), chars / per, symbols / per, dup / max(len(lines), 1), repeat / per, len(packed.translate(None, _NO_UPPER)) / per_char,
        len(packed.translate(None, _NO_DIGIT)) / per_char, len(set(words)) / per, n / max(len(lines), 1),
    ]
    return [n, chars, symbols, dup, repeat], features


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


@dataclass
class Trees:
    """Nodes of all trees in flat arrays; a leaf is its own child and has feature 0 with an infinite cut."""

    root: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        at = np.repeat(self.root[None, :], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
        return self.start + self.value[at].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -50, 50)))


def grow(x: np.ndarray, y: np.ndarray, monotone=MONOTONE, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0, least: float = 2.0) -> Trees:
    """Boost logistic loss with second-order steps on binned features.

    A split on a constrained feature is taken only if its sides are in order, and
    bounds handed down to both sides keep every later leaf in order.  Ties go to
    the first feature and the lowest cut.
    """
    nodes: list[list[float]] = []  # feature, cut, left, right, value
    roots: list[int] = []
    share = np.clip(y.mean() if len(y) else 1.0, 0.01, 0.99)
    start = float(np.log(share / (1 - share)))
    if len(y) and 0 < y.sum() < len(y):
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
        binned = [np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)]
        margin = np.full(len(y), start)

        def node(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
            me = len(nodes)
            sum_g, sum_h = g[rows].sum(), h[rows].sum()
            value = float(np.clip(-sum_g / (sum_h + ridge), low, high))
            nodes.append([0, np.inf, me, me, value * rate])
            margin_of[rows] = value * rate
            if level == depth:
                return me
            best = (1e-9, None)
            for j, c in enumerate(cuts):
                gl = np.bincount(binned[j][rows], g[rows], len(c) + 1).cumsum()[:-1]
                hl = np.bincount(binned[j][rows], h[rows], len(c) + 1).cumsum()[:-1]
                gr, hr = sum_g - gl, sum_h - hl
                vl, vr = np.clip(-gl / (hl + ridge), low, high), np.clip(-gr / (hr + ridge), low, high)
                gain = -(gl * vl + 0.5 * (hl + ridge) * vl**2) - (gr * vr + 0.5 * (hr + ridge) * vr**2) + (sum_g * value + 0.5 * (sum_h + ridge) * value**2)
                gain[(hl < least / 4) | (hr < least / 4) | (monotone[j] * (vr - vl) < 0)] = -1
                if len(gain) and gain.max() > best[0]:
                    k = int(gain.argmax())
                    best = (float(gain[k]), (j, k, vl[k], vr[k]))
            if best[1] is None:
                return me
            j, k, vl, vr = best[1]
            mid = (vl + vr) / 2
            bounds = {0: ((low, high), (low, high)), -1: ((max(low, mid), high), (low, min(high, mid))), 1: ((low, min(high, mid)), (max(low, mid), high))}[monotone[j]]
            go = binned[j][rows] <= k
            nodes[me][0], nodes[me][1] = j, float(cuts[j][k])
            nodes[me][2] = node(rows[go], g, h, level + 1, *bounds[0])
            nodes[me][3] = node(rows[~go], g, h, level + 1, *bounds[1])
            return me

        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            margin_of = np.zeros(len(y))
            roots.append(node(np.arange(len(y)), p - y, np.maximum(p * (1 - p), 1e-6), 0, -np.inf, np.inf))
            margin += margin_of
    if not nodes:
        nodes, roots = [[0, np.inf, 0, 0, 0.0]], [0]
    a = np.array(nodes, float)
    return Trees(np.array(roots), a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4], depth, start)


def sample_labels(labels: DataFrame, column: str, max_train: int) -> DataFrame:
    """At most ``max_train`` (doc_id, y) with the smallest hashes of their ids; a document with two labels has the larger one."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
    return known.groupBy("doc_id").agg(F.max(column).cast("double").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Trees:
    """Grow trees on the labelled documents of a bounded sample.  Without both labels every score is the share of label 1 (1 if there is none)."""
    small_batches(docs.sparkSession)
    chosen = sample_labels(labels, "quality", max_train)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y")  # at most max_train ids
    schema = T.StructType([docs.schema["doc_id"], T.StructField("y", T.DoubleType()), T.StructField("x", T.ArrayType(T.DoubleType()))])

    def measure(parts):
        for b in batches(parts):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array([statistics(t)[1] for t in texts_of(b.column("text"))], pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    one_each = rows.mapInArrow(measure, schema).groupBy("doc_id").agg(F.min(F.struct("x", "y")).alias("r"))
    got = sorted((str(r["doc_id"]), r["r"]["x"], r["r"]["y"]) for r in one_each.collect())  # one row for each sampled id at most
    return grow(np.array([g[1] for g in got], float).reshape(-1, len(FEATURES)), np.array([g[2] for g in got], float))


def _verdicts(trees: Trees, texts: list[bytes | None], keep_at: float):
    counts, features = zip(*(statistics(t) for t in texts))
    p = trees.probability(np.array(features, float))
    failed = np.array([base_failed(c[0], c[4]) for c in counts])
    return counts, failed, p, ~failed & (p >= keep_at)


def judge(docs: DataFrame, trees: Trees, keep_at: float = KEEP_AT) -> DataFrame:
    """Per document ``doc_id``, the five counts, ``base_failed``, ``p_quality`` and ``kept``.

    Null and empty texts have no words and fail the base rules.  One row per input
    row; other columns are not read.  No shuffle.
    """
    small_batches(docs.sparkSession)
    schema = T.StructType([
        docs.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in COUNTS], T.StructField("base_failed", T.BooleanType()),
        T.StructField("p_quality", T.DoubleType()), T.StructField("kept", T.BooleanType()),
    ])

    def run(parts):
        for b in batches(parts):
            counts, failed, p, kept = _verdicts(trees, texts_of(b.column("text")), keep_at)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, pa.int64()) for c in zip(*counts)], pa.array(failed), pa.array(p), pa.array(kept)], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def keep(docs: DataFrame, trees: Trees, keep_at: float = KEEP_AT) -> DataFrame:
    """The documents that both the base rules and the trees keep, with all their columns."""
    small_batches(docs.sparkSession)

    def run(parts):
        for b in batches(parts):
            yield b.filter(pa.array(_verdicts(trees, texts_of(b.column("text")), keep_at)[3]))

    return docs.mapInArrow(run, docs.schema)
