"""Language identification of mixed texts: scripts narrow the candidates, Viterbi labels spans of words."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, held_out, small_batches, teaches, texts_of

BUCKETS = 1 << 15
PER_LANGUAGE = 400  # documents of each language that a model is fitted on
SWITCH = 12.0  # what a change of language costs, in nats
OUTSIDE = -30.0  # score of a word for a language that does not use its script
SCRIPT_SHARE = 0.01
CHUNK = 1_000_000  # characters that are scored at once
UNKNOWN = "und"

#: First code points of script ranges; letters of a range without a name count as "other".
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF)], "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)], "cyrillic": [(0x400, 0x52F)], "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)], "arabic": [(0x600, 0x6FF), (0x750, 0x77F)], "devanagari": [(0x900, 0x97F)], "bengali": [(0x980, 0x9FF)], "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)], "georgian": [(0x10A0, 0x10FF)], "kana": [(0x3040, 0x30FF)], "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x323AF)], "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
}
SCRIPT_NAMES = ("other", *SCRIPTS)


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: its lower-case form (0 if it is no letter or mark of a word) and its script's number."""
    lower = np.zeros(0x110000, np.uint32)
    for c in range(0x32400):  # no letters are assigned above
        ch = chr(c)
        if ch.isalpha() or c > 0x2FF and unicodedata.category(ch) in ("Mn", "Mc"):
            low = ch.lower()
            lower[c] = ord(low) if len(low) == 1 else c
    script = np.zeros(0x110000, np.uint8)
    for k, ranges in enumerate(SCRIPTS.values(), 1):
        for a, b in ranges:
            script[a : b + 1] = k
    return lower, script


@lru_cache(1)
def _marks() -> np.ndarray:
    """For each code point, whether it is a mark and no letter."""
    out = np.zeros(0x110000, bool)
    for c in np.flatnonzero(_tables()[0]).tolist():
        out[c] = not chr(c).isalpha()
    return out


class Words:
    """The words of several texts: maximal runs of letters, and the n-gram numbers at their letters."""

    def __init__(self, texts: list[str]):
        lower, script = _tables()
        # a zero before, between and after the texts ends their words
        raw = np.frombuffer(("\0" + "\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
        code = lower[raw].astype(np.uint64)
        letter = code > 0
        marks = letter & _marks()[raw]
        if marks.any():  # a run of marks alone is no word
            edge = np.diff(letter.astype(np.int8))
            start, end = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
            known = np.cumsum(np.concatenate([[0], letter & ~marks]))
            for k in np.flatnonzero(known[end] == known[start]).tolist():
                code[start[k] : end[k]] = 0
            letter = code > 0
        edge = np.diff(letter.astype(np.int8))
        self.start, self.end = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
        first = np.cumsum([1, *[len(t) + 1 for t in texts]])
        self.text_start = first[:-1]
        self.bounds = np.searchsorted(self.start, first)  # words of text k: bounds[k] to bounds[k + 1]
        at = np.flatnonzero(letter)
        before, here, after = code[at - 1], code[at], code[at + 1]
        mix = np.uint64(0x9E3779B97F4A7C15)
        two = ((before * np.uint64(0x110000) + here) * mix) >> np.uint64(64 - 15)
        three = (((before * np.uint64(0x110000) + here) * np.uint64(0x1F0001) + after + np.uint64(7)) * mix) >> np.uint64(64 - 15)
        self.two, self.three = two.astype(np.int64), three.astype(np.int64)
        self.sizes = self.end - self.start
        self.first_letter = np.cumsum(self.sizes) - self.sizes
        self.letter_script = script[raw[at]]
        self.script = self.letter_script[self.first_letter] if len(at) else np.zeros(0, np.uint8)


@dataclass
class LanguageModel:
    """Log probabilities of two kinds of n-grams for each language, and which scripts each language uses."""

    languages: list[str]
    two: np.ndarray
    three: np.ndarray
    outside: np.ndarray

    @classmethod
    def from_counts(cls, languages: list[str], two: np.ndarray, three: np.ndarray, scripts: np.ndarray) -> LanguageModel:
        def logs(c):
            return np.log((c + 0.5) / (c.sum(axis=0) + 0.5 * len(c))).astype(np.float32)

        uses = scripts / np.maximum(scripts.sum(axis=0), 1) >= SCRIPT_SHARE
        none = ~uses.any(axis=1)
        return cls(languages, logs(two), logs(three), np.where(uses | none[:, None], 0.0, OUTSIDE).astype(np.float32))

    def scores(self, w: Words) -> np.ndarray:
        """Per word and language; n-grams that overlap count half."""
        per_letter = (self.two[w.two] + self.three[w.three]) / 2
        return np.add.reduceat(per_letter, w.first_letter, axis=0) + self.outside[w.script] if len(w.start) else np.zeros((0, len(self.languages)))


def viterbi(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of each word when each change costs ``switch``; ties stay, then go to the first."""
    n = len(scores)
    best = int(scores.sum(axis=0).argmax())
    # If no stretch gains as much as one change costs by leaving the best language, that language labels all words.
    gain = np.cumsum((scores.max(axis=1) - scores[:, best]).astype(np.float64))
    if gain[-1] <= switch:
        return np.full(n, best)
    rival = scores.copy()
    rival[:, best] = -np.inf
    run = np.concatenate([[0.0], np.cumsum((rival.max(axis=1) - scores[:, best]).astype(np.float64))]) if scores.shape[1] > 1 else np.zeros(n + 1)
    if (run - np.minimum.accumulate(run)).max() <= switch:
        return np.full(n, best)
    back = np.empty((n, scores.shape[1]), np.int32)
    total = np.zeros(scores.shape[1])
    own = np.arange(scores.shape[1])
    for t, s in enumerate(scores.astype(np.float64)):
        top = int(total.argmax())
        jump = total[top] - switch > total
        back[t] = np.where(jump, top, own)
        total = np.where(jump, total[top] - switch, total) + s
    out = np.empty(n, np.int64)
    at = int(total.argmax())
    for t in range(n - 1, -1, -1):
        out[t] = at
        at = back[t, at]
    return out


def label(model: LanguageModel, texts: list[str], switch: float = SWITCH) -> list[list[tuple[int, int, int, int]]]:
    """For each text its spans (first character, end character, language, letters)."""
    w = Words(texts)
    scores = model.scores(w)
    out = []
    for k, first in enumerate(w.text_start.tolist()):
        a, b = w.bounds[k], w.bounds[k + 1]
        if a == b or not model.languages:
            out.append([])
            continue
        path = viterbi(scores[a:b], switch)
        cut = np.concatenate([[0], np.flatnonzero(np.diff(path)) + 1, [b - a]])
        letters = np.concatenate([[0], np.cumsum(w.sizes[a:b])])
        out.append([(int(w.start[a + i] - first), int(w.end[a + j - 1] - first), int(path[i]), int(letters[j] - letters[i])) for i, j in zip(cut[:-1].tolist(), cut[1:].tolist())])
    return out


def predict(model: LanguageModel, spans: list[tuple[int, int, int, int]]) -> tuple[str, float]:
    """The language with the most letters (ties: the first by name) and its share of them."""
    if not spans:
        return UNKNOWN, 0.0
    letters = np.zeros(len(model.languages))
    for _, _, k, n in spans:
        letters[k] += n
    best = int(letters.argmax())
    return model.languages[best], float(letters[best] / letters.sum())


def _decoded(column: pa.Array) -> list[str]:
    return [(t or b"").decode("utf-8", "replace") for t in texts_of(column)]


def _chunks(texts: list[str], most: int):
    """Slices of the list with about ``most`` characters or one text each."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t) > most:
            yield texts[at:k]
            at, size = k, 0
        size += len(t)
    if texts:
        yield texts[at:]


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Count n-grams and scripts on up to ``per_language`` documents of each language, the whole text of each.

    Only documents with a known language that are not held out teach; of a
    language's documents those with the smallest hash are taken.  The chosen ids (at
    most ``per_language`` for each language) are broadcast, counts are summed in the
    tasks and then by language and number, so that the driver gets at most
    2 * 2^15 + 15 numbers for each language.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text", "lang")  # other columns cannot clash
    chosen = docs.where(F.col("lang").isNotNull() & teaches(F.col("doc_id"))).select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang")).distinct()
    for keys in (["_lang", F.pmod(F.hash("_id"), F.lit(16))], ["_lang"]):  # in parts first, so that a hot language is no large group
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64("_id"), "_id"))
        chosen = chosen.withColumn("_rank", rank).where(F.col("_rank") <= per_language).drop("_rank")
    rows = docs.join(F.broadcast(chosen), (docs["doc_id"] == F.col("_id")) & (docs["lang"] == F.col("_lang"))).select(docs["text"], docs["lang"].alias("_lang"))

    def count(parts):
        sums: dict[str, np.ndarray] = {}
        for b in batches(parts):
            for lang, text in zip(b.column("_lang").to_pylist(), _decoded(b.column("text"))):
                w = Words([text])
                own = sums.setdefault(lang, np.zeros(2 * BUCKETS + len(SCRIPT_NAMES), np.int64))
                own[:BUCKETS] += np.bincount(w.two, minlength=BUCKETS)
                own[BUCKETS : 2 * BUCKETS] += np.bincount(w.three, minlength=BUCKETS)
                own[2 * BUCKETS :] += np.bincount(w.letter_script, minlength=len(SCRIPT_NAMES))
        for lang, own in sums.items():
            used = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(own[used], pa.int64())], names=["lang", "at", "n"])

    counted = rows.mapInArrow(count, "lang string, at int, n bigint").groupBy("lang", "at").agg(F.sum("n").alias("n"))
    got = counted.toPandas()
    languages = sorted(got["lang"].unique()) if len(got) else []
    sums = np.zeros((2 * BUCKETS + len(SCRIPT_NAMES), len(languages)))
    if len(got):
        sums[got["at"].to_numpy(), np.searchsorted(languages, got["lang"])] = got["n"].to_numpy()
    return LanguageModel.from_counts([str(x) for x in languages], sums[:BUCKETS], sums[BUCKETS : 2 * BUCKETS], sums[2 * BUCKETS :])


def identify(docs: DataFrame, model: LanguageModel, switch: float = SWITCH) -> DataFrame:
    """Per document ``doc_id``, ``held_out``, ``lang_pred``, ``score`` and ``spans`` (start, end in characters, lang).

    Only the text is read.  A null text, one without a letter, and any text under a
    model without languages are ``und`` with score 0 and no spans.  One row per input
    row; no shuffle.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("lang", T.StringType())])))])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(parts):
        m = shared.value
        for b in batches(parts):
            found = [s for chunk in _chunks(_decoded(b.column("text")), CHUNK * 4 // max(4, len(m.languages))) for s in label(m, chunk, switch)]
            best = [predict(m, s) for s in found]
            spans = [[{"start": s[0], "end": s[1], "lang": m.languages[s[2]]} for s in x] for x in found]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x[0] for x in best]), pa.array([x[1] for x in best], pa.float64()), pa.array(spans, kind)], names=["doc_id", "lang_pred", "score", "spans"])

    out = docs.select("doc_id", "text").mapInArrow(run, schema)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "spans")
