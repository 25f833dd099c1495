"""Line dedup by a deletion-neighbourhood join: near-equal lines share a line with one word left out.

Lines are compared as sequences of words; the edit bound is one word inserted, left
out or replaced, in lines of four words or more (in shorter ones a word is more than a
quarter of the line; all lines of one word would be alike).  Two such lines agree in
the left or the right half, so hashes of halves show first which lines can have a
partner at all.  Only those emit their deletion variants as hashed keys, and only of
the half that is not shared, where the edit must lie.  Equal variants are joined, the
edit distance is verified on the words, and the earliest line stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.session import materialize, steps

from .common import WordHashes, batches, free_names, mixed, small_batches, texts_of

EDIT_WORDS = 4  # in shorter lines the bound is no edit
_BASE = 0x9E3779B97F4A7C15
_HALF = 1 << 63


class Segments:
    """Hashes of any runs of words, from one running sum."""

    def __init__(self, words: np.ndarray, base: int):
        n = len(words)
        self.base = np.uint64(base)
        self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base, np.uint64)]), dtype=np.uint64)
        inverse = np.uint64(pow(base, -1, 1 << 64))
        self.back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, inverse, np.uint64)]), dtype=np.uint64)
        self.sum = np.concatenate([[np.uint64(0)], np.cumsum(words * self.power[:-1], dtype=np.uint64)])

    def raw(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Sum over words a to b of word * base^(place from a)."""
        return (self.sum[b] - self.sum[a]) * self.back[a]

    def without(self, a: np.ndarray, b: np.ndarray, i: np.ndarray) -> np.ndarray:
        """The same over words a to b but for word i."""
        return self.raw(a, i) + self.raw(i + np.int64(1), b) * self.power[i - a]


def _finish(raw: np.ndarray, n: np.ndarray, salt: int) -> np.ndarray:
    return mixed(raw + n.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D) + np.uint64(salt)).astype(np.int64)


def _line_words(text: bytes | None) -> Iterator[tuple[int, list[bytes]]]:
    for k, line in enumerate((text or b"").split(b"\n")):
        words = line.split()
        if words:
            yield k, words


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, _key, line, a, b, halves): 128 bits for each line's words, and the keys of its halves.

    With q words in the shorter of two lines within the bound, the first or the last
    q // 2 words of both are equal; a line of n words has to offer q = n and n - 1.
    The lowest bit of a key tells the left half from the right.
    """
    schema = T.StructType([docs.schema["doc_id"], T.StructField("_key", T.LongType()), T.StructField("line", T.IntegerType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("halves", T.ArrayType(T.LongType()))])
    whole, part = xxhash.xxh3_128_intdigest, xxhash.xxh3_64_intdigest

    def run(parts):
        for batch in batches(parts):
            row, line, a, b, halves = [], [], [], [], []
            for r, text in enumerate(texts_of(batch.column("text"))):
                for k, words in _line_words(text):
                    digest = whole(b" ".join(words))
                    row.append(r)
                    line.append(k)
                    a.append((digest & (2**64 - 1)) - _HALF)
                    b.append((digest >> 64) - _HALF)
                    keys = []
                    n = len(words)
                    if n >= EDIT_WORDS:
                        for cut in {n // 2, (n - 1) // 2}:
                            keys += [(part(b" ".join(words[:cut])) >> 2) * 2, (part(b" ".join(words[n - cut :])) >> 2) * 2 + 1]
                    halves.append(keys)
            pick = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(pick), batch.column("_key").take(pick), pa.array(line, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(halves, pa.list_(pa.int64())),
            ], names=schema.names)

    return docs.select("doc_id", _key().alias("_key"), "text").mapInArrow(run, schema)


def _key() -> Column:
    return F.xxhash64("doc_id", "text")


def _place() -> Column:
    """Sorts lines: by document id (null last), then by the text's hash, then in the text."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("_key").alias("key"), F.col("line").alias("line"))


def variants(hashes: np.ndarray, left: bool = True, right: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(keys, kinds) of a line of word hashes.  Kind 0: all but word i, and i; kind 1: the whole line; kind 2: all but word i.

    Lines of one kind-0 key differ in one word at the same place.  A kind-2 line is a
    kind-1 line of the same key with one word more.  ``left`` and ``right`` tell which
    halves the line shares with another: words of a shared half are not left out, as
    the edit lies behind (or before) it.  Of a run of equal words any may be left out,
    so one behind the half is.
    """
    n = len(hashes)
    half = (n - 1) // 2
    at = np.unique(np.concatenate([np.arange(half, n) if left else np.zeros(0, np.int64), np.arange(n - half) if right else np.zeros(0, np.int64)]))
    seg = Segments(hashes, _BASE)
    left_out = seg.without(np.zeros(len(at), np.int64), np.full(len(at), n), at)
    whole = seg.raw(np.array([0]), np.array([n]))
    same = _finish(left_out + mixed(at.astype(np.uint64)), np.full(len(at), n), 5)
    gone = np.unique(_finish(left_out, np.full(len(at), n - 1), 6))
    own = _finish(whole, np.array([n]), 6)
    return np.concatenate([same, own, gone]), np.repeat([0, 1, 2], [len(same), 1, len(gone)])


def within_one(a: list[bytes], b: list[bytes]) -> bool:
    """Whether one word inserted, left out or replaced, or none, turns a into b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def near(a: list[bytes], b: list[bytes]) -> bool:
    """Whether two lines are within the edit bound of both."""
    return within_one(a, b) if min(len(a), len(b)) >= EDIT_WORDS else a == b


def _suspect_lines(docs: DataFrame, lines: DataFrame, first: DataFrame) -> DataFrame:
    """(a, b, place, left, right, text) of distinct lines that share a half, left or right, with a different line."""
    halves = lines.select("a", "b", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.min("a").alias("lo"), F.max("a").alias("hi")).where("lo <> hi").select("half")
    right = F.col("half") % 2 != 0
    ids = halves.join(shared, "half", "left_semi").groupBy("a", "b").agg(F.bool_or(~right).alias("left"), F.bool_or(right).alias("right"))
    at = first.join(ids, ["a", "b"]).select("a", "b", "place", "left", "right", F.col("place.key").alias("_key"), F.col("place.line").alias("_line"))
    # Equal (doc_id, text) rows hold the same lines: any of them will do, and the id itself need not match.
    wanted = at.groupBy("_key").agg(F.collect_list(F.struct("a", "b", "place", "left", "right", "_line")).alias("_wanted"))  # at most the lines of one text
    names = ["a", "b", "place", "left", "right"]

    def run(parts):
        for batch in batches(parts):
            column = batch.column("_wanted")
            rows, texts = column.flatten(), []
            place = iter(rows.field("_line").to_pylist())
            for text, n in zip(texts_of(batch.column("text")), column.value_lengths().to_pylist()):
                pieces = text.split(b"\n")
                texts += [pieces[next(place)] for _ in range(n)]
            yield pa.RecordBatch.from_arrays([*[rows.field(c) for c in names], pa.array(texts, pa.binary()).cast(pa.string())], names=[*names, "text"])

    schema = T.StructType([*[at.schema[c] for c in names], T.StructField("text", T.StringType())])
    each = docs.select(_key().alias("_key"), "text").join(wanted, "_key").select("text", "_wanted").mapInArrow(run, schema)
    return each.groupBy("a", "b").agg(F.min("place").alias("place"), F.bool_or("left").alias("left"), F.bool_or("right").alias("right"), F.min("text").alias("text"))


def _edit_links(suspects: DataFrame) -> DataFrame:
    """(a, b) of lines that have an earlier line within one edit, verified."""
    schema = "a bigint, b bigint, k bigint, kind int"

    def emit(parts):
        hashes = WordHashes()
        for batch in batches(parts):
            keys, kinds, count = [], [], []
            for text, left, right in zip(texts_of(batch.column("text")), batch.column("left").to_pylist(), batch.column("right").to_pylist()):
                k, kind = variants(hashes(text.split()), left, right)
                keys.append(k)
                kinds.append(kind)
                count.append(len(k))
            pick = pa.array(np.repeat(np.arange(len(count)), count))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pick), batch.column("b").take(pick), pa.array(np.concatenate(keys)), pa.array(np.concatenate(kinds).astype(np.int32))], names=["a", "b", "k", "kind"])

    # dealt anew: suspects are few, but each makes many rows
    emitted = materialize(suspects.select("a", "b", "left", "right", "text").repartition("a", "b").mapInArrow(emit, schema))
    shared = emitted.groupBy("k").agg(F.min("a").alias("lo"), F.max("a").alias("hi")).where("lo <> hi").select("k")
    members = materialize(emitted.join(shared, "k", "left_semi").join(suspects.select("a", "b", "place"), ["a", "b"]))
    groups = members.groupBy("k").agg(*[F.min(F.when(F.col("kind") == kind, F.struct("place", "a", "b"))).alias(f"best{kind}") for kind in (0, 1, 2)])
    partner = F.when(F.col("kind") == 0, F.col("best0")).when(F.col("kind") == 1, F.col("best2")).otherwise(F.col("best1"))
    linked = members.join(groups, "k").select("a", "b", "place", partner.alias("p")).where("p.place < place")
    pairs = linked.select("a", "b", F.col("p.a").alias("pa"), F.col("p.b").alias("pb")).distinct()
    mine, other = suspects.select("a", "b", "text"), suspects.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("text").alias("other"))
    texts = pairs.join(mine, ["a", "b"]).join(other, ["pa", "pb"]).select("a", "b", "text", "other")

    def verify(parts):
        for batch in batches(parts):
            good = [near(x.split(), y.split()) for x, y in zip(texts_of(batch.column("text")), texts_of(batch.column("other")))]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return texts.mapInArrow(verify, "a bigint, b bigint").distinct()


def removed_lines(docs: DataFrame) -> DataFrame:
    """Per distinct (doc_id, text) with lines to remove: ``doc_id``, ``_key`` and ``lines``, their numbers from 0 in order.

    Lines are parts of a text between line feeds, compared by their words.  A line
    goes if an earlier line, of the same or an earlier document, has the same words
    or (both with four words or more) is one word edit away.  Earlier means a
    smaller doc_id (null last), then a smaller hash of the text, then an earlier
    line.  Lines without words stay.  Rows equal in doc_id and text count as one
    document and get the same result.

    Occurrences of a line are counted before the shuffle, so a line that stands
    everywhere costs one row per task; keys of equal variants are reduced to their
    earliest line, never paired; the join back to occurrences is one that Spark can
    split where a line is hot.
    """
    small_batches(docs.sparkSession)
    lines = materialize(_lines(docs))
    first = materialize(lines.groupBy("a", "b").agg(F.min(_place()).alias("place"), F.max(_place()).alias("last")))
    suspects = materialize(_suspect_lines(docs, lines, first))
    near = _edit_links(suspects).withColumn("near", F.lit(True))
    # written on its own, so that the next join stands alone and Spark can split it where a line is hot
    repeated = materialize(first.join(near, ["a", "b"], "left").where("near or place < last").select("a", "b", "place", F.coalesce("near", F.lit(False)).alias("near")))
    gone = lines.select("doc_id", "_key", "line", "a", "b").join(repeated, ["a", "b"]).where(F.col("near") | (F.col("place") < _place()))
    return gone.groupBy("doc_id", "_key").agg(F.array_sort(F.collect_set("line")).alias("lines"))  # at most the lines of one text


def removed(docs: DataFrame) -> DataFrame:
    """:func:`removed_lines` as a table of its own; those written on the way are gone."""
    with steps(docs.sparkSession) as kept:
        kept.append(materialize(removed_lines(docs)))
    return kept[0]


def _joined(docs: DataFrame, gone: DataFrame, extra: list[Column]) -> tuple[DataFrame, str]:
    """``docs`` with ``extra`` columns and the numbers of removed lines (null: none), and the name of those."""
    key, key2, doc2, lines = free_names(docs, "_line_key", "_line_key2", "_line_doc", "_gone")
    left = docs.select(*[F.col(f"`{c}`") for c in docs.columns], *extra, _key().alias(key))
    right = gone.select(F.col("_key").alias(key2), F.col("doc_id").alias(doc2), F.col("lines").alias(lines))
    return left.join(right, (F.col(key) == F.col(key2)) & F.col("doc_id").eqNullSafe(F.col(doc2)), "left").drop(key, key2, doc2), lines


def dedup(docs: DataFrame) -> DataFrame:
    """The documents without their removed lines, in their columns.

    A text that loses all its lines goes as a document; one without removed lines,
    null and empty ones included, is kept as it is.
    """
    joined, lines = _joined(docs, removed(docs), [])

    def run(parts):
        for batch in batches(parts):
            at = batch.schema.get_field_index("text")
            texts, stays = [], []
            for text, gone in zip(texts_of(batch.column(at)), batch.column(lines).to_pylist()):
                if gone is not None:
                    gone = set(gone)
                    text = b"\n".join(x for k, x in enumerate(text.split(b"\n")) if k not in gone)
                stays.append(gone is None or bool(text.split()))
                texts.append(text)
            field = batch.schema.field(at)
            out = batch.set_column(at, field, pa.array(texts, pa.binary()).cast(field.type))
            yield out.select([c for c in batch.schema.names if c != lines]).filter(pa.array(stays, pa.bool_()))

    return joined.mapInArrow(run, docs.schema)


def report(docs: DataFrame) -> DataFrame:
    """Per document ``doc_id``, ``n_lines`` (parts between line feeds; null text: 0), ``n_removed`` and ``removed``, the line numbers joined by commas."""
    n_lines = F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    joined, gone = _joined(docs.select("doc_id", "text"), removed(docs), [n_lines.alias("n_lines")])
    return joined.select("doc_id", "n_lines", F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join(gone, ","), F.lit("")).alias("removed"))
