"""Benchmark decontamination: a broadcast hash set of test n-grams against training windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.session import materialize

from .common import batches, free_names, small_batches, texts_of

WINDOW = 13
MAX_WORDS = 2_000_000  # benchmark words that one broadcast set is made of
CHUNK_WORDS = 400_000  # document words that are hashed at once
_STEP = np.uint64(0x9E3779B97F4A7C15)

#: Bytes of words: digits, a-z and all of UTF-8's multi-byte characters; A-Z are lower-cased, the rest become blanks.
_NORMAL = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_NORMAL).split() if text else []


def _windows(ids: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of n word numbers."""
    m = len(ids) - n + 1
    out = np.zeros(max(m, 0), np.uint64)
    if m > 0:
        for k in range(n):
            out *= _STEP
            out += ids[k : k + m]
    return out


class GramSet:
    """Windows of benchmark items: hashes to find candidates, the words themselves to verify them."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.exact: dict[bytes, tuple[str, ...]] = {}
        hashes: dict[int, list[np.ndarray]] = {}
        for item, text in items:
            words = words_of(text)
            n = min(window, len(words))
            if not n:
                continue
            ids = np.fromiter((self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words), np.uint64, len(words))
            hashes.setdefault(n, []).append(_windows(ids, n))
            for i in range(len(words) - n + 1):
                key = b" ".join(words[i : i + n])
                if item not in (found := self.exact.get(key, ())):
                    self.exact[key] = (*found, item)
        self.hashes = {n: np.unique(np.concatenate(h)) for n, h in sorted(hashes.items())}
        self.bits = max(16, int(np.ceil(np.log2(max(1, sum(map(len, self.hashes.values()))) * 16))))
        self.maps = {n: self._bitmap(h) for n, h in self.hashes.items()}

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h * _STEP) >> np.uint64(64 - self.bits)

    def _bitmap(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(1 << self.bits, bool)
        out[self._slot(h)] = True
        return out

    def scan(self, words: list[bytes]) -> list[tuple[int, int, tuple[str, ...]]]:
        """(first word, words, items) of every window that occurs."""
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.uint64, len(words))
        out = []
        for n, known in self.hashes.items():
            h = _windows(ids, n)
            at = np.flatnonzero(self.maps[n][self._slot(h)])
            at = at[np.isin(h[at], known)]
            for i in at.tolist():
                if items := self.exact.get(b" ".join(words[i : i + n])):
                    out.append((i, n, items))
        return out


def _scan_batches(grams: GramSet, rows: Iterator[pa.RecordBatch], keep: list[str]) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, list[tuple[int, int]], set[str]]]]]:
    """For each batch: per row its words, the merged spans of hit words and the items."""
    for batch in batches(rows):
        texts = texts_of(batch.column("text"))
        found: list[tuple[int, list[tuple[int, int]], set[str]]] = []
        words: list[bytes] = []
        starts: list[int] = []

        def flush(words=words, starts=starts, found=found):
            ends = [*starts[1:], len(words)]
            spans: list[list[tuple[int, int]]] = [[] for _ in starts]
            items: list[set[str]] = [set() for _ in starts]
            rows_at = np.array(starts)
            for i, n, names in sorted(grams.scan(words)):
                k = int(np.searchsorted(rows_at, i, "right")) - 1
                own = spans[k]
                a, b = i - starts[k], i - starts[k] + n
                if own and a <= own[-1][1]:
                    own[-1] = (own[-1][0], max(own[-1][1], b))
                else:
                    own.append((a, b))
                items[k].update(names)
            # a blank stands after each text, so that no window spans two
            found.extend((e - s - 1, sp, it) for s, e, sp, it in zip(starts, ends, spans, items))
            words.clear()
            starts.clear()

        for text in texts:
            starts.append(len(words))
            words += words_of(text)
            words.append(b"")
            if len(words) >= CHUNK_WORDS:
                flush()
        if starts:
            flush()
        yield batch, found


def _slices(items: DataFrame) -> tuple[DataFrame, int]:
    """The items as strings and bytes, and how many gram sets they are cut into.

    A set is made of at most about MAX_WORDS benchmark words (one very long item may
    exceed it alone).  A larger benchmark is cut by the hash of its items into more
    sets, each of which scans the documents in turn.
    """
    sized = items.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text")).where("item is not null and text is not null")
    letters = sized.agg(F.sum(F.length("text"))).first()[0] or 0
    return sized, max(1, -(-letters // (5 * MAX_WORDS)))


def _gram_set(sized: DataFrame, slices: int, k: int, window: int):
    part = sized.where(F.pmod(F.xxhash64("item", "text"), F.lit(slices)) == k)
    return sized.sparkSession.sparkContext.broadcast(GramSet([(r[0], bytes(r[1])) for r in part.collect()], window))


def _hits(docs: DataFrame, items: DataFrame, window: int) -> tuple[DataFrame, bool]:
    """Results of :func:`hits` with ``_row``, and whether there is one per distinct (doc_id, text) instead of one per row."""
    spark = docs.sparkSession
    small_batches(spark)
    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("_row", T.LongType()),
    ])

    def scanner(shared):
        def run(rows):
            for batch, found in _scan_batches(shared.value, rows, []):
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id"), pa.array([f[0] for f in found], pa.int64()), pa.array([[list(s) for s in f[1]] for f in found], pa.list_(pa.list_(pa.int64()))),
                    pa.array([sorted(f[2]) for f in found], pa.list_(pa.string())), batch.column("_row"),
                ], names=["doc_id", "n_words", "spans", "items", "_row"])

        return run

    sized, slices = _slices(items)
    if slices == 1:
        source = docs.select("doc_id", "text", F.lit(0).cast("long").alias("_row"))
        return source.mapInArrow(scanner(_gram_set(sized, 1, 0, window)), schema), False
    # more sets: equal (doc_id, text) rows get equal results; the hits of a set are written and the set is freed before the next is read
    source = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("_row"))
    each = []
    for k in range(slices):
        shared = _gram_set(sized, slices, k, window)
        each.append(materialize(source.mapInArrow(scanner(shared), schema).dropDuplicates(["doc_id", "_row"])))
        shared.destroy()
    union = each[0]
    for more in each[1:]:
        union = union.unionAll(more)
    merged = union.groupBy("doc_id", "_row").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    joined = F.expr("aggregate(array_sort(spans), cast(array() as array<array<bigint>>), (a, s) -> if(size(a) > 0 and s[0] <= a[size(a) - 1][1], concat(slice(a, 1, size(a) - 1), array(array(a[size(a) - 1][0], greatest(a[size(a) - 1][1], s[1])))), concat(a, array(s))))")
    return merged.withColumn("spans", joined), True


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document ``doc_id``, ``n_words``, ``spans`` (first word, end word) that are hit, and ``items``, sorted as strings.

    A window is ``window`` consecutive words of an item, or all words of a shorter
    one; a document word inside any occurrence is hit.  Hashes find candidates, the
    words decide.  Null and empty texts have no words; items without words, id or
    text match nothing; repeated items count once and repeated documents keep their
    rows.  Nothing is shuffled: the documents are scanned where they are read.
    """
    found, distinct = _hits(docs, items, window)
    if not distinct:
        return found.drop("_row")
    source = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("_row"))
    out = source.alias("d").join(found.alias("m"), F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("d._row") == F.col("m._row")))
    return out.select("d.doc_id", "n_words", "spans", "items")


def digest(found: DataFrame) -> DataFrame:
    """The counts of the contract from :func:`hits`."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))


def contaminated(n_words: int, spans: list[tuple[int, int]], share: int = 20) -> bool:
    n_hit = sum(b - a for a, b in spans)
    return n_hit > 0 and share * n_hit >= n_words


def _without(text: bytes, spans: list[tuple[int, int]]) -> str:
    """The text without the characters from the first to the last word of each span."""
    plain = text.translate(_NORMAL)
    ends, at = [], 0
    for w in plain.split():
        at = plain.index(w, at)
        ends.append((at, at + len(w)))
        at += len(w)
    out, done = [], 0
    for a, b in spans:
        out.append(text[done : ends[a][0]])
        done = ends[b - 1][1]
    return b"".join([*out, text[done:]]).decode("utf-8", "replace")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, remove: str = "documents") -> DataFrame:
    """The documents without contaminated ones, or (``remove='spans'``) with their hit spans cut out.

    A document is contaminated if a twentieth of its words or more is hit.  All
    columns and all other documents are kept as they are.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(remove)
    spark = docs.sparkSession
    small_batches(spark)

    def cleaner(shared):
        def run(rows):
            for batch, found in _scan_batches(shared.value, rows, []):
                bad = [contaminated(n, spans) for n, spans, _ in found]
                if remove == "documents":
                    yield batch.filter(pa.array([not b for b in bad], pa.bool_()))
                    continue
                at = batch.schema.get_field_index("text")
                texts = [_without(t, f[1]) if b else t and t.decode() for t, f, b in zip(texts_of(batch.column(at)), found, bad)]
                yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

        return run

    sized, slices = _slices(items)
    if slices == 1:
        return docs.mapInArrow(cleaner(_gram_set(sized, 1, 0, window)), docs.schema)
    # the share counts hits of all sets together; each row is judged by its own id and text
    found, _ = _hits(docs, items, window)
    bad = digest(found.withColumn("doc_id", F.struct("doc_id", "_row", "spans"))).where("contaminated").select("doc_id.*").alias("b")
    key, cut = free_names(docs, "_key", "_cut")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text")).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col(f"d.{key}") == F.col("b._row"))
    if remove == "documents":
        return keyed.join(bad, same, "left_anti").drop(key)

    def cutter(rows):
        for batch in rows:
            at, spans = batch.schema.get_field_index("text"), batch.column(batch.num_columns - 1).to_pylist()
            texts = [_without(t, s) if s else t and t.decode() for t, s in zip(texts_of(batch.column(at)), spans)]
            kept = batch.select(batch.schema.names[:-1])
            yield kept.set_column(at, kept.schema.field(at), pa.array(texts, kept.schema.field(at).type))

    marked = keyed.join(bad, same, "left").select(*[F.col(f"d.`{c}`") for c in docs.columns], F.col("b.spans").alias(cut))
    return marked.mapInArrow(cutter, docs.schema)


def sha256_of(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
