"""Hard-negative mining by rotated one-bit codes.

Vectors are rotated by signed Hadamard transforms and stored with their signs (one bit
a dimension), the length of their part along that sign vector (the alignment) and the
length of the rest.  With o = align * s + r and r at right angles to the unit sign
vector s, <q, o> = align * <q, s> + <q, r>, where <q, s> comes from popcounts over
bit planes of q and Cauchy-Schwarz bounds |<q, r>| by |r| * sqrt(|q|^2 - <q, s>^2).
In few dimensions one such code leaves about 0.6 of a vector's length in r, too much
to rule anything out, so r is rotated and coded again, ``LEVELS`` times.
Pairs whose interval misses what is still wanted are left; the others are scored on
integers.  The bound is deterministic, so results are exact.

Anchors meet all rows in blocks: a block of anchors of bounded size is broadcast and
the stored codes are scanned where they lie; each task keeps the best few rows of an
anchor, so only those are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.session import materialize, work_dir

from .common import batches, table

SCALE = 256
BLOCK_CELLS = 1 << 21  # components of the anchors that are broadcast at once
PAIRS = 1 << 15  # anchor-row pairs whose intervals are computed at once, in cache
SCORED = 1 << 15  # survivors that are scored at once
LEVELS = 4  # codes of a vector, each of what the one before leaves
PLANES = 6  # bits of an anchor's component in the estimates
NO_ID = np.iinfo(np.int64).max  # stands for a null id, last among ties
LEAST, MOST = -(2**63) + 1, 2**63 - 1

CODES = "vec_id bigint, label bigint, comps binary, code binary, align binary, rest double"


def rotate(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Rows, padded with zeros to a power of two from 64, after three rounds of random signs and a Hadamard transform."""
    d = max(64, 1 << max(0, x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), d))
    y[:, : x.shape[1]] = x
    rng = np.random.default_rng(seed)
    for _ in range(3):
        y *= rng.choice([-1.0, 1.0], d)
        h = 1
        while h < d:
            z = y.reshape(len(x), d // (2 * h), 2, h)
            y = np.stack([z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]], 2).reshape(len(x), d)
            h *= 2
        y /= np.sqrt(d)
    return y


def _bits(on: np.ndarray) -> np.ndarray:
    """Booleans of each row, packed into 64-bit words."""
    return np.ascontiguousarray(np.packbits(on, axis=-1, bitorder="little")).view(np.uint64)


def encode_rows(comps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code words, alignments, length of the rest) of each row; words of a level stand together."""
    y, codes, aligns = comps, [], []
    for level in range(LEVELS):
        y = rotate(y, level)
        on = y > 0
        align = np.where(on, y, -y).sum(1) / np.sqrt(y.shape[1])
        y = y - np.where(on, 1.0, -1.0) * (align / np.sqrt(y.shape[1]))[:, None]
        codes.append(_bits(on))
        aligns.append(align)
    return np.concatenate(codes, 1), np.stack(aligns, 1), np.sqrt((y * y).sum(1))


def encode(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """The stored codes of ``vectors`` (vec_id, label, embedding): floor(scale * x) of each component, signs, alignment and rest.

    Rows with a null label or vector, or with a null or non-finite component, take no
    part.  Shorter vectors count as padded with zeros.
    """
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    used = vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.col("embedding").cast("array<double>").alias("embedding")).where(finite)
    width = used.agg(F.max(F.size("embedding"))).first()[0] or 0

    def run(parts):
        for b in batches(parts):
            column = b.column("embedding")
            n = np.asarray(column.value_lengths())
            comps = np.zeros((len(n), width))
            comps[np.arange(width) < n[:, None]] = np.asarray(column.flatten())
            comps = np.floor(scale * comps)
            code, align, rest = encode_rows(comps)
            yield pa.RecordBatch.from_arrays([
                b.column("vec_id"), b.column("label"), pa.array([r.tobytes() for r in comps], pa.binary()), pa.array([r.tobytes() for r in code], pa.binary()), pa.array([r.tobytes() for r in align], pa.binary()), pa.array(rest),
            ], names=["vec_id", "label", "comps", "code", "align", "rest"])

    return used.mapInArrow(run, CODES)


def scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Integer inner products of paired rows; beyond 64 bits they count as the largest or smallest number."""
    peak = (np.abs(left).max(initial=0.0), np.abs(right).max(initial=0.0))
    if peak[0] * peak[1] * max(1, left.shape[1]) < 2**53:  # every sum is a whole number that a double holds
        return np.einsum("ij,ij->i", left, right).astype(np.int64)
    exact = [sum(int(x) * int(y) for x, y in zip(a, b)) for a, b in zip(left.tolist(), right.tolist())]
    return np.array([min(max(s, LEAST), MOST) for s in exact], np.int64)


def best(place: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the first k entries of each place by falling score, then id; in order of the places."""
    order = np.lexsort((ids, -score, place))
    p = place[order]
    return order[np.arange(len(p)) - np.searchsorted(p, p) < k]


@dataclass
class Anchors:
    """A block of anchors, with their bit planes."""

    ids: np.ndarray
    labels: np.ndarray
    comps: np.ndarray

    def __post_init__(self):
        q, self.levels = self.comps, []
        for level in range(LEVELS):
            q = rotate(q, level)
            low = q.min(1)
            step = np.maximum((q.max(1) - low) / (2**PLANES - 1), 1e-300)
            u = np.clip(np.rint((q - low[:, None]) / step[:, None]), 0, 2**PLANES - 1).astype(np.int64)
            error = np.abs(q - low[:, None] - step[:, None] * u).sum(1)
            self.levels.append((low[:, None], step[:, None], u.sum(1)[:, None], error[:, None], [_bits((u >> j) & 1 == 1) for j in range(PLANES)]))
        self.dims = q.shape[1]
        self.norm2 = (q * q).sum(1)

    def interval(self, a: slice, code: np.ndarray, align: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the scores of anchors ``a`` with rows."""
        words, root = self.dims // 64, np.sqrt(self.dims)
        # half a score and a billionth of the lengths stand for rounding
        slack = 1e-9 * np.sqrt(self.norm2[a])[:, None] * (np.abs(align).sum(1) + rest) + 0.5
        middle, both, ones_in = np.zeros_like(slack), np.empty(slack.shape, np.uint64), np.empty(slack.shape, np.uint8)
        for level, (low, step, total, error, planes) in enumerate(self.levels):
            own = code[:, level * words : (level + 1) * words]
            held = np.zeros(slack.shape, np.int32)  # at most dims * 2^PLANES
            for j, plane in reversed(list(enumerate(planes))):
                if j < PLANES - 1:
                    held += held
                for w in range(words):
                    np.bitwise_and(plane[a][:, None, w], own[:, w], out=both)
                    held += np.bitwise_count(both, out=ones_in)
            ones = np.bitwise_count(own).sum(1, dtype=np.int64)
            along = (low[a] * (2 * ones - self.dims) + step[a] * (2 * held - total[a])) / root
            middle += align[:, level] * along
            slack += align[:, level] * (error[a] / root)
            last = np.maximum(np.abs(along) - error[a] / root, 0)
        slack += rest * np.sqrt(np.maximum(self.norm2[a][:, None] - last**2, 0))
        return np.minimum(middle - slack, MOST), np.maximum(middle + slack, LEAST)  # as scores end there


def _rows(parts, width: int, words: int):
    """The stored rows of a task in pieces of 64, 128 and so on up to 4096 rows: early ones set the thresholds."""
    want, piece = 64, []
    for b in batches(parts):
        at = 0
        while at < b.num_rows:
            take = min(want - sum(p.num_rows for p in piece), b.num_rows - at)
            piece.append(b.slice(at, take))
            at += take
            if sum(p.num_rows for p in piece) == want:
                yield _unpacked(piece, width, words)
                want, piece = min(2 * want, 4096), []
    if piece:
        yield _unpacked(piece, width, words)


def _unpacked(piece, width, words):
    t = pa.Table.from_batches(piece)
    blob = lambda name, kind, n: np.frombuffer(b"".join(t.column(name).to_pylist()), kind).reshape(t.num_rows, n)
    ids = np.asarray(t.column("vec_id").combine_chunks().fill_null(int(NO_ID)))
    return ids, np.asarray(t.column("label")), blob("comps", np.float64, width), blob("code", np.uint64, words), blob("align", np.float64, LEVELS), np.asarray(t.column("rest"))


def _survivors(block: Anchors, rows, wanted):
    """(anchor, row, score) of pairs that ``wanted`` (anchors, their lower bounds, upper bounds, rows' labels, ids) keeps, in pieces."""
    ids, labels, comps, code, align, rest = rows
    step = max(1, PAIRS // max(1, len(ids)))
    for start in range(0, len(block.ids), step):
        a = slice(start, start + step)
        at, row = np.nonzero(wanted(a, *block.interval(a, code, align, rest), labels, ids))
        for k in range(0, len(at), SCORED):
            i, r = at[k : k + SCORED] + start, row[k : k + SCORED]
            yield i, r, scores(block.comps[i], comps[r])


def _positives(codes: DataFrame, shared, k: int, width: int, words: int) -> DataFrame:
    """(place, score, vec_id): the first k other rows of the same label of each anchor of a block, as far as a task sees."""

    def run(parts):
        block = shared.value
        place, score, ids = (np.zeros(0, np.int64) for _ in range(3))
        least = np.full(len(block.ids), LEAST)

        def wanted(a, low, high, labels, own):
            return (block.labels[a][:, None] == labels) & (block.ids[a][:, None] != own) & ~(high < least[a][:, None])

        for rows in _rows(parts, width, words):
            for i, r, s in _survivors(block, rows, wanted):
                place, score, ids = np.concatenate([place, i]), np.concatenate([score, s]), np.concatenate([ids, rows[0][r]])
                keep = best(place, score, ids, k)
                place, score, ids = place[keep], score[keep], ids[keep]
                full = np.flatnonzero(np.bincount(place, minlength=len(least)) == k)
                least[full] = score[np.searchsorted(place, full, "right") - 1]
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(score), pa.array(ids)], names=["place", "score", "vec_id"])

    return codes.mapInArrow(run, "place bigint, score bigint, vec_id bigint")


def _negatives(codes: DataFrame, shared, width: int, words: int, k: int, low_percent: int, high_percent: int) -> DataFrame:
    """(place, score, vec_id): the first k rows of another label in the window of each positive, as far as a task sees."""

    def run(parts):
        block, owner, bound = shared.value
        share = lambda p, percent: -(-int(p) * percent // 100)
        floor = np.array([share(p, low_percent) for p in bound], np.int64)
        ceiling = np.array([int(p) * high_percent // 100 for p in bound], np.int64)
        first = np.searchsorted(owner, np.arange(len(block.ids) + 1))  # the positives of anchor i start at first[i]
        most = int(np.diff(first).max(initial=0))
        place, score, ids = (np.zeros(0, np.int64) for _ in range(3))
        least = floor.copy()  # a positive's window, or its k-th best so far
        need, top = np.full(len(block.ids), MOST), np.full(len(block.ids), LEAST)
        np.maximum.at(top, owner, ceiling)

        def settle():
            need[:] = MOST
            np.minimum.at(need, owner, np.where(floor > ceiling, MOST, least))

        def wanted(a, low, high, labels, own):
            return (block.labels[a][:, None] != labels) & (need[a] < MOST)[:, None] & ~(high < need[a][:, None]) & ~(low > top[a][:, None])

        settle()
        for rows in _rows(parts, width, words):
            for i, r, s in _survivors(block, rows, wanted):
                for slot in range(most):
                    p = first[i] + slot
                    has = p < first[i + 1]
                    p = np.where(has, p, 0)
                    good = np.flatnonzero(has & (s >= least[p]) & (s <= ceiling[p]))
                    place, score, ids = np.concatenate([place, p[good]]), np.concatenate([score, s[good]]), np.concatenate([ids, rows[0][r[good]]])
                keep = best(place, score, ids, k)
                place, score, ids = place[keep], score[keep], ids[keep]
                full = np.flatnonzero(np.bincount(place, minlength=len(least)) == k)
                least[full] = score[np.searchsorted(place, full, "right") - 1]
                settle()
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(score), pa.array(ids)], names=["place", "score", "vec_id"])

    return codes.mapInArrow(run, "place bigint, score bigint, vec_id bigint")


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first k of each place over all tasks, with their ``rank`` from 1."""
    order = Window.partitionBy("place").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _block(rows) -> Anchors:
    ids = np.array([NO_ID if r["vec_id"] is None else r["vec_id"] for r in rows], np.int64)
    comps = np.frombuffer(b"".join(bytes(r["comps"]) for r in rows), np.float64).reshape(len(rows), -1)
    return Anchors(ids, np.array([r["label"] for r in rows], np.int64), comps)


def mine(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low_percent: int = 80, high_percent: int = 100, scale: int = SCALE) -> DataFrame:
    """Hard negatives for each anchor (rows of ``vectors`` where ``anchor``, over vec_id, label, embedding, holds) and each of its positives.

    Scores are inner products of floor(scale * x); higher ones come first, ties by the
    smaller id, null ids last; beyond 64 bits they count as the largest or smallest number.
    An anchor's positives are its first rows of the same
    label with another id (all, if fewer); a positive's negatives the first rows of
    another label whose score n satisfies low_percent * p <= 100 * n <= high_percent * p
    (none for p < 0).  Returns ``anchor_id``, ``positive_id``, ``rank``, ``negative_id``,
    ``positive_score`` and ``negative_score``.

    Rows with a null label, vector or component or a non-finite one take no part.
    Repeated rows are candidates each for itself; equal anchor rows are mined once.
    No rows or no anchors give no result.  Columns other than the three are not read.
    """
    spark = vectors.sparkSession
    out = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    codes = materialize(encode(vectors.select("vec_id", "label", "embedding"), scale))
    sample = codes.select("comps", "code").first()
    if sample is None:
        return spark.createDataFrame([], out)
    width, words = len(sample["comps"]) // 8, len(sample["code"]) // 8
    chosen = materialize(codes.where(anchor).select("vec_id", "label", "comps").distinct())
    blocks = -(-chosen.count() * 64 * words // LEVELS // BLOCK_CELLS)
    path = work_dir(spark) + "/found"
    null_id = lambda c: F.when(F.col(c) != int(NO_ID), F.col(c))
    spark.createDataFrame([], out).write.parquet(path)
    for k in range(blocks):
        rows = chosen.where(F.pmod(F.xxhash64("vec_id", "label", "comps"), F.lit(blocks)) == k).collect()  # about BLOCK_CELLS components
        if not rows:
            continue
        block = _block(rows)
        shared = spark.sparkContext.broadcast(block)
        known = _first(_positives(codes, shared, positives, width, words), positives).collect()  # at most ``positives`` an anchor of the block
        shared.unpersist()
        known.sort(key=lambda r: (r["place"], r["rank"]))
        owner, bound, ids = (np.array([r[c] for r in known], np.int64) for c in ("place", "score", "vec_id"))
        if not len(owner):
            continue
        more = spark.sparkContext.broadcast((block, owner, bound))
        names = spark.createDataFrame(pa.table({"place": np.arange(len(owner)), "anchor_id": block.ids[owner], "positive_id": ids, "positive_score": bound}))
        found = _first(_negatives(codes, more, width, words, negatives, low_percent, high_percent), negatives).join(F.broadcast(names), "place")  # one row a positive of the block
        found.select(null_id("anchor_id").alias("anchor_id"), null_id("positive_id").alias("positive_id"), "rank", null_id("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(path)
        more.unpersist()
    return spark.read.schema(out).parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(moved, F.col("vec_id") % 100 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS c
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, o.vec_id AS other, a.label = o.label AS same, CAST(list_inner_product(a.c, o.c) AS BIGINT) AS score
  FROM v AS a JOIN v AS o ON a.vec_id <> o.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT * FROM (SELECT anchor_id, other AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) AS k FROM s WHERE same) WHERE k <= 5
), n AS (
  SELECT anchor_id, positive_id, positive_score, other AS negative_id, score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
