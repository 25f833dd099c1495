"""N-gram Jaccard join by PartEnum signatures, and its connected components.

Two sets with Jaccard similarity of s or more and sizes a and b differ in at most
(a + b)(1 - s)/(1 + s) elements.  For each band of sizes that bound is some k: the
domain is dealt by hash into n1 parts, at least one of which holds at most
k2 = ceil((k + 1)/n1) - 1 of the differing elements; dealt again into n2 pieces, that
part agrees in n2 - k2 of its pieces.  Every part and every choice of n2 - k2 pieces
gives a signature of what the set has there, so similar sets share one.  Below
``PERCENT`` that takes too many signatures or leaves most of them empty, hence equal
for unlike sets.  There, e parts more are dealt, so that e + 1 parts hold at most k2 of
the differing elements and at least e + 1 signatures agree; each set leaves out the e
signatures that cover least.  Signatures that agree cover as much in both sets and so
have the same order; the last of them has e before it and is left out by neither.
As these are many, only sets that can be similar to another make them: in the order of
a hash, the first elements of two similar sets agree in some (see ``prefix``), so a set
whose first elements stand too seldom in another is alone.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.session import materialize, steps

from .common import WordHashes, batches, free_names, mixed, small_batches, texts_of
from .graph import components

SHINGLE = 3
PERCENT = 90
WIDTH = 1.25  # sizes of a band reach so far
ELEMENTS = 7.0  # a signature should cover so many elements
BROADCAST_ROWS = 1_000_000
SHARED_PART = 16  # one in so many elements of similar sets has to be among the first of both
BLOCK_SETS = 512  # members of a group that are compared at once
BLOCK_ELEMENTS = 1 << 16  # in which they may differ from its central set
REACH = 1.01  # sizes of a class of members reach further than those of similar sets by so much
MEMBER = ("a", "c", "n", "v", "d", "seeks")
SHORT = (1 << 40) - 1  # names in the filter: two that are equal by chance let a set more pass, never one less


@dataclass(frozen=True)
class Band:
    """Signature plan for pairs whose larger set has a size up to ``top`` and above the band before."""

    number: int
    low: int  # the smallest partner
    top: int
    parts: int
    pieces: int
    choices: tuple[tuple[int, ...], ...]
    spare: int = 0  # so many signatures, those that cover the fewest elements, are left out


@lru_cache(100_000)
def _top(number: int) -> int:
    if number == 0:
        return 1
    before = _top(number - 1)
    return max(before + 1, int(before * WIDTH))


@lru_cache(100_000)
def band(number: int, percent: int = PERCENT) -> Band:
    before, top = (_top(number - 1) if number else 0), _top(number)
    k = 2 * top * (100 - percent) // (100 + percent)
    low = -(-(before + 1) * percent // 100)
    if percent < PERCENT:  # one differing element in a part of three pieces, any two of which are chosen
        parts = k // 2 + 1
        spare = parts // 8
        return Band(number, low, top, parts + spare, 3, tuple(combinations(range(3), 2)), spare)
    plans = []
    for k2 in range(4):
        n1 = -(-(k + 1) // (k2 + 1))
        held = -(-(k + 1) // n1) - 1
        for n2 in range(held + 1, held + 4):
            plans.append((n1 * comb(n2, held), low * (n2 - held) / (n1 * n2), n1, n2, held))
    enough = [p for p in plans if p[1] >= ELEMENTS]
    few = [p for p in plans if p[0] <= 3 * (k + 1)]
    _, _, n1, n2, held = min(enough) if enough else max(few, key=lambda p: (p[1], -p[0]))
    return Band(number, low, top, n1, n2, tuple(combinations(range(n2), n2 - held)))


def bands_of(size: int, percent: int = PERCENT) -> list[Band]:
    """The bands in which a set of that size can be the larger or the smaller one of a pair."""
    if size == 0:
        return []
    number = 0 if size == 1 else max(0, int(np.log(size) / np.log(WIDTH)) - 40)
    while _top(number) < size:
        number += 1
    out = [band(number, percent)]
    while (_top(number) + 1) * percent <= 100 * size:
        number += 1
        out.append(band(number, percent))
    return out


def shingles(words: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of n-word windows; fewer words are one window, no words none."""
    m = len(words)
    if not m:
        return words
    size = min(n, m)
    out = np.full(m - size + 1, size, np.uint64)
    for k in range(size):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + words[k : m - size + 1 + k])
    return np.unique(out)


def signatures(elements: np.ndarray, salt: int = 0, percent: int = PERCENT) -> np.ndarray:
    """Hashes that are equal only where the band, the choice of pieces and the elements in them are."""
    out = []
    spread = mixed(elements + np.uint64(0x51ED270B + salt))
    for b in bands_of(len(elements), percent):
        cells = b.parts * b.pieces
        at = ((spread >> np.uint64(20)) % np.uint64(cells)).astype(np.int64)
        sums = np.zeros(cells, np.uint64)
        np.add.at(sums, at, spread)
        table = sums.reshape(b.parts, b.pieces)
        name = np.arange(b.parts, dtype=np.uint64) * np.uint64(1009) + np.uint64(b.number << 40)
        own = []
        for c, choice in enumerate(b.choices):
            h = name + np.uint64(c)
            for piece in choice:
                h = mixed(h + table[:, piece])
            own.append(h)
        own = np.concatenate(own)
        if b.spare:
            held = np.bincount(at, minlength=cells).reshape(b.parts, b.pieces)
            covered = np.concatenate([held[:, choice].sum(1) for choice in b.choices])
            own = own[np.argsort(covered, kind="stable")[b.spare :]]
        out.append(own)
    # 48 bits: shuffled in three quarters of the room, and still few chance meetings among 10^13 signatures
    return (np.concatenate(out) >> np.uint64(16)).view(np.int64) if out else np.zeros(0, np.int64)


def _shared_by(size: int) -> int:
    return max(1, size // SHARED_PART)


def prefix(elements: np.ndarray, percent: int) -> np.ndarray:
    """The elements that come first in the order of a hash, shortened: as many as sets may differ in, and some.

    Similar sets share t elements or more, with t = ceil(percent / 100 * n) for either size n.
    A set lists its first n - t + l elements, hence the first l of the shared ones.  For a
    partner l is that of a size of t or more, so both list at least as many as that is
    (``_required``).
    """
    n = len(elements)
    if not n:
        return np.zeros(0, np.int64)
    m = n + n * -percent // 100 + _shared_by(n)
    spread = mixed(elements + np.uint64(0x2C1B3C6D))
    if m < n:
        spread = np.partition(spread, m - 1)[:m]
    return (spread >> np.uint64(24)).view(np.int64)


def _required(size: Column, percent: int) -> Column:
    """So many elements of a set's prefix are in that of a similar set."""
    return F.greatest(F.lit(1), F.floor(F.ceil(size * percent / 100) / SHARED_PART))


def _set(hashes: WordHashes, text: bytes | None, n: int) -> np.ndarray:
    words = (text or b"").lower().split()  # of bytes: A-Z only, ASCII white space only
    return shingles(hashes(words), n)


def _signed(elements: np.ndarray, percent: int) -> np.ndarray:
    return signatures(elements, 0, percent)


def _features(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(doc_id, _key, a, b, n_shingles, sigs); 128 bits name a set.  A task gives the signatures of equal sets once.

    Below ``PERCENT`` ``first``, the prefix, stands in the place of ``sigs``.
    """
    name, hashed = ("first", prefix) if percent < PERCENT else ("sigs", _signed)
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in ("_key", "a", "b", "n_shingles")], T.StructField(name, T.ArrayType(T.LongType()))])

    def run(parts):
        hashes, seen = WordHashes(), set()
        for batch in batches(parts):
            a, b, size, sigs = [], [], [], []
            for text in texts_of(batch.column("text")):
                own = _set(hashes, text, n)
                digest = xxhash.xxh3_128_intdigest(own.tobytes())
                a.append((digest & (2**64 - 1)) - 2**63)
                b.append((digest >> 64) - 2**63)
                size.append(len(own))
                fresh = a[-1] not in seen
                seen.add(a[-1])
                sigs.append(hashed(own, percent) if fresh else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_key"), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(size, pa.int64()), pa.array(sigs, pa.list_(pa.int64()))], names=schema.names)

    return docs.select("doc_id", _key().alias("_key"), "text").mapInArrow(run, schema)


def _key():
    return F.xxhash64("doc_id", "text")


def _sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(a, elements) for the sets ``wanted`` (a, _key)."""

    def run(parts):
        hashes = WordHashes()
        for batch in batches(parts):
            own = [_set(hashes, t, n).view(np.int64) for t in texts_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("a"), pa.array(own, pa.list_(pa.int64()))], names=["a", "elements"])

    known = wanted.count()
    if known <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)  # two numbers a row; larger ones are joined by key
    texts = docs.select(_key().alias("_key"), "text").join(wanted, "_key").select("a", "text")
    sets = materialize(texts.mapInArrow(run, "a bigint, elements array<bigint>"))
    # repeated rows of one document give its set again; without them the sets need no shuffle
    return sets if sets.count() == known else materialize(sets.dropDuplicates(["a"]))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) whose sets are similar enough."""
    left = sets.select(F.col("a").alias("u"), F.col("elements").alias("x"))
    right = sets.select(F.col("a").alias("v"), F.col("elements").alias("y"))
    sized = pairs.join(left, "u").join(right, "v").withColumn("c", F.size(F.array_intersect("x", "y")))
    return sized.where(F.col("c") * 100 >= (F.size("x") + F.size("y") - F.col("c")) * percent).select("u", "v")


def _fits(x: str, y: str, percent: int) -> Column:
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


def _size_class(n: Column) -> Column:
    return F.floor(F.log2(n) * 64).cast("int")  # steps of about one percent


def _open(members: DataFrame) -> DataFrame:
    """Members of signatures that hold more than one component, with what stands in the signature.

    ``top`` is the most central member, ``classes`` are those of the members' sizes.
    """
    crowd = members.groupBy("sig").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.max(F.struct("score", "a", "n", "c")).alias("top"), F.collect_set(_size_class(F.col("n"))).alias("classes"))
    return members.join(crowd.where("lo <> hi").drop("lo", "hi"), "sig")


def _promising(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Open members that may still have a link to another component, with ``v``, their elements that another component has.

    A partner shares no other elements, so v bounds the intersection: sets with too
    small a v have no link outside their component, and neither have those for whom
    no member of their signature is small enough.
    """
    open_ = materialize(_open(members).drop("top", "classes"))
    nodes = open_.select("a", "c", "n").distinct()
    elements = sets.join(nodes, "a").select("a", "c", F.explode("elements").alias("x"))
    common = elements.groupBy("x").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("x")
    shared = elements.join(common, "x", "left_semi").groupBy("a").agg(F.count(F.lit(1)).alias("v"))
    kept = _open(open_.join(shared, "a").where(F.col("v") * 100 >= F.col("n") * percent))
    in_reach = F.exists("classes", lambda k: (k >= F.col("low")) & (k <= F.col("high")))
    return materialize(_open(kept.select("*", *_reach(percent)).where(in_reach).drop("low", "high", "top", "classes")).drop("classes"))


def _reach(percent: int) -> list[Column]:
    """Classes of the sizes that a partner can have."""
    smallest = F.ceil(F.col("n") * percent / 100)
    largest = F.floor((F.col("v") * (100 + percent) - F.col("n") * percent) / percent)
    return [_size_class(smallest).alias("low"), _size_class(F.greatest(largest, F.lit(1))).alias("high")]


def _by_difference(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) between members of one signature that are in different components.

    All members are held against the signature's most central set o by what differs:
    the Hamming distance of two sets is that of their differences from o.  Those near
    enough to o are linked with it; any other link has an end s that is not, a seeker.
    """
    far, near = F.lit(100 + percent), F.lit(100 - percent)
    pairs = left.select(F.col("top.a").alias("o"), F.col("top.c").alias("oc"), F.col("top.n").alias("on"), "a", "c", "n", "v").where("a <> o").distinct()
    x, y = sets.select("a", F.col("elements").alias("x")), sets.select(F.col("a").alias("o"), F.col("elements").alias("y"))
    apart = F.array_union(F.array_except("x", "y"), F.array_except("y", "x"))
    close = F.col("d") * far <= (F.col("n") + F.col("on")) * near
    held = materialize(pairs.join(x, "a").join(y, "o").withColumn("apart", apart).drop("x", "y").withColumn("d", F.size("apart")).withColumn("seeks", (F.col("c") != F.col("oc")) & ~close))
    direct = held.where((F.col("c") != F.col("oc")) & close).select(F.col("a").alias("u"), F.col("o").alias("v"))
    return direct.unionAll(_sought(held, percent)).distinct()


def _blocks(held: DataFrame, percent: int) -> DataFrame:
    """One row for each block of a group's members: (o, reach, block, blocks) and lists of what they have.

    ``reach`` is the class of a member's size: sizes of similar sets are in one class or in
    two that are next to each other.  A class is dealt by hash into blocks of bounded sets
    and elements.
    """
    reach = F.floor(F.log(F.col("n")) / math.log(REACH * 100 / percent)).cast("int")
    classed = held.withColumn("reach", reach)
    room = F.greatest(F.count(F.lit(1)) / F.lit(BLOCK_SETS), F.sum("d") / F.lit(BLOCK_ELEMENTS))
    dealt = classed.join(classed.groupBy("o", "reach").agg(F.ceil(room).cast("int").alias("blocks")), ["o", "reach"])
    rows = F.collect_list(F.struct(*MEMBER, "apart")).alias("rows")  # at most what a block holds
    block = dealt.groupBy("o", "reach", "blocks", F.pmod(F.xxhash64("a"), "blocks").alias("block")).agg(rows)
    return materialize(block.select("o", "reach", "block", "blocks", *[F.col(f"rows.{c}").alias(c) for c in MEMBER], F.flatten("rows.apart").alias("apart")))


def _sought(held: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) of a seeker with any member of its group in another component, by the distance of their differences.

    Sets that are alike but not enough make as many pairs as the square of a group.  So
    blocks of seekers meet blocks of members, and no pair is a row: a worker counts what
    two blocks have in common and returns the links.
    """
    members = _blocks(held.join(held.where("seeks").select("o").distinct(), "o", "left_semi"), percent)
    seekers = _blocks(held.where("seeks"), percent).drop("blocks")
    classes = members.groupBy("o", F.col("reach").alias("preach")).agg(F.max("blocks").alias("pblocks"))
    near_classes = F.explode(F.array(*[F.col("reach") + k for k in (-1, 0, 1)])).alias("preach")
    pairs = seekers.select("o", "reach", "block", near_classes).join(classes, ["o", "preach"]).withColumn("pblock", F.explode(F.sequence(F.lit(0), F.col("pblocks") - 1))).drop("pblocks")
    other = members.select("o", F.col("reach").alias("preach"), F.col("block").alias("pblock"), *[F.col(c).alias(f"p{c}") for c in (*MEMBER, "apart")])
    met = pairs.join(seekers, ["o", "reach", "block"]).join(other, ["o", "preach", "pblock"]).select(*MEMBER, "apart", *[f"p{c}" for c in (*MEMBER, "apart")])

    def run(parts):
        for batch in batches(parts):
            for r in range(batch.num_rows):
                mine, theirs = ({c: batch.column(p + c)[r].values.to_numpy(zero_copy_only=False) for c in (*MEMBER, "apart")} for p in ("", "p"))
                i, j = similar(mine, theirs, percent)
                yield pa.RecordBatch.from_arrays([pa.array(mine["a"][i]), pa.array(theirs["a"][j])], names=["u", "v"])

    return met.mapInArrow(run, "u bigint, v bigint")


def similar(mine: dict[str, np.ndarray], theirs: dict[str, np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the pairs of a block of seekers and one of members that are linked, two seekers once."""
    far, near = 100 + percent, 100 - percent
    values, codes = np.unique(np.concatenate([mine["apart"], theirs["apart"]]), return_inverse=True)
    own, others = codes[: len(mine["apart"])], codes[len(mine["apart"]) :]
    starts = np.concatenate([[0], np.cumsum(mine["d"])])
    ends = np.concatenate([[0], np.cumsum(theirs["d"])])
    marked, found = np.zeros(len(values), bool), []
    for k in range(len(mine["a"])):
        a, c, n, v, d = (mine[x][k] for x in ("a", "c", "n", "v", "d"))
        sizes = n + theirs["n"]
        # v bounds what a set has in common with any other component
        may = (theirs["c"] != c) & (~theirs["seeks"] | (a < theirs["a"])) & (np.abs(d - theirs["d"]) * far <= sizes * near) & (sizes * percent <= np.minimum(v, theirs["v"]) * far)
        if may.any():
            marked[own[starts[k] : starts[k + 1]]] = True
            common = np.diff(np.concatenate([[0], np.cumsum(marked[others])])[ends])
            marked[own[starts[k] : starts[k + 1]]] = False
            good = np.flatnonzero(may & ((d + theirs["d"] - 2 * common) * far <= sizes * near))
            found.append((np.full(len(good), k), good))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def _repeated(rows: DataFrame, name: str) -> DataFrame:
    """The rows whose ``name`` stands more than once; most stand once and go no further than one count."""
    shared = rows.groupBy(name).agg(F.count(F.lit(1)).alias("m")).where("m > 1").select(name)
    return rows.join(shared, name, "left_semi")


def _members(feats: DataFrame) -> DataFrame:
    """(sig, a) of the signatures that stand more than once."""
    return _repeated(feats.where("sigs is not null").select(F.explode("sigs").alias("sig"), "a"), "sig").distinct()


def _candidates(feats: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, _key) of the sets whose prefix shares enough elements with others."""
    short = F.col("a").bitwiseAND(F.lit(SHORT)).alias("short")
    found = _repeated(feats.where("first is not null").select(F.explode("first").alias("x"), short), "x").groupBy("short").agg(F.count(F.lit(1)).alias("shared"))
    enough = nodes.select("a", "n", "_key", short).join(found, "short").where(F.col("shared") >= _required(F.col("n"), percent))
    return enough.groupBy("a").agg(F.min("_key").alias("_key"))


def _signatures(sets: DataFrame, percent: int) -> DataFrame:
    """(a, sigs) of (a, elements)."""

    def run(parts):
        for batch in batches(parts):
            column = batch.column("elements")
            ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
            sigs = [signatures(own.view(np.uint64), 0, percent) for own in np.split(column.flatten().to_numpy(zero_copy_only=False), ends[:-1])]
            yield pa.RecordBatch.from_arrays([batch.column("a"), pa.array(sigs, pa.list_(pa.int64()))], names=["a", "sigs"])

    return sets.mapInArrow(run, "a bigint, sigs array<bigint>")


def _links(docs: DataFrame, members: DataFrame, nodes: DataFrame, n: int, percent: int, sets: DataFrame | None = None) -> DataFrame:
    """(node, component) of the sets that are linked with another.

    First every set is compared with the most central set that it shares a signature
    with.  Then, where the members of a signature are in different components, those
    that cannot have a link outside their own are left out.  Links among the rest are
    found by how they differ from their signature's most central set.
    """
    score = members.groupBy("sig").agg(F.count(F.lit(1)).alias("m")).join(members, "sig").groupBy("a").agg(F.sum("m").alias("score"))
    known = materialize(score.join(nodes.groupBy("a").agg(F.first("n").alias("n"), F.min("_key").alias("_key")), "a"))
    sets = _sets(docs, known.select("a", "_key"), n) if sets is None else sets
    members = members.join(known.drop("_key"), "a").select("sig", "a", "n", "score")
    top = F.max(F.struct("score", "a", "n")).alias("top")
    best = members.join(members.groupBy("sig").agg(top), "sig").where((F.col("top.a") != F.col("a")) & _fits("n", "top.n", percent)).groupBy("a").agg(F.max("top").alias("top"))
    links = materialize(_verified(best.select(F.col("a").alias("u"), F.col("top.a").alias("v")), sets, percent))
    found = materialize(components(links))
    labelled = members.join(found.withColumnRenamed("node", "a"), "a", "left").withColumn("c", F.coalesce("component", "a")).drop("component")
    left = _promising(labelled, sets, percent)
    if left.isEmpty():
        return found
    return components(materialize(links.unionAll(_by_difference(left, sets, percent))))


def classes(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per document ``doc_id``, ``n_shingles``, ``component_id``, ``set_id`` and ``component`` (a set's number for the component).

    A document's set are its distinct windows of ``shingle`` words (A-Z lower-cased,
    words between ASCII white space), or all words where there are fewer.  Sets with
    100 * intersection >= percent * union are linked; the component is the smallest
    doc_id that links reach (null ids count only where there are no others).  Null
    and empty texts have no set and are alone.  Repeated rows are kept; other columns
    are not read.  Equal sets are one node and never meet as pairs; all links between
    different sets are found.
    """
    small_batches(docs.sparkSession)
    with steps(docs.sparkSession) as kept:
        kept.append(materialize(_classes(docs, shingle, percent)))
    return kept[0]


def _classes(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    sets = None
    with steps(docs.sparkSession) as kept:  # the signatures or prefixes of all sets, most of the disk, go as soon as the shared ones are known
        feats = materialize(_features(docs, shingle, percent))
        nodes = materialize(feats.where("n_shingles > 0").groupBy("a", "b").agg(F.min("doc_id").alias("least"), F.max("n_shingles").alias("n"), F.min("_key").alias("_key")))
        kept += [materialize(feats.drop("sigs", "first")), nodes]
        if percent < PERCENT:
            sets = _sets(docs, materialize(_candidates(feats, nodes, percent)), shingle)
            feats = materialize(_signatures(sets, percent))
            kept.append(sets)
        members = materialize(_members(feats))
        kept.append(members)
    feats = kept[0]
    found = _links(docs, members, nodes, shingle, percent, sets)
    placed = nodes.join(found.withColumnRenamed("node", "a"), "a", "left").select("a", "b", "least", F.coalesce("component", "a").alias("component"))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = placed.join(least, "component").select(F.col("a").alias("_a"), F.col("b").alias("_b"), "component_id", "component")
    joined = feats.join(named, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left")
    return joined.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.col("a").alias("set_id"), "component", "_key")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The documents with one of each component, in their columns.

    The row of the smallest doc_id stays; of several rows with that id the one with
    the smallest hash.  Texts without words all stay.
    """
    found = classes(docs, shingle, percent).where("n_shingles > 0 and doc_id <=> component_id")
    (key,) = free_names(docs, "_kept_key")
    stay = materialize(found.groupBy("component").agg(F.min("_key").alias(key)).select(key).distinct())
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.where(worded).select(*columns, _key().alias(key))
    one = keyed.join(stay, key, "left_semi").dropDuplicates([key])
    return one.select(*columns).unionAll(docs.where(~worded).select(*columns))
