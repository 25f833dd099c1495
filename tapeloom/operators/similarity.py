"""Similarity graph of vectors by banded random-hyperplane signatures.

A random hyperplane parts two vectors at an angle a with probability a / pi.  A band of
b hyperplanes puts vectors at the threshold into one bucket with probability
p = (1 - a/pi)^b, and ceil(log(1 - recall) / log(1 - p)) bands find a pair with the
wanted recall.  b grows with the logarithm of a group's size, so that buckets of
unlike vectors hold a fixed number.  Buckets that are larger all the same are banded
again, by hyperplanes of their own and by their own size.  Equal vectors are one node.
A recall of 1 compares all pairs instead.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

BUCKET = 64  # unlike vectors that a bucket should hold
BITS = 24  # most hyperplanes of a band
BLOCK = 512  # vectors of a block that meets all blocks of its batch
BLOCK_FILES = 16  # files of blocks, at least
FILE_BLOCKS = 16  # blocks of a file
PAIR_BYTES = 16 << 20  # of pairs of blocks that a worker is sent at a time
STRIP = 128  # vectors of a block that are compared at a time


def bands_for(bits: int, threshold: float, recall: float) -> int:
    """Bands of so many hyperplanes that find a pair at the threshold with probability ``recall``."""
    together = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** bits
    return 1 if together >= recall else math.ceil(math.log1p(-recall) / math.log1p(-together))


def _bits(size: Column) -> Column:
    return F.least(F.greatest(F.ceil(F.log2(size / F.lit(float(BUCKET)))), F.lit(0)), F.lit(BITS)).cast("int")


def _signed(nodes: DataFrame, bands: Column, bits: Column, seed: int) -> DataFrame:
    """One row for each band of a node: ``band`` and ``sig``, the sides of its first ``bits`` hyperplanes.

    The hyperplanes of band k come from a generator seeded by k, so no task holds more
    of them than one band's.
    """
    rows = nodes.withColumns({"__bands": bands, "__bits": bits})

    def run(parts):
        for batch in parts:
            if not batch.num_rows:
                continue
            column = batch.column("__u")
            x = np.asarray(column.flatten()).reshape(batch.num_rows, -1)
            n, b = np.asarray(batch.column("__bands")), np.asarray(batch.column("__bits")).astype(np.int64)
            for k in range(int(n.max())):
                some = np.flatnonzero(n > k)
                width = int(b[some].max())
                if width:
                    planes = np.random.default_rng((seed, k)).normal(size=(BITS, x.shape[1]))[:width]
                    side = (x[some] @ planes.T > 0) & (np.arange(width) < b[some][:, None])
                    sig = side @ (1 << np.arange(width, dtype=np.int64))
                else:
                    sig = np.zeros(len(some), np.int64)
                pick = pa.array(some)
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pick) for c in keys], pa.array(np.full(len(some), k, np.int32)), pa.array(sig)], names=[*keys, "band", "sig"])

    keys = [c for c in nodes.columns if c != "__u"]
    schema = ", ".join([f"`{c}` {nodes.schema[c].dataType.simpleString()}" for c in keys] + ["band int", "sig bigint"])
    return rows.mapInArrow(run, schema)


def _blocks(nodes: DataFrame) -> DataFrame:
    """Nodes in blocks of about ``BLOCK``: (__batch, __lo, __blocks, __ids, __x), the vectors one behind the other."""
    sizes = nodes.groupBy("__batch").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("__blocks"))
    sized = nodes.select("__batch", "__node", "__u").join(sizes.withColumnRenamed("__batch", "__b2"), F.col("__batch").eqNullSafe(F.col("__b2"))).drop("__b2")
    placed = sized.withColumn("__lo", F.pmod(F.xxhash64("__node"), F.col("__blocks")).cast("int"))
    block = placed.groupBy("__batch", "__lo", "__blocks").agg(F.collect_list(F.struct("__node", "__u")).alias("__rows"))
    files = max(BLOCK_FILES, math.ceil(nodes.count() / (BLOCK * FILE_BLOCKS)))
    return materialize(block.select("__batch", "__lo", "__blocks", F.col("__rows.__node").alias("__ids"), F.flatten("__rows.__u").alias("__x")).repartition(files))


def _within(block: DataFrame) -> DataFrame:
    """Each block with itself."""
    return block.select("__batch", F.lit(True).alias("__same"), "__ids", "__x", F.col("__ids").alias("__ids2"), F.col("__x").alias("__x2"))


def _across(block: DataFrame) -> DataFrame:
    """Every two blocks of a batch, once.

    A task reads a part of the blocks and each other part from storage: joined by key,
    a block would be shuffled as often as there are blocks, which is the square of the input.
    """
    left = block.where("__blocks > 1").drop("__blocks")
    right = left.select(*[F.col(c).alias(f"{c}2") for c in left.columns])
    once = (F.col("__lo") < F.col("__lo2")) == ((F.col("__lo") + F.col("__lo2")) % 2 == 0)  # one of the two orders, in all parts alike
    met = left.join(right.hint("shuffle_replicate_nl"), F.col("__batch").eqNullSafe(F.col("__batch2")) & (F.col("__lo") != F.col("__lo2")) & once)
    return met.select("__batch", F.lit(False).alias("__same"), "__ids", "__x", "__ids2", "__x2")


def _similar_pairs(both: DataFrame, kind: str, threshold: float, first: bool = False) -> DataFrame:
    """Pairs of two blocks above the threshold, (__batch, __node, __to, similarity) with ids of type ``kind``; with ``first`` only some of them, if there are any.

    A task compares a strip of one block at a time, so it holds no more than two blocks and the
    pairs of a strip, however large the batch is.
    """

    def run(parts):
        for batch in parts:
            for r in range(batch.num_rows):
                name, same = batch.column("__batch").slice(r, 1), batch.column("__same")[r].as_py()
                ids, ids2 = batch.column("__ids")[r].values, batch.column("__ids2")[r].values
                x = np.asarray(batch.column("__x")[r].values).reshape(len(ids), -1)
                y = np.asarray(batch.column("__x2")[r].values).reshape(len(ids2), -1)
                for start in range(0, len(ids), STRIP):
                    cosine = x[start : start + STRIP] @ y.T
                    i, j = np.nonzero(cosine > threshold)
                    if same:  # each pair once
                        once = i + start < j
                        i, j = i[once], j[once]
                    if first:
                        i, j = i[:1], j[:1]
                    if len(i):
                        names = name.take(pa.array(np.zeros(len(i), np.int64)))
                        yield pa.RecordBatch.from_arrays([names, ids.take(pa.array(i + start)), ids2.take(pa.array(j)), pa.array(cosine[i, j])], names=["__batch", "__node", "__to", "similarity"])
                        if first:
                            break

    schema = f"__batch {both.schema['__batch'].dataType.simpleString()}, __node {kind}, __to {kind}, similarity double"
    return both.mapInArrow(run, schema)


def _all_pairs(nodes: DataFrame, threshold: float, linked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every pair of a batch above the threshold, and the batches that have one or are ``linked`` (__batch) already.

    The pairs are found as they are read and stand nowhere in between.  A batch whose
    blocks hold no pair in themselves is compared once more to know whether it has one.
    """
    conf, limit = nodes.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    conf.set(limit, str(PAIR_BYTES))  # read when the result is, so it stays lowered for the session
    block, kind = _blocks(nodes), nodes.schema["__node"].dataType.simpleString()
    some = materialize(linked.unionAll(_similar_pairs(_within(block), kind, threshold, True).select("__batch")).distinct())
    rest = materialize(block.where("__blocks > 1").join(some.withColumnRenamed("__batch", "__b2"), F.col("__batch").eqNullSafe(F.col("__b2")), "left_anti"))
    if not rest.isEmpty():
        some = materialize(some.unionAll(_similar_pairs(_across(rest), kind, threshold, True).select("__batch")).distinct())
    return _similar_pairs(_within(block).unionAll(_across(block)), kind, threshold), some


def _array_lookup(values: list[int], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), at + 1)


def _banded_pairs(nodes: DataFrame, threshold: float, recall: float) -> DataFrame:
    """Pairs of a batch that share a bucket of some band and are above the threshold: (__batch, __node, __to, similarity)."""
    counts = [bands_for(b, threshold, recall) for b in range(BITS + 1)]
    sizes = nodes.groupBy("__batch").agg(F.count(F.lit(1)).alias("__n"))
    sized = nodes.join(sizes.withColumnRenamed("__batch", "__b2"), F.col("__batch").eqNullSafe(F.col("__b2"))).drop("__b2", "__v")
    keyed = sized.select("__batch", "__node", "__u", "__n")
    first = materialize(_signed(keyed, _array_lookup(counts, _bits(F.col("__n"))), _bits(F.col("__n")), 1).drop("__n"))
    bucket = ["__batch", "band", "sig"]
    crowd = first.groupBy(*bucket).agg(F.count(F.lit(1)).alias("__m")).where("__m > 1")
    crowd = crowd.select(*[F.col(c).alias(f"{c}_") for c in bucket], "__m")
    members = first.join(crowd, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in bucket]).drop(*[f"{c}_" for c in bucket])
    hot = F.col("__m") > 4 * BUCKET
    cool = members.where(~hot).select("__batch", "__node", F.xxhash64("band", "sig").alias("__k"))
    units = nodes.select(F.col("__batch").alias("__b2"), F.col("__node").alias("__n2"), "__u")
    again = members.where(hot).withColumn("__k", F.xxhash64("band", "sig")).join(units, F.col("__batch").eqNullSafe(F.col("__b2")) & (F.col("__node") == F.col("__n2"))).select("__batch", "__node", "__k", "__m", "__u")
    finer = _signed(again, _array_lookup(counts, _bits(F.col("__m"))), _bits(F.col("__m")), 2)
    finer = finer.select("__batch", "__node", F.xxhash64("__k", "band", "sig").alias("__k"))
    meet = materialize(cool.unionByName(finer))
    right = meet.select(F.col("__batch").alias("__b2"), F.col("__k").alias("__k2"), F.col("__node").alias("__to"))
    pairs = meet.join(right, (F.col("__k") == F.col("__k2")) & F.col("__batch").eqNullSafe(F.col("__b2"))).where("__node < __to").select("__batch", "__node", "__to").distinct()
    left_u = nodes.select(F.col("__batch").alias("__b3"), F.col("__node").alias("__n3"), F.col("__u").alias("__x"))
    right_u = nodes.select(F.col("__batch").alias("__b4"), F.col("__node").alias("__n4"), F.col("__u").alias("__y"))
    scored = pairs.join(left_u, F.col("__batch").eqNullSafe(F.col("__b3")) & (F.col("__node") == F.col("__n3"))).join(right_u, F.col("__batch").eqNullSafe(F.col("__b4")) & (F.col("__to") == F.col("__n4")))
    dot = F.aggregate(F.zip_with("__x", "__y", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return scored.select("__batch", "__node", "__to", dot.alias("similarity")).where(F.col("similarity") > threshold)


def similarity_edges(vectors: DataFrame, threshold: float = 0.3, batch: str = "batch", ident: str = "vec_id", embedding: str = "embedding", recall: float = 0.95) -> DataFrame:
    """Ordered pairs of a batch whose cosine similarity exceeds the threshold: (batch, src, dst, similarity, kind).

    Batches may be of any size.  Candidates share a bucket of some band, and their exact
    cosine decides; a pair above the threshold is found with probability ``recall`` or
    more.  With a ``recall`` of 1 all pairs are compared, block by block.  Vectors of a batch that are equal are one node, that of the smallest id:
    the others hang on it by one edge each (kind ``copy``, from the copy to the node)
    and share its edges (kind ``similar``).  A batch with none of these is linked as a
    ring by id (kind ``ring``, similarity null).  Null vectors and ids take no part;
    all vectors of a table have one length.
    """
    known = vectors.where(F.col(ident).isNotNull() & F.col(embedding).isNotNull())
    named = known.select(F.col(batch).alias("__batch"), F.col(ident).alias("__id"), F.transform(embedding, lambda x: x.cast("double")).alias("__v"))
    grouped = named.groupBy("__batch", "__v").agg(F.min("__id").alias("__node"))
    norm = F.sqrt(F.aggregate("__v", F.lit(0.0), lambda a, x: a + x * x))
    nodes = materialize(grouped.select("__batch", "__v", "__node", F.transform("__v", lambda x: x / F.greatest(norm, F.lit(1e-12))).alias("__u")))
    copies = named.join(nodes.select("__batch", "__v", "__node"), (named["__batch"].eqNullSafe(nodes["__batch"])) & (named["__v"] == nodes["__v"])).where(named["__id"] != F.col("__node"))
    copies = copies.select(named["__batch"], F.col("__id").alias("src"), F.col("__node").alias("dst"), F.lit(1.0).alias("similarity"), F.lit("copy").alias("kind"))

    alike = 1.0 > threshold
    linked = copies.where(F.lit(alike)).select("__batch")
    if recall >= 1:
        near, linked = _all_pairs(nodes, threshold, linked)
    else:
        near = materialize(_banded_pairs(nodes, threshold, recall))
        linked = materialize(linked.unionAll(near.select("__batch")).distinct())
    similar = near.select("__batch", F.inline(F.array(F.struct(F.col("__node").alias("src"), F.col("__to").alias("dst")), F.struct(F.col("__to").alias("src"), F.col("__node").alias("dst")))), "similarity", F.lit("similar").alias("kind"))
    edges = similar.unionByName(copies) if alike else similar

    linked = linked.select(F.col("__batch").alias("__b2"))
    lonely = nodes.join(linked, F.col("__batch").eqNullSafe(F.col("__b2")), "left_anti").select("__batch", "__node")
    ring = _ring(lonely)
    return edges.unionByName(ring).select(F.col("__batch").alias(batch), "src", "dst", "similarity", "kind")


def _ring(nodes: DataFrame) -> DataFrame:
    """Each node linked with the next of its batch by id, the last with the first; ranges of ids are linked on their own, then their ends."""
    parts = materialize(nodes.repartitionByRange("__batch", "__node").withColumn("__p", F.spark_partition_id()))
    within = Window.partitionBy("__batch", "__p").orderBy("__node")
    step = parts.withColumn("__next", F.lead("__node").over(within))
    ends = parts.groupBy("__batch", "__p").agg(F.min("__node").alias("__first"))  # one row a range
    order = Window.partitionBy("__batch").orderBy("__p")
    after = ends.select(F.col("__batch").alias("__b2"), F.col("__p").alias("__p2"), F.coalesce(F.lead("__first").over(order), F.first("__first").over(order)).alias("__after"))
    joined = step.join(after, F.col("__batch").eqNullSafe(F.col("__b2")) & (F.col("__p") == F.col("__p2")))
    return joined.select("__batch", F.col("__node").alias("src"), F.coalesce("__next", "__after").alias("dst"), F.lit(None).cast("double").alias("similarity"), F.lit("ring").alias("kind"))
