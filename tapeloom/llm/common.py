"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.session import materialize

#: Rows that travel to Python at once; texts can be long, so far fewer than Spark's 10,000.
BATCH_ROWS = 500
BATCH_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Lower the rows and bytes per Arrow batch, so that a batch of long texts fits a worker.

    The settings are read when a query runs, after the operator has returned, so they stay
    lowered for the session.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes for no column of ``df`` to have it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves remainder 2 of 4; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def teaches(doc_id: Column) -> Column:
    """True for ids that a model may learn from: known and not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 != 2, F.lit(False))


def texts_of(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    return column.cast(pa.large_binary()).to_pylist()


def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b for b in rows if b.num_rows)


def numbered(df: DataFrame, by: str, name: str) -> DataFrame:
    """Add the row's place (from 0) in the order of ``by``, nulls last; ``by`` must be unique.

    Rows are dealt by ranges of ``by``; a row's place is its place in its range
    plus the rows of earlier ranges, so that no task sorts the whole table.  The
    dealt table is written first: range bounds are drawn from a sample and a
    second computation could draw others.
    """
    order = F.col(by).asc_nulls_last()
    parts = materialize(df.repartitionByRange(order).withColumn("_range", F.spark_partition_id()))
    counts = parts.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # one row for each range
    offset = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    inside = parts.withColumn("_at", F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1)
    return inside.join(F.broadcast(offset), "_range").withColumn(name, F.col("_before") + F.col("_at")).drop("_range", "_before", "_at")


_CACHE = 200_000  # words whose hash a task remembers at once


class WordHashes:
    """64-bit hashes of words; each distinct word is hashed once until the cache is full."""

    def __init__(self):
        self.place: dict[bytes, int] = {}
        self.known = np.zeros(_CACHE, np.uint64)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        place = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        out = self.known[place]
        for i in np.flatnonzero(place < 0).tolist():
            w = words[i]
            out[i] = xxhash.xxh3_64_intdigest(w)
            if w not in self.place:
                if len(self.place) >= _CACHE:
                    self.place.clear()
                k = self.place[w] = len(self.place)
                self.known[k] = out[i]
        return out


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))
