"""Mixing sources to target weights: whole repetitions plus one hash-seeded draw."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.session import materialize

from .common import numbered

WORD = r"[^\x20\x09-\x0D]+"
MOST = 3  # a source is repeated at most so often
CYCLE = (1, 2, 3)  # weights of the sources in their order
SEED = "mix-1"


def size_of(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def default_weights(sources: DataFrame) -> DataFrame:
    """``weight`` 1, 2, 3, 1, ... for the sources in code point order, null last."""
    placed = numbered(sources, "source", "_place")
    return placed.withColumn("weight", F.element_at(F.array(*map(F.lit, CYCLE)), (F.col("_place") % len(CYCLE) + 1).cast("int")).cast("long")).drop("_place")


def targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """Add ``target`` and ``rate`` to a table (source, source_size, weight).

    All sizes together are shared by weight.  A target stops at ``most`` times its
    source's size and the excess is shared anew among the others: with ``level``
    words for each unit of weight the target is least(most * size, level * weight).
    Every round is one aggregate over the sources; the level only rises and each
    round stops at least one more source, so the loop ends.
    A source without words has target 0 and rate 0.
    """
    cap = F.col("source_size") * most
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = -1.0
    while True:
        below = cap <= F.lit(level) * F.col("weight")
        capped, weight = sources.agg(F.sum(F.when(below, cap).otherwise(0)), F.sum(F.when(below, 0).otherwise(F.col("weight")))).first()
        if not weight:
            break
        risen = float(total - capped) / float(weight)
        if risen <= level:
            break
        level = risen
    target = F.least(cap.cast("double"), F.lit(level) * F.col("weight"))
    out = sources.withColumn("target", F.when(F.col("source_size") > 0, target).otherwise(0.0))
    return out.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the id and the seed alone."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def plan_mix(docs: DataFrame, weights: DataFrame | None = None, most: int = MOST, seed: str = SEED) -> DataFrame:
    """One row per document with ``size``, ``source_size``, ``target``, ``copies`` and ``taken``.

    ``docs`` needs doc_id, text, source; its other columns are not kept.  ``weights``
    (source, weight) names the shares, else they are 1, 2, 3 in turn.  A document is
    taken floor(rate) times and once more where its draw is below the fraction of
    the rate, so its size counts at most ``most`` times.  Totals are summed before
    the shuffle; a hot source costs one row per task, and the small table of sources
    is joined back without moving a document.

    Null texts have size 0, a null source is a source of its own, a null id draws
    as the empty text, repeated rows draw alike.  Empty tables give empty results.
    """
    sized = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"))
    mixed = _rates(sized, weights, most)
    copies = F.floor("rate") + (draw(F.col("doc_id"), seed) < F.col("rate") - F.floor("rate")).cast("long")
    joined = sized.alias("d").join(mixed.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")), "left")
    out = joined.select("doc_id", "d.source", "size", "source_size", "target", "rate").withColumn("copies", copies.cast("long"))
    return out.withColumn("taken", F.col("size") * F.col("copies"))


def _rates(sized: DataFrame, weights: DataFrame | None, most: int) -> DataFrame:
    sources = materialize(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    if weights is None:
        sources = materialize(default_weights(sources))
    else:
        sources = sources.join(weights.select("source", F.col("weight").cast("long")), F.col("source").eqNullSafe(weights["source"]), "left").select(sources["source"], "source_size", F.coalesce("weight", F.lit(0)).alias("weight"))
    return targets(sources, most)


def mix(docs: DataFrame, weights: DataFrame | None = None, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The mixture itself: every document as often as :func:`plan_mix` takes it.

    All columns are kept and ``copy`` (from 1) numbers the copies; a column of that
    name is replaced.
    """
    names = [c for c in docs.columns if c.lower() != "copy"]
    rates = _rates(docs.select("source", size_of(F.col("text")).alias("size")), weights, most)
    rates = rates.select(F.col("source").alias("_source"), F.col("rate").alias("_rate"))
    joined = docs.join(rates, F.col("source").eqNullSafe(F.col("_source")), "left")
    copies = F.floor("_rate") + (draw(F.col("doc_id"), seed) < F.col("_rate") - F.floor("_rate")).cast("long")
    return joined.where(copies > 0).select(*[F.col(f"`{c}`") for c in names], F.explode(F.sequence(F.lit(1), copies.cast("int"))).alias("copy"))


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS weight FROM sized GROUP BY source
), ordered AS (
  SELECT *, coalesce(sum(3 * source_size) OVER earlier, 0) AS capped, sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0) AS open,
    sum(source_size) OVER () AS total, row_number() OVER (ORDER BY 3.0 * source_size / weight, source) AS place
  FROM sources WINDOW earlier AS (ORDER BY 3.0 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), levels AS (
  SELECT *, CAST(total - capped AS DOUBLE) / CAST(open AS DOUBLE) AS level FROM ordered
), chosen AS (
  SELECT arg_min(level, place) AS level FROM levels WHERE level * weight <= 3 * source_size
), rates AS (
  SELECT source, source_size, CASE WHEN source_size > 0 THEN least(CAST(3 * source_size AS DOUBLE), c.level * s.weight) ELSE 0.0 END AS target
  FROM sources s, chosen c
), drawn AS (
  SELECT d.doc_id, d.size, r.source_size, r.target, CASE WHEN r.source_size > 0 THEN r.target / r.source_size ELSE 0.0 END AS rate,
    CAST(CAST('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), '') || ':mix-1'), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS u
  FROM sized d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target, size * CAST(floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken FROM drawn
"""
