"""Exact quantiles and ranks of distributions too large for one task.

The values are first reduced to (value, count), then cut into ordered buckets at
approximate quantiles.  The cut points only balance the work: the rank of a
value is the count of all lower buckets plus its rank inside its own bucket, so
the result is exact whatever the cut points are.  No task holds more than one
bucket and the driver holds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .core import col, seeded

BUCKETS = 64
BUCKET_ROWS = 1 << 18  # rows of a group that one window ranks
MOST_CUTS = 1024


def _bucket(value: str, cuts: str, buckets: int) -> Column:
    """How many of the sorted cuts lie below the value: first among every ``step``-th, then in one stretch."""
    step = max(2, int(buckets**0.5))
    n = buckets - 1
    v = F.col(value)
    coarse = F.array(*[F.col(cuts)[i - 1] for i in range(step, n + 1, step)]) if n >= step else F.array().cast("array<double>")
    c = F.size(F.filter(coarse, lambda x: x < v))
    stretch = F.slice(F.col(cuts), c * step + 1, F.lit(step - 1))
    return c * step + F.size(F.filter(stretch, lambda x: x < v))


def value_ranks(df: DataFrame, value: str | Column, by: tuple[str, ...] = (), weight: str | None = None,
                buckets: int = BUCKETS) -> DataFrame:
    """One row per (by, distinct value): ``v, n, lo, total``.

    ``lo`` is the number of rows with a smaller value, ``n`` the rows with this
    value, ``total`` all rows of the group.
    """
    by = list(by)
    size = F.sum(weight) if weight else F.count(F.lit(1))
    vals = (
        df.select(*by, col(value).cast("double").alias("v"), *([weight] if weight else []))
        .where("v IS NOT NULL")
        .groupBy(*by, "v")
        .agg(size.alias("n"))
    )
    keys = by
    if not by:  # one group: a constant key keeps the plan an equi-join
        vals, keys = vals.withColumn("__g", F.lit(0)), ["__g"]
    cuts = [i / buckets for i in range(1, buckets)]
    bounds = vals.groupBy(*keys).agg(F.percentile_approx("v", cuts, 1000).alias("__cuts"))
    if not by:
        bounds = F.broadcast(bounds)  # a single row
    placed = vals.join(bounds, keys).withColumn("__k", _bucket("v", "__cuts", buckets)).drop("__cuts")
    per_bucket = placed.groupBy(*keys, "__k").agg(F.sum("n").alias("__kn"))
    order = Window.partitionBy(*keys).orderBy("__k")  # at most `buckets` rows per group
    per_bucket = per_bucket.select(
        *keys,
        "__k",
        (F.sum("__kn").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__kn")).alias("__below"),
        F.sum("__kn").over(Window.partitionBy(*keys)).alias("total"),
    )
    if not by:
        per_bucket = F.broadcast(per_bucket)  # at most `buckets` rows
    inside = Window.partitionBy(*keys, "__k").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    return (
        placed.withColumn("__c", F.sum("n").over(inside))
        .join(per_bucket, [*keys, "__k"])
        .select(*by, "v", "n", (F.col("__below") + F.col("__c") - F.col("n")).alias("lo"), "total")
    )


def exact_quantiles(df: DataFrame, value: str | Column, probs: list[float], by: tuple[str, ...] = (),
                    out: str = "quantiles", buckets: int = BUCKETS) -> DataFrame:
    """Linear-interpolated quantiles as one array per group, in the order of ``probs``."""
    r = value_ranks(df, value, by, buckets=buckets)
    parts = []
    for i, p in enumerate(probs):
        h = (F.col("total") - 1) * F.lit(float(p))
        k = F.floor(h)
        for j, at in enumerate((k, F.least(k + 1, F.col("total") - 1))):
            hit = (F.col("lo") <= at) & (at < F.col("lo") + F.col("n"))
            parts.append(F.max(F.when(hit, F.col("v"))).alias(f"__q{i}_{j}"))
        parts.append(F.max(h - k).alias(f"__f{i}"))
    wide = r.groupBy(*by).agg(*parts)
    arr = F.array(*[
        F.col(f"__q{i}_0") + F.col(f"__f{i}") * (F.col(f"__q{i}_1") - F.col(f"__q{i}_0")) for i in range(len(probs))
    ])
    return wide.select(*by, arr.alias(out))


def average_rank(r: DataFrame) -> Column:
    """Average rank (from 1) of a value out of :func:`value_ranks`."""
    return F.col("lo") + (F.col("n") + 1) / 2.0


def _place(df: DataFrame, value: str, keys: list[str], sizes: DataFrame) -> DataFrame:
    """Add ``__at_{value}``, how many cuts of the group lie below the value, and ``__same_{value}``, whether it is a cut.

    Cuts are approximate quantiles of the groups in ``sizes``; rows of other groups get NULL.
    """
    cuts = df.join(F.broadcast(sizes), keys).groupBy(*keys).agg(
        F.percentile_approx(value, [i / MOST_CUTS for i in range(1, MOST_CUTS)], 10 * MOST_CUTS).alias("__all"), F.first("__total").alias("__total")
    )
    step = F.greatest(F.lit(1), F.floor(F.lit(MOST_CUTS * BUCKET_ROWS) / F.col("__total")).cast("int"))
    cuts = cuts.select(*keys, F.array_distinct(F.filter("__all", lambda x, i: F.pmod(i + 1, step) == 0)).alias("__cuts"))
    cuts = cuts.withColumn("__wide", F.ceil(F.sqrt(F.size("__cuts").cast("double"))).cast("int"))
    cuts = cuts.withColumn("__coarse", F.filter("__cuts", lambda x, i: F.pmod(i + 1, F.col("__wide")) == 0))
    d = df.join(F.broadcast(cuts), keys, "left")  # fewer cuts than rows / BUCKET_ROWS
    d = d.withColumn("__low", F.size(F.filter("__coarse", lambda x: x < F.col(value))) * F.col("__wide"))
    at = F.col("__low") + F.size(F.filter(F.slice("__cuts", F.col("__low") + 1, F.col("__wide")), lambda x: x < F.col(value)))
    d = d.withColumn(f"__at_{value}", F.when(F.col("__cuts").isNotNull(), at))
    same = F.coalesce(F.get("__cuts", f"__at_{value}") == F.col(value), F.lit(False))
    return d.select(*df.columns, f"__at_{value}", same.alias(f"__same_{value}"))


def _centred_rank(df: DataFrame, value: str, keys: list[str], placed: DataFrame | None, sizes: DataFrame, out: str) -> DataFrame:
    """Add the average rank of ``value`` in its group, less the mean rank (total + 1) / 2.

    A stretch between cuts is ranked by itself and starts at the count of all below; a value
    that is a cut has the rank of its count, so rows of a hot value need not meet.
    """
    d, stretch, below = df, list(keys), F.lit(0)
    if placed is not None:
        at, same = f"__at_{value}", f"__same_{value}"
        counts = placed.where(F.col(at).isNotNull()).groupBy(*keys, at, same).agg(F.count(F.lit(1)).alias("__many"))
        # rows that equal the next cut come after the rest of the stretch
        order = Window.partitionBy(*keys).orderBy(at, same).rowsBetween(Window.unboundedPreceding, 0)
        counts = counts.withColumn("__below", F.sum("__many").over(order) - F.col("__many"))
        d = d.join(F.broadcast(sizes), keys, "left").join(F.broadcast(counts), [*keys, at, same], "left")  # two rows a stretch
        # rows at a cut take nothing from the window, so they are spread
        d = d.withColumn("__salt", F.when(F.col(same), F.pmod(F.monotonically_increasing_id(), F.lit(4096)) + 1).otherwise(0))
        stretch, below = [*keys, at, "__salt"], F.coalesce("__below", F.lit(0))
    w = Window.partitionBy(*stretch).orderBy(value)
    d = d.withColumns({
        "__place": F.rank().over(w),
        "__upto": F.count(F.lit(1)).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)),
        "__rows": F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    })
    twice, total = F.col("__place") + F.col("__upto"), F.col("__rows")
    if placed is not None:
        twice, total = F.when(F.col(same), F.col("__many") + 1).otherwise(twice), F.coalesce("__total", "__rows")
    return d.select(*df.columns, (below + (twice - total - 1) / 2.0).alias(out))


def spearman(df: DataFrame, x: str, y: str, by: tuple[str, ...] = (), out: str = "rank_ic", written: bool = False) -> DataFrame:
    """Spearman correlation with average ranks, per group; NULL for a constant side.

    A row carries both its values through the ranking, so nothing is joined back.  Sizes, cuts,
    counts and ranks read the rows, which are ``written`` first (:func:`..session.materialize`).
    Only groups of more than ``BUCKET_ROWS`` rows are cut.
    """
    by = list(by)
    keys = by or ["__g"]  # one group: a constant key
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    # the sum turns -0.0 into 0.0
    both = known.select(*(by or [F.lit(0).alias("__g")]), (F.col(x).cast("double") + 0.0).alias("__x"), (F.col(y).cast("double") + 0.0).alias("__y"))
    both = both if written else materialize(both)
    sizes = materialize(both.groupBy(*keys).agg(F.count(F.lit(1)).alias("__total")).where(F.col("__total") > BUCKET_ROWS))
    placed = None if sizes.isEmpty() else materialize(_place(_place(both, "__x", keys, sizes), "__y", keys, sizes))
    j = _centred_rank(both if placed is None else placed, "__x", keys, placed, sizes, "__rx").drop("__x", "__at___x", "__same___x")
    j = _centred_rank(j, "__y", keys, placed, sizes, "__ry")
    a, b = F.col("__rx"), F.col("__ry")
    return j.groupBy(*by).agg(
        F.try_divide(F.sum(a * b), F.sqrt(F.sum(a * a)) * F.sqrt(F.sum(b * b))).alias(out)
    )


def hash_rank(df: DataFrame, key: str, seed: int, out: str = "rank", bits: int = 12) -> DataFrame:
    """Exact position (from 0) of every row in a seeded shuffle, and the ``total``.

    The leading bits of a uniform hash are balanced ordered buckets by construction.
    """
    df = df.withColumn("__h", seeded(seed, key)).withColumn("__k", F.shiftright("__h", 60 - bits))
    counts = df.groupBy("__k").agg(F.count(F.lit(1)).alias("__n"))
    order = Window.partitionBy(F.lit(0)).orderBy("__k")  # at most 2^bits rows
    counts = counts.select(
        "__k",
        (F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).alias("__below"),
        F.sum("__n").over(Window.partitionBy(F.lit(0))).alias("total"),
    )
    inside = Window.partitionBy("__k").orderBy("__h", key)
    return (
        df.withColumn("__r", F.row_number().over(inside) - 1)
        .join(F.broadcast(counts), "__k")
        .withColumn(out, F.col("__below") + F.col("__r"))
        .drop("__h", "__k", "__r", "__below")
    )
