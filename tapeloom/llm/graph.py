"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.session import materialize


def _hang(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Hang neighbours of each node under the smallest of them and the node itself.

    With ``larger_only`` (large star) the node's larger neighbours; else (small star)
    the node and its smaller neighbours.
    """
    if larger_only:
        around = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = around.join(least, "u")
    if larger_only:
        hung = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        hung = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return hung.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v): the smallest node that links reach.

    Alternates large and small stars until nothing changes; each round is two
    aggregates and two joins over the links, written so that lost executors cost one
    round.  A node with very many neighbours is a hot join key that Spark splits.
    """
    state = materialize(edges.where("u <> v").select("u", "v").distinct())
    mark = None
    while True:
        now = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not now[0] or tuple(now) == mark:
            break
        mark = tuple(now)
        state = materialize(_hang(_hang(state, True), False))
    tops = state.select(F.col("v").alias("node")).distinct()
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(tops.select("node", F.col("node").alias("component")))
