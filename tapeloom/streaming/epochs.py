"""Stateful stream steps on DataFrames: state and output are tables with one folder for each epoch.

A micro-batch and the state before it go through a batch step, which gives rows to
write and the state after it.  Both are written under the epoch's number before the
epoch counts as done, so a repeated epoch starts from the same state and replaces what
it wrote.  Nothing of a key has to fit a task: the steps are joins, windows and
aggregates that Spark splits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scan import ema, span_alpha
from ..session import materialize, remove
from .bars import stream_news

Step = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]


def advance(batch: DataFrame, epoch: int, path: str, step: Step, first: DataFrame) -> None:
    """One epoch: ``{path}/state`` of the epoch before (``first`` for epoch 0), the step, output and state of this one."""
    spark = batch.sparkSession
    state = spark.read.schema(first.schema).parquet(f"{path}/state/{epoch - 1}") if epoch else first
    out, after = step(batch, state)
    out.write.mode("overwrite").parquet(f"{path}/out/epoch={epoch}")
    after.write.mode("overwrite").parquet(f"{path}/state/{epoch}")
    remove(spark, f"{path}/state/{epoch - 2}")  # this epoch can be repeated from the one before


def run_epochs(src: DataFrame, path: str, checkpoint: str, step: Step, first: DataFrame) -> None:
    """Feed everything the source has now through ``step``, micro-batch by micro-batch."""
    q = src.writeStream.foreachBatch(lambda batch, epoch: advance(batch, epoch, path, step, first))
    q.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_epochs(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """The rows of all epochs."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(f"{path}/out").drop("epoch")


# --- X9 ----------------------------------------------------------------------


def ema_step(span: float) -> Step:
    """Continue each ticker's average: its last value stands before the new bars as their seed."""

    def step(batch: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
        new = batch.select("ticker", "ts", "seq", "x", F.lit(1).alias("__new"))
        seeds = state.join(batch.select("ticker").distinct(), "ticker", "left_semi").select("ticker", "ts", "seq", F.col("ema").alias("x"), F.lit(0).alias("__new"))
        done = ema(seeds.unionByName(new), "x", "ema", alpha=span_alpha(span), order=["__new", "ts", "seq"])
        done = materialize(done.where("__new = 1").select("ticker", "ts", "seq", "ema"))
        last = done.groupBy("ticker").agg(F.max_by(F.struct("ts", "seq", "ema"), F.struct("ts", "seq")).alias("s")).select("ticker", "s.*")
        return done, last.unionByName(state.join(last, "ticker", "left_anti"))

    return step


def run_ema(bars: DataFrame, path: str, checkpoint: str, span: float = 12, c: str = "close", key: str = "ticker", ts: str = "ts", seq: str | None = None) -> DataFrame:
    """Exponential average per ticker carried over micro-batches; (ticker, ts, seq, ema).

    Bars of a ticker arrive in time order from batch to batch; inside a batch they are
    sorted by (ts, seq).  The state is one row a ticker.
    """
    spark = bars.sparkSession
    src = bars.select(F.col(key).cast("string").alias("ticker"), F.col(ts).alias("ts"), (F.col(seq) if seq else F.lit(0)).cast("bigint").alias("seq"), F.col(c).cast("double").alias("x"))
    first = spark.createDataFrame([], f"ticker string, ts {src.schema['ts'].dataType.simpleString()}, seq bigint, ema double")
    run_epochs(src, path, checkpoint, ema_step(span), first)
    return read_epochs(spark, path, first.schema)


# --- X6 ----------------------------------------------------------------------

#: Children of a node: bars of a second, seconds of a minute, minutes of an hour, hours of a day, days of a month of 32, months.
FANS = (1_000_000, 60, 60, 24, 32)


def extremes(bars: DataFrame, key: str = "ticker", ts: str = "ts") -> DataFrame:
    """Blocks of time of each ticker with the extremes of their parts: (ticker, level, node, items (child, hi, lo)).

    Level 0 are seconds, whose items are bars; each later level groups the one before.
    The last one is a single block of all months.
    """
    at = bars.where(F.col(ts).isNotNull()).select(F.col(key), F.unix_micros(F.col(ts).cast("timestamp")).alias("child"), F.col("high").cast("double").alias("hi"), F.col("low").cast("double").alias("lo"))
    out = None
    for level, fan in enumerate((*FANS, None)):
        node = F.floor(F.col("child") / fan) if fan else F.lit(0)
        grouped = at.groupBy(key, node.cast("bigint").alias("node")).agg(F.array_sort(F.collect_list(F.struct("child", "hi", "lo"))).alias("items"), F.max("hi").alias("hi"), F.min("lo").alias("lo"))
        grouped = materialize(grouped)
        rows = grouped.select(key, F.lit(level).alias("level"), "node", "items")
        out = rows if out is None else out.unionByName(rows)
        at = grouped.select(key, F.col("node").alias("child"), "hi", "lo")
    return out


def _stopped(x) -> Column:
    return F.when(F.col("direction") == "long", x["lo"] <= F.col("stop_loss")).otherwise(x["hi"] >= F.col("stop_loss"))


def _earned(x) -> Column:
    return F.when(F.col("direction") == "long", x["hi"] >= F.col("take_profit")).otherwise(x["lo"] <= F.col("take_profit"))


def first_exits(bars: DataFrame, positions: DataFrame, key: str = "ticker", ts: str = "ts") -> DataFrame:
    """The first bar after its entry that touches each position's stop or target: (position_id, ts, exit_price, exit_reason).

    ``positions`` (position_id, ticker, entry_ts, direction, stop_loss, take_profit).
    A bar that touches both, or bars of one time of which one is stopped, count as
    stopped.  A position looks at the blocks around its entry, one of each level, for
    the first later part whose extremes touch; then it goes down that part.  So it
    meets a dozen blocks, however many bars there are.  Open positions give no row.
    """
    nodes = extremes(bars, key, ts)
    p = positions.select("position_id", key, F.unix_micros(F.col("entry_ts").cast("timestamp")).alias("__entry"), "direction", "stop_loss", "take_profit")
    touches = lambda x: F.coalesce(_stopped(x), F.lit(False)) | F.coalesce(_earned(x), F.lit(False))
    # up: own child of each level, and the block that holds it
    own, steps = F.col("__entry"), []
    for level, fan in enumerate((*FANS, None)):
        node = F.floor(own / fan).cast("bigint") if fan else F.lit(0).cast("bigint")
        steps.append(F.struct(F.lit(level).alias("level"), node.alias("node"), own.alias("__own")))
        own = node
    up = p.select("*", F.inline(F.array(*steps))).join(nodes, [key, "level", "node"])
    found = up.withColumn("__hit", F.try_element_at(F.filter("items", lambda x: (x["child"] > F.col("__own")) & touches(x)), F.lit(1))).where("__hit is not null")
    best = found.groupBy("position_id", key, "direction", "stop_loss", "take_profit").agg(F.min_by(F.struct("level", F.col("__hit").alias("hit")), "level").alias("b"))
    at = best.select("position_id", key, "direction", "stop_loss", "take_profit", F.col("b.level").alias("level"), F.col("b.hit").alias("hit"))
    for level in range(len(FANS), 0, -1):  # down: those above go into the part that touches
        stay = at.where(F.col("level") < level)
        go = at.where(F.col("level") == level).select("position_id", key, "direction", "stop_loss", "take_profit", F.lit(level - 1).alias("level"), F.col("hit.child").alias("node"))
        down = go.join(nodes, [key, "level", "node"]).withColumn("hit", F.element_at(F.filter("items", touches), 1))
        at = materialize(stay.unionByName(down.select(*stay.columns)))
    # bars of the same time: a stop among them counts
    same = at.withColumn("level", F.lit(0)).withColumn("node", F.floor(F.col("hit.child") / FANS[0]).cast("bigint")).join(nodes, [key, "level", "node"])
    stop = F.exists("items", lambda x: (x["child"] == F.col("hit.child")) & F.coalesce(_stopped(x), F.lit(False)))
    return same.select("position_id", F.timestamp_micros("hit.child").alias("ts"), F.when(stop, F.col("stop_loss")).otherwise(F.col("take_profit")).alias("exit_price"), F.when(stop, "stop_hit").otherwise("tp_hit").alias("exit_reason"))


def exit_step(key: str = "ticker", ts: str = "ts") -> Step:
    """Close what the new bars touch; closed positions leave the state."""

    def step(batch: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
        hits = materialize(first_exits(batch, state, key, ts))
        return hits, state.join(hits.select("position_id"), "position_id", "left_anti").select(*state.columns)

    return step


def run_exits(bars: DataFrame, positions: DataFrame, path: str, checkpoint: str, key: str = "ticker", ts: str = "ts") -> DataFrame:
    """Exits of all open positions over micro-batches of bars, as :func:`first_exits`.

    Bars of a ticker arrive in time order from batch to batch.  The state holds the
    positions that are still open.
    """
    run_epochs(bars, path, checkpoint, exit_step(key, ts), positions.select("position_id", key, "entry_ts", "direction", "stop_loss", "take_profit"))
    return read_epochs(bars.sparkSession, path, "position_id bigint, ts timestamp, exit_price double, exit_reason string")


# --- X3 ----------------------------------------------------------------------


def keep_news(batch: DataFrame, epoch: int, path: str, url: str = "url", ts: str = "published_at", prefixes: int = 256) -> None:
    """Write the rows of a batch whose URL no earlier epoch has, the earliest of each URL.

    The written table is the memory: it is partitioned by epoch and a prefix of the
    URL's hash, and only the prefixes that the batch has are read.
    """
    spark = batch.sparkSession
    hashed = batch.where(F.col(url).isNotNull()).withColumn("prefix", F.pmod(F.xxhash64(url), F.lit(prefixes)).cast("int"))
    rest = [c for c in batch.columns if c != url]
    one = hashed.groupBy("prefix", url).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(ts, *[F.col(f"`{c}`").cast("string") for c in rest if c != ts])).alias("__r")).select("prefix", url, "__r.*")
    one = materialize(one)
    if epoch:
        schema = one.drop("prefix").schema.add("epoch", "long").add("prefix", "integer")
        wanted = [r[0] for r in one.select("prefix").distinct().collect()]  # at most ``prefixes`` numbers
        stored = spark.read.schema(schema).parquet(f"{path}/out").where((F.col("epoch") < epoch) & F.col("prefix").isin(wanted))
        one = one.join(stored.select("prefix", url), ["prefix", url], "left_anti")
    one.repartition("prefix").write.mode("overwrite").partitionBy("prefix").parquet(f"{path}/out/epoch={epoch}")


def run_news(src: DataFrame, path: str, checkpoint: str, delay: str = "2 days", url: str = "url", ts: str = "published_at") -> DataFrame:
    """One row per URL for good: near copies go by the watermark, later ones by the stored URLs.

    The streaming state is bounded by ``delay``; a URL that returns years later is
    still dropped.  Rows without URL are no articles.
    """
    q = stream_news(src, delay, url, ts).writeStream.foreachBatch(lambda b, e: keep_news(b, e, path, url, ts))
    q.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return src.sparkSession.read.schema(src.schema).parquet(f"{path}/out")
