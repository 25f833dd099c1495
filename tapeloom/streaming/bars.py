"""Bars and news as streams.  Every function maps a streaming DataFrame to a streaming DataFrame;
event times are ``timestamp`` columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything the source has now into Parquet, then stop.

    The checkpoint carries offsets, watermark and state to the next run.
    """
    q = df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint)
    q.trigger(availableNow=True).start().awaitTermination()


def stream_bars(src: DataFrame, delay: str = "10 minutes", key: str = "ticker", ts: str = "ts") -> DataFrame:
    """Bars with copies of a (ticker, ts) inside the watermark removed."""
    return src.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key, ts])


def stream_ohlcv(ticks: DataFrame, size: str = "1 minute", slide: str | None = None, delay: str = "10 minutes", key: str = "ticker", ts: str = "ts",
                 price: str = "price", volume: str = "qty", order: list[str] | None = None) -> DataFrame:
    """OHLCV bars of a tumbling (or, with ``slide``, sliding) window; X4: later ticks than ``delay`` are dropped."""
    seq = F.struct(*(order or [ts]))
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    g = ticks.withWatermark(ts, delay).groupBy(w.alias("w"), key).agg(
        F.min_by(price, seq).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, seq).alias("close"),
        F.sum(volume).alias("volume"),
    )
    return g.select(key, F.col("w.start").alias("ts"), F.col("w.end").alias("end"), "open", "high", "low", "close", "volume")


def stream_news(src: DataFrame, delay: str = "2 days", url: str = "url", ts: str = "published_at") -> DataFrame:
    """One row per URL inside the delay; :func:`tapeloom.streaming.epochs.run_news` also remembers older ones."""
    return src.withWatermark(ts, delay).dropDuplicatesWithinWatermark([url])


def stream_enrich(bars: DataFrame, daily: DataFrame, lag_days: int = 1, key: str = "ticker", date: str = "date") -> DataFrame:
    """Bars with the static daily row of ``lag_days`` before, NULL without one."""
    static = daily.withColumn(date, F.date_add(date, lag_days))
    return bars.join(static, [key, date], "left")


def stream_sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes", key: str = "ticker", ts: str = "ts", value: str = "price") -> DataFrame:
    """Activity sessions of a key: closed by a pause longer than ``gap``."""
    g = events.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return g.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def stream_quality(bars: DataFrame, size: str = "1 hour", delay: str = "10 minutes", key: str = "ticker", ts: str = "ts") -> DataFrame:
    """Per window and ticker the rows, NULL prices, inverted ranges and empty volumes."""
    bad = lambda c: F.sum(F.when(c, 1).otherwise(0))
    any_null = F.col("open").isNull() | F.col("high").isNull() | F.col("low").isNull() | F.col("close").isNull()
    g = bars.withWatermark(ts, delay).groupBy(F.window(ts, size).alias("w"), key).agg(
        F.count(F.lit(1)).alias("n_rows"), bad(any_null).alias("n_null"), bad(F.col("high") < F.col("low")).alias("n_inverted"),
        bad(F.coalesce("volume", F.lit(0.0)) <= 0).alias("n_empty"),
    )
    return g.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_rows", "n_null", "n_inverted", "n_empty")


def refresh_daily(src: DataFrame, path: str, checkpoint: str, build) -> None:
    """Continuous refresh: run a batch operator on every micro-batch and append its rows."""

    def step(batch: DataFrame, epoch: int) -> None:
        # one folder per epoch, so a repeated epoch replaces its own output
        build(batch).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    src.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
