"""Rule-based strategies: each adds a ``signal`` in [-1, 1] to daily bars."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import clip, div, rows, seeded, series
from .daily import macd_lines, rsi

LONG, SHORT = 1.0, -0.5


def _t() -> Column:
    return F.row_number().over(series()) - 1


def hold_last(c: str | Column, w: Window, start: float = 0.0) -> Column:
    """The last decided value; NULL means keep."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(start))


def buy_and_hold(df: DataFrame) -> DataFrame:
    """B1"""
    return df.withColumn("signal", F.lit(1.0))


def sma_crossover(df: DataFrame, fast: int = 10, slow: int = 30) -> DataFrame:
    """B2: long while the fast average is above the slow one, half short otherwise."""
    w = series()
    rule = F.when(F.avg("close").over(rows(w, fast)) > F.avg("close").over(rows(w, slow)), LONG).otherwise(SHORT)
    return df.withColumn("signal", F.when(_t() < slow, 0.0).otherwise(rule))


def macd_signal(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """Long while MACD is above its signal line."""
    base = df.columns
    df = macd_lines(df, fast, slow, signal)
    rule = F.when(F.col("macd") > F.col("macd_signal"), LONG).otherwise(SHORT)
    return df.withColumn("signal", F.when(_t() < slow, 0.0).otherwise(rule)).select(*base, "signal")


def mean_reversion(df: DataFrame, window: int = 20, n_std: float = 2.0) -> DataFrame:
    """Buy below the lower band, sell above the upper, flat near the mean, hold in between."""
    w = series()
    base = df.columns
    df = df.withColumns({"__m": F.avg("close").over(rows(w, window)), "__s": F.stddev_pop("close").over(rows(w, window)), "__t": _t()})
    gap = F.col("close") - F.col("__m")
    decided = (
        F.when(F.col("__t") < window, 0.0)
        .when(F.col("__s") < 1e-10, 0.0)
        .when(gap < -n_std * F.col("__s"), LONG)
        .when(gap > n_std * F.col("__s"), SHORT)
        .when(F.abs(gap) < 0.5 * F.col("__s"), 0.0)
    )
    df = df.withColumn("__d", decided)
    return df.withColumn("signal", hold_last("__d", w)).select(*base, "signal")


def momentum(df: DataFrame, lookback: int = 20, scale: bool = True) -> DataFrame:
    """With the move over ``lookback`` rows: ten times it, clamped, or just its sign."""
    roc = div("close", F.lag("close", lookback).over(series())) - 1
    rule = clip(roc * 10, -1, 1) if scale else F.when(roc > 0, LONG).when(roc.isNotNull(), SHORT)
    return df.withColumn("signal", F.coalesce(rule, F.lit(0.0)))


def rsi_signal(df: DataFrame, period: int = 14, oversold: float = 30, overbought: float = 70) -> DataFrame:
    """Buy oversold, sell overbought, mildly long below the middle."""
    base = df.columns
    df = rsi(df, period, 0.0, "__rsi", scale=1.0).withColumn("__t", _t())
    r = F.col("__rsi")
    rule = F.when(r < oversold, LONG).when(r > overbought, SHORT).when(r < (oversold + overbought) / 2, 0.5).otherwise(0.0)
    return df.withColumn("signal", F.when(F.col("__t") <= period, 0.0).otherwise(rule)).select(*base, "signal")


def random_signal(df: DataFrame, seed: int = 42, p: float = 0.1) -> DataFrame:
    """Change to a random position with probability p, drawn from a hash of the row."""
    w = series()

    def draw(i: int, n: int) -> Column:
        return seeded(seed + i, "ticker", "date") % n

    choices = F.array(*[F.lit(x) for x in (-1.0, -0.5, 0.0, 0.5, 1.0)])
    pick = F.when(draw(0, 1_000_000) < int(p * 1_000_000), F.element_at(choices, (draw(1, 5) + 1).cast("int")))
    df = df.withColumn("__d", pick)
    return df.withColumn("signal", hold_last("__d", w)).drop("__d")


def perfect_foresight(df: DataFrame, h: int = 5) -> DataFrame:
    """Twenty times the coming h-row return, clamped: the ceiling no forecast can pass."""
    future = div(F.lead("close", h).over(series()), "close") - 1
    return df.withColumn("signal", F.coalesce(clip(future * 20, -1, 1), F.lit(0.0)))


BASELINES = {
    "Buy & Hold": buy_and_hold,
    "SMA(10/30)": lambda d: sma_crossover(d, 10, 30),
    "SMA(20/50)": lambda d: sma_crossover(d, 20, 50),
    "MACD": macd_signal,
    "MeanRev(BB20)": mean_reversion,
    "Momentum(20d)": lambda d: momentum(d, 20),
    "Momentum(60d)": lambda d: momentum(d, 60),
    "RSI(14)": rsi_signal,
    "Random": random_signal,
}


def run_strategies(bars: DataFrame, strategies: dict | None = None) -> DataFrame:
    """All strategies over the same bars: (strategy, ticker, date, close, signal).

    The signals are computed side by side on one ticker exchange and then
    unpivoted, instead of reading the bars once per strategy.
    """
    todo = strategies or BASELINES
    df = bars.select("ticker", "date", "open", "high", "low", "close", "volume")
    for i, rule in enumerate(todo.values()):
        df = rule(df).withColumnRenamed("signal", f"__sig{i}")
    pairs = F.map_from_arrays(F.array(*[F.lit(n) for n in todo]), F.array(*[F.col(f"__sig{i}").cast("double") for i in range(len(todo))]))
    return df.select("ticker", "date", "close", F.explode(pairs).alias("strategy", "signal"))
