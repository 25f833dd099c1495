"""Portfolios from predictions, positions from signals, and their performance."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import TRADING_DAYS, div, seeded

FLAT = 1e-10


def _keys(by) -> list:
    return list(by) if by else [F.lit(0)]


def growth(total: Column, n: Column, floor_years: float = 0.0) -> Column:
    """Annualised growth; NULL once everything (or more) is lost."""
    years = F.greatest(n / float(TRADING_DAYS), F.lit(floor_years)) if floor_years else n / float(TRADING_DAYS)
    return F.when(total > -1, F.pow(1 + total, 1.0 / years) - 1)


def top_k(df: DataFrame, c: str, k: int, by: tuple[str, ...] = ("date",), largest: bool = True, tie: str = "ticker") -> DataFrame:
    """The k rows with the largest (smallest) value per group, with their ``rank``.

    The rank filter is pushed before the shuffle, so no task sees a whole group.
    """
    order = F.desc(c) if largest else F.asc(c)
    w = Window.partitionBy(*by).orderBy(order, F.desc(tie) if largest else F.asc(tie))
    known = df.where(F.col(c).isNotNull())
    return known.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def cum_return(df: DataFrame, ret: str, out: str = "equity", by: tuple[str, ...] = (), date: str = "date") -> DataFrame:
    """Running product of 1 + return (one row per date and group)."""
    w = Window.partitionBy(*_keys(by)).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.product(1 + F.col(ret)).over(w))


def drawdown(df: DataFrame, equity: str, by: tuple[str, ...] = (), date: str = "date") -> DataFrame:
    """Distance from the running peak and its minimum so far."""
    w = Window.partitionBy(*_keys(by)).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("__peak", F.max(equity).over(w))
    df = df.withColumn("drawdown", div(F.col(equity) - F.col("__peak"), "__peak"))
    return df.withColumn("max_drawdown", F.min("drawdown").over(w)).drop("__peak")


def performance_summary(df: DataFrame, ret: str = "ret", by: tuple[str, ...] = (), date: str = "date", trades: DataFrame | None = None,
                        extra: list[Column] | None = None) -> DataFrame:
    """Return, volatility, Sharpe, Sortino, drawdown, Calmar, hit rate, win, loss and profit factor.

    Hit rate, win, loss and profit factor describe days, or trades where a trade
    table (with ``pnl_pct`` and ``holding_rows``) is given.
    """
    by = list(by)
    curve = drawdown(cum_return(df, ret, "__eq", tuple(by), date), "__eq", tuple(by), date)
    r = F.col(ret)
    down = F.when(r < 0, r)
    g = curve.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_days"),
        (F.product(1 + r) - 1).alias("total_return"),
        (F.stddev_pop(r) * math.sqrt(TRADING_DAYS)).alias("ann_volatility"),
        (F.when(F.count(down) > 1, F.stddev_pop(down)) * math.sqrt(TRADING_DAYS)).alias("__down"),
        F.min("drawdown").alias("max_drawdown"),
        F.avg(F.when(r > 0, 1.0).otherwise(0.0)).alias("hit_rate"),
        F.coalesce(F.avg(F.when(r > 0, r)), F.lit(0.0)).alias("avg_win"),
        F.coalesce(F.avg(F.when(r <= 0, r)), F.lit(0.0)).alias("avg_loss"),
        div(F.sum(F.when(r > 0, r).otherwise(0.0)), F.abs(F.sum(F.when(r <= 0, r).otherwise(0.0)))).alias("profit_factor"),
        F.avg(ret).alias("mean_ret"),
        *(extra or []),
    )
    ann = growth(F.col("total_return"), F.col("n_days"), 0.01)
    g = g.withColumn("ann_return", ann)

    def over(c: Column) -> Column:
        return F.when(c > FLAT, F.col("ann_return") / c).when(F.col("ann_return").isNotNull(), 0.0)

    g = g.withColumns(
        {
            "sharpe": over(F.col("ann_volatility")),
            "sortino": over(F.coalesce(F.col("__down"), F.lit(0.0))),
            "calmar": over(F.abs(F.col("max_drawdown"))),
        }
    ).drop("__down")
    if trades is None:
        return g
    p = F.col("pnl_pct")
    t = trades.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_trades"),
        F.avg(F.when(p > 0, 1.0).otherwise(0.0)).alias("hit_rate"),
        F.coalesce(F.avg(F.when(p > 0, p)), F.lit(0.0)).alias("avg_win"),
        F.coalesce(F.avg(F.when(p <= 0, p)), F.lit(0.0)).alias("avg_loss"),
        div(F.sum(F.when(p > 0, p).otherwise(0.0)), F.abs(F.sum(F.when(p <= 0, p).otherwise(0.0)))).alias("profit_factor"),
        F.avg("holding_rows").alias("avg_holding"),
    )
    g = g.drop("hit_rate", "avg_win", "avg_loss", "profit_factor")
    out = g.join(t, by, "left") if by else g.join(F.broadcast(t))
    return out.withColumn("n_trades", F.coalesce("n_trades", F.lit(0)))


# --- positions ---------------------------------------------------------------


def position_returns(df: DataFrame, signal: str = "signal", bps: float = 10.0, min_change: float = 0.01, limit: float = 1.0,
                     by: tuple[str, ...] = ("strategy", "ticker"), date: str = "date") -> DataFrame:
    """``position`` and net ``ret`` per row.

    A signal is taken over when it moves by more than ``min_change`` against the
    signal before; a row earns the position it starts with and pays ``bps`` of
    what it trades.
    """
    w = Window.partitionBy(*by).orderBy(date)
    s = F.greatest(F.least(F.col(signal), F.lit(limit)), F.lit(-limit))
    df = df.withColumn("__s", s)
    moved = F.abs(F.col("__s") - F.coalesce(F.lag("__s").over(w), F.lit(0.0))) > min_change
    df = df.withColumn("__taken", F.when(moved, F.col("__s")))
    df = df.withColumn("position", F.coalesce(F.last("__taken", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)))
    before = F.coalesce(F.lag("position").over(w), F.lit(0.0))
    gain = F.coalesce(div("close", F.lag("close").over(w)) - 1, F.lit(0.0))
    cost = F.abs(F.col("position") - before) * (bps / 10_000.0)
    return df.withColumn("ret", before * gain - cost).drop("__s", "__taken")


def trades(df: DataFrame, by: tuple[str, ...] = ("strategy", "ticker"), date: str = "date", bps: float = 10.0) -> DataFrame:
    """Stretches of one position as trades, from the row it is taken to the row it is left (or the last row)."""
    w = Window.partitionBy(*by).orderBy(date)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    changed = F.when(F.col("position") != F.coalesce(F.lag("position").over(w), F.lit(0.0)), 1).otherwise(0)
    df = df.withColumns(
        {
            "__c": changed,
            "__next_date": F.coalesce(F.lead(date).over(w), F.col(date)),
            "__next_close": F.coalesce(F.lead("close").over(w), F.col("close")),
            "__more": F.when(F.lead(date).over(w).isNotNull(), 1).otherwise(0),
        }
    )
    df = df.withColumn("trade", F.sum("__c").over(run)).where("position <> 0")
    g = df.groupBy(*by, "trade").agg(
        F.min(date).alias("entry_date"),
        F.max("__next_date").alias("exit_date"),
        F.min_by("close", date).alias("entry_price"),
        F.max_by("__next_close", date).alias("exit_price"),
        F.max("position").alias("size"),
        F.sum("__more").alias("holding_rows"),
    )
    pnl = F.col("size") * (div("exit_price", "entry_price") - 1)
    return g.withColumns(
        {"direction": F.signum("size").cast("int"), "size": F.abs("size"), "pnl_pct": pnl, "cost": F.abs("size") * (bps / 10_000.0)}
    )


def compare_strategies(summary: DataFrame) -> DataFrame:
    """Strategies by mean Sharpe over tickers, best first."""
    g = summary.groupBy("strategy").agg(
        *[F.avg(c).alias(c) for c in ("total_return", "sharpe", "sortino", "max_drawdown", "hit_rate", "profit_factor")],
        F.count(F.lit(1)).alias("n_tickers"),
    )
    # one row per strategy
    return g.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc_nulls_last("sharpe"), "strategy")))


# --- portfolios from predictions ---------------------------------------------


def _k(n: Column, top: int, rule: str) -> Column:
    quarter = F.greatest(F.lit(1), F.floor(n / 4))
    if rule == "half":  # top_k if the day has 2 * top_k rows, else a quarter of the day
        return F.when(n >= 2 * top, F.lit(top)).otherwise(quarter)
    return F.least(F.lit(top), quarter)


def long_short_positions(preds: DataFrame, top: int = 20, k_rule: str = "quarter", pred: str = "pred", target: str = "target",
                         date: str = "date", ticker: str = "ticker") -> DataFrame:
    """The long and short side of each date: (date, ticker, side, target)."""
    known = preds.where(F.col(pred).isNotNull() & F.col(target).isNotNull())
    n = known.groupBy(date).agg(F.count(F.lit(1)).alias("__n"))  # one row per date
    sides = []
    for side, largest in ((1, True), (-1, False)):
        best = top_k(known, pred, top, (date,), largest, ticker)
        sides.append(best.select(date, ticker, target, "rank", F.lit(side).alias("side")))
    both = sides[0].unionByName(sides[1]).join(n, date)
    return both.where(F.col("rank") <= _k(F.col("__n"), top, k_rule)).select(date, ticker, "side", target)


def turnover(positions: DataFrame, date: str = "date", ticker: str = "ticker") -> DataFrame:
    """Share of a day's positions that were not held on the day before; 1 on the first day."""
    w = Window.partitionBy(F.lit(0)).orderBy(date)  # one row per date
    days = positions.select(date).distinct().select(date, F.lag(date).over(w).alias("__prev"))
    # when the same position was held last: one row per date in each (ticker, side)
    held = F.lag(date).over(Window.partitionBy(ticker, "side").orderBy(date))
    j = positions.select(date, ticker, "side", held.alias("__held")).join(days, date)
    new = F.sum(F.when(F.col("__held") == F.col("__prev"), 0).otherwise(1))
    return j.groupBy(date).agg((new / F.count(F.lit(1))).alias("turnover"))


def long_short_daily(preds: DataFrame, top: int = 20, k_rule: str = "quarter", bps: float = 10.0, **names) -> DataFrame:
    """One row per date: gross and net return and turnover of a long-short portfolio."""
    target, date = names.get("target", "target"), names.get("date", "date")
    pos = long_short_positions(preds, top, k_rule, **names)
    gross = pos.groupBy(date).agg(
        (F.avg(F.when(F.col("side") == 1, F.col(target))) - F.avg(F.when(F.col("side") == -1, F.col(target)))).alias("__ls"),
        F.sum(F.when(F.col("side") == 1, 1).otherwise(0)).alias("k"),
    )
    out = gross.join(turnover(pos, date, names.get("ticker", "ticker")), date).withColumn("gross", F.col("__ls") / 2.0)
    return out.withColumn("ret", F.col("gross") - F.col("turnover") * (bps / 10_000.0)).drop("__ls")


def long_enough(summary: DataFrame, least: int) -> DataFrame:
    """Series of fewer than ``least`` days are not annualised: Sharpe and total return are 0, other measures unknown."""
    short = F.col("n_days") < least
    zero = {"sharpe", "total_return"}
    measures = [f.name for f in summary.schema if f.dataType.typeName() == "double"]
    return summary.withColumns({c: F.when(~short, F.col(c)).otherwise(F.lit(0.0) if c in zero else None) for c in measures})


def long_short(preds: DataFrame, top: int = 20, k_rule: str = "quarter", bps: float = 10.0, least_days: int = 5, **names) -> DataFrame:
    """Performance of the long-short portfolio, with its mean turnover, from ``least_days`` days on."""
    daily = long_short_daily(preds, top, k_rule, bps, **names)
    return long_enough(performance_summary(daily, date=names.get("date", "date"), extra=[F.avg("turnover").alias("avg_turnover")]), least_days)


def long_only_daily(preds: DataFrame, top: int = 20, pred: str = "pred", target: str = "target", date: str = "date", ticker: str = "ticker") -> DataFrame:
    """One row per date: mean outcome of the best positive predictions, 0 (cash) without any."""
    known = preds.where(F.col(pred).isNotNull() & F.col(target).isNotNull())
    n = known.groupBy(date).agg(F.count(F.lit(1)).alias("__n"))
    best = top_k(known.where(F.col(pred) > 0), pred, top, (date,), True, ticker).join(n, date)
    k = F.when(F.col("__n") < top, F.greatest(F.lit(1), F.floor(F.col("__n") / 2))).otherwise(top)
    held = best.where(F.col("rank") <= k).groupBy(date).agg(F.avg(target).alias("__r"))
    return n.join(held, date, "left").select(date, F.coalesce("__r", F.lit(0.0)).alias("ret"))


def long_only(preds: DataFrame, top: int = 20, least_days: int = 10, **names) -> DataFrame:
    """Performance of the long-only portfolio, from ``least_days`` days on."""
    return long_enough(performance_summary(long_only_daily(preds, top, **names), date=names.get("date", "date")), least_days)


def portfolio_curves(preds: DataFrame, top: int = 20, pred: str = "pred", target: str = "target", date: str = "date", ticker: str = "ticker", least: int = 5) -> DataFrame:
    """Equity curves of the top, bottom, whole market and top minus bottom."""
    known = preds.where(F.col(pred).isNotNull() & F.col(target).isNotNull())
    market = known.groupBy(date).agg(F.avg(target).alias("market_ret"), F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= max(least, top))
    top_ret = top_k(known, pred, top, (date,), True, ticker).groupBy(date).agg(F.avg(target).alias("top_ret"))
    bottom = top_k(known, pred, top, (date,), False, ticker).groupBy(date).agg(F.avg(target).alias("bottom_ret"))
    j = market.drop("__n").join(top_ret, date).join(bottom, date).withColumn("ls_ret", F.col("top_ret") - F.col("bottom_ret"))
    for c in ("top", "bottom", "market", "ls"):
        j = cum_return(j, f"{c}_ret", f"{c}_equity", (), date)
    return j


def stitched_oos(preds: DataFrame, folds: DataFrame, top: int = 20, k_rule: str = "quarter", date: str = "date", **names) -> DataFrame:
    """Daily long-short return and equity over the test periods of all folds in date order.

    ``preds`` has a fold column; where test periods overlap the latest fold counts.
    """
    from .targets import assign_folds

    test = assign_folds(preds.withColumnRenamed("fold", "__fold"), folds, date).where("split = 'test' AND fold = __fold").drop("__fold", "split")
    newest = test.groupBy(date).agg(F.max("fold").alias("__f"))  # one row per date
    test = test.join(newest, date).where("fold = __f").drop("__f")
    pos = long_short_positions(test, top, k_rule, date=date, **names)
    target = names.get("target", "target")
    daily = pos.groupBy(date).agg(
        ((F.avg(F.when(F.col("side") == 1, F.col(target))) - F.avg(F.when(F.col("side") == -1, F.col(target)))) / 2).alias("ret")
    )
    return drawdown(cum_return(daily, "ret", "equity", (), date), "equity", (), date)


def baseline_predictions(preds: DataFrame, kind: str, target: str = "target", seed: int = 42, key: str = "ticker", date: str = "date") -> DataFrame:
    """Predictions that know nothing: seeded noise, the target before, or zero."""
    if kind == "zero":
        value = F.lit(0.0)
    elif kind == "lagged":
        value = F.coalesce(F.lag(target).over(Window.partitionBy(key).orderBy(date)), F.lit(0.0))
    elif kind == "random":
        # two hashes of the row make one normal draw
        u = [(seeded(seed + i, key, date) % (1 << 40) + 1) / float((1 << 40) + 1) for i in (0, 1)]
        value = F.sqrt(-2 * F.log(u[0])) * F.cos(2 * math.pi * u[1])
    else:
        raise ValueError("kind must be 'random', 'lagged' or 'zero'")
    return preds.withColumn("pred", value)


def ensemble(preds: DataFrame, fold_ics: DataFrame, top_folds: int = 3, pred: str = "pred", keys: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """Predictions of the best folds by validation IC, weighted by it (equally if it does not add up to more than 0).

    A ticker some fold is silent on gets the weights of the folds that speak.
    """
    best = fold_ics.orderBy(F.desc("val_ic"), "fold").limit(top_folds)  # a handful of rows
    j = preds.join(F.broadcast(best), "fold")
    w = F.col("val_ic")
    weighted = F.when(F.sum(w) > 0, div(F.sum(F.col(pred) * w), F.sum(w))).otherwise(F.avg(pred))
    return j.groupBy(*keys).agg(weighted.alias("predicted_return"), F.count(F.lit(1)).alias("n_folds"))
