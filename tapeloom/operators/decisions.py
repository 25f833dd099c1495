"""Decision rules over prediction tables: agreement, gates, sizes, orders and outcomes."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import EPS, clip, div, half_away
from .joins import nth_bar_after

TINY = 1e-6
# Position scales by regime and confidence, and the thresholds of the rules.
REGIME_SCALE = {"bull_low_vol": 1.0, "bull_high_vol": 0.7, "sideways": 0.5, "bear_low_vol": 0.3, "bear_high_vol": 0.2}
CONFIDENCE_SCALE = {"hot": 1.0, "warm": 0.6, "cold": 0.2}
OTHER_SCALE = 0.5
IC_HOT, IC_COLD, DA_HOT, DA_COLD = 0.05, 0.02, 0.52, 0.50
MIN_ACTIVE, DIRECTION_FLOOR, MIN_PRICE, MIN_NOTIONAL = 3, 0.55, 2.0, 10.0


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def agreement(df: DataFrame, preds: str = "preds") -> DataFrame:
    """How far the sub-models of a map column agree in direction and size.

    Zero predictions are placeholders and drop out when at least two others remain.
    """
    every = F.map_values(F.col(preds))
    alive = F.filter(every, lambda x: F.abs(x) > TINY)
    df = df.withColumns({"__nz": F.size(alive), "__p": F.when(F.size(alive) >= 2, alive).otherwise(every)})
    df = df.withColumn("__a", F.filter("__p", lambda x: F.abs(x) > TINY))
    n, nz = F.size("__p").cast("double"), F.size("__a").cast("double")
    pos, neg = F.size(F.filter("__a", lambda x: x > 0)), F.size(F.filter("__a", lambda x: x < 0))
    mean = div(_sum(F.col("__p")), n)
    spread = F.array_max("__p") - F.array_min("__p")
    mean_abs = div(_sum(F.transform("__p", lambda x: F.abs(x))), n)
    df = df.withColumns(
        {
            "direction_agreement": F.when(nz == 0, 0.5).otherwise(div(F.greatest(pos, neg), nz)),
            "magnitude_agreement": clip(1.0 - spread / (mean_abs + 1e-8), 0, 1),
            "mean_prediction": mean,
            "n_active_models": F.size("__p"),
            "n_nonzero_models": F.col("__nz"),
            "sign_balance": F.coalesce(div(F.abs(pos - neg), nz), F.lit(0.0)),
        }
    )
    centred = _sum(F.transform("__p", lambda x: (x - F.col("mean_prediction")) * (x - F.col("mean_prediction"))))
    overall = clip(0.65 * F.col("direction_agreement") + 0.35 * F.col("magnitude_agreement"), 0, 1)
    return df.withColumns({"std_prediction": F.sqrt(div(centred, n)), "overall_agreement": overall}).drop("__nz", "__p", "__a")


def feature_health(features: DataFrame, cols: list[str], preds: DataFrame, lookback: int = 60, z_limit: float = 3.0, bad_limit: float = 0.5,
                   key: str = "ticker", date: str = "date") -> DataFrame:
    """Per ticker and feature over its last rows: z-score of the latest value, bad rate, trend,
    and whether it is suspicious or supportive, with reasons.

    ``preds`` has one ``predicted_return`` per ticker.
    """
    recent = features.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(date)))).where(F.col("__r") <= lookback)
    pairs = F.map_from_arrays(F.array(*[F.lit(c) for c in cols]), F.array(*[F.col(c).cast("double") for c in cols]))
    long = recent.select(key, date, "__r", F.explode(pairs).alias("feature", "__x"))
    ok = F.col("__x").isNotNull() & ~F.isnan("__x") & (F.abs("__x") != float("inf"))
    long = long.withColumn("__c", F.when(ok, F.col("__x")))
    # rank of the finite values from the newest, for the trend
    fresh = Window.partitionBy(key, "feature").orderBy("__r").rowsBetween(Window.unboundedPreceding, 0)
    long = long.withColumn("__k", F.when(F.col("__c").isNotNull(), F.count("__c").over(fresh)))
    n, c, k = F.count("__c"), F.col("__c"), F.col("__k")
    latest = F.max(F.when(F.col("__r") == 1, c))
    g = long.groupBy(key, "feature").agg(
        (1 - n / F.count(F.lit(1))).alias("nan_rate"),
        F.coalesce(F.avg(F.when(c == 0, 1.0).when(c.isNotNull(), 0.0)), F.lit(1.0)).alias("__zero"),
        n.alias("__n"),
        F.when(n >= 5, F.avg(c)).otherwise(0.0).alias("mean"),
        F.when(n >= 5, F.stddev_pop(c)).otherwise(0.0).alias("std"),
        F.when(n >= 5, F.coalesce(latest, F.avg(c))).otherwise(0.0).alias("latest_value"),
        F.when(n >= 10, F.signum(F.avg(F.when(k <= 5, c)) - F.avg(F.when((k > 5) & (k <= 10), c)))).otherwise(0.0).alias("trend_sign"),
    )
    g = g.withColumns(
        {
            "bad_rate": F.col("nan_rate") + F.col("__zero") * 0.5,
            "zscore": F.when(F.col("__n") >= 5, (F.col("latest_value") - F.col("mean")) / (F.col("std") + EPS)).otherwise(0.0),
        }
    ).join(preds.select(key, F.signum("predicted_return").alias("__s")), key, "left")
    z, bad, t = F.abs("zscore"), F.col("bad_rate"), F.col("trend_sign")
    s = F.coalesce(F.col("__s"), F.lit(0.0))
    known = (s != 0) & (t != 0)
    extreme, high_bad = z > z_limit, bad > bad_limit
    against = known & (t != s) & (z > 1.0)
    suspicious = extreme | high_bad | against
    # the branch that contradicts takes precedence over the one that supports
    aligned = known & ~against & ~extreme & ~high_bad & (t == s) & (z > 0.5)
    stable = ~suspicious & (bad < 0.1) & (F.col("std") > 1e-8) & (F.col("std") / (F.abs("mean") + 1e-8) < 1.0) & (z < 1.5)
    reasons = F.array_compact(
        F.array(
            F.when(extreme, F.lit("extreme_zscore")),
            F.when(high_bad, F.lit("high_bad_rate")),
            F.when(against, F.lit("trend_contradicts_prediction")),
            F.when(aligned, F.lit("trend_supports_prediction")),
            F.when(stable, F.lit("stable_feature")),
        )
    )
    return g.select(
        key, "feature", "zscore", "nan_rate", "bad_rate", "trend_sign", "latest_value", "mean", "std",
        suspicious.alias("suspicious"), ((aligned | stable) & ~suspicious).alias("supportive"), reasons.alias("reasons"),
    )


def model_confidence(df: DataFrame, ic: str = "ic", da: str = "directional_accuracy", out: str = "confidence") -> DataFrame:
    """Hot, warm or cold from recent IC and directional accuracy; warm where unknown."""
    i, d = F.col(ic), F.col(da)
    c = F.when(i.isNull() | d.isNull(), "warm").when((i >= IC_HOT) & (d >= DA_HOT), "hot").when((i < IC_COLD) | (d < DA_COLD), "cold").otherwise("warm")
    return df.withColumn(out, c)


def approve(df: DataFrame, min_agreement: float = 0.5, min_return: float = 0.001) -> DataFrame:
    """Approval with the list of reasons against it, and the risk level.

    Needs predicted_return, overall_agreement, direction_agreement,
    n_active_models, std_prediction and confidence.
    """
    conf = F.col("confidence")
    cold = conf == "cold"

    def text(c: Column, fmt: str) -> Column:
        return F.format_string(fmt, c)

    n = F.col("n_active_models")
    rules = [
        F.when((n > 0) & (n < MIN_ACTIVE), text(n.cast("int"), "only %d active sub-models")),
        F.when(F.abs("predicted_return") < min_return, F.lit("predicted return below threshold")),
        F.when(F.col("overall_agreement") < min_agreement, F.lit("sub-model agreement below threshold")),
        F.when(F.col("direction_agreement") < DIRECTION_FLOOR, F.lit("directional agreement below floor")),
        F.when((F.col("std_prediction") < TINY) & (conf != "hot"), F.lit("sub-model spread near zero")),
    ]
    reasons = F.when(cold, F.array(F.lit("model confidence is cold"))).otherwise(F.array_compact(F.array(*rules)))
    risk = (
        F.when((conf == "hot") & (F.col("overall_agreement") > 0.7), "low")
        .when(cold | (F.col("overall_agreement") < 0.4) | (F.col("direction_agreement") < DIRECTION_FLOOR), "high")
        .otherwise("medium")
    )
    return df.withColumns({"reasons": reasons, "risk_level": risk}).withColumn("approved", F.size("reasons") == 0)


def _scale(table: dict[str, float], c: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col(c)), F.lit(OTHER_SCALE))


def position_size(df: DataFrame, max_pct: float = 0.05, regime: str = "regime", confidence: str = "confidence", agree: str = "overall_agreement",
                  out: str = "position_size_pct") -> DataFrame:
    """Share of the portfolio: maximum scaled by regime, confidence and agreement."""
    size = max_pct * _scale(REGIME_SCALE, regime) * _scale(CONFIDENCE_SCALE, confidence) * (0.5 + 0.5 * F.col(agree))
    return df.withColumn(out, half_away(F.least(size, F.lit(max_pct)), 4))


def build_orders(preds: DataFrame, stops: DataFrame, regime: str | Column, confidence: str | Column, top: int = 20, max_pct: float = 0.05,
                 min_agreement: float = 0.5, min_return: float = 0.001, min_price: float = MIN_PRICE) -> DataFrame:
    """Orders from predictions: screen the highest, measure agreement, gate, size, and set stops.

    ``preds`` (ticker, predicted_return, preds map), ``stops`` as of
    :func:`tapeloom.operators.daily.atr_stops`.
    """
    label = F.lit(regime) if isinstance(regime, str) else regime
    conf = F.lit(confidence) if isinstance(confidence, str) else confidence
    # the screen sorts once over all tickers; Spark keeps the first rows of each task
    screened = preds.where(F.col("predicted_return").isNotNull()).orderBy(F.desc("predicted_return"), "ticker").limit(top)
    df = agreement(screened).withColumns({"regime": label, "confidence": conf})
    df = approve(df, min_agreement, min_return).where("approved")
    df = df.join(stops, "ticker").where(F.col("price") >= min_price)
    df = position_size(df, max_pct)
    long = F.col("predicted_return") > 0
    return df.select(
        "ticker",
        F.when(long, "long").otherwise("short").alias("direction"),
        "position_size_pct",
        F.when(long, F.col("long_stop")).otherwise(F.col("short_stop")).alias("stop_loss"),
        F.when(long, F.col("long_target")).otherwise(F.col("short_target")).alias("take_profit"),
        "atr",
        F.col("price").alias("current_price"),
        "risk_level",
        F.col("regime").alias("regime_label"),
        F.col("confidence").alias("model_confidence"),
        "predicted_return",
        F.col("overall_agreement").alias("sub_model_agreement"),
        F.col("std_prediction").alias("sub_model_spread"),
    )


def bracket_levels(orders: DataFrame, prices: DataFrame, held: DataFrame, buying_power: float) -> DataFrame:
    """Stop and target on the right side of the current price.

    Held tickers, prices under 2 and orders under 10 in value are skipped.
    """
    df = orders.drop("price").join(held.select("ticker"), "ticker", "left_anti").join(prices.select("ticker", "price"), "ticker")
    df = df.withColumn("notional", F.lit(float(buying_power)) * F.col("position_size_pct"))
    df = df.where((F.col("price") >= MIN_PRICE) & (F.col("notional") >= MIN_NOTIONAL))
    p, long = F.col("price"), F.col("direction") == "long"
    a = F.coalesce(F.nullif(F.col("atr"), F.lit(0.0)), p * 0.03)
    side = F.when(long, 1.0).otherwise(-1.0)
    stop = F.coalesce(F.nullif(F.col("stop_loss"), F.lit(0.0)), p - side * 2.0 * a)
    target = F.coalesce(F.nullif(F.col("take_profit"), F.lit(0.0)), p + side * 3.0 * a)
    stop = F.when((stop - p) * side >= 0, p * (1 - side * 0.05)).otherwise(stop)
    target = F.when((target - p) * side <= 0, p * (1 + side * 0.10)).otherwise(target)
    return df.withColumns({"stop_loss": stop, "take_profit": target})


def fill_outcomes(journal: DataFrame, bars: DataFrame, h: int = 5) -> DataFrame:
    """Fill open journal rows whose exit bar (h rows after the entry bar) exists.

    Rows that already have an outcome, or whose exit lies ahead, stay as they are.
    """
    # only what the look-up needs travels through it; rows are matched by ticker and day
    day = F.to_date(F.try_to_timestamp("timestamp"))
    due = journal.where("actual_return IS NULL AND entry_price > 0").select("ticker", day.alias("date")).where("date IS NOT NULL").distinct()
    exits = nth_bar_after(due, bars, h).select("ticker", F.col("date").alias("__day"), F.col("exit_date").alias("__xd"), F.col("exit_price").alias("__xp"))
    j = journal.withColumn("__day", day).join(exits, ["ticker", "__day"], "left")
    fill = F.col("actual_return").isNull() & (F.col("entry_price") > 0) & F.col("__xp").isNotNull()
    gain = (F.col("__xp") - F.col("entry_price")) / F.col("entry_price")
    gain = F.when(F.lower("direction") == "short", -gain).otherwise(gain)
    out = {
        "actual_return": F.when(fill, gain).otherwise(F.col("actual_return")),
        "exit_price": F.when(fill, F.col("__xp")).otherwise(F.col("exit_price")),
        "exit_timestamp": F.when(fill, F.date_format("__xd", "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.col("exit_timestamp")),
        "exit_reason": F.when(fill, F.lit("time_exit")).otherwise(F.col("exit_reason")),
    }
    return j.select(*[out[c].alias(c) if c in out else F.col(c) for c in journal.columns])


def mid_price(quotes: DataFrame, bars: DataFrame, tickers: DataFrame) -> DataFrame:
    """Mean of bid and ask, else the one there is, else the last close."""
    last = bars.groupBy("ticker").agg(F.max_by("close", "date").alias("__close"))
    j = tickers.select("ticker").join(quotes.select("ticker", "bid", "ask"), "ticker", "left").join(last, "ticker", "left")
    bid, ask = F.coalesce("bid", F.lit(0.0)), F.coalesce("ask", F.lit(0.0))
    quoted = F.when((ask > 0) & (bid > 0), half_away((ask + bid) / 2.0, 4)).when(ask > 0, ask).when(bid > 0, bid)
    return j.select("ticker", F.coalesce(quoted, F.col("__close")).alias("price"))


def equity_snapshots(events: DataFrame, benchmark: DataFrame, ts: str = "ts") -> DataFrame:
    """The last account state of each day, profit of the day, and growth against a benchmark.

    ``events`` (ts, equity, cash, open_positions), ``benchmark`` (date, close).
    """
    daily = events.groupBy(F.to_date(ts).alias("date")).agg(F.max_by(F.struct("equity", "cash", "open_positions"), ts).alias("__s"))
    w = Window.partitionBy(F.lit(0)).orderBy("date")  # one row per date
    d = daily.select("date", half_away("__s.equity", 2).alias("equity"), half_away("__s.cash", 2).alias("cash"), F.col("__s.open_positions").alias("open_positions"))
    d = d.withColumn("pnl_today", F.coalesce(half_away(F.col("equity") - F.lag("equity").over(w), 2), F.lit(0.0)))
    d = d.join(F.broadcast(benchmark.select("date", F.col("close").alias("__b"))), "date", "left")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("__b", F.last("__b", ignorenulls=True).over(run))
    own = div("equity", F.first("equity").over(run)) - 1
    ref = div("__b", F.first("__b", ignorenulls=True).over(run)) - 1
    return d.withColumns({"return_pct": own, "benchmark_pct": ref, "alpha": own - ref}).drop("__b")


def open_positions(positions: DataFrame, signals: DataFrame) -> DataFrame:
    """Open positions with value, unrealised profit and the current signal.

    ``positions`` (ticker, qty, avg_entry_price, current_price), ``signals`` (ticker, predicted_return, …).
    """
    q, entry, now = F.col("qty"), F.col("avg_entry_price"), F.col("current_price")
    p = positions.where(q != 0).withColumns(
        {
            "side": F.when(q > 0, "long").otherwise("short"),
            "market_value": q * now,
            "unrealized_pl": q * (now - entry),
            "unrealized_plpc": div(F.signum(q) * (now - entry) * 100, entry),
        }
    )
    j = p.join(signals, "ticker", "left")
    agree = F.when(F.col("predicted_return").isNotNull(), F.signum("predicted_return") == F.signum(q))
    return j.withColumn("signal_agrees", agree)
