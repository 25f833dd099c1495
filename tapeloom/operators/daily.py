"""Daily features: one row per (ticker, date), all on one ticker exchange."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cleaning import clean
from ..functions.core import EPS, TRADING_DAYS, add_all, clip, div, lag_or_first, pct_change, rolling, rows, series, sma
from ..functions.scan import add_grid, ema_many, rolling_moments, span_alpha, wilder_many, wilder_seed

ANNUAL = math.sqrt(TRADING_DAYS)
PRICES = ("open", "high", "low", "close", "volume")
RETURN_HORIZONS = (1, 2, 5, 10, 20)


def returns(df: DataFrame, horizons=RETURN_HORIZONS) -> DataFrame:
    """Simple returns over several horizons and the one-day log return."""
    w = series()
    out = {f"return_{h}d": pct_change("close", h, w) for h in horizons}
    out["log_return_1d"] = F.log(div("close", F.lag("close", 1).over(w)))
    return df.withColumns(out)


def _floor(c: str) -> Column:
    return F.greatest(F.col(c), F.lit(EPS))


def _ret1(df: DataFrame) -> DataFrame:
    return df.withColumn("__r1", pct_change(_floor("close"), 1, series()))


def _std0(c: str, w: Window, n: int) -> Column:
    """Sample deviation of the last n rows, 0 while undefined."""
    return F.coalesce(F.stddev_samp(c).over(rows(w, n)), F.lit(0.0))


def realized_vol(df: DataFrame, windows=(5, 10, 20, 60)) -> DataFrame:
    """Annualised deviation of daily returns, 0 at the head."""
    w = series()
    return _ret1(df).withColumns({f"realized_vol_{n}d": _std0("__r1", w, n) * ANNUAL for n in windows}).drop("__r1")


def parkinson_vol(df: DataFrame, windows=(10, 20)) -> DataFrame:
    """D3: high-low range volatility."""
    w = series()
    df = df.withColumn("__pk", F.pow(F.log(_floor("high") / _floor("low")), F.lit(2.0)) / (4 * math.log(2)))
    mean = {n: F.coalesce(rolling(F.avg, "__pk", w, n, 2), F.lit(0.0)) for n in windows}
    return df.withColumns({f"parkinson_vol_{n}d": F.sqrt(m * TRADING_DAYS) for n, m in mean.items()}).drop("__pk")


def garman_klass_vol(df: DataFrame, windows=(10, 20)) -> DataFrame:
    """Open-high-low-close volatility."""
    w = series()
    hl, co = F.log(_floor("high") / _floor("low")), F.log(_floor("close") / _floor("open"))
    df = df.withColumn("__gk", hl * hl * 0.5 - co * co * (2 * math.log(2) - 1))
    mean = {n: F.coalesce(rolling(F.avg, "__gk", w, n, 2), F.lit(0.0)) for n in windows}
    return df.withColumns({f"gk_vol_{n}d": F.sqrt(F.abs(m) * TRADING_DAYS) for n, m in mean.items()}).drop("__gk")


def vol_ratio(df: DataFrame, short: int = 5, long: int = 60) -> DataFrame:
    """Short over long realised volatility."""
    w = series()
    ratio = (_std0("__r1", w, short) + EPS) / (_std0("__r1", w, long) + EPS)
    return _ret1(df).withColumn(f"vol_ratio_{short}_{long}", ratio).drop("__r1")


def sma_features(df: DataFrame, windows=(10, 20, 50, 200), slopes=(20, 50)) -> DataFrame:
    """Distance from moving averages and their five-row change."""
    w = series()
    need = sorted(set(windows) | set(slopes))
    df = df.withColumns({f"__sma{n}": sma("close", w, n) for n in need})
    out = {f"sma_{n}_dist": div(F.col("close") - F.col(f"__sma{n}"), F.col(f"__sma{n}") + EPS) for n in windows}
    out |= {f"sma_{n}_slope": F.coalesce(pct_change(f"__sma{n}", 5, w), F.lit(0.0)) for n in slopes}
    return df.withColumns(out).drop(*[f"__sma{n}" for n in need])


def price_position(df: DataFrame, windows=(20, 60)) -> DataFrame:
    """Where the close lies in the n-day range."""
    w = series()
    out = {}
    for n in windows:
        hi, lo = F.max("high").over(rows(w, n)), F.min("low").over(rows(w, n))
        out[f"price_position_{n}d"] = (F.col("close") - lo) / (hi - lo + EPS)
    return df.withColumns(out)


def true_range(df: DataFrame, out: str = "tr", order: str = "date") -> DataFrame:
    prev = lag_or_first("close", 1, series(order=order))
    high, low = F.col("high"), F.col("low")
    return df.withColumn(out, F.greatest(high - low, F.abs(high - prev), F.abs(low - prev)))


def atr(df: DataFrame, period: int = 14) -> DataFrame:
    """True range, its EMA, and the EMA over the close."""
    df = ema_many(true_range(df), {"atr": ("tr", span_alpha(period))})
    return df.withColumn("atr_norm", F.col("atr") / (F.col("close") + EPS))


def adx(df: DataFrame, period: int = 14, order: str = "date") -> DataFrame:
    """Trend strength ``adx`` in [0, 1] and signed ``di_diff``; ties count as down."""
    w = series(order=order)
    up = F.greatest(F.col("high") - lag_or_first("high", 1, w), F.lit(0.0))
    down = F.greatest(lag_or_first("low", 1, w) - F.col("low"), F.lit(0.0))
    df = true_range(df, "__tr", order).withColumns({"__up": up, "__dn": down})
    df = df.withColumns(
        {
            "__dmp": F.when(F.col("__up") > F.col("__dn"), F.col("__up")).otherwise(0.0),
            "__dmm": F.when(F.col("__up") > F.col("__dn"), 0.0).otherwise(F.col("__dn")),
        }
    )
    a = span_alpha(period)
    df = ema_many(df, {"__atr": ("__tr", a), "__ep": ("__dmp", a), "__em": ("__dmm", a)}, order=order)
    plus, minus = 100 * F.col("__ep") / (F.col("__atr") + EPS), 100 * F.col("__em") / (F.col("__atr") + EPS)
    df = df.withColumns({"__p": plus, "__m": minus})
    df = df.withColumn("__dx", 100 * F.abs(F.col("__p") - F.col("__m")) / (F.col("__p") + F.col("__m") + EPS))
    df = ema_many(df, {"__adx": ("__dx", a)}, order=order)
    return df.withColumns({"adx": F.col("__adx") / 100, "di_diff": (F.col("__p") - F.col("__m")) / 100}).drop(
        "__tr", "__up", "__dn", "__dmp", "__dmm", "__atr", "__ep", "__em", "__p", "__m", "__dx", "__adx"
    )


def rsi(df: DataFrame, period: int = 14, undefined_rs: float = 1.0, out: str = "rsi", scale: float = 100.0,
        order: str = "date") -> DataFrame:
    """Wilder RSI over ``scale``.

    ``undefined_rs`` stands in for the gain/loss ratio at the head and where
    there is no loss.
    """
    delta = F.col("close") - lag_or_first("close", 1, series(order=order))
    df = df.withColumns({"__g": F.greatest(delta, F.lit(0.0)), "__d": F.greatest(-delta, F.lit(0.0))})
    df = wilder_many(df, {"__ag": "__g", "__al": "__d"}, period, order=order)
    rs = F.when(F.col("__al") > 0, F.col("__ag") / F.col("__al")).otherwise(float(undefined_rs))
    return df.withColumn(out, (100.0 - 100.0 / (1.0 + rs)) / scale).drop("__g", "__d", "__ag", "__al")


def macd_lines(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, key="ticker", order="date") -> DataFrame:
    """MACD line, signal and histogram in price units: ``macd, macd_signal, macd_hist``."""
    df = ema_many(df, {"__f": ("close", span_alpha(fast)), "__s": ("close", span_alpha(slow))}, key, order)
    df = df.withColumn("macd", F.col("__f") - F.col("__s"))
    df = ema_many(df, {"macd_signal": ("macd", span_alpha(signal))}, key, order)
    return df.withColumn("macd_hist", F.col("macd") - F.col("macd_signal")).drop("__f", "__s")


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """MACD line, signal and histogram over the close."""
    close = F.col("close") + EPS
    return macd_lines(df, fast, slow, signal).withColumns(
        {
            "macd_norm": F.col("macd") / close,
            "macd_signal_norm": F.col("macd_signal") / close,
            "macd_hist_norm": F.col("macd_hist") / close,
        }
    ).drop("macd", "macd_signal", "macd_hist")


def stochastic_williams(df: DataFrame, n: int = 14) -> DataFrame:
    """Stochastic %K and %D, Williams %R."""
    w = series()
    hi, lo = F.max("high").over(rows(w, n)), F.min("low").over(rows(w, n))
    df = df.withColumns({"__hi": hi, "__lo": lo})
    span = F.col("__hi") - F.col("__lo") + EPS
    df = df.withColumns({f"stoch_k_{n}": (F.col("close") - F.col("__lo")) / span, "williams_r": -(F.col("__hi") - F.col("close")) / span})
    return df.withColumn(f"stoch_d_{n}", sma(f"stoch_k_{n}", w, 3)).drop("__hi", "__lo")


def rate_of_change(df: DataFrame, horizons=(5, 10, 20)) -> DataFrame:
    """Change against h rows before, 0 at the head."""
    w = series()
    out = {}
    for h in horizons:
        prev = F.lag("close", h).over(w)
        out[f"roc_{h}d"] = F.coalesce(div(F.col("close") - prev, prev + EPS), F.lit(0.0))
    return df.withColumns(out)


def volume_ratios(df: DataFrame, windows=(5, 20)) -> DataFrame:
    """Volume over its moving averages, and its five-row change."""
    w = series()
    out = {f"vol_ratio_{n}d": F.col("volume") / (sma("volume", w, n) + 1) for n in windows}
    out["vol_change_5d"] = F.coalesce(pct_change("volume", 5, w), F.lit(0.0))
    return df.withColumns(out)


def obv_slope(df: DataFrame, n: int = 20) -> DataFrame:
    """Five-row change of the smoothed on-balance volume."""
    w = series()
    step = F.coalesce(F.signum(F.col("close") - F.lag("close", 1).over(w)) * F.col("volume"), F.lit(0.0))
    df = df.withColumn("__step", step)
    df = df.withColumn("__obv", F.sum("__step").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumn("__obvs", sma("__obv", w, n))
    return df.withColumn("obv_slope", F.coalesce(pct_change("__obvs", 5, w), F.lit(0.0))).drop("__step", "__obv", "__obvs")


def vwap_distance(df: DataFrame, offset: float = 1.0) -> DataFrame:
    """Distance of the close from the running volume-weighted price."""
    run = series().rowsBetween(Window.unboundedPreceding, 0)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    df = df.withColumn("__vwap", F.sum(typical * F.col("volume")).over(run) / (F.sum("volume").over(run) + offset))
    return df.withColumn("vwap_dist", div(F.col("close") - F.col("__vwap"), F.col("__vwap") + EPS)).drop("__vwap")


def candle_features(df: DataFrame, with_atr: bool = True) -> DataFrame:
    """Body, shadows, gap, normalised ATR (unless the table has it) and relative range."""
    w = series()
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    span = h - l + EPS
    prev = F.lag("close", 1).over(w)
    keep = df.columns
    df = df.withColumns(
        {
            "body_ratio": (c - o) / span,
            "upper_shadow": (h - F.greatest(c, o)) / span,
            "lower_shadow": (F.least(c, o) - l) / span,
            "gap": F.coalesce(div(o - prev, prev + EPS), F.lit(0.0)),
            "__range": (h - l) / (c + EPS),
        }
    )
    df = df.withColumn("range_ratio", F.col("__range") / (sma("__range", w, 20) + EPS))
    if with_atr:
        df = ema_many(true_range(df, "__tr"), {"__atr": ("__tr", span_alpha(14))})
        df = df.withColumn("atr_norm", F.col("__atr") / (c + EPS))
    return df.select(*[k for k in keep if k not in CANDLE], *CANDLE)


CANDLE = ["body_ratio", "upper_shadow", "lower_shadow", "gap", "atr_norm", "range_ratio"]


def calendar_features(df: DataFrame, date: str = "date") -> DataFrame:
    """Weekday and month on the circle, turn of the month."""
    dow, month, day = F.weekday(date), F.month(date), F.dayofmonth(date)
    return df.withColumns(
        {
            "dow_sin": F.sin(2 * math.pi * dow / 5),
            "dow_cos": F.cos(2 * math.pi * dow / 5),
            "month_sin": F.sin(2 * math.pi * month / 12),
            "month_cos": F.cos(2 * math.pi * month / 12),
            "turn_of_month": F.when((day <= 3) | (day >= 28), 1.0).otherwise(0.0),
        }
    )


# Names of the raw-plus features.
RAW_PLUS = [
    "log_ret_1d", "log_ret_5d", "log_ret_20d", "real_vol_5d", "real_vol_20d", "vol_regime", "rsi", "vwap_dist",
    "rel_vol", "atr_norm", "gap", "body_ratio", "dow_sin", "dow_cos", "month_sin", "month_cos", "turn_of_month",
]


def raw_plus_features(df: DataFrame) -> DataFrame:
    """The compact stationary set of 17 columns.

    Row 0 measures range and gap against its own close; there is no earlier one.
    """
    w = series()
    base = df.columns
    df = df.withColumn("__r1", F.coalesce(pct_change("close", 1, w), F.lit(0.0)))
    out = {}
    for h in (1, 5, 20):
        prev = F.lag("close", h).over(w)
        out[f"log_ret_{h}d"] = F.coalesce(F.when(prev > 0, F.log(div("close", prev))), F.lit(0.0))
    for n in (5, 20):
        out[f"real_vol_{n}d"] = _std0("__r1", w, n) * ANNUAL
    out["vol_regime"] = (_std0("__r1", w, 5) + EPS) / (_std0("__r1", w, 60) + EPS)
    out["rel_vol"] = F.col("volume") / (sma("volume", w, 20) + 1.0)
    out["body_ratio"] = (F.col("close") - F.col("open")) / (F.col("high") - F.col("low") + EPS)
    prev = F.lag("close", 1).over(w)
    out["gap"] = F.coalesce(div(F.col("open") - prev, prev + EPS), F.lit(0.0))
    df = df.withColumns(out)
    df = vwap_distance(df, EPS)
    df = rsi(df, 14, 1.0, "__rsi", scale=1.0).withColumn("rsi", F.col("__rsi") / 50.0 - 1.0)
    df = ema_many(true_range(df, "__tr"), {"__atr": ("__tr", span_alpha(14))})
    df = df.withColumn("atr_norm", F.col("__atr") / (F.col("close") + EPS))
    return clean(calendar_features(df), RAW_PLUS).select(*base, *RAW_PLUS)


RECURSIVE = ["adx", "di_diff", "rsi", "macd_norm", "macd_signal_norm", "macd_hist_norm", "atr_norm"]


def recursive_features(df: DataFrame, period: int = 14) -> DataFrame:
    """All recursive indicators of the full set (D8-D11) in three passes over one sort.

    The single operators sort the series once each; here all averages of prices
    share a pass, then all averages of averages.
    """
    w = series()
    base = df.columns
    a = span_alpha(period)
    up = F.greatest(F.col("high") - lag_or_first("high", 1, w), F.lit(0.0))
    down = F.greatest(lag_or_first("low", 1, w) - F.col("low"), F.lit(0.0))
    delta = F.col("close") - lag_or_first("close", 1, w)
    df = true_range(df, "__tr").withColumns({"__up": up, "__dn": down, "__g": F.greatest(delta, F.lit(0.0)), "__d": F.greatest(-delta, F.lit(0.0))})
    rising = F.col("__up") > F.col("__dn")
    df, _ = add_grid(df.withColumns({"__dmp": F.when(rising, F.col("__up")).otherwise(0.0), "__dmm": F.when(rising, 0.0).otherwise(F.col("__dn"))}))
    df = df.withColumns({"__sg": wilder_seed("__g", period), "__sl": wilder_seed("__d", period), "__p": F.col("__t") - period})
    df = ema_many(df, {
        "__atr": ("__tr", a), "__ep": ("__dmp", a), "__em": ("__dmm", a), "__f": ("close", span_alpha(12)), "__s": ("close", span_alpha(26)),
    }, pos="__t")
    df = ema_many(df, {"__ag": ("__sg", 1.0 / period), "__al": ("__sl", 1.0 / period)}, pos="__p", grid="__t")
    df = df.withColumns({
        "__plus": 100 * F.col("__ep") / (F.col("__atr") + EPS), "__minus": 100 * F.col("__em") / (F.col("__atr") + EPS), "__macd": F.col("__f") - F.col("__s"),
    })
    df = df.withColumn("__dx", 100 * F.abs(F.col("__plus") - F.col("__minus")) / (F.col("__plus") + F.col("__minus") + EPS))
    df = ema_many(df, {"__adx": ("__dx", a), "__sig": ("__macd", span_alpha(9))}, pos="__t")
    close = F.col("close") + EPS
    rs = F.when(F.col("__al") > 0, F.col("__ag") / F.col("__al")).otherwise(1.0)
    out = {
        "adx": F.col("__adx") / 100,
        "di_diff": (F.col("__plus") - F.col("__minus")) / 100,
        "rsi": (100.0 - 100.0 / (1.0 + rs)) / 100.0,
        "macd_norm": F.col("__macd") / close,
        "macd_signal_norm": F.col("__sig") / close,
        "macd_hist_norm": (F.col("__macd") - F.col("__sig")) / close,
        "atr_norm": F.col("__atr") / close,
    }
    return df.withColumns(out).select(*base, *RECURSIVE)


def frame_features(df: DataFrame) -> DataFrame:
    """All other windows of the full set (D1-D7, D12-D17) in four passes over one sort.

    A pass holds every frame and lag that needs no result of its own, and frames of 50,
    60 and 200 rows are put together from those of 10, 20 and 50 rows further back:
    Spark re-adds a sliding frame for every row.
    """
    w, base = series(), df.columns
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    c, o, h, l, v = (F.col(x) for x in ("close", "open", "high", "low", "volume"))

    def back(x: str, *steps: int) -> list[Column]:
        return [F.col(x), *[F.lag(x, n).over(w) for n in steps]]

    def total(x: str, *steps: int) -> Column:
        return add_all([F.coalesce(y, F.lit(0)) for y in back(x, *steps)])

    def mean(x: str, n: int) -> Column:
        return F.coalesce(F.when(F.col(f"__k{x}{n}") >= max(1, n // 2), F.try_divide(F.col(f"__s{x}{n}"), F.col(f"__k{x}{n}"))), F.col(f"__a{x}"))

    def sums(x: str, column: str, windows) -> dict[str, Column]:
        return {f"__{p}{x}{n}": f(column).over(rows(w, n)) for n in windows for p, f in (("s", F.sum), ("k", F.count))}

    hl, co = F.log(_floor("high") / _floor("low")), F.log(_floor("close") / _floor("open"))
    df = df.withColumns({
        "__pk": F.pow(hl, F.lit(2.0)) / (4 * math.log(2)), "__gk": hl * hl * 0.5 - co * co * (2 * math.log(2) - 1),
        "__range": (h - l) / (c + EPS), "__fc": _floor("close"), "__tv": (h + l + c) / 3 * v,
    })
    first = {f"__c{n}": F.lag("close", n).over(w) for n in RETURN_HORIZONS}
    first |= {"__pfc": F.lag("__fc", 1).over(w), "__v5": F.lag("volume", 5).over(w), "__stv": F.sum("__tv").over(run), "__sv": F.sum("volume").over(run)}
    first |= sums("p", "__pk", (10, 20)) | sums("g", "__gk", (10, 20)) | sums("c", "close", (10, 20)) | sums("v", "volume", (5, 20)) | sums("r", "__range", (20,))
    first |= {f"__a{x}": F.avg(y).over(run) for x, y in (("c", "close"), ("v", "volume"), ("r", "__range"))}
    first |= {f"__{p}{n}": f(x).over(rows(w, n)) for n in (14, 20) for p, f, x in (("hi", F.max, "high"), ("lo", F.min, "low"))}
    df = df.withColumns(first)
    span = F.col("__hi14") - F.col("__lo14") + EPS
    df = df.withColumns({
        "__r1": div("__fc", "__pfc") - 1.0, "__step": F.coalesce(F.signum(c - F.col("__c1")) * v, F.lit(0.0)),
        "__m20": mean("c", 20), "stoch_k_14": (c - F.col("__lo14")) / span, "williams_r": -(F.col("__hi14") - c) / span,
    })
    second = {f"__d{n}": F.stddev_samp("__r1").over(rows(w, n)) for n in (5, 10, 20)}
    second |= {"__vq": F.var_pop("__r1").over(rows(w, 20)), "__mq": F.avg("__r1").over(rows(w, 20)), "__kq": F.count("__r1").over(rows(w, 20))}
    second |= {f"__{p}c50": total(f"__{p}c10", 10, 20, 30, 40) for p in "sk"}
    second |= {"__hi60": F.greatest(*back("__hi20", 20, 40)), "__lo60": F.least(*back("__lo20", 20, 40)), "__obv": F.sum("__step").over(run),
               "stoch_d_14": sma("stoch_k_14", w, 3), "__m20b": F.lag("__m20", 5).over(w)}
    df = df.withColumns(second).withColumn("__m50", mean("c", 50))
    third = {f"__{p}c200": total(f"__{p}c50", 50, 100, 150) for p in "sk"}
    third |= {f"__{p}q{n}": F.lag(f"__{p}q", n).over(w) for n in (20, 40) for p in "vmk"}
    third |= {"__obvs": sma("__obv", w, 20), "__m50b": F.lag("__m50", 5).over(w)}
    df = df.withColumns(third)
    parts = [(F.coalesce(F.col(f"__kq{n}"), F.lit(0)).cast("double"), F.coalesce(F.col(f"__mq{n}"), F.lit(0.0)), F.coalesce(F.col(f"__vq{n}"), F.lit(0.0))) for n in ("", 20, 40)]
    df = df.withColumns({"__k60": add_all([k for k, _, _ in parts]), "__s60": add_all([k * m for k, m, _ in parts])})
    middle = F.try_divide("__s60", "__k60")
    squares = add_all([k * (x + (m - middle) * (m - middle)) for k, m, x in parts])
    df = df.withColumns({"__d60": F.when(F.col("__k60") > 1, F.sqrt(squares / (F.col("__k60") - 1))), "__obvb": F.lag("__obvs", 5).over(w)})
    vwap = F.col("__stv") / (F.col("__sv") + 1.0)
    out = {f"return_{n}d": div(c, f"__c{n}") - 1.0 for n in RETURN_HORIZONS}
    out["log_return_1d"] = F.log(div(c, "__c1"))
    out |= {f"realized_vol_{n}d": F.coalesce(F.col(f"__d{n}"), F.lit(0.0)) * ANNUAL for n in (5, 10, 20, 60)}
    out["vol_ratio_5_60"] = (F.coalesce("__d5", F.lit(0.0)) + EPS) / (F.coalesce("__d60", F.lit(0.0)) + EPS)
    for n in (10, 20):
        pk, gk = (F.coalesce(F.when(F.col(f"__k{x}{n}") >= 2, F.try_divide(F.col(f"__s{x}{n}"), F.col(f"__k{x}{n}"))), F.lit(0.0)) for x in "pg")
        out |= {f"parkinson_vol_{n}d": F.sqrt(pk * TRADING_DAYS), f"gk_vol_{n}d": F.sqrt(F.abs(gk) * TRADING_DAYS)}
    out |= {f"sma_{n}_dist": div(c - m, m + EPS) for n, m in ((10, mean("c", 10)), (20, F.col("__m20")), (50, F.col("__m50")), (200, mean("c", 200)))}
    out |= {f"sma_{n}_slope": F.coalesce(div(f"__m{n}", f"__m{n}b") - 1.0, F.lit(0.0)) for n in (20, 50)}
    out |= {f"price_position_{n}d": (c - F.col(f"__lo{n}")) / (F.col(f"__hi{n}") - F.col(f"__lo{n}") + EPS) for n in (20, 60)}
    out |= {f"roc_{n}d": F.coalesce(div(c - F.col(f"__c{n}"), F.col(f"__c{n}") + EPS), F.lit(0.0)) for n in (5, 10, 20)}
    out |= {f"vol_ratio_{n}d": v / (mean("v", n) + 1) for n in (5, 20)}
    out |= {
        "vol_change_5d": F.coalesce(div(v, "__v5") - 1.0, F.lit(0.0)),
        "obv_slope": F.coalesce(div("__obvs", "__obvb") - 1.0, F.lit(0.0)),
        "vwap_dist": div(c - vwap, vwap + EPS),
        "body_ratio": (c - o) / (h - l + EPS), "upper_shadow": (h - F.greatest(c, o)) / (h - l + EPS), "lower_shadow": (F.least(c, o) - l) / (h - l + EPS),
        "gap": F.coalesce(div(o - F.col("__c1"), F.col("__c1") + EPS), F.lit(0.0)),
        "range_ratio": F.col("__range") / (mean("r", 20) + EPS),
    }
    return df.select(*base, "stoch_k_14", "stoch_d_14", "williams_r", *[x.alias(n) for n, x in out.items()])


# Groups of feature names.
GROUPS = {
    "returns": ([returns], [*[f"return_{h}d" for h in RETURN_HORIZONS], "log_return_1d"]),
    "volatility": (
        [realized_vol, parkinson_vol, garman_klass_vol, vol_ratio],
        ["realized_vol_5d", "realized_vol_10d", "realized_vol_20d", "realized_vol_60d", "parkinson_vol_10d",
         "parkinson_vol_20d", "gk_vol_10d", "gk_vol_20d", "vol_ratio_5_60"],
    ),
    "trend": (
        [sma_features, price_position, adx],
        ["sma_10_dist", "sma_20_dist", "sma_50_dist", "sma_200_dist", "sma_20_slope", "sma_50_slope",
         "price_position_20d", "price_position_60d", "adx", "di_diff"],
    ),
    "momentum": (
        [rsi, macd, stochastic_williams, rate_of_change],
        ["rsi", "macd_norm", "macd_signal_norm", "macd_hist_norm", "stoch_k_14", "stoch_d_14", "williams_r",
         "roc_5d", "roc_10d", "roc_20d"],
    ),
    "volume": ([volume_ratios, obv_slope, vwap_distance],
               ["vol_ratio_5d", "vol_ratio_20d", "vol_change_5d", "obv_slope", "vwap_dist"]),
    "microstructure": ([candle_features], CANDLE),
    "calendar": ([calendar_features], ["dow_sin", "dow_cos", "month_sin", "month_cos", "turn_of_month"]),
}


def feature_names(groups=tuple(GROUPS), feature_set: str = "full") -> list[str]:
    return list(RAW_PLUS) if feature_set == "raw_plus" else [c for g in groups for c in GROUPS[g][1]]


def daily_features(df: DataFrame, groups=tuple(GROUPS), feature_set: str = "full") -> DataFrame:
    """The whole feature table, cleaned; ``groups`` switches parts off.

    All steps window over the ticker, so the plan has a single exchange.
    """
    missing = [c for c in PRICES if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    if feature_set == "raw_plus":
        return raw_plus_features(df)
    names, base = feature_names(groups), df.columns
    together = {"trend", "momentum", "microstructure"} <= set(groups)
    if together:
        df = recursive_features(df)  # first, while the rows it sorts are narrow
    if set(GROUPS) <= set(groups):
        return clean(calendar_features(frame_features(df)), names).select(*base, *names)
    for g in groups:
        for step in GROUPS[g][0]:
            if together and step in (adx, rsi, macd):
                continue
            if step is vol_ratio and "realized_vol_5d" in df.columns:
                # both volatilities are in the table already, annualised
                df = df.withColumn("vol_ratio_5_60", (F.col("realized_vol_5d") / ANNUAL + EPS) / (F.col("realized_vol_60d") / ANNUAL + EPS))
                continue
            df = step(df, with_atr=False) if together and step is candle_features else step(df)
    return clean(df, names).select(*base, *names)


def rolling_zscore(df: DataFrame, cols: list[str], window: int = 252, limit: float = 5.0, warmup: str = "global",
                   eps_mode: str = "clip", key="ticker", order="date") -> DataFrame:
    """Rolling z-score per ticker, clamped to +-limit.

    Rows with fewer than window//2 values use the mean and deviation of the whole
    series (``warmup='global'``, which looks ahead) or yield NULL
    (``warmup='null'``).  ``eps_mode`` is 'add' (std + 1e-10) or 'clip' (std at
    least 1e-8).
    """
    keys = [key] if isinstance(key, str) else list(key)
    w, every = series(key, order), Window.partitionBy(*keys)
    least = max(2, window // 2)
    df = rolling_moments(df, {c: [window] for c in cols}, key, order)
    known = {c: F.col(f"__k_{c}_{window}") >= least for c in cols}
    stats = {f"__m_{c}": F.when(known[c], F.col(f"__m_{c}_{window}")) for c in cols}
    stats |= {f"__s_{c}": F.when(known[c], F.col(f"__d_{c}_{window}")) for c in cols}
    df = df.withColumns(stats)
    extra = [f"__{p}_{c}_{window}" for c in cols for p in "mdk"]
    out = {}
    for c in cols:
        mean, std = F.col(f"__m_{c}"), F.col(f"__s_{c}")
        if warmup == "global":
            g = F.stddev_samp(c).over(every)
            mean = F.coalesce(mean, F.avg(c).over(every))
            std = F.coalesce(std, F.when(g > 1e-8, g).otherwise(1.0))
        std = std + EPS if eps_mode == "add" else F.greatest(std, F.lit(1e-8))
        z = clip((F.col(c) - mean) / std, -limit, limit)
        known = std.isNotNull() if warmup == "global" else (mean.isNotNull() & F.col(f"__s_{c}").isNotNull())
        out[c] = F.coalesce(z, F.lit(0.0)) if warmup == "global" else F.when(known, z)
    return df.withColumns(out).drop(*stats, *extra)


def atr_stops(df: DataFrame, period: int = 14, stop_mult: float = 2.0, target_mult: float = 3.0) -> DataFrame:
    """Last close of each ticker with ATR based stop and target for both directions.

    ATR is the plain mean of the last ``period`` true ranges.
    """
    w = series()
    prev = F.lag("close", 1).over(w)
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))
    ranked = df.withColumn("__tr", tr).withColumn("__r", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date"))))
    last = ranked.where(F.col("__r") <= period).groupBy("ticker").agg(
        F.max_by("close", "date").alias("price"),
        F.when(F.count("__tr") == period, F.avg("__tr")).alias("atr"),
    )
    p, a = F.col("price"), F.col("atr")
    return last.select(
        "ticker", "price", "atr",
        (p - stop_mult * a).alias("long_stop"), (p + target_mult * a).alias("long_target"),
        (p + stop_mult * a).alias("short_stop"), (p - target_mult * a).alias("short_target"),
    )
