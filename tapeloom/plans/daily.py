"""Daily feature queries (D1-D22) and the recursive smoothers."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import scan
from ..functions.core import half_away, rounded
from ..operators import daily as D
from ..sources import tables as T
from .registry import query, r6, rounds
from .sql import BARS, NUM, lag, pct, run, sma, std0, win

EPS = "1e-10"
A252 = "sqrt(252.0)"


def _out(df, cols, digits=6):
    return rounded(df.select("ticker", "date", *cols), digits)


# --- windows -----------------------------------------------------------------

R1 = ", r AS (SELECT *, {0} AS r1 FROM bars)".format(pct("close", 1))
RET = [f"return_{h}d" for h in D.RETURN_HORIZONS] + ["log_return_1d"]


@query("D1_returns", f"WITH {BARS} SELECT ticker, date, "
       + ", ".join(r6(pct("close", h), f"return_{h}d") for h in D.RETURN_HORIZONS)
       + ", " + r6(f"ln(close / {lag('close')})", "log_return_1d") + " FROM bars")
def d1(spark, sf):
    return _out(D.returns(T.bars_daily(spark, sf)), RET)


@query("D2_realized_vol", f"WITH {BARS}{R1} SELECT ticker, date, "
       + ", ".join(r6(f"{std0('r1', n)} * {A252}", f"realized_vol_{n}d") for n in (5, 10, 20, 60)) + " FROM r")
def d2(spark, sf):
    return _out(D.realized_vol(T.bars_daily(spark, sf)), [f"realized_vol_{n}d" for n in (5, 10, 20, 60)])


def _mean2(c, n):
    return f"coalesce(CASE WHEN count({c}) {win(n)} >= 2 THEN avg({c}) {win(n)} END, 0.0)"


@query("D3_parkinson_vol", f"WITH {BARS}, p AS (SELECT *, ln(high / low) ** 2 / (4 * ln(2)) AS pk FROM bars) SELECT ticker, date, "
       + ", ".join(r6(f"sqrt({_mean2('pk', n)} * 252)", f"parkinson_vol_{n}d") for n in (10, 20)) + " FROM p")
def d3(spark, sf):
    return _out(D.parkinson_vol(T.bars_daily(spark, sf)), ["parkinson_vol_10d", "parkinson_vol_20d"])


@query("D4_garman_klass_vol", f"WITH {BARS}, p AS (SELECT *, CAST(0.5 AS DOUBLE) * ln(high / low) ** 2 - (2 * ln(2) - 1) * ln(close / open) ** 2 AS gk FROM bars) SELECT ticker, date, "
       + ", ".join(r6(f"sqrt(abs({_mean2('gk', n)}) * 252)", f"gk_vol_{n}d") for n in (10, 20)) + " FROM p")
def d4(spark, sf):
    return _out(D.garman_klass_vol(T.bars_daily(spark, sf)), ["gk_vol_10d", "gk_vol_20d"])


@query("D5_vol_ratio", f"WITH {BARS}{R1} SELECT ticker, date, "
       + r6(f"({std0('r1', 5)} + {EPS}) / ({std0('r1', 60)} + {EPS})", "vol_ratio_5_60") + " FROM r")
def d5(spark, sf):
    return _out(D.vol_ratio(T.bars_daily(spark, sf)), ["vol_ratio_5_60"])


SMAS = (10, 20, 50, 200)
SMA_CTE = ", s AS (SELECT *, " + ", ".join(f"{sma('close', n)} AS sma{n}" for n in SMAS) + " FROM bars)"
SMA_COLS = [f"sma_{n}_dist" for n in SMAS] + ["sma_20_slope", "sma_50_slope"]


@query("D6_sma_features", f"WITH {BARS}{SMA_CTE} SELECT ticker, date, "
       + ", ".join(r6(f"(close - sma{n}) / (sma{n} + {EPS})", f"sma_{n}_dist") for n in SMAS) + ", "
       + ", ".join(r6(f"coalesce({pct(f'sma{n}', 5)}, 0.0)", f"sma_{n}_slope") for n in (20, 50)) + " FROM s")
def d6(spark, sf):
    return _out(D.sma_features(T.bars_daily(spark, sf)), SMA_COLS)


@query("D7_price_position", f"WITH {BARS} SELECT ticker, date, " + ", ".join(
    r6(f"(close - min(low) {win(n)}) / (max(high) {win(n)} - min(low) {win(n)} + {EPS})", f"price_position_{n}d") for n in (20, 60)) + " FROM bars")
def d7(spark, sf):
    return _out(D.price_position(T.bars_daily(spark, sf)), ["price_position_20d", "price_position_60d"])


# --- recursive indicators ----------------------------------------------------

PREV = ", p AS (SELECT *, coalesce({0}, close) AS pc, coalesce({1}, high) AS ph, coalesce({2}, low) AS pl FROM num)".format(
    lag("close"), lag("high"), lag("low"))
BASE = PREV + """, m AS (
  SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr,
    CASE WHEN greatest(high - ph, 0.0) > greatest(pl - low, 0.0) THEN greatest(high - ph, 0.0) ELSE 0.0 END AS dmp,
    CASE WHEN greatest(high - ph, 0.0) > greatest(pl - low, 0.0) THEN 0.0 ELSE greatest(pl - low, 0.0) END AS dmm,
    greatest(close - pc, 0.0) AS gain, greatest(pc - close, 0.0) AS loss FROM p)"""


def ema_rec(src: str, specs: dict[str, tuple[str, float]], name: str = "ema", pos: str = "t", key: str = "ticker", order: str = "date") -> str:
    """Recursive EMA over numbered rows: one pass, any number of columns."""
    first = ", ".join(f"CAST({c} AS DOUBLE) AS {o}" for o, (c, _) in specs.items())
    step = ", ".join(f"{1 - a!r}::DOUBLE * e.{o} + {a!r}::DOUBLE * n.{c} AS {o}" for o, (c, a) in specs.items())
    return f"""{name} AS (
  SELECT {key}, {order}, {pos}, {first} FROM {src} WHERE {pos} = 0
  UNION ALL
  SELECT n.{key}, n.{order}, n.{pos}, {step} FROM {name} e JOIN {src} n ON n.{key} = e.{key} AND n.{pos} = e.{pos} + 1)"""


A14 = 2 / 15
EMA12 = NUM + ", " + ema_rec("num", {"ema_12": ("close", 2 / 13), "ema_26": ("close", 2 / 27)})


@query("A5_ema", f"WITH RECURSIVE {EMA12} SELECT ticker, date, {rounds(['ema_12', 'ema_26'], 5)} FROM ema")
def a5(spark, sf):
    df = scan.ema_many(T.bars_daily(spark, sf), {"ema_12": ("close", 2 / 13), "ema_26": ("close", 2 / 27)})
    return _out(df, ["ema_12", "ema_26"], 5)


WILDER = NUM + BASE + """, g AS (
  SELECT ticker, date, t - 14 AS q,
    CASE WHEN t = 14 THEN avg(gain) {0} ELSE gain END AS gain, CASE WHEN t = 14 THEN avg(loss) {0} ELSE loss END AS loss FROM m), """.format(win(14)) + ema_rec(
    "g", {"ag": ("gain", 1 / 14), "al": ("loss", 1 / 14)}, "wil", "q")


@query("A6_wilder", f"WITH RECURSIVE {WILDER} SELECT n.ticker, n.date, {r6('w.ag', 'avg_gain', 5)}, {r6('w.al', 'avg_loss', 5)} FROM num n LEFT JOIN wil w ON n.ticker = w.ticker AND n.date = w.date")
def a6(spark, sf):
    df = T.bars_daily(spark, sf)
    delta = F.col("close") - D.lag_or_first("close", 1, D.series())
    df = df.withColumns({"g": F.greatest(delta, F.lit(0.0)), "l": F.greatest(-delta, F.lit(0.0))})
    return _out(scan.wilder_many(df, {"avg_gain": "g", "avg_loss": "l"}, 14), ["avg_gain", "avg_loss"], 5)


def ewm_std_sql(src: str, c: str, span: int, pos: str = "t", key: str = "ticker", order: str = "date") -> str:
    """Recursive bias-corrected EW deviation: weighted mean, variance and squared weight sum."""
    a = 2 / (span + 1)
    d = 1 - a
    return f"""ew AS (
  SELECT {key}, {order}, {pos}, CAST({c} AS DOUBLE) AS m, CAST(0 AS DOUBLE) AS v, CAST(1 AS DOUBLE) AS s FROM {src} WHERE {pos} = 0
  UNION ALL
  SELECT n.{key}, n.{order}, n.{pos}, e.m + {a!r}::DOUBLE * (n.{c} - e.m),
    {d!r}::DOUBLE * (e.v + {a!r}::DOUBLE * (n.{c} - e.m) * (n.{c} - e.m)), {d * d!r}::DOUBLE * e.s + {a * a!r}::DOUBLE
  FROM ew e JOIN {src} n ON n.{key} = e.{key} AND n.{pos} = e.{pos} + 1)"""


@query("A7_ewm_std", f"WITH RECURSIVE {NUM}, rr AS (SELECT ticker, date, t - 1 AS q, {pct('close', 1)} AS r1 FROM num), "
       + ewm_std_sql("rr", "r1", 60, "q")
       + f" SELECT n.ticker, n.date, {r6('CASE WHEN e.q > 0 THEN sqrt(e.v / (1 - e.s)) END', 'ewm_std')} FROM num n LEFT JOIN ew e ON n.ticker = e.ticker AND n.date = e.date")
def a7(spark, sf):
    df = T.bars_daily(spark, sf).withColumn("r1", D.pct_change("close", 1, D.series()))
    return _out(scan.ewm_std(df, "r1", "ewm_std", 60), ["ewm_std"])


ATR = NUM + BASE + ", " + ema_rec("m", {"atr": ("tr", A14), "ep": ("dmp", A14), "em": ("dmm", A14)}, "dm")


@query("D8_atr", f"WITH RECURSIVE {ATR} SELECT ticker, date, {r6('m.tr', 'tr', 8)}, {r6('atr', 'atr', 5)}, {r6(f'atr / (close + {EPS})', 'atr_norm')} FROM dm JOIN m USING (ticker, date)")
def d8(spark, sf):
    df = D.atr(T.bars_daily(spark, sf))
    return df.select("ticker", "date", half_away("tr", 8).alias("tr"), half_away("atr", 5).alias("atr"), half_away("atr_norm", 6).alias("atr_norm"))


ADX = ATR + f""", di AS (SELECT ticker, date, t, 100 * ep / (atr + {EPS}) AS p, 100 * em / (atr + {EPS}) AS n FROM dm),
  dx AS (SELECT *, 100 * abs(p - n) / (p + n + {EPS}) AS dx FROM di), """ + ema_rec("dx", {"adx": ("dx", A14)}, "ax")


@query("D9_adx", f"WITH RECURSIVE {ADX} SELECT ticker, date, {r6('adx / 100', 'adx')}, {r6('(p - n) / 100', 'di_diff')} FROM ax JOIN di USING (ticker, date)")
def d9(spark, sf):
    return _out(D.adx(T.bars_daily(spark, sf)), ["adx", "di_diff"])


RSI = WILDER + ", rsi AS (SELECT num.ticker, num.date, num.t, 100 - 100 / (1 + CASE WHEN al > 0 THEN ag / al ELSE {u} END) AS rsi FROM num LEFT JOIN wil ON num.ticker = wil.ticker AND num.date = wil.date)"


@query("D10_rsi", f"WITH RECURSIVE {RSI.format(u='1.0')} SELECT ticker, date, {r6('rsi / 100', 'rsi')} FROM rsi")
def d10(spark, sf):
    return _out(D.rsi(T.bars_daily(spark, sf)), ["rsi"])


MACD = EMA12 + ", line AS (SELECT ticker, date, t, ema_12 - ema_26 AS macd FROM ema), " + ema_rec("line", {"sig": ("macd", 0.2)}, "sg") + \
    ", macd AS (SELECT num.*, line.macd, sg.sig, line.macd - sg.sig AS hist FROM num JOIN line USING (ticker, date) JOIN sg USING (ticker, date))"


@query("D11_macd", f"WITH RECURSIVE {MACD} SELECT ticker, date, " + ", ".join(
    r6(f"{c} / (close + {EPS})", n) for c, n in (("macd", "macd_norm"), ("sig", "macd_signal_norm"), ("hist", "macd_hist_norm"))) + " FROM macd")
def d11(spark, sf):
    return _out(D.macd(T.bars_daily(spark, sf)), ["macd_norm", "macd_signal_norm", "macd_hist_norm"])


# --- windows again -----------------------------------------------------------

STOCH = f", h AS (SELECT *, max(high) {win(14)} AS hh, min(low) {win(14)} AS ll FROM bars), k AS (SELECT *, (close - ll) / (hh - ll + {EPS}) AS sk, -(hh - close) / (hh - ll + {EPS}) AS wr FROM h)"


@query("D12_stochastic_williams", f"WITH {BARS}{STOCH} SELECT ticker, date, {r6('sk', 'stoch_k_14')}, {r6(sma('sk', 3), 'stoch_d_14')}, {r6('wr', 'williams_r')} FROM k")
def d12(spark, sf):
    return _out(D.stochastic_williams(T.bars_daily(spark, sf)), ["stoch_k_14", "stoch_d_14", "williams_r"])


@query("D13_rate_of_change", f"WITH {BARS} SELECT ticker, date, " + ", ".join(
    r6(f"coalesce((close - {lag('close', h)}) / ({lag('close', h)} + {EPS}), 0.0)", f"roc_{h}d") for h in (5, 10, 20)) + " FROM bars")
def d13(spark, sf):
    return _out(D.rate_of_change(T.bars_daily(spark, sf)), ["roc_5d", "roc_10d", "roc_20d"])


@query("D14_volume_ratios", f"WITH {BARS} SELECT ticker, date, " + ", ".join(
    r6(f"volume / ({sma('volume', n)} + 1)", f"vol_ratio_{n}d") for n in (5, 20)) + ", " + r6(f"coalesce({pct('volume', 5)}, 0.0)", "vol_change_5d") + " FROM bars")
def d14(spark, sf):
    return _out(D.volume_ratios(T.bars_daily(spark, sf)), ["vol_ratio_5d", "vol_ratio_20d", "vol_change_5d"])


OBV = f", st AS (SELECT *, coalesce(sign(close - {lag('close')}) * volume, 0.0) AS step FROM bars), ob AS (SELECT *, sum(step) {run()} AS obv FROM st), os AS (SELECT *, {sma('obv', 20)} AS obvs FROM ob)"


@query("D15_obv_slope", f"WITH {BARS}{OBV} SELECT ticker, date, {r6(f'coalesce({pct('obvs', 5)}, 0.0)', 'obv_slope', 4)} FROM os")
def d15(spark, sf):
    return _out(D.obv_slope(T.bars_daily(spark, sf)), ["obv_slope"], 4)


def _vwap(offset):
    return f", v AS (SELECT *, sum((high + low + close) / 3 * volume) {run()} / (sum(volume) {run()} + {offset}) AS vwap FROM bars)"


@query("D16_vwap_distance", f"WITH {BARS}{_vwap('1')} SELECT ticker, date, {r6(f'(close - vwap) / (vwap + {EPS})', 'vwap_dist')} FROM v")
def d16(spark, sf):
    return _out(D.vwap_distance(T.bars_daily(spark, sf)), ["vwap_dist"])


CANDLE_EXPR = {
    "body_ratio": f"(close - open) / (high - low + {EPS})",
    "upper_shadow": f"(high - greatest(close, open)) / (high - low + {EPS})",
    "lower_shadow": f"(least(close, open) - low) / (high - low + {EPS})",
    "gap": f"coalesce((open - {lag('close')}) / ({lag('close')} + {EPS}), 0.0)",
}


@query("D17_candle_features", f"WITH RECURSIVE {ATR}, q AS (SELECT m.*, dm.atr, (high - low) / (close + {EPS}) AS rg FROM m JOIN dm USING (ticker, date)) SELECT ticker, date, "
       + ", ".join(r6(e, n, 5) for n, e in CANDLE_EXPR.items()) + f", {r6(f'atr / (close + {EPS})', 'atr_norm', 5)}, {r6(f'rg / ({sma('rg', 20)} + {EPS})', 'range_ratio', 5)} FROM q")
def d17(spark, sf):
    return _out(D.candle_features(T.bars_daily(spark, sf)), D.CANDLE, 5)


PI = repr(math.pi)
CAL_EXPR = {
    "dow_sin": f"sin(2 * {PI}::DOUBLE * (isodow(date) - 1) / 5)",
    "dow_cos": f"cos(2 * {PI}::DOUBLE * (isodow(date) - 1) / 5)",
    "month_sin": f"sin(2 * {PI}::DOUBLE * month(date) / 12)",
    "month_cos": f"cos(2 * {PI}::DOUBLE * month(date) / 12)",
    "turn_of_month": "CASE WHEN day(date) <= 3 OR day(date) >= 28 THEN 1.0 ELSE 0.0 END",
}


@query("D18_calendar_features", f"WITH {BARS} SELECT ticker, date, " + ", ".join(r6(e, n) for n, e in CAL_EXPR.items()) + " FROM bars")
def d18(spark, sf):
    return _out(D.calendar_features(T.bars_daily(spark, sf)), list(CAL_EXPR))


RAW_EXPR = {f"log_ret_{h}d": f"coalesce(ln(close / {lag('close', h)}), 0.0)" for h in (1, 5, 20)}
RAW_EXPR |= {f"real_vol_{n}d": f"{std0('r1', n)} * {A252}" for n in (5, 20)}
RAW_EXPR |= {
    "vol_regime": f"({std0('r1', 5)} + {EPS}) / ({std0('r1', 60)} + {EPS})",
    "rsi": "rsi / 50 - 1",
    "vwap_dist": f"(close - vwap) / (vwap + {EPS})",
    "rel_vol": f"volume / ({sma('volume', 20)} + 1)",
    "atr_norm": f"atr / (close + {EPS})",
    "gap": CANDLE_EXPR["gap"],
    "body_ratio": CANDLE_EXPR["body_ratio"],
    **CAL_EXPR,
}
RAW = RSI.format(u="1.0") + ", " + ema_rec("m", {"atr": ("tr", A14)}, "atrs") + f""", raw AS (
  SELECT num.*, rsi.rsi, atrs.atr, coalesce({pct('close', 1)}, 0.0) AS r1,
    sum((high + low + close) / 3 * volume) {run()} / (sum(volume) {run()} + {EPS}) AS vwap
  FROM num JOIN rsi USING (ticker, date) JOIN atrs USING (ticker, date))""".replace("lag(close, 1) OVER (PARTITION BY ticker ORDER BY date)", "lag(close, 1) OVER (PARTITION BY num.ticker ORDER BY num.date)")


@query("D19_raw_plus", f"WITH RECURSIVE {RAW} SELECT ticker, date, " + ", ".join(r6(RAW_EXPR[n], n, 5) for n in D.RAW_PLUS) + " FROM raw")
def d19(spark, sf):
    return _out(D.raw_plus_features(T.bars_daily(spark, sf)), D.RAW_PLUS, 5)


# every group at once
ALL = MACD + BASE + ", " + ema_rec("m", {"atr": ("tr", A14), "ep": ("dmp", A14), "em": ("dmm", A14)}, "dm") + \
    f""", di AS (SELECT ticker, date, t, 100 * ep / (atr + {EPS}) AS p, 100 * em / (atr + {EPS}) AS n FROM dm),
  dx AS (SELECT *, 100 * abs(p - n) / (p + n + {EPS}) AS dx FROM di), """ + ema_rec("dx", {"adx": ("dx", A14)}, "ax") + \
    RSI[len(NUM + BASE):].format(u="1.0") + f""", e0 AS (
  SELECT num.*, macd, sig, hist, p, n, adx, rsi, atr,
    {pct('num.close', 1, 'num.ticker', 'num.date')} AS r1, ln(num.high / num.low) ** 2 / (4 * ln(2)) AS pk,
    CAST(0.5 AS DOUBLE) * ln(num.high / num.low) ** 2 - (2 * ln(2) - 1) * ln(num.close / num.open) ** 2 AS gk,
    coalesce(sign(num.close - {lag('num.close', 1, 'num.ticker', 'num.date')}) * num.volume, 0.0) AS step,
    (num.high - num.low) / (num.close + {EPS}) AS rg
  FROM num JOIN macd USING (ticker, date) JOIN di USING (ticker, date) JOIN ax USING (ticker, date)
       JOIN rsi USING (ticker, date) JOIN dm USING (ticker, date)),
e1 AS (SELECT *, {', '.join(f"{sma('close', n)} AS sma{n}" for n in SMAS)}, max(high) {win(14)} AS hh, min(low) {win(14)} AS ll,
    sum(step) {run()} AS obv, sum((high + low + close) / 3 * volume) {run()} / (sum(volume) {run()} + 1) AS vwap FROM e0),
e2 AS (SELECT *, (close - ll) / (hh - ll + {EPS}) AS sk, {sma('obv', 20)} AS obvs FROM e1)"""
FULL_EXPR = {f"return_{h}d": pct("close", h) for h in D.RETURN_HORIZONS}
FULL_EXPR["log_return_1d"] = f"ln(close / {lag('close')})"
FULL_EXPR |= {f"realized_vol_{n}d": f"{std0('r1', n)} * {A252}" for n in (5, 10, 20, 60)}
FULL_EXPR |= {f"parkinson_vol_{n}d": f"sqrt({_mean2('pk', n)} * 252)" for n in (10, 20)}
FULL_EXPR |= {f"gk_vol_{n}d": f"sqrt(abs({_mean2('gk', n)}) * 252)" for n in (10, 20)}
FULL_EXPR["vol_ratio_5_60"] = f"({std0('r1', 5)} + {EPS}) / ({std0('r1', 60)} + {EPS})"
FULL_EXPR |= {f"sma_{n}_dist": f"(close - sma{n}) / (sma{n} + {EPS})" for n in SMAS}
FULL_EXPR |= {f"sma_{n}_slope": pct(f"sma{n}", 5) for n in (20, 50)}
FULL_EXPR |= {f"price_position_{n}d": f"(close - min(low) {win(n)}) / (max(high) {win(n)} - min(low) {win(n)} + {EPS})" for n in (20, 60)}
FULL_EXPR |= {"adx": "adx / 100", "di_diff": "(p - n) / 100", "rsi": "rsi / 100"}
FULL_EXPR |= {n: f"{c} / (close + {EPS})" for c, n in (("macd", "macd_norm"), ("sig", "macd_signal_norm"), ("hist", "macd_hist_norm"))}
FULL_EXPR |= {"stoch_k_14": "sk", "stoch_d_14": sma("sk", 3), "williams_r": f"-(hh - close) / (hh - ll + {EPS})"}
FULL_EXPR |= {f"roc_{h}d": f"(close - {lag('close', h)}) / ({lag('close', h)} + {EPS})" for h in (5, 10, 20)}
FULL_EXPR |= {f"vol_ratio_{n}d": f"volume / ({sma('volume', n)} + 1)" for n in (5, 20)}
FULL_EXPR |= {"vol_change_5d": pct("volume", 5), "obv_slope": pct("obvs", 5), "vwap_dist": f"(close - vwap) / (vwap + {EPS})"}
FULL_EXPR |= CANDLE_EXPR | {"atr_norm": f"atr / (close + {EPS})", "range_ratio": f"rg / ({sma('rg', 20)} + {EPS})"} | CAL_EXPR


@query("D20_daily_features", f"WITH RECURSIVE {ALL} SELECT ticker, date, "
       + ", ".join(r6(f"coalesce({FULL_EXPR[n]}, 0.0)", n, 4) for n in D.feature_names()) + " FROM e2")
def d20(spark, sf):
    return _out(D.daily_features(T.bars_daily(spark, sf)), D.feature_names(), 4)


def zscore_sql(src: str, cols, window: int, least: int, eps_add: bool = False, key: str = "ticker", order: str = "date", digits: int = 5) -> str:
    parts = []
    for c in cols:
        mean = f"CASE WHEN count({c}) {win(window, key, order)} >= {least} THEN avg({c}) {win(window, key, order)} ELSE avg({c}) OVER (PARTITION BY {key}) END"
        g = f"CASE WHEN stddev_samp({c}) OVER (PARTITION BY {key}) > 1e-8 THEN stddev_samp({c}) OVER (PARTITION BY {key}) ELSE 1.0 END"
        std = f"CASE WHEN count({c}) {win(window, key, order)} >= {least} THEN stddev_samp({c}) {win(window, key, order)} ELSE {g} END"
        den = f"({std} + 1e-10)" if eps_add else f"greatest({std}, 1e-8)"
        parts.append(r6(f"coalesce(least(greatest(({c} - {mean}) / {den}, -5.0), 5.0), 0.0)", c, digits))
    return f"SELECT {key}, {order}, {', '.join(parts)} FROM {src}"


Z = ", z AS (SELECT ticker, date, coalesce({0}, 0.0) AS return_1d, coalesce({1}, 0.0) AS roc_5d, volume / ({2} + 1) AS vol_ratio_5d FROM bars) ".format(
    pct("close", 1), f"(close - {lag('close', 5)}) / ({lag('close', 5)} + {EPS})", sma("volume", 5))


@query("D21_rolling_zscore", f"WITH {BARS}{Z}" + zscore_sql("z", ["return_1d", "roc_5d", "vol_ratio_5d"], 252, 126))
def d21(spark, sf):
    df = D.volume_ratios(D.rate_of_change(D.returns(T.bars_daily(spark, sf))))
    df = D.clean(df, ["return_1d"])
    return _out(D.rolling_zscore(df, ["return_1d", "roc_5d", "vol_ratio_5d"]), ["return_1d", "roc_5d", "vol_ratio_5d"], 5)


@query("D22_atr_stops", f"""WITH {BARS}, p AS (SELECT *, greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) AS tr0,
    {lag('close')} AS pc, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS r FROM bars),
  l AS (SELECT ticker, arg_max(close, date) AS price, CASE WHEN count(pc) = 14 THEN avg(tr0) END AS atr FROM p WHERE r <= 14 GROUP BY ticker)
  SELECT ticker, {r6('price', 'price', 8)}, {r6('atr', 'atr', 4)}, {r6('price - 2 * atr', 'long_stop', 4)}, {r6('price + 3 * atr', 'long_target', 4)},
    {r6('price + 2 * atr', 'short_stop', 4)}, {r6('price - 3 * atr', 'short_target', 4)} FROM l""")
def d22(spark, sf):
    df = D.atr_stops(T.bars_daily(spark, sf))
    return rounded(df.withColumn("price", half_away("price", 8)), 4, skip=("price",))
