"""Intraday queries (M1-M6) on event bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import rounded
from ..operators import minute as M
from ..sources import tables as T
from .daily import EPS, PI, ema_rec
from .registry import query, r6
from .sql import VECTORS, event_bars, lag, win

MB = event_bars()
KEY = ("ticker", "ts")


def ntz(df):
    return df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _out(df, cols, digits=6):
    return rounded(ntz(df).select(*KEY, *cols), digits)


@query("M1_minute_base", f"WITH {MB} SELECT ticker, ts, {r6(f'coalesce(close / {lag('close', 1, order='ts')} - 1, 0.0)', 'return_1m')}, {r6('ln(1 + volume)', 'log_volume')}, {r6('(high - low) / greatest(close, 1e-8)', 'spread')}, {r6('((high + low + close) / 3 - close) / greatest(close, 1e-8)', 'vwap_proxy')} FROM mbars")
def m1(spark, sf):
    return _out(M.minute_base(T.bars_minute(spark, sf)), ["return_1m", "log_volume", "spread", "vwap_proxy"])


# the recursive check SQL walks one bar of each ticker per step
HN = event_bars("minute") + """, num AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts) - 1 AS t FROM mbars),
  p AS (SELECT *, coalesce({0}, close) AS pc, coalesce({1}, high) AS ph, coalesce({2}, low) AS pl FROM num),
  m AS (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr,
    CASE WHEN greatest(high - ph, 0.0) > greatest(pl - low, 0.0) THEN greatest(high - ph, 0.0) ELSE 0.0 END AS dmp,
    CASE WHEN greatest(high - ph, 0.0) > greatest(pl - low, 0.0) THEN 0.0 ELSE greatest(pl - low, 0.0) END AS dmm,
    greatest(close - pc, 0.0) AS gain, greatest(pc - close, 0.0) AS loss FROM p),
  g AS (SELECT ticker, ts, t - 14 AS q, CASE WHEN t = 14 THEN avg(gain) {3} ELSE gain END AS gain, CASE WHEN t = 14 THEN avg(loss) {3} ELSE loss END AS loss FROM m)""".format(
    lag("close", 1, order="ts"), lag("high", 1, order="ts"), lag("low", 1, order="ts"), win(14, order="ts"))
A = 2 / 15
HREC = ", ".join([
    HN,
    ema_rec("m", {"e5": ("close", 2 / 6), "e12": ("close", 2 / 13), "e26": ("close", 2 / 27), "atr": ("tr", 1 / 14),
                  "at2": ("tr", A), "ep": ("dmp", A), "em": ("dmm", A)}, "e", order="ts"),
    ema_rec("g", {"ag": ("gain", 1 / 14), "al": ("loss", 1 / 14)}, "wil", "q", order="ts"),
    f"l AS (SELECT ticker, ts, t, e12 - e26 AS macd, 100 * ep / (at2 + {EPS}) AS pp, 100 * em / (at2 + {EPS}) AS nn FROM e)",
    f"l2 AS (SELECT *, 100 * abs(pp - nn) / (pp + nn + {EPS}) AS dx FROM l)",
    ema_rec("l2", {"sig": ("macd", 0.2), "adx": ("dx", A)}, "s", order="ts"),
])
IND = {
    "rsi": "CASE WHEN t >= 14 THEN 100 - CASE WHEN al > 0 THEN 100 / (1 + ag / al) ELSE 0 END END",
    "macd": "CASE WHEN t >= 25 THEN l.macd END",
    "macd_signal": "CASE WHEN t >= 33 THEN sig END",
    "macd_diff": "CASE WHEN t >= 33 THEN l.macd - sig END",
    "ema_5": "CASE WHEN t >= 4 THEN e5 END", "ema_12": "CASE WHEN t >= 11 THEN e12 END", "ema_26": "CASE WHEN t >= 25 THEN e26 END",
    "bb_upper": f"CASE WHEN t >= 19 THEN mid + 2 * sd END", "bb_lower": "CASE WHEN t >= 19 THEN mid - 2 * sd END", "bb_mid": "CASE WHEN t >= 19 THEN mid END",
    "atr": "CASE WHEN t >= 13 THEN e.atr END", "adx": "CASE WHEN t >= 27 THEN adx END",
}
IND_SQL = f"""WITH RECURSIVE {HREC}, b AS (SELECT ticker, ts, avg(close) {win(20, order='ts')} AS mid, stddev_pop(close) {win(20, order='ts')} AS sd FROM num)
  SELECT num.ticker, num.ts, {{cols}} FROM num JOIN e USING (ticker, ts) JOIN l USING (ticker, ts) JOIN s USING (ticker, ts) JOIN b USING (ticker, ts)
  LEFT JOIN wil ON wil.ticker = num.ticker AND wil.ts = num.ts"""


def _num(e: str) -> str:
    return e.replace("WHEN t ", "WHEN num.t ")


@query("M2_minute_indicators", IND_SQL.format(cols=", ".join(r6(_num(e), n, 5) for n, e in IND.items())))
def m2(spark, sf):
    return _out(M.minute_indicators(T.bars_minute(spark, sf)), list(IND), 5)


REL = ["ema_5", "ema_12", "ema_26"]


@query("M3_relative_to_close", IND_SQL.format(cols=", ".join(r6(f"({_num(IND[n])} - num.close) / greatest(num.close, 1e-8)", n) for n in REL)))
def m3(spark, sf):
    df = M.minute_indicators(T.bars_minute(spark, sf), ("ema",))
    return _out(M.relative_to_close(df, REL), REL)


@query("M4_time_of_day", f"WITH {MB} SELECT ticker, ts, " + ", ".join(
    r6(f"{f}(2 * {PI}::DOUBLE * (hour(ts) * 60 + minute(ts) - 570) / 390)", f"tod_{f}") for f in ("sin", "cos")) + " FROM mbars")
def m4(spark, sf):
    return _out(M.time_of_day(T.bars_minute(spark, sf)), ["tod_sin", "tod_cos"])


@query("M5_validate_bars", f"""WITH {MB}, b AS (SELECT ticker, ts, open, high, low, CASE WHEN close > 100 THEN NULL ELSE close END AS close, CASE WHEN volume > 1 THEN high + 1 ELSE low END AS low2, volume FROM mbars),
  g AS (SELECT *, ts - {lag('ts', 1, order='ts')} AS gap FROM b),
  a AS (SELECT ticker, count(*) AS n_rows, CAST(sum(CASE WHEN close IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_null, CAST(sum(CASE WHEN high < low2 THEN 1 ELSE 0 END) AS BIGINT) AS n_high_below_low,
    CAST(0 AS BIGINT) AS n_backwards, CAST(sum(CASE WHEN gap = INTERVAL 1 MINUTE THEN 0 ELSE 1 END) AS BIGINT) AS n_irregular FROM g GROUP BY ticker)
  SELECT *, n_null = 0 AND n_high_below_low = 0 AS valid, array_to_string(list_filter([CASE WHEN n_null > 0 THEN n_null || ' null values' END, CASE WHEN n_high_below_low > 0 THEN n_high_below_low || ' bars with high below low' END,
    CASE WHEN n_irregular > 10 THEN 'irregular spacing in ' || n_irregular || ' bars' END], lambda x: x IS NOT NULL), '; ') AS issues FROM a""")
def m5(spark, sf):
    df = T.bars_minute(spark, sf).withColumns({
        "close": F.when(F.col("close") <= 100, F.col("close")),
        "low": F.when(F.col("volume") > 1, F.col("high") + 1).otherwise(F.col("low")),
    })
    return M.validate_bars(df).withColumn("issues", F.array_join("issues", "; "))


@query("M6_daily_bridge", f"""WITH {VECTORS}, d AS (SELECT ticker, date, avg(pos - neg) AS c FROM vectors GROUP BY ticker, date),
  b AS (SELECT event_id, 'S' || (event_id % 10) AS ticker, DATE '1995-01-02' + CAST(event_id % 2400 AS INTEGER) AS date FROM events)
  SELECT event_id, b.ticker, b.date, {r6('coalesce(c, 0.0)', 'news_sentiment_daily_bridge')} FROM b LEFT JOIN d ON d.ticker = b.ticker AND d.date = b.date - 1""")
def m6(spark, sf):
    bars = T.table(spark, sf, "events").select(
        "event_id", F.concat(F.lit("S"), F.pmod("event_id", F.lit(10)).cast("string")).alias("ticker"),
        F.date_add(F.lit(T.DAY0).cast("date"), F.pmod("event_id", F.lit(2400)).cast("int")).alias("date"),
    )
    daily = T.article_vectors(spark, sf).groupBy("ticker", "date").agg(F.avg(F.col("pos") - F.col("neg")).alias("compound_mean"))
    return rounded(M.daily_bridge(bars, daily))
