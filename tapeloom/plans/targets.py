"""Targets, samples and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import half_away, rounded
from ..operators import targets as G
from ..sources import tables as T
from .daily import ewm_std_sql
from .registry import query, r6, scaled, scaled_sql
from .sql import BARS, NUM, SECTORS, event_bars, seeded_sql


def _lead(c, h, key="ticker", order="date"):
    return f"lead({c}, {h}) OVER (PARTITION BY {key} ORDER BY {order})"


def fwd(h, order="date"):
    return f"(greatest({_lead('close', h, order=order)}, CASE WHEN {_lead('close', h, order=order)} IS NOT NULL THEN 1e-8 END) / greatest(close, 1e-8) - 1)"


FWD = f"CASE WHEN {_lead('close', 1)} IS NOT NULL AND close > 0 THEN {fwd(1)} END"


def fwd_sql(h: int, order: str = "date") -> str:
    return f"CASE WHEN {_lead('close', h, order=order)} IS NOT NULL AND close > 0 THEN {fwd(h, order)} END"


@query("T1_forward_return", f"WITH {BARS} SELECT ticker, date, {r6(fwd_sql(5), 'ret_5')}, {r6(f'ln(1 + {fwd_sql(1)})', 'log_ret_1')} FROM bars")
def t1(spark, sf):
    df = G.forward_return(G.forward_return(T.bars_daily(spark, sf), 5, out="ret_5"), 1, True, "log_ret_1")
    return rounded(df.select("ticker", "date", "ret_5", "log_ret_1"))


@query("T2_open_to_close", f"WITH {BARS} SELECT ticker, date, {r6('least(greatest((close - open) / open, -0.2), 0.2)', 'open_to_close')} FROM bars")
def t2(spark, sf):
    return rounded(G.open_to_close(T.bars_daily(spark, sf)).select("ticker", "date", "open_to_close"))


E11 = " + ".join(f"CASE WHEN v >= {t} THEN 1 ELSE 0 END" for t in G.THRESHOLDS_11)


@query("T3_class_labels", f"""WITH {BARS}, f AS (SELECT ticker, date, {fwd_sql(1)} AS r FROM bars),
  q AS (SELECT ticker, quantile_cont(r, [0.333, 0.667]) AS a, quantile_cont(r, [0.2, 0.4, 0.6, 0.8]) AS b FROM f GROUP BY ticker),
  j AS (SELECT f.ticker, f.date, coalesce(r, 0.0) AS v, a, b FROM f JOIN q USING (ticker))
  SELECT ticker, date, CASE WHEN v < a[1] THEN 0 WHEN v > a[2] THEN 2 ELSE 1 END AS label_3,
    CASE WHEN v >= b[1] THEN 1 ELSE 0 END + CASE WHEN v >= b[2] THEN 1 ELSE 0 END + CASE WHEN v >= b[3] THEN 1 ELSE 0 END + CASE WHEN v >= b[4] THEN 1 ELSE 0 END AS label_5,
    {E11} AS label_11, CASE WHEN v < -0.01 THEN 0 WHEN v > 0.01 THEN 2 ELSE 1 END AS label_fixed FROM j""")
def t3(spark, sf):
    df = G.forward_return(T.bars_daily(spark, sf))
    df = G.class_labels(df, 3, out="label_3")
    df = G.class_labels(df, 5, out="label_5")
    df = G.class_labels(df, 11, out="label_11")
    df = G.class_labels(df, 3, "fixed", out="label_fixed")
    return df.select("ticker", "date", "label_3", "label_5", "label_11", "label_fixed")


def target_sql(src: str, h: int, span: int, lag_rows: int, order: str = "date") -> str:
    return f"""f AS (SELECT ticker, {order}, {fwd_sql(h, order)} AS r FROM {src}),
  w AS (SELECT *, CASE WHEN r IS NOT NULL THEN least(greatest(r, -0.2), 0.2) END AS win FROM f),
  x AS (SELECT *, lag(win, {lag_rows}) OVER (PARTITION BY ticker ORDER BY {order}) AS x,
        row_number() OVER (PARTITION BY ticker ORDER BY {order}) - 1 - {lag_rows} AS q FROM w),
  {ewm_std_sql('x', 'x', span, 'q', order=order)},
  z AS (SELECT x.*, greatest(coalesce(CASE WHEN ew.q > 0 THEN sqrt(ew.v / (1 - ew.s)) END, 1.0), 1e-8) AS sd FROM x LEFT JOIN ew ON ew.ticker = x.ticker AND ew.{order} = x.{order})
  SELECT ticker, {order}, {r6('CASE WHEN win IS NOT NULL THEN least(greatest(win / sd, -5.0), 5.0) END', 'target', 5)}, {r6('win', 'raw_target')} FROM z"""


@query("T4_ewma_target", f"WITH RECURSIVE {BARS}, {target_sql('bars', 1, 60, 1)}")
def t4(spark, sf):
    df = G.ewma_target(T.bars_daily(spark, sf)).select("ticker", "date", "target", half_away("raw_target", 6).alias("raw_target"))
    return df.withColumn("target", half_away("target", 5) + 0.0)


@query("T5_minute_target", f"WITH RECURSIVE {event_bars('minute')}, {target_sql('mbars', 390, 390, 1, 'ts')}")
def t5(spark, sf):
    df = G.minute_target(T.bars_minute(spark, sf))
    return df.select("ticker", F.col("ts").cast("timestamp_ntz").alias("ts"), (half_away("target", 5) + 0.0).alias("target"), half_away("raw_target", 6).alias("raw_target"))


@query("T6_sequences", f"""WITH {NUM}, f AS (SELECT *, {fwd_sql(1)} AS target, count(*) OVER (PARTITION BY ticker) AS n FROM num),
  s AS (SELECT ticker, date, t AS row, target, n FROM f WHERE t >= 60 AND (t - 60) % 5 = 0 AND t < n - 1 AND target IS NOT NULL)
  SELECT s.ticker, s.date, s.row, {scaled_sql('flatten(list([CAST(f.close AS FLOAT), CAST(f.volume AS FLOAT)] ORDER BY f.t))', 'sequence', 2)}, {r6('any_value(s.target)', 'target')}
  FROM s JOIN f ON f.ticker = s.ticker AND f.t >= s.row - 30 AND f.t < s.row GROUP BY s.ticker, s.date, s.row""")
def t6(spark, sf):
    df = G.forward_return(T.bars_daily(spark, sf), out="target")
    out = G.sequences(df, 30, 5, ["close", "volume"], warmup=60).withColumn("sequence", F.flatten("sequence"))
    return rounded(out.select("ticker", "date", "row", scaled("sequence", 2), "target"))


@query("T7_temporal_split", f"""WITH {NUM}, c AS (SELECT *, count(*) OVER (PARTITION BY ticker) - 1 AS e FROM num),
  b AS (SELECT *, 252 + CAST(floor((e - 252) * 0.7::DOUBLE) AS BIGINT) AS te, CAST(floor((e - 252) * 0.15::DOUBLE) AS BIGINT) AS v FROM c)
  SELECT ticker, date, CASE WHEN t < 252 OR t >= e THEN NULL WHEN t < te THEN 'train' WHEN t < te + v THEN 'val' ELSE 'test' END AS split FROM b""")
def t7(spark, sf):
    return G.temporal_split(T.bars_daily(spark, sf)).select("ticker", "date", "split")


@query("T8_global_date_split", f"""WITH {BARS}, d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM bars)),
  b AS (SELECT min(CASE WHEN i = CAST(floor(n * 0.7::DOUBLE) AS BIGINT) THEN date END) AS te, min(CASE WHEN i = CAST(floor(n * 0.7::DOUBLE) AS BIGINT) + CAST(floor(n * 0.15::DOUBLE) AS BIGINT) THEN date END) AS ve FROM d)
  SELECT ticker, bars.date, CASE WHEN date < te THEN 'train' WHEN date < ve THEN 'val' ELSE 'test' END AS split FROM bars, b""")
def t8(spark, sf):
    return G.global_date_split(T.bars_daily(spark, sf)).select("ticker", "date", "split")


@query("T9_ticker_split", f"""WITH {SECTORS}, r AS (SELECT ticker, row_number() OVER (ORDER BY {seeded_sql(42, 'ticker')}, ticker) - 1 AS place, count(*) OVER () AS total FROM (SELECT DISTINCT ticker FROM sectors))
  SELECT ticker, CASE WHEN place < total * 8 // 10 THEN 'train' WHEN place < total * 8 // 10 + total // 10 THEN 'val' ELSE 'test' END AS split FROM r""")
def t9(spark, sf):
    return G.ticker_split(T.sectors(spark, sf))


def windows_sql(expanding: bool, n: int = 5, purge: int = 5) -> str:
    if expanding:
        start, stop = "d0", f"least(d0 + CAST(floor(span * ((fold + 1) / {n}.0::DOUBLE)) AS INTEGER), d1)"
    else:
        start = f"d0 + CAST(fold * ((span - CAST(floor(span * 0.6::DOUBLE) AS INTEGER)) // {n - 1}) AS INTEGER)"
        stop = f"least({start} + CAST(floor(span * 0.6::DOUBLE) AS INTEGER), d1)"
    return f"""rg AS (SELECT min(date) AS d0, max(date) AS d1, CAST(max(date) - min(date) AS INTEGER) AS span FROM bars),
  f0 AS (SELECT CAST(fold AS INTEGER) AS fold, {start} AS a, {stop} AS z FROM rg, range({n}) r(fold)),
  f1 AS (SELECT *, a + CAST(floor((z - a) * 0.7::DOUBLE) AS INTEGER) AS tb, CAST(floor((z - a) * 0.15::DOUBLE) AS INTEGER) AS v FROM f0),
  wins AS (SELECT fold, a AS train_lo, tb - {purge} AS train_hi, tb + {purge} AS val_lo, tb + v AS val_hi, tb + v AS test_lo, z AS test_hi FROM f1)"""


@query("T10_walk_forward_windows", f"WITH {BARS}, {windows_sql(True)} SELECT 'expanding' AS mode, * FROM wins UNION ALL SELECT 'rolling' AS mode, * FROM (WITH {windows_sql(False).replace('wins AS', 'wins2 AS')} SELECT * FROM wins2)")
def t10(spark, sf):
    bars = T.bars_daily(spark, sf)
    a = G.walk_forward_windows(bars).withColumn("mode", F.lit("expanding"))
    return a.unionByName(G.walk_forward_windows(bars, expanding=False).withColumn("mode", F.lit("rolling")))


FOLDS = """parts AS (SELECT fold, 'train' AS split, train_lo AS lo, train_hi AS hi FROM wins UNION ALL SELECT fold, 'val', val_lo, val_hi FROM wins UNION ALL SELECT fold, 'test', test_lo, test_hi FROM wins)"""


@query("T11_assign_folds", f"WITH {BARS}, {windows_sql(False)}, {FOLDS} SELECT ticker, date, fold, split FROM bars JOIN parts ON date >= lo AND date < hi")
def t11(spark, sf):
    bars = T.bars_daily(spark, sf).select("ticker", "date")
    return G.assign_folds(bars, G.walk_forward_windows(bars, expanding=False))


@query("T12_minute_split", f"""WITH {event_bars('minute')}, rg AS (SELECT min(date) AS d0, max(date) AS d1, CAST(max(date) - min(date) AS INTEGER) AS span FROM mbars),
  c AS (SELECT *, d0 + CAST(floor(span * 0.7::DOUBLE) AS INTEGER) AS tb, d0 + CAST(floor(span * (0.7::DOUBLE + 0.15::DOUBLE)) AS INTEGER) AS ve FROM rg)
  SELECT ticker, ts, CASE WHEN date < tb - 5 THEN 'train' WHEN date >= tb + 5 AND date < ve THEN 'val' WHEN date >= ve THEN 'test' END AS split
  FROM mbars, c WHERE date < tb - 5 OR (date >= tb + 5 AND date < ve) OR (date >= ve AND date < d1)""")
def t12(spark, sf):
    return G.minute_split(T.bars_minute(spark, sf)).select("ticker", F.col("ts").cast("timestamp_ntz").alias("ts"), "split")


@query("T13_date_overlap", f"WITH {BARS} SELECT DISTINCT date FROM bars WHERE date IN (SELECT CAST(o_orderdate AS DATE) FROM orders)")
def t13(spark, sf):
    orders = T.table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("date"))
    return G.date_overlap(T.bars_daily(spark, sf), orders)
