"""Decision queries (B19-B29) and feedback queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import half_away, rounded
from ..operators import daily as D
from ..operators import decisions as X
from ..operators import feedback as L
from ..operators import metrics as M
from ..operators import portfolio as P
from ..operators import targets as G
from ..sources import tables as T
from ..sources.feeds import JOURNAL_SCHEMA
from .metrics import MODELS, PREDS, metrics_sql, predictions
from .registry import query, r6, rounds
from .sql import BARS, event_bars, lag
from .targets import FOLDS, windows_sql

def model_map():
    return F.create_map(*[x for m in MODELS for x in (F.lit(m), F.col(m))])


def mapped(spark, sf):
    """Predictions with the sub-models as a map; sma20 is silent (0) on one weekday."""
    p = predictions(spark, sf).withColumn("sma20", F.when(F.weekday("date") == 2, 0.0).otherwise(F.col("sma20")))
    return p.withColumn("preds", model_map())


AGR = """ag0 AS (SELECT * REPLACE (CASE WHEN isodow(date) = 3 THEN 0.0 ELSE sma20 END AS sma20) FROM preds),
  ag1 AS (SELECT *, list_filter([ret5, rev1, sma20], lambda x: abs(x) > 1e-6) AS nz FROM ag0), ag2 AS (SELECT *, CASE WHEN len(nz) >= 2 THEN nz ELSE [ret5, rev1, sma20] END AS pp, nz AS a FROM ag1),
  ag3 AS (SELECT *, len(pp) AS n, CAST(len(a) AS DOUBLE) AS k, len(list_filter(a, lambda x: x > 0)) AS pos, len(list_filter(a, lambda x: x < 0)) AS neg, list_sum(pp) / len(pp) AS mean_prediction FROM ag2),
  ag4 AS (SELECT *, CASE WHEN k = 0 THEN 0.5 ELSE greatest(pos, neg) / k END AS direction_agreement, least(greatest(1 - (list_max(pp) - list_min(pp)) / (list_sum(list_transform(pp, lambda x: abs(x))) / n + 1e-8), 0.0), 1.0) AS magnitude_agreement,
    sqrt(list_sum(list_transform(pp, lambda x: (x - mean_prediction) ** 2)) / n) AS std_prediction, CASE WHEN k > 0 THEN abs(pos - neg) / k ELSE 0.0 END AS sign_balance FROM ag3),
  agr AS (SELECT *, least(greatest(0.65::DOUBLE * direction_agreement + 0.35::DOUBLE * magnitude_agreement, 0.0), 1.0) AS overall_agreement FROM ag4)"""
AG = ["direction_agreement", "magnitude_agreement", "overall_agreement", "mean_prediction", "std_prediction", "sign_balance"]


@query("B19_agreement", f"WITH {PREDS}, {AGR} SELECT ticker, date, {rounds(AG)}, CAST(n AS INTEGER) AS n_active_models, CAST(k AS INTEGER) AS n_nonzero_models FROM agr")
def b19(spark, sf):
    return rounded(X.agreement(mapped(spark, sf)).select("ticker", "date", *AG, "n_active_models", "n_nonzero_models"))


HC = ["ret5", "rev1", "sma20", "close"]
LAST = "lp AS (SELECT ticker, arg_max(pred, date) AS predicted_return FROM preds GROUP BY ticker)"
HEALTH = f"""{PREDS}, {LAST}, rc AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS r FROM preds),
  ln AS ({' UNION ALL '.join(f"SELECT ticker, r, '{c}' AS feature, {c if c != 'rev1' else 'CASE WHEN r % 2 = 0 THEN rev1 END'} AS x FROM rc WHERE r <= 60" for c in HC)}),
  lk AS (SELECT *, CASE WHEN x IS NOT NULL THEN count(x) OVER (PARTITION BY ticker, feature ORDER BY r ROWS UNBOUNDED PRECEDING) END AS k FROM ln),
  h0 AS (SELECT ticker, feature, 1 - count(x) / count(*) AS nan_rate, coalesce(avg(CASE WHEN x = 0 THEN 1.0::DOUBLE WHEN x IS NOT NULL THEN 0.0::DOUBLE END), 1.0) AS zr, count(x) AS n, CASE WHEN count(x) >= 5 THEN avg(x) ELSE 0 END AS mean, CASE WHEN count(x) >= 5 THEN stddev_pop(x) ELSE 0 END AS std,
    CASE WHEN count(x) >= 5 THEN coalesce(max(CASE WHEN r = 1 THEN x END), avg(x)) ELSE 0 END AS latest_value, CASE WHEN count(x) >= 10 THEN sign(avg(CASE WHEN k <= 5 THEN x END) - avg(CASE WHEN k > 5 AND k <= 10 THEN x END)) ELSE 0 END AS trend_sign FROM lk GROUP BY ticker, feature),
  h1 AS (SELECT h0.*, nan_rate + zr * 0.5::DOUBLE AS bad_rate, CASE WHEN n >= 5 THEN (latest_value - mean) / (std + 1e-10) ELSE 0 END AS zscore, coalesce(sign(predicted_return), 0) AS s FROM h0 LEFT JOIN lp USING (ticker)),
  h2 AS (SELECT *, abs(zscore) > 1.5 AS ex, bad_rate > 0.45 AS hb, s <> 0 AND trend_sign <> 0 AND trend_sign <> s AND abs(zscore) > 1 AS ag FROM h1),
  h3 AS (SELECT *, ex OR hb OR ag AS suspicious, s <> 0 AND trend_sign <> 0 AND NOT ex AND NOT hb AND NOT ag AND trend_sign = s AND abs(zscore) > 0.5 AS al FROM h2),
  h4 AS (SELECT *, NOT suspicious AND bad_rate < 0.1 AND std > 1e-8 AND std / (abs(mean) + 1e-8) < 1.0 AND abs(zscore) < 1.5 AS st FROM h3)"""


@query("B20_feature_health", f"""WITH {HEALTH} SELECT ticker, feature, {rounds(['zscore', 'nan_rate', 'bad_rate', 'trend_sign', 'latest_value', 'mean', 'std'], 5)}, suspicious, (al OR st) AND NOT suspicious AS supportive,
  array_to_string(list_filter([CASE WHEN ex THEN 'extreme_zscore' END, CASE WHEN hb THEN 'high_bad_rate' END, CASE WHEN ag THEN 'trend_contradicts_prediction' END, CASE WHEN al THEN 'trend_supports_prediction' END, CASE WHEN st THEN 'stable_feature' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM h4""")
def b20(spark, sf):
    p = predictions(spark, sf)
    last = p.groupBy("ticker").agg(F.max_by("pred", "date").alias("predicted_return"))
    # every second value of one feature is missing, from the newest on
    odd = F.pmod(F.row_number().over(D.Window.partitionBy("ticker").orderBy(F.desc("date"))), F.lit(2)) == 0
    feats = p.withColumn("__odd", odd).withColumn("rev1", F.when(F.col("__odd"), F.col("rev1")))
    h = X.feature_health(feats, HC, last, z_limit=1.5, bad_limit=0.45)
    return rounded(h.withColumn("reasons", F.array_join("reasons", "; ")), 5)


CONF = "CASE WHEN ic >= 0.05 AND directional_accuracy >= 0.52 THEN 'hot' WHEN ic < 0.02 OR directional_accuracy < 0.50 THEN 'cold' ELSE 'warm' END"


@query("B21_model_confidence", f"WITH {PREDS}, g AS (SELECT date, {metrics_sql('rev1', 'target')} FROM preds GROUP BY date) SELECT date, {r6('ic', 'ic')}, {CONF} AS confidence FROM g")
def b21(spark, sf):
    m = M.regression_metrics(predictions(spark, sf), "rev1", by=("date",))
    return rounded(X.model_confidence(m).select("date", "ic", "confidence"))


DCONF = f"dc AS (SELECT date, CASE WHEN avg(rev1) > 0 THEN 'cold' WHEN avg(ret5) > 1 THEN 'hot' ELSE 'warm' END AS confidence FROM preds GROUP BY date)"
APPR = f"""{PREDS}, {AGR}, {DCONF}, ap0 AS (SELECT ticker, date, pred AS predicted_return, agr.* EXCLUDE (ticker, date), confidence FROM agr JOIN dc USING (date)),
  ap AS (SELECT *, CASE WHEN confidence = 'cold' THEN ['model confidence is cold'] ELSE list_filter([CASE WHEN n < 3 THEN 'only ' || n || ' active sub-models' END, CASE WHEN abs(predicted_return) < 0.05 THEN 'predicted return below threshold' END,
    CASE WHEN overall_agreement < 0.5 THEN 'sub-model agreement below threshold' END, CASE WHEN direction_agreement < 0.55 THEN 'directional agreement below floor' END, CASE WHEN std_prediction < 1e-6 AND confidence <> 'hot' THEN 'sub-model spread near zero' END], lambda x: x IS NOT NULL) END AS reasons,
    CASE WHEN confidence = 'hot' AND overall_agreement > 0.7 THEN 'low' WHEN confidence = 'cold' OR overall_agreement < 0.4 OR direction_agreement < 0.55 THEN 'high' ELSE 'medium' END AS risk_level FROM ap0)"""


def gated(spark, sf):
    p = mapped(spark, sf)
    conf = p.groupBy("date").agg(F.avg("rev1").alias("a"), F.avg("ret5").alias("b")).select(
        "date", F.when(F.col("a") > 0, "cold").when(F.col("b") > 1, "hot").otherwise("warm").alias("confidence")
    )
    df = X.agreement(p.withColumn("predicted_return", F.col("pred"))).join(F.broadcast(conf), "date")  # one row per date
    return X.approve(df, min_return=0.05)


@query("B22_approve", f"WITH {APPR} SELECT ticker, date, len(reasons) = 0 AS approved, array_to_string(reasons, '; ') AS reasons, risk_level FROM ap")
def b22(spark, sf):
    return gated(spark, sf).select("ticker", "date", "approved", F.array_join("reasons", "; ").alias("reasons"), "risk_level")


SIZE = "round(least({m}::DOUBLE * CASE regime WHEN 'bull_low_vol' THEN 1.0 WHEN 'bull_high_vol' THEN 0.7 WHEN 'sideways' THEN 0.5 WHEN 'bear_low_vol' THEN 0.3 WHEN 'bear_high_vol' THEN 0.2 ELSE 0.5 END::DOUBLE * CASE confidence WHEN 'hot' THEN 1.0 WHEN 'warm' THEN 0.6 WHEN 'cold' THEN 0.2 ELSE 0.5 END::DOUBLE * (0.5::DOUBLE + 0.5::DOUBLE * overall_agreement), {m}), 4)"
_RG = "CASE quarter(date) WHEN 1 THEN 'bull_low_vol' WHEN 2 THEN 'sideways' WHEN 3 THEN 'bear_high_vol' ELSE 'other' END"


@query("B23_position_size", f"WITH {APPR}, z AS (SELECT *, {_RG} AS regime FROM ap) SELECT ticker, date, {SIZE.format(m=0.0473)} AS position_size_pct FROM z")
def b23(spark, sf):
    q = F.quarter("date")
    df = gated(spark, sf).withColumn("regime", F.when(q == 1, "bull_low_vol").when(q == 2, "sideways").when(q == 3, "bear_high_vol").otherwise("other"))
    return X.position_size(df, 0.0473).select("ticker", "date", "position_size_pct")


STOPS = f"""sp0 AS (SELECT *, greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) AS tr0, {lag('close')} AS pc, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS r FROM bars),
  stops AS (SELECT ticker, arg_max(close, date) AS price, CASE WHEN count(pc) = 14 THEN avg(tr0) END AS atr FROM sp0 WHERE r <= 14 GROUP BY ticker)"""
ORD = f"""{PREDS}, {AGR}, {STOPS}, od0 AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rr FROM agr), od1 AS (SELECT * FROM od0 WHERE rr = 1 ORDER BY pred DESC, ticker LIMIT 40),
  od2 AS (SELECT *, 'sideways' AS regime, 'warm' AS confidence FROM od1 JOIN stops USING (ticker) WHERE n >= 3 AND abs(pred) >= 0.001 AND overall_agreement >= 0.5 AND direction_agreement >= 0.55 AND std_prediction >= 1e-6 AND price >= 2),
  orders_ AS (SELECT ticker, CASE WHEN pred > 0 THEN 'long' ELSE 'short' END AS direction, {SIZE.format(m=0.05)} AS position_size_pct, CASE WHEN pred > 0 THEN price - 2 * atr ELSE price + 2 * atr END AS stop_loss, CASE WHEN pred > 0 THEN price + 3 * atr ELSE price - 3 * atr END AS take_profit, atr, price AS current_price,
    CASE WHEN overall_agreement < 0.4 THEN 'high' ELSE 'medium' END AS risk_level, regime AS regime_label, confidence AS model_confidence, pred AS predicted_return, overall_agreement AS sub_model_agreement, std_prediction AS sub_model_spread FROM od2)"""


def orders(spark, sf):
    m = mapped(spark, sf)
    last = m.groupBy("ticker").agg(F.max_by(F.struct(F.col("pred").alias("predicted_return"), "ret5", "rev1", "sma20"), "date").alias("s"))
    p = last.select("ticker", "s.predicted_return", "s.ret5", "s.rev1", "s.sma20").withColumn("preds", model_map())
    return X.build_orders(p, D.atr_stops(T.bars_daily(spark, sf)), "sideways", "warm", top=40)


ONUM = ["stop_loss", "take_profit", "atr", "predicted_return", "sub_model_agreement", "sub_model_spread"]


@query("B24_build_orders", f"WITH {ORD} SELECT ticker, direction, position_size_pct, {rounds(ONUM, 4)}, {r6('current_price', 'current_price', 8)}, risk_level, regime_label, model_confidence FROM orders_")
def b24(spark, sf):
    return rounded(orders(spark, sf).withColumn("current_price", half_away("current_price", 8)), 4, skip=("current_price",))


@query("B25_bracket_levels", f"""WITH {ORD}, px AS (SELECT ticker, arg_max(close, date) * CASE WHEN length(ticker) = 2 THEN 2.5::DOUBLE ELSE 0.4::DOUBLE END AS price FROM bars GROUP BY ticker), held AS (SELECT DISTINCT 'S' || s_suppkey AS ticker FROM supplier WHERE s_nationkey = 3),
  b0 AS (SELECT o.*, price, 20000::DOUBLE * position_size_pct AS notional, CASE WHEN direction = 'long' THEN 1.0 ELSE -1.0 END AS side FROM orders_ o JOIN px USING (ticker) WHERE ticker NOT IN (SELECT ticker FROM held) AND price >= 2),
  b1 AS (SELECT *, coalesce(nullif(stop_loss, 0), price - side * 2 * coalesce(nullif(atr, 0), price * 0.03)) AS st, coalesce(nullif(take_profit, 0), price + side * 3 * coalesce(nullif(atr, 0), price * 0.03)) AS tp FROM b0 WHERE notional >= 10)
  SELECT ticker, direction, {r6('price', 'price', 5)}, {r6('notional', 'notional', 4)}, {r6('CASE WHEN (st - price) * side >= 0 THEN price * (1 - side * 0.05::DOUBLE) ELSE st END', 'stop_loss', 4)}, {r6('CASE WHEN (tp - price) * side <= 0 THEN price * (1 + side * 0.1::DOUBLE) ELSE tp END', 'take_profit', 4)} FROM b1""")
def b25(spark, sf):
    px = T.bars_daily(spark, sf).groupBy("ticker").agg(F.max_by("close", "date").alias("c")).select(
        "ticker", (F.col("c") * F.when(F.length("ticker") == 2, 2.5).otherwise(0.4)).alias("price")
    )
    held = T.table(spark, sf, "supplier").where("s_nationkey = 3").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker"))
    b = X.bracket_levels(orders(spark, sf), px, held, 20000)
    b = b.select("ticker", "direction", half_away("price", 5).alias("price"), "notional", "stop_loss", "take_profit")
    return rounded(b, 4, skip=("price",))


JR = f"""jr0 AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY pred DESC, ticker DESC) AS r FROM preds),
  jr AS (SELECT ticker, date, CASE WHEN month(date) % 2 = 0 THEN 'short' ELSE 'long' END AS direction, close AS entry_price, 'Q' || quarter(date) AS regime_label, pred AS predicted_return, least(abs(sma20), 1.0) AS sub_model_agreement, ret5, sma20 FROM jr0 WHERE r <= 3)"""


def journal(spark, sf):
    """The three highest predictions of each date as journal rows without outcomes."""
    best = P.top_k(predictions(spark, sf), "pred", 3)
    known = {
        "timestamp": F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss"), "run_id": F.col("date").cast("string"), "ticker": F.col("ticker"),
        "direction": F.when(F.month("date") % 2 == 0, "short").otherwise("long"), "entry_price": F.col("close"),
        "regime_label": F.concat(F.lit("Q"), F.quarter("date").cast("string")), "predicted_return": F.col("pred"),
        "sub_model_agreement": F.least(F.abs("sma20"), F.lit(1.0)), "regime_features": F.create_map(F.lit("ret5"), F.col("ret5"), F.lit("sma20"), F.col("sma20")),
    }
    fields = [tuple(f.rsplit(" ", 1)) for f in JOURNAL_SCHEMA.split(", ")]
    return best.select(*[known.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields])


FILLED = f"""{JR}, jb AS (SELECT ticker, date, lead(date, 5) OVER (PARTITION BY ticker ORDER BY date) AS xd, lead(close, 5) OVER (PARTITION BY ticker ORDER BY date) AS xp FROM bars),
  jf AS (SELECT jr.*, xd, xp, CASE WHEN direction = 'short' THEN -(xp - entry_price) / entry_price ELSE (xp - entry_price) / entry_price END AS actual_return FROM jr JOIN jb USING (ticker, date))"""


def resolved(spark, sf):
    return X.fill_outcomes(journal(spark, sf), T.bars_daily(spark, sf))


@query("B26_fill_outcomes", f"WITH {PREDS}, {FILLED} SELECT ticker, strftime(date, '%Y-%m-%dT00:00:00') AS timestamp, direction, {r6('entry_price', 'entry_price', 8)}, {r6('xp', 'exit_price', 8)}, strftime(xd, '%Y-%m-%dT00:00:00') AS exit_timestamp, CASE WHEN xp IS NOT NULL THEN 'time_exit' END AS exit_reason, {r6('actual_return', 'actual_return')} FROM jf")
def b26(spark, sf):
    j = resolved(spark, sf).select("ticker", "timestamp", "direction", half_away("entry_price", 8).alias("entry_price"), half_away("exit_price", 8).alias("exit_price"), "exit_timestamp", "exit_reason", "actual_return")
    return rounded(j, 6, skip=("entry_price", "exit_price"))


@query("B27_mid_price", f"""WITH {BARS}, q AS (SELECT 'S' || s_suppkey AS ticker, CASE WHEN s_suppkey % 4 IN (0, 1) THEN s_acctbal END AS bid, CASE WHEN s_suppkey % 4 IN (0, 2) THEN s_acctbal * 1.01::DOUBLE END AS ask FROM supplier WHERE s_suppkey % 7 <> 0), c AS (SELECT ticker, arg_max(close, date) AS close FROM bars GROUP BY ticker)
  SELECT s.ticker, round(coalesce(CASE WHEN ask > 0 AND bid > 0 THEN round((ask + bid) / 2, 4) WHEN ask > 0 THEN ask WHEN bid > 0 THEN bid END, close), 7) AS price FROM (SELECT 'S' || s_suppkey AS ticker FROM supplier) s LEFT JOIN q USING (ticker) LEFT JOIN c USING (ticker)""")
def b27(spark, sf):
    s = T.table(spark, sf, "supplier")
    k, b = F.pmod("s_suppkey", F.lit(4)), F.col("s_acctbal")
    t = F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker")
    q = s.where("s_suppkey % 7 <> 0").select(t, F.when(k.isin(0, 1), b).alias("bid"), F.when(k.isin(0, 2), b * 1.01).alias("ask"))
    return rounded(X.mid_price(q, T.bars_daily(spark, sf), s.select(t)), 7)


@query("B28_equity_snapshots", f"""WITH {event_bars('hour')}, e AS (SELECT CAST(ts AS DATE) AS date, arg_max(row(value * 100, user_id * 1.5::DOUBLE, event_id % 10), row(ts, event_id)) AS s FROM events GROUP BY 1),
  b AS (SELECT date, arg_max(close, ts) AS b FROM mbars WHERE ticker = 'click' GROUP BY date), d AS (SELECT date, round(s[1], 2) AS equity, round(s[2], 2) AS cash, s[3] AS open_positions FROM e),
  x AS (SELECT d.*, coalesce(round(equity - lag(equity) OVER (ORDER BY date), 2), 0.0) AS pnl_today, equity / first(equity) OVER (ORDER BY date) - 1 AS rp, last_value(b IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS bb FROM d LEFT JOIN b USING (date)),
  y AS (SELECT *, bb / first_value(bb IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS bp FROM x) SELECT date, equity, cash, open_positions, pnl_today, {r6('rp', 'return_pct')}, {r6('bp', 'benchmark_pct')}, {r6('rp - bp', 'alpha')} FROM y""")
def b28(spark, sf):
    ev = T.table(spark, sf, "events")
    acct = ev.select(F.struct(F.col("ts").cast("timestamp").alias("t"), "event_id").alias("k"), F.col("ts").cast("timestamp").alias("ts"), (F.col("value") * 100).alias("equity"), (F.col("user_id") * 1.5).alias("cash"), F.pmod("event_id", F.lit(10)).alias("open_positions"))
    # the account is read at distinct moments: keep the last event of each
    acct = acct.groupBy("ts").agg(F.max_by(F.struct("equity", "cash", "open_positions"), "k").alias("s")).select("ts", "s.*")
    bench = T.bars_minute(spark, sf, "hour").where("ticker = 'click'").groupBy("date").agg(F.max_by("close", "ts").alias("close"))
    return rounded(X.equity_snapshots(acct, bench))


@query("B29_open_positions", f"""WITH {PREDS}, {LAST}, p AS (SELECT 'S' || s_suppkey AS ticker, CAST(s_suppkey % 5 - 2 AS DOUBLE) AS qty, s_acctbal AS avg_entry_price, s_acctbal + s_nationkey AS current_price FROM supplier)
  SELECT ticker, qty, avg_entry_price, current_price, CASE WHEN qty > 0 THEN 'long' ELSE 'short' END AS side, {r6('qty * current_price', 'market_value', 4)}, {r6('qty * (current_price - avg_entry_price)', 'unrealized_pl', 4)}, {r6('sign(qty) * (current_price - avg_entry_price) * 100 / avg_entry_price', 'unrealized_plpc', 5)},
    {r6('predicted_return', 'predicted_return')}, sign(predicted_return) = sign(qty) AS signal_agrees FROM p LEFT JOIN lp USING (ticker) WHERE qty <> 0""")
def b29(spark, sf):
    s = T.table(spark, sf, "supplier")
    pos = s.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker"), (F.pmod("s_suppkey", F.lit(5)) - 2).cast("double").alias("qty"), F.col("s_acctbal").alias("avg_entry_price"), (F.col("s_acctbal") + F.col("s_nationkey")).alias("current_price"))
    sig = predictions(spark, sf).groupBy("ticker").agg(F.max_by("pred", "date").alias("predicted_return"))
    out = X.open_positions(pos, sig)
    return out.withColumns({"market_value": half_away("market_value", 4), "unrealized_pl": half_away("unrealized_pl", 4) + 0.0, "unrealized_plpc": half_away("unrealized_plpc", 5) + 0.0, "predicted_return": half_away("predicted_return", 6)})


# --- feedback ----------------------------------------------------------------

# two-feature ridge in closed form on the scaled training part
HOLD = """hd AS (SELECT date, count(*) AS n FROM preds GROUP BY date), hc AS (SELECT date, sum(n) OVER (ORDER BY date) <= floor(sum(n) OVER () * 0.8::DOUBLE) AS train FROM hd),
  hx AS (SELECT p.*, train FROM preds p JOIN hc USING (date)), hm AS (SELECT avg(ret5) AS m1, stddev_pop(ret5) + 1e-6 AS s1, avg(rev1) AS m2, stddev_pop(rev1) + 1e-6 AS s2, count(*) AS n FROM hx WHERE train),
  hs AS (SELECT train, target AS y, (ret5 - m1) / s1 AS a, (rev1 - m2) / s2 AS b, n FROM hx, hm), hg AS (SELECT sum(a * a) + {ridge} AS aa, sum(a * b) AS ab, sum(b * b) + {ridge} AS bb, sum(a * y) AS ay, sum(b * y) AS byy FROM hs WHERE train),
  hw AS (SELECT (ay * bb - byy * ab) / (aa * bb - ab * ab) AS w1, (aa * byy - ab * ay) / (aa * bb - ab * ab) AS w2 FROM hg), hp AS (SELECT a * w1 + b * w2 AS p, y, n FROM hs, hw WHERE NOT train)"""


@query("A13_ridge_ic", f"WITH {PREDS}, {HOLD.format(ridge='50.0')} SELECT {r6('covar_pop(p, y) / (stddev_pop(p) * stddev_pop(y))', 'ic', 5)}, count(*) AS n_valid, any_value(n) AS n_train FROM hp")
def a13(spark, sf):
    return rounded(L.ridge_ic(predictions(spark, sf), ["ret5", "rev1"], ridge=50.0), 5)


def _ic3(c: str) -> str:
    """IC with features a, b and ``c`` by Cramer's rule on the sums of the training part."""
    det = f"(aa * (bb * {c}{c} - b{c} * b{c}) - ab * (ab * {c}{c} - b{c} * a{c}) + a{c} * (ab * b{c} - bb * a{c}))"
    w = [
        f"(ay * (bb * {c}{c} - b{c} * b{c}) - ab * (byy * {c}{c} - b{c} * {c}y) + a{c} * (byy * b{c} - bb * {c}y)) / {det}",
        f"(aa * (byy * {c}{c} - b{c} * {c}y) - ay * (ab * {c}{c} - b{c} * a{c}) + a{c} * (ab * {c}y - byy * a{c})) / {det}",
        f"(aa * (bb * {c}y - byy * b{c}) - ab * (ab * {c}y - byy * a{c}) + ay * (ab * b{c} - bb * a{c})) / {det}",
    ]
    return f"(SELECT corr(a * w1 + b * w2 + {c} * w3, y) FROM (SELECT a, b, {c}, y, {', '.join(f'{e} AS w{i}' for i, e in enumerate(w, 1))} FROM hs, hg WHERE NOT train))"


_AB = ["a", "b", "c", "d"]
ABLATE = f"""pk AS (SELECT date, ret5 AS a0, rev1 AS b0, sma20 AS c0, ret5 * rev1 AS d0, target AS y FROM preds WHERE ret5 IS NOT NULL AND rev1 IS NOT NULL AND sma20 IS NOT NULL AND target IS NOT NULL),
  hd AS (SELECT date, count(*) AS n FROM pk GROUP BY date), hc AS (SELECT date, sum(n) OVER (ORDER BY date) <= floor(sum(n) OVER () * 0.8::DOUBLE) AS train FROM hd), hx AS (SELECT pk.*, train FROM pk JOIN hc USING (date)),
  hm AS (SELECT {', '.join(f'avg({x}0) AS m{x}, stddev_pop({x}0) + 1e-6 AS s{x}' for x in _AB)} FROM hx WHERE train), hs AS (SELECT train, y, {', '.join(f'({x}0 - m{x}) / s{x} AS {x}' for x in _AB)} FROM hx, hm),
  hg AS (SELECT {', '.join(f'sum({x} * {x}) + 0.001 AS {x}{x}' for x in _AB)}, sum(a * b) AS ab, sum(a * c) AS ac, sum(a * d) AS ad, sum(b * c) AS bc, sum(b * d) AS bd, sum(a * y) AS ay, sum(b * y) AS byy, sum(c * y) AS cy, sum(d * y) AS dy FROM hs WHERE train),
  ic AS (SELECT (SELECT corr(a * w1 + b * w2, y) FROM (SELECT a, b, y, (ay * bb - byy * ab) / (aa * bb - ab * ab) AS w1, (aa * byy - ab * ay) / (aa * bb - ab * ab) AS w2 FROM hs, hg WHERE NOT train)) AS base, {_ic3('c')} AS ic_c, {_ic3('d')} AS ic_d),
  ab AS (SELECT 'sma20' AS name, ic_c AS ic, base FROM ic UNION ALL SELECT 'feat_cross', ic_d, base FROM ic)"""


@query("A13_ablate", f"WITH {PREDS}, {ABLATE} SELECT name, {r6('ic', 'ic', 5)}, {r6('base', 'baseline_ic', 5)}, {r6('ic - base', 'delta_ic', 5)}, CASE WHEN ic - base >= 0.001 THEN 'promoted' ELSE 'rejected' END AS status FROM ab")
def a13_ablate(spark, sf):
    p = predictions(spark, sf).withColumn("feat_cross", F.col("ret5") * F.col("rev1"))
    return rounded(L.ablate(p, ["ret5", "rev1"], ["sma20", "feat_cross"]), 5)


@query("A14_feature_drift", f"""WITH {PREDS}, {JR}, q AS (SELECT *, rank() OVER (ORDER BY date) - 1 AS lo, count(*) OVER () AS tot FROM jr), l AS (SELECT lo < greatest(floor(tot * 0.8::DOUBLE), 1) AS base, 'ret5' AS feature, ret5 AS x FROM q UNION ALL SELECT lo < greatest(floor(tot * 0.8::DOUBLE), 1), 'sma20', sma20 FROM q),
  g AS (SELECT feature, avg(CASE WHEN base THEN x END) AS base_mean, stddev_samp(CASE WHEN base THEN x END) AS base_std, avg(CASE WHEN NOT base THEN x END) AS recent_mean FROM l GROUP BY feature), s AS (SELECT *, coalesce(CASE WHEN base_std > 0 THEN abs(recent_mean - base_mean) / (base_std + 1e-8) END, 0.0) AS score FROM g)
  SELECT feature, {rounds(['base_mean', 'base_std', 'recent_mean', 'score'], 5)}, score >= 2 AS drifted FROM s""")
def a14(spark, sf):
    return rounded(L.feature_drift(journal(spark, sf)), 5)


REPORT = f"""{FILLED}, rs AS (SELECT * FROM jf WHERE actual_return IS NOT NULL), rg0 AS (SELECT 'regime' AS level, regime_label AS name, actual_return AS r FROM rs UNION ALL SELECT 'ticker', ticker, actual_return FROM rs UNION ALL SELECT 'portfolio', 'all', actual_return FROM rs),
  rp AS (SELECT level, name, count(*) AS n, avg(CASE WHEN r > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS win_rate, avg(r) AS avg_return FROM rg0 GROUP BY level, name),
  rf AS (SELECT *, n >= 10 AND CASE level WHEN 'regime' THEN win_rate < 0.48 OR avg_return < 0 WHEN 'ticker' THEN win_rate < 0.45 OR avg_return < -0.001 ELSE avg_return < -0.001 END AS flagged FROM rp)"""


@query("A15_training_report", f"WITH {PREDS}, {REPORT} SELECT level, name, n, {rounds(['win_rate', 'avg_return'])}, flagged FROM rf")
def a15(spark, sf):
    return rounded(L.training_report(resolved(spark, sf)))


@query("A15_should_retrain", f"WITH {PREDS}, {REPORT} SELECT CAST(count(CASE WHEN flagged THEN 1 END) AS BIGINT) AS n_flagged, CAST(0 AS BIGINT) AS n_drifted, count(CASE WHEN flagged THEN 1 END) > 0 AS trigger_retrain FROM rf")
def a15_trigger(spark, sf):
    j = resolved(spark, sf)
    return L.should_retrain(L.training_report(j), L.feature_drift(j))


RWS = f"""{PREDS}, src AS (SELECT *, 'Q' || quarter(date) AS regime FROM preds), m AS (SELECT regime, {metrics_sql()} FROM src GROUP BY regime), w0 AS (SELECT regime, (1 - directional_accuracy) + (1 - least(abs(ic), 1.0)) AS w FROM m),
  rw AS (SELECT regime, 1 + coalesce((w - min(w) OVER ()) / nullif(max(w) OVER () - min(w) OVER (), 0), 0) * 4 AS weight FROM w0)"""


def _regime_of(df):
    return df.withColumn("regime", F.concat(F.lit("Q"), F.quarter("date").cast("string")))


@query("A18_regime_weights", f"WITH {RWS} SELECT ticker, date, {r6('coalesce(CASE WHEN year(date) > 1995 THEN weight END, 1.0)', 'weight', 5)} FROM src JOIN rw USING (regime)")
def a18(spark, sf):
    p = predictions(spark, sf)
    w = L.regime_weights(M.regression_metrics(_regime_of(p), by=("regime",)))
    labels = _regime_of(p.select("date").distinct()).where(F.year("date") > 1995)
    return rounded(L.sample_weights(p.select("ticker", "date"), labels, w), 5)


@query("A19_feature_trust", f"""WITH {PREDS}, a AS ({' UNION ALL '.join(f"SELECT date, '{c}' AS feature, {c} < -0.2 AS suspicious, {c} > 0.5 AS supportive FROM preds" for c in MODELS)}),
  n AS (SELECT date, dense_rank() OVER (ORDER BY date DESC) - 1 AS later FROM (SELECT DISTINCT date FROM a)), g AS (SELECT feature, sum(0.95::DOUBLE ** later) AS n_seen, sum(CASE WHEN suspicious THEN 0.95::DOUBLE ** later ELSE 0 END) AS n_suspicious, sum(CASE WHEN supportive THEN 0.95::DOUBLE ** later ELSE 0 END) AS n_supportive FROM a JOIN n USING (date) GROUP BY feature),
  t AS (SELECT *, (n_supportive - n_suspicious) / n_seen AS trust FROM g) SELECT feature, {rounds(['n_seen', 'n_suspicious', 'n_supportive', 'trust'], 5)}, {r6('greatest(0, (trust + 1) / 2)', 'weight', 5)}, trust < -0.5 AS dropped, CAST(row_number() OVER (ORDER BY trust DESC, feature) AS INTEGER) AS rank FROM t""")
def a19(spark, sf):
    long = M.stack_models(predictions(spark, sf), MODELS, ["date"])
    a = long.select(F.unix_date("date").alias("run_ts"), F.col("model").alias("feature"), (F.col("pred") < -0.2).alias("suspicious"), (F.col("pred") > 0.5).alias("supportive"))
    return rounded(L.feature_trust(a), 5)


_FS = " UNION ALL ".join(f"SELECT fold, '{m}' AS model, {m} AS p, target FROM te" for m in MODELS)


@query("A20_attention_bias", f"""WITH RECURSIVE {PREDS}, {windows_sql(False)}, {FOLDS}, te AS (SELECT preds.*, fold FROM preds JOIN parts ON date >= lo AND date < hi WHERE split = 'test'), {FILLED},
  fs AS ({_FS}), im AS (SELECT fold, model, {metrics_sql('p', 'target')} FROM fs GROUP BY fold, model), ja AS (SELECT fold, avg(CASE WHEN actual_return > 0 THEN 1 ELSE -1 END * sub_model_agreement / 3) AS at0 FROM jf JOIN parts ON date >= lo AND date < hi WHERE split = 'test' AND actual_return IS NOT NULL GROUP BY fold),
  jm AS (SELECT im.fold, im.model, im.ic, coalesce(at0, 0) * CASE im.model WHEN 'ret5' THEN 1 WHEN 'rev1' THEN 2 ELSE 3 END AS att FROM im LEFT JOIN ja ON ja.fold = im.fold),
  rb AS (SELECT fold, model, ic, (0.7::DOUBLE * CASE WHEN stddev_pop(ic) OVER (PARTITION BY fold) > 1e-8 THEN (ic - avg(ic) OVER (PARTITION BY fold)) / stddev_pop(ic) OVER (PARTITION BY fold) ELSE 0 END
     + 0.3::DOUBLE * CASE WHEN stddev_pop(att) OVER (PARTITION BY fold) > 1e-8 THEN (att - avg(att) OVER (PARTITION BY fold)) / stddev_pop(att) OVER (PARTITION BY fold) ELSE 0 END) * 0.5::DOUBLE AS raw FROM jm),
  em AS (SELECT fold, model, ic, raw, least(greatest(raw, -2.0), 2.0)::DOUBLE AS bias FROM rb WHERE fold = 0 UNION ALL SELECT n.fold, n.model, n.ic, n.raw, least(greatest(0.7::DOUBLE * e.bias + 0.3::DOUBLE * n.raw, -2.0), 2.0)::DOUBLE FROM em e JOIN rb n ON n.model = e.model AND n.fold = e.fold + 1)
  SELECT fold, model, {r6('ic', 'ic', 5)}, {r6('raw', 'raw_bias', 5)}, {r6('bias', 'bias', 5)} FROM em""")
def a20(spark, sf):
    windows = G.walk_forward_windows(T.bars_daily(spark, sf), expanding=False)
    te = G.assign_folds(predictions(spark, sf), windows).where("split = 'test'")
    m = M.regression_metrics(M.stack_models(te, MODELS, ["fold", "target"]), by=("fold", "model")).select("fold", "model", "ic")
    j = resolved(spark, sf).withColumn("date", F.to_date(F.try_to_timestamp("timestamp")))
    att = L.journal_attribution(G.assign_folds(j, windows).where("split = 'test'"), 3)
    # credit is shared evenly; uneven shares here give the z-score something to see
    share = F.explode(F.map_from_arrays(F.array(*[F.lit(x) for x in MODELS]), F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)))).alias("model", "k")
    att = att.select("fold", "attribution", share).select("fold", "model", (F.col("attribution") * F.col("k")).alias("attribution"))
    return rounded(L.attention_bias(m, att), 5)
