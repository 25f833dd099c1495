"""Strategy and portfolio queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import half_away, rounded
from ..operators import metrics as M
from ..operators import portfolio as P
from ..operators import strategies as S
from ..operators import targets as G
from ..sources import tables as T
from .daily import MACD, RSI
from .metrics import FM, MODELS, PERF, PREDS, fold_metrics, metrics_sql, perf_sql, positions_sql, predictions, turnover_sql
from .registry import query, r6, rounds
from .sql import BARS, NUM, lag, run, seeded_sql, win
from .targets import FOLDS, windows_sql


def _sig(df):
    return df.select("ticker", "date", (half_away(F.col("signal").cast("double"), 6) + 0.0).alias("signal"))


@query("B1_buy_and_hold", f"WITH {BARS} SELECT ticker, date, 1.0::DOUBLE AS signal FROM bars")
def b1(spark, sf):
    return _sig(S.buy_and_hold(T.bars_daily(spark, sf)))


def sma_sig(fast, slow):
    return f"CASE WHEN t < {slow} THEN 0.0 WHEN avg(close) {win(fast)} > avg(close) {win(slow)} THEN 1.0 ELSE -0.5 END"


@query("B2_sma_crossover", f"WITH {NUM} SELECT ticker, date, {r6(sma_sig(10, 30), 'signal')} FROM num")
def b2(spark, sf):
    return _sig(S.sma_crossover(T.bars_daily(spark, sf)))


MACD_SIG = "CASE WHEN t < 26 THEN 0.0 WHEN macd > sig THEN 1.0 ELSE -0.5 END"


@query("B3_macd_signal", f"WITH RECURSIVE {MACD} SELECT ticker, date, {r6(MACD_SIG, 'signal')} FROM macd")
def b3(spark, sf):
    return _sig(S.macd_signal(T.bars_daily(spark, sf)))


MR = f"""mr0 AS (SELECT *, avg(close) {win(20)} AS m, stddev_pop(close) {win(20)} AS s FROM num),
  mr1 AS (SELECT *, CASE WHEN t < 20 OR s < 1e-10 THEN 0.0 WHEN close - m < -2 * s THEN 1.0 WHEN close - m > 2 * s THEN -0.5 WHEN abs(close - m) < 0.5::DOUBLE * s THEN 0.0 END AS d FROM mr0),
  mr AS (SELECT *, coalesce(last_value(d IGNORE NULLS) {run()}, 0.0) AS signal FROM mr1)"""


@query("B4_mean_reversion", f"WITH {NUM}, {MR} SELECT ticker, date, {r6('signal', 'signal')} FROM mr")
def b4(spark, sf):
    return _sig(S.mean_reversion(T.bars_daily(spark, sf)))


def mom_safe(n):
    return f"CASE WHEN t < {n} THEN 0.0 ELSE least(greatest((close / {lag('close', n)} - 1) * 10, -1.0), 1.0) END"


@query("B5_momentum", f"WITH {NUM} SELECT ticker, date, {r6(mom_safe(20), 'signal')} FROM num")
def b5(spark, sf):
    return _sig(S.momentum(T.bars_daily(spark, sf)))


RSI_SIG = "CASE WHEN t <= 14 THEN 0.0 WHEN rsi < 30 THEN 1.0 WHEN rsi > 70 THEN -0.5 WHEN rsi < 50 THEN 0.5 ELSE 0.0 END"


@query("B6_rsi_signal", f"WITH RECURSIVE {RSI.format(u='0.0')} SELECT ticker, date, {r6(RSI_SIG, 'signal')} FROM rsi")
def b6(spark, sf):
    return _sig(S.rsi_signal(T.bars_daily(spark, sf)))


@query("B7_random_signal", f"""WITH {BARS}, d AS (SELECT ticker, date, CASE WHEN {seeded_sql(42, 'ticker', 'date')} % 1000000 < 100000 THEN [-1.0, -0.5, 0.0, 0.5, 1.0][{seeded_sql(43, 'ticker', 'date')} % 5 + 1] END AS p FROM bars)
  SELECT ticker, date, {r6('coalesce(last_value(p IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING), 0.0)', 'signal')} FROM d""")
def b7(spark, sf):
    return _sig(S.random_signal(T.bars_daily(spark, sf)))


@query("B8_perfect_foresight", f"WITH {NUM} SELECT ticker, date, {r6('CASE WHEN lead(close, 5) OVER (PARTITION BY ticker ORDER BY date) IS NULL THEN 0.0 ELSE least(greatest((lead(close, 5) OVER (PARTITION BY ticker ORDER BY date) / close - 1) * 20, -1.0), 1.0) END', 'signal')} FROM num")
def b8(spark, sf):
    return _sig(S.perfect_foresight(T.bars_daily(spark, sf)))


RULES = {"SMA(10/30)": lambda d: S.sma_crossover(d, 10, 30), "MeanRev(BB20)": S.mean_reversion, "Momentum(20d)": S.momentum}
SIGS = f"""{NUM}, {MR}, sg AS (SELECT 'SMA(10/30)' AS strategy, ticker, date, close, {sma_sig(10, 30)}::DOUBLE AS signal FROM num
  UNION ALL SELECT 'MeanRev(BB20)', ticker, date, close, signal::DOUBLE FROM mr UNION ALL SELECT 'Momentum(20d)', ticker, date, close, {mom_safe(20)}::DOUBLE FROM num)"""
_ST = "strategy, ticker"


def _w(c, n=1):
    return f"lag({c}) OVER (PARTITION BY {_ST} ORDER BY date)"


POSR = f"""{SIGS}, q0 AS (SELECT *, CASE WHEN abs(signal - coalesce({_w('signal')}, 0)) > 0.01 THEN signal END AS tk FROM sg),
  q1 AS (SELECT *, coalesce(last_value(tk IGNORE NULLS) OVER (PARTITION BY {_ST} ORDER BY date ROWS UNBOUNDED PRECEDING), 0.0) AS position FROM q0),
  pr AS (SELECT strategy, ticker, date, close, position, coalesce({_w('position')}, 0.0) * coalesce(close / {_w('close')} - 1, 0.0) - abs(position - coalesce({_w('position')}, 0.0)) * 0.001::DOUBLE AS ret FROM q1)"""


def positions(spark, sf):
    return P.position_returns(S.run_strategies(T.bars_daily(spark, sf), RULES))


@query("B9_position_returns", f"WITH {POSR} SELECT strategy, ticker, date, {rounds(['position', 'ret'])} FROM pr")
def b9(spark, sf):
    return rounded(positions(spark, sf).select("strategy", "ticker", "date", "position", "ret"))


TRADES = f"""{POSR}, u0 AS (SELECT *, CASE WHEN position <> coalesce({_w('position')}, 0) THEN 1 ELSE 0 END AS c, lead(date) OVER (PARTITION BY {_ST} ORDER BY date) AS nd, lead(close) OVER (PARTITION BY {_ST} ORDER BY date) AS nc FROM pr),
  u1 AS (SELECT *, CAST(sum(c) OVER (PARTITION BY {_ST} ORDER BY date ROWS UNBOUNDED PRECEDING) AS BIGINT) AS trade FROM u0),
  tr0 AS (SELECT strategy, ticker, trade, min(date) AS entry_date, max(coalesce(nd, date)) AS exit_date, arg_min(close, date) AS entry_price, arg_max(coalesce(nc, close), date) AS exit_price,
    max(position) AS pos, CAST(sum(CASE WHEN nd IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS holding_rows FROM u1 WHERE position <> 0 GROUP BY strategy, ticker, trade),
  tr AS (SELECT *, pos * (exit_price / entry_price - 1) AS pnl_pct FROM tr0)"""


@query("B10_trades", f"WITH {TRADES} SELECT strategy, ticker, trade, entry_date, exit_date, {r6('entry_price', 'entry_price', 8)}, {r6('exit_price', 'exit_price', 8)}, {r6('abs(pos)', 'size')}, holding_rows, CAST(sign(pos) AS INTEGER) AS direction, {r6('pnl_pct', 'pnl_pct')}, {r6('abs(pos) * 0.001::DOUBLE', 'cost')} FROM tr")
def b10(spark, sf):
    t = P.trades(positions(spark, sf))
    t = t.withColumns({c: half_away(c, 8) for c in ("entry_price", "exit_price")})
    return rounded(t, 6, skip=("entry_price", "exit_price"))


PSQL = f"""{TRADES}, {perf_sql('pr', 'strategy, ticker')}, tt AS (SELECT strategy, ticker, count(*) AS n_trades, avg(CASE WHEN pnl_pct > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS hit_rate, coalesce(avg(CASE WHEN pnl_pct > 0 THEN pnl_pct END), 0.0) AS avg_win,
    coalesce(avg(CASE WHEN pnl_pct <= 0 THEN pnl_pct END), 0.0) AS avg_loss, sum(CASE WHEN pnl_pct > 0 THEN pnl_pct ELSE 0.0 END) / nullif(abs(sum(CASE WHEN pnl_pct <= 0 THEN pnl_pct ELSE 0.0 END)), 0) AS profit_factor, avg(holding_rows) AS avg_holding FROM tr GROUP BY strategy, ticker),
  ps AS (SELECT perf.* EXCLUDE (hit_rate, avg_win, avg_loss, profit_factor), coalesce(n_trades, 0) AS n_trades, tt.hit_rate, tt.avg_win, tt.avg_loss, tt.profit_factor, avg_holding FROM perf LEFT JOIN tt USING (strategy, ticker))"""
# compounded returns span many orders of magnitude: compare their logarithm
LOG_TOTAL = "sign(total_return) * ln(1 + abs(total_return))"
POUT = f"{r6(LOG_TOTAL, 'log_total', 4)}, {rounds(PERF[1:], 4)}"


def _log_total(df):
    return df.withColumn("log_total", F.signum("total_return") * F.log1p(F.abs("total_return"))).drop("total_return")


def summary(spark, sf):
    p = positions(spark, sf)
    return P.performance_summary(p, by=("strategy", "ticker"), trades=P.trades(p))


@query("B11_performance_summary", f"WITH {PSQL} SELECT strategy, ticker, n_days, n_trades, {POUT}, {r6('avg_holding', 'avg_holding', 4)} FROM ps")
def b11(spark, sf):
    return rounded(_log_total(summary(spark, sf)), 4)


BEST = ["total_return", "sharpe", "sortino", "max_drawdown", "hit_rate", "profit_factor"]


@query("B12_compare_strategies", f"WITH {PSQL}, g AS (SELECT strategy, count(*) AS n_tickers, {', '.join(f'avg({c}) AS {c}' for c in BEST)} FROM ps GROUP BY strategy) SELECT strategy, n_tickers, {r6(LOG_TOTAL, 'log_total', 4)}, {rounds(BEST[1:], 4)}, CAST(row_number() OVER (ORDER BY sharpe DESC NULLS LAST, strategy) AS INTEGER) AS rank FROM g")
def b12(spark, sf):
    return rounded(_log_total(P.compare_strategies(summary(spark, sf))), 4)


LS = f"""ls0 AS (SELECT date, avg(CASE WHEN side = 1 THEN target END) - avg(CASE WHEN side = -1 THEN target END) AS ls FROM pos GROUP BY date),
  lsd AS (SELECT date, ls / 2.0::DOUBLE - turnover * 0.001::DOUBLE AS ret, turnover FROM ls0 JOIN tov USING (date)), {perf_sql('lsd')}"""
LS_OUT = f"SELECT n_days, {rounds(PERF, 5)}, (SELECT {r6('avg(turnover)', 'x', 5).rsplit(' AS ', 1)[0]} FROM lsd) AS avg_turnover FROM perf"


@query("B13_long_short", f"WITH {PREDS}, {positions_sql(20)}, {turnover_sql()}, {LS} {LS_OUT}")
def b13(spark, sf):
    return rounded(P.long_short(predictions(spark, sf)), 5)


@query("B13_long_short_half_rule", f"WITH {PREDS}, {positions_sql(5, 'half')}, {turnover_sql()}, {LS} {LS_OUT}")
def b13_half(spark, sf):
    return rounded(P.long_short(predictions(spark, sf), 5, "half"), 5)


@query("B14_long_only", f"""WITH {PREDS}, n AS (SELECT date, count(*) AS n FROM preds GROUP BY date), r AS (SELECT date, target, row_number() OVER (PARTITION BY date ORDER BY pred DESC, ticker DESC) AS r FROM preds WHERE pred > 0),
  h AS (SELECT date, avg(target) AS x FROM r JOIN n USING (date) WHERE r <= CASE WHEN n < 8 THEN greatest(1, n // 2) ELSE 8 END GROUP BY date), lo AS (SELECT date, coalesce(x, 0.0) AS ret FROM n LEFT JOIN h USING (date)), {perf_sql('lo')}
  SELECT n_days, {rounds(PERF, 5)} FROM perf""")
def b14(spark, sf):
    return rounded(P.long_only(predictions(spark, sf), 8), 5)


CURVES = ("top", "bottom", "market", "ls")


@query("B15_portfolio_curves", f"""WITH {PREDS}, r AS (SELECT *, count(*) OVER (PARTITION BY date) AS n, row_number() OVER (PARTITION BY date ORDER BY pred DESC, ticker DESC) AS a, row_number() OVER (PARTITION BY date ORDER BY pred, ticker) AS b FROM preds),
  g AS (SELECT date, avg(CASE WHEN a <= 5 THEN target END) AS top_ret, avg(CASE WHEN b <= 5 THEN target END) AS bottom_ret, avg(target) AS market_ret, avg(CASE WHEN a <= 5 THEN target END) - avg(CASE WHEN b <= 5 THEN target END) AS ls_ret FROM r WHERE n >= 5 GROUP BY date)
  SELECT date, {rounds([f'{c}_ret' for c in CURVES])}, {', '.join(r6(f'ln(abs(product(1 + {c}_ret) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)))', f'{c}_log_equity', 5) for c in CURVES)} FROM g""")
def b15(spark, sf):
    c = P.portfolio_curves(predictions(spark, sf), 5)
    logs = {f"{x}_log_equity": half_away(F.log(F.abs(f"{x}_equity")), 5) + 0.0 for x in CURVES}
    return rounded(c.withColumns(logs).select("date", *[f"{x}_ret" for x in CURVES], *logs), skip=tuple(logs))


@query("B16_stitched_oos", f"""WITH {PREDS}, {windows_sql(False)}, {FOLDS}, fp AS (SELECT preds.* EXCLUDE (pred), fold, CASE WHEN fold % 2 = 0 THEN pred ELSE ret5 END AS pred FROM preds JOIN parts ON date >= lo AND date < hi WHERE split = 'test'),
  nf AS (SELECT *, max(fold) OVER (PARTITION BY date) AS mf FROM fp), src AS (SELECT * FROM nf WHERE fold = mf), {positions_sql(20, src='src')},
  d AS (SELECT date, (avg(CASE WHEN side = 1 THEN target END) - avg(CASE WHEN side = -1 THEN target END)) / 2 AS ret FROM pos GROUP BY date), {perf_sql('d')}
  SELECT date, {r6('ret', 'ret')}, {r6('ln(eq)', 'log_equity', 5)}, {r6('dd', 'drawdown')} FROM perf1""")
def b16(spark, sf):
    p = predictions(spark, sf)
    windows = G.walk_forward_windows(T.bars_daily(spark, sf), expanding=False)
    # every fold predicts every row; odd folds with another model
    by_fold = p.withColumn("fold", F.explode(F.array(*[F.lit(i) for i in range(5)])))
    by_fold = by_fold.withColumn("pred", F.when(F.col("fold") % 2 == 0, F.col("pred")).otherwise(F.col("ret5")))
    out = P.stitched_oos(by_fold, windows)
    out = out.select("date", "ret", (half_away(F.log("equity"), 5) + 0.0).alias("log_equity"), "drawdown")
    return rounded(out, skip=("log_equity",))


@query("B17_baseline_lagged", f"WITH {PREDS}, b AS (SELECT *, coalesce({lag('target')}, 0.0) AS p FROM preds), g AS (SELECT {metrics_sql('p', 'target')} FROM b) SELECT {rounds(['mse', 'rmse', 'mae', 'ic', 'directional_accuracy'])}, n_samples FROM g")
def b17(spark, sf):
    return rounded(M.regression_metrics(P.baseline_predictions(predictions(spark, sf), "lagged")))


@query("B17_baseline_zero", f"WITH {PREDS}, b AS (SELECT *, 0.0::DOUBLE AS p FROM preds), g AS (SELECT {metrics_sql('p', 'target')} FROM b) SELECT {rounds(['mse', 'rmse', 'mae', 'ic', 'directional_accuracy'])}, n_samples FROM g")
def b17_zero(spark, sf):
    return rounded(M.regression_metrics(P.baseline_predictions(predictions(spark, sf), "zero")))


@query("B17_baseline_random", f"""WITH {PREDS}, b AS (SELECT *, sqrt(-2 * ln(({seeded_sql(42, 'ticker', 'date')} % 1099511627776 + 1) / 1099511627777::DOUBLE)) * cos(2 * pi() * (({seeded_sql(43, 'ticker', 'date')} % 1099511627776 + 1) / 1099511627777::DOUBLE)) AS p FROM preds),
  g AS (SELECT {metrics_sql('p', 'target')} FROM b) SELECT {rounds(['mse', 'rmse', 'mae', 'ic', 'directional_accuracy'])}, n_samples FROM g""")
def b17_random(spark, sf):
    return rounded(M.regression_metrics(P.baseline_predictions(predictions(spark, sf), "random")))


@query("B18_ensemble", f"""WITH {FM}, l AS (SELECT ticker, arg_max(row(ret5, rev1, sma20), date) AS m FROM preds GROUP BY ticker), p AS (SELECT ticker, fold, CASE fold % 3 WHEN 0 THEN m[1] WHEN 1 THEN m[2] ELSE m[3] END AS pred FROM l, range(5) r(fold)),
  b AS (SELECT fold, val_ic FROM fm ORDER BY val_ic DESC, fold LIMIT 3) SELECT ticker, {r6('CASE WHEN sum(val_ic) > 0 THEN sum(pred * val_ic) / sum(val_ic) ELSE avg(pred) END', 'predicted_return', 5)}, count(*) AS n_folds FROM p JOIN b USING (fold) GROUP BY ticker""")
def b18(spark, sf):
    last = predictions(spark, sf).groupBy("ticker").agg(F.max_by(F.struct(*MODELS), "date").alias("m"))
    k = F.col("fold") % 3
    p = last.withColumn("fold", F.explode(F.array(*[F.lit(i) for i in range(5)])))
    p = p.withColumn("pred", F.when(k == 0, F.col("m.ret5")).when(k == 1, F.col("m.rev1")).otherwise(F.col("m.sma20")))
    return rounded(P.ensemble(p, fold_metrics(spark, sf).select("fold", "val_ic")), 5)
