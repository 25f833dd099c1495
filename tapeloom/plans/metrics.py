"""Metric queries (A1-A4, A8-A14, A16, A17, A21-A23) and cross-sectional windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import clip, div, half_away, rounded, series, sma
from ..operators import metrics as M
from ..operators import portfolio as P
from ..operators import targets as G
from ..operators.strategies import hold_last
from ..session import work_dir
from ..sources import tables as T
from .registry import query, r6, rounds
from .sql import BARS, lag, run, sma as sma_sql
from .targets import FOLDS, windows_sql

MODELS = ["ret5", "rev1", "sma20"]


def predictions(spark, sf):
    """Three simple forecasts, their mean and the next-row return, one row per bar after warm-up."""
    w = series()
    df = T.bars_daily(spark, sf).select("ticker", "date", "close").withColumns(
        {
            "ret5": div("close", F.lag("close", 5).over(w)) - 1,
            "rev1": 1 - div("close", F.lag("close", 1).over(w)),
            "__sma": sma("close", w, 20),
            "__next": div(F.lead("close", 1).over(w), "close") - 1,
        }
    )
    df = df.withColumns({"sma20": div(F.col("close") - F.col("__sma"), "__sma"), "target": clip("__next", -0.2, 0.2), "raw_target": F.col("__next")})
    df = df.where("ret5 IS NOT NULL AND target IS NOT NULL")
    return df.withColumn("pred", (F.col("ret5") + F.col("rev1") + F.col("sma20")) / 3.0).drop("__sma", "__next")


PREDS = f"""{BARS}, p0 AS (SELECT ticker, date, close, close / {lag('close', 5)} - 1 AS ret5, 1 - close / {lag('close', 1)} AS rev1, {sma_sql('close', 20)} AS m,
    lead(close, 1) OVER (PARTITION BY ticker ORDER BY date) / close - 1 AS nx FROM bars),
  preds AS (SELECT ticker, date, close, ret5, rev1, (close - m) / m AS sma20, least(greatest(nx, -0.2), 0.2) AS target, nx AS raw_target,
    (ret5 + rev1 + (close - m) / m) / 3.0::DOUBLE AS pred FROM p0 WHERE ret5 IS NOT NULL AND nx IS NOT NULL)"""

COLS = ["mse", "rmse", "mae", "ic", "directional_accuracy"]


def metrics_sql(p: str = "pred", t: str = "target") -> str:
    corr = f"CASE WHEN stddev_pop({p}) < 1e-10 OR stddev_pop({t}) < 1e-10 THEN 0.0 ELSE covar_pop({p}, {t}) / (stddev_pop({p}) * stddev_pop({t})) END"
    return f"""avg(({p} - {t}) * ({p} - {t})) AS mse, sqrt(avg(({p} - {t}) * ({p} - {t}))) AS rmse, avg(abs({p} - {t})) AS mae, {corr} AS ic,
    avg(CASE WHEN ({p} > 0) = ({t} > 0) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS directional_accuracy, count(*) AS n_samples"""


def rank_sql(src: str, by: str, p: str = "pred", t: str = "target", name: str = "ric") -> str:
    part = f"PARTITION BY {by}" if by else ""
    keys = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""{name}0 AS (SELECT {keys}rank() OVER ({part} ORDER BY {p}) + (count(*) OVER (PARTITION BY {keys}{p}) - 1) / 2.0::DOUBLE AS rx,
      rank() OVER ({part} ORDER BY {t}) + (count(*) OVER (PARTITION BY {keys}{t}) - 1) / 2.0::DOUBLE AS ry FROM {src}),
  {name} AS (SELECT {keys}coalesce(covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0), 0.0) AS rank_ic FROM {name}0 {group})"""


@query("A1_regression_metrics", f"WITH {PREDS}, g AS (SELECT date, {metrics_sql()} FROM preds GROUP BY date) SELECT date, {rounds(COLS)}, n_samples FROM g")
def a1(spark, sf):
    return rounded(M.regression_metrics(predictions(spark, sf), by=("date",)))


@query("A2_rank_ic", f"WITH {PREDS}, {rank_sql('preds', 'date')} SELECT date, {r6('rank_ic', 'rank_ic')} FROM ric")
def a2(spark, sf):
    return rounded(M.rank_ic(predictions(spark, sf), by=("date",)))


@query("A2_rank_ic_overall", f"WITH {PREDS}, {rank_sql('preds', '', 'rev1')} SELECT {r6('rank_ic', 'rank_ic')} FROM ric")
def a2_all(spark, sf):
    return rounded(M.rank_ic(predictions(spark, sf), "rev1"))


GM = "WITH {preds}, src AS ({src}), g AS (SELECT {by}, {m} FROM src GROUP BY {by} HAVING count(*) >= {n}), {r} SELECT {by}, {cols}, {ric}, n_samples FROM g JOIN ric USING ({by})"


def _grouped(src: str, by: str, n: int) -> str:
    return GM.format(preds=PREDS, src=src, by=by, m=metrics_sql(), n=n, r=rank_sql("src", by), cols=rounds(COLS), ric=r6("rank_ic", "rank_ic"))


@query("A3_metrics_by_ticker", _grouped("SELECT * FROM preds", "ticker", 10))
def a3_ticker(spark, sf):
    return rounded(M.grouped_metrics(predictions(spark, sf), ("ticker",)))


@query("A3_metrics_by_regime", _grouped("SELECT *, 'Q' || quarter(date) AS regime FROM preds", "regime", 20))
def a3_regime(spark, sf):
    df = predictions(spark, sf).withColumn("regime", F.concat(F.lit("Q"), F.quarter("date").cast("string")))
    return rounded(M.grouped_metrics(df, ("regime",), min_n=20))


_STACK = " UNION ALL ".join(f"SELECT ticker, date, target, '{m}' AS model, {m} AS pred FROM preds" for m in MODELS) + \
    " UNION ALL SELECT ticker, date, target, 'equal_weight', (ret5 + rev1 + sma20) / 3.0::DOUBLE FROM preds UNION ALL SELECT ticker, date, target, 'trend_only', (ret5 + sma20) / 2.0::DOUBLE FROM preds"


@query("A3_metrics_by_model", _grouped(_STACK, "model", 10))
def a3_model(spark, sf):
    long = M.stack_models(predictions(spark, sf), MODELS, ["ticker", "date", "target"], {"equal_weight": MODELS, "trend_only": ["ret5", "sma20"]})
    return rounded(M.grouped_metrics(long, ("model",)))


def fold_metrics(spark, sf):
    """Per rolling fold: validation IC, test metrics and long-short Sharpe."""
    p = predictions(spark, sf)
    windows = G.walk_forward_windows(T.bars_daily(spark, sf), expanding=False)
    f = G.assign_folds(p, windows)
    val = M.regression_metrics(f.where("split = 'val'"), by=("fold",)).select("fold", F.col("ic").alias("val_ic"))
    test = f.where("split = 'test'")
    m = M.all_metrics(test, by=("fold",)).select("fold", "ic", "rank_ic", "directional_accuracy")
    daily = test.groupBy("fold", "date").agg(F.avg(F.col("target") * F.signum("pred")).alias("ret"))
    s = P.performance_summary(daily, by=("fold",)).select("fold", "sharpe")
    return val.join(m, "fold").join(s, "fold")


def perf_sql(src: str, by: str = "", name: str = "perf") -> str:
    keys, part, group = (f"{by}, ", f"PARTITION BY {by}", f"GROUP BY {by}") if by else ("", "", "")
    return f"""{name}0 AS (SELECT *, product(1 + ret) OVER ({part} ORDER BY date ROWS UNBOUNDED PRECEDING) AS eq FROM {src}),
  {name}1 AS (SELECT *, eq / max(eq) OVER ({part} ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM {name}0),
  {name}2 AS (SELECT {keys}count(*) AS n_days, product(1 + ret) - 1 AS total_return, stddev_pop(ret) * sqrt(252.0) AS ann_volatility,
    CASE WHEN count(CASE WHEN ret < 0 THEN 1 END) > 1 THEN stddev_pop(CASE WHEN ret < 0 THEN ret END) * sqrt(252.0) ELSE 0.0 END AS dv, min(dd) AS max_drawdown,
    avg(CASE WHEN ret > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS hit_rate, coalesce(avg(CASE WHEN ret > 0 THEN ret END), 0.0) AS avg_win,
    coalesce(avg(CASE WHEN ret <= 0 THEN ret END), 0.0) AS avg_loss, sum(CASE WHEN ret > 0 THEN ret ELSE 0.0 END) / nullif(abs(sum(CASE WHEN ret <= 0 THEN ret ELSE 0.0 END)), 0) AS profit_factor,
    avg(ret) AS mean_ret FROM {name}1 {group}),
  {name}3 AS (SELECT *, CASE WHEN total_return > -1 THEN (1 + total_return) ** (1.0 / greatest(n_days / 252.0::DOUBLE, 0.01)) - 1 END AS ann_return FROM {name}2),
  {name} AS (SELECT *, CASE WHEN ann_volatility > 1e-10 THEN ann_return / ann_volatility WHEN ann_return IS NOT NULL THEN 0.0 END AS sharpe,
    CASE WHEN dv > 1e-10 THEN ann_return / dv WHEN ann_return IS NOT NULL THEN 0.0 END AS sortino, CASE WHEN abs(max_drawdown) > 1e-10 THEN ann_return / abs(max_drawdown) WHEN ann_return IS NOT NULL THEN 0.0 END AS calmar FROM {name}3)"""


PERF = ["total_return", "ann_volatility", "max_drawdown", "hit_rate", "avg_win", "avg_loss", "profit_factor", "mean_ret", "ann_return", "sharpe", "sortino", "calmar"]

FM = f"""{PREDS}, {windows_sql(False)}, {FOLDS}, fp AS (SELECT preds.*, fold, split FROM preds JOIN parts ON date >= lo AND date < hi), te AS (SELECT * FROM fp WHERE split = 'test'),
  v AS (SELECT fold, {metrics_sql()} FROM fp WHERE split = 'val' GROUP BY fold), m AS (SELECT fold, {metrics_sql()} FROM te GROUP BY fold), {rank_sql('te', 'fold')},
  dl AS (SELECT fold, date, avg(target * sign(pred)) AS ret FROM te GROUP BY fold, date), {perf_sql('dl', 'fold')},
  fm AS (SELECT fold, v.ic AS val_ic, m.ic AS ic, rank_ic, m.directional_accuracy, sharpe FROM v JOIN m USING (fold) JOIN ric USING (fold) JOIN perf USING (fold))"""
FC = ["val_ic", "ic", "rank_ic", "directional_accuracy", "sharpe"]


@query("A4_fold_summary", f"WITH {FM} SELECT count(*) AS n_windows, " + ", ".join(
    f"{r6(f'avg({c})', c + '_mean', 5)}, {r6(f'stddev_pop({c})', c + '_std', 5)}, {r6(f'min({c})', c + '_min', 5)}, {r6(f'max({c})', c + '_max', 5)}" for c in FC)
    + f", CAST(sum(CASE WHEN sharpe > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_positive, arg_max(fold, val_ic) AS best_fold, {r6('CASE WHEN sum(val_ic) > 0 THEN sum(ic * val_ic) / sum(val_ic) END', 'ic_weighted_mean', 5)}, {r6('CASE WHEN sum(val_ic) > 0 THEN sum(sharpe * val_ic) / sum(val_ic) END', 'sharpe_weighted_mean', 5)} FROM fm")
def a4(spark, sf):
    return rounded(M.fold_summary(fold_metrics(spark, sf)), 5)


@query("A8_ic_over_time", f"""WITH {PREDS}, d AS (SELECT date, {metrics_sql()} FROM preds GROUP BY date HAVING count(*) >= 3 AND stddev_pop(pred) > 1e-10 AND stddev_pop(target) > 1e-10),
  m AS (SELECT date_trunc('month', date)::DATE AS month, avg(ic) AS ic_mean, stddev_pop(ic) AS ic_std, count(*) AS n_days FROM d GROUP BY 1)
  SELECT month, {rounds(['ic_mean', 'ic_std'])}, n_days, {r6('avg(ic_mean) OVER (ORDER BY month ROWS 11 PRECEDING)', 'ic_12m')}, {r6('avg(CASE WHEN ic_mean > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) OVER ()', 'share_positive')} FROM m""")
def a8(spark, sf):
    return rounded(M.ic_over_time(predictions(spark, sf)))


@query("A9_calibration", f"""WITH {PREDS}, e AS (SELECT list_sort(list_distinct(quantile_cont(pred, [{', '.join(str(i / 10) for i in range(11))}]))) AS e FROM preds),
  b AS (SELECT target, len(list_filter(e[2:len(e) - 1], lambda x: x <= pred)) + 1 AS bin FROM preds, e),
  g AS (SELECT bin, avg(target) AS mean, stddev_pop(target) / sqrt(count(*)) AS sem, count(*) AS n FROM b GROUP BY bin HAVING count(*) >= 5),
  s AS (SELECT arg_max(mean, bin) - arg_min(mean, bin) AS spread, regr_slope(mean, bin) AS slope FROM g) SELECT CAST(bin AS INTEGER) AS bin, {rounds(['mean', 'sem', 'spread', 'slope'])}, n FROM g, s""")
def a9(spark, sf):
    return rounded(M.calibration(predictions(spark, sf)))


@query("A10_signal_bins", f"""WITH {PREDS}, e AS (SELECT list_sort(list_distinct(quantile_cont(rev1, [{', '.join(str(i / 20) for i in range(21))}]))) AS e FROM preds),
  b AS (SELECT target, len(list_filter(e[2:len(e) - 1], lambda x: x < rev1)) AS bin FROM preds, e), g AS (SELECT bin, avg(target) AS mean, count(*) AS n FROM b GROUP BY bin),
  s AS (SELECT regr_slope(target, rev1) AS slope, regr_intercept(target, rev1) AS intercept FROM preds) SELECT CAST(bin AS INTEGER) AS bin, {rounds(['mean', 'slope', 'intercept'])}, n FROM g, s""")
def a10(spark, sf):
    return rounded(M.signal_bins(predictions(spark, sf), "rev1"))


@query("A11_return_histogram", f"""WITH {PREDS}, l AS (SELECT quantile_cont(abs(raw_target), 0.99) AS lim FROM preds), x AS (SELECT 'actual' AS series, raw_target AS x FROM preds UNION ALL SELECT 'predicted', pred FROM preds),
  b AS (SELECT series, least(CAST(floor((x + lim) / (2 * lim) * 69) AS BIGINT), 68) AS bin, lim FROM x, l WHERE x BETWEEN -lim AND lim), g AS (SELECT series, bin, count(*) AS n, max(lim) AS lim FROM b GROUP BY series, bin)
  SELECT series, bin, n, {r6('-lim + bin * (2 * lim / 69)', 'left_edge')}, {r6("n / (sum(n) OVER (PARTITION BY series) * (2 * lim / 69))", 'density')} FROM g""")
def a11(spark, sf):
    return rounded(M.return_histogram(predictions(spark, sf), "pred", "raw_target"))


HZ = (1, 2, 5, 10)


@query("A12_ic_by_horizon", f"WITH {PREDS}, h AS (SELECT ticker, date, close, " + ", ".join(f"lead(close, {h}) OVER (PARTITION BY ticker ORDER BY date) / close - 1 AS h{h}" for h in HZ)
       + " FROM bars), j AS (" + " UNION ALL ".join(f"SELECT {h} AS horizon, pred, least(greatest(h{h}, -0.5), 0.5) AS target FROM preds JOIN h USING (ticker, date) WHERE h{h} IS NOT NULL" for h in HZ)
       + f"), g AS (SELECT horizon, {metrics_sql()} FROM j GROUP BY horizon) SELECT horizon, {r6('ic', 'ic')}, n_samples FROM g")
def a12(spark, sf):
    return rounded(M.ic_by_horizon(predictions(spark, sf), T.bars_daily(spark, sf), list(HZ)))


@query("A16_quality_report", f"""WITH {PREDS}, f AS (SELECT ticker, date, ret5, rev1, CASE WHEN abs(raw_target) < 2 THEN target END AS target FROM preds),
  per AS (SELECT ticker, count(*) AS n, avg(CASE WHEN ret5 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS z1, avg(CASE WHEN rev1 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS z2 FROM f GROUP BY ticker),
  c AS (SELECT count(*) AS n_tickers, min(n) AS rows_min, max(n) AS rows_max, median(n) AS rows_median, avg((z1 + z2) / 2) AS zero_ratio FROM per),
  t AS (SELECT CAST(sum(CASE WHEN target IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_missing_target, avg(target) AS target_mean, stddev_pop(target) AS target_std, min(target) AS target_min, max(target) AS target_max, min(date) AS first_date, max(date) AS last_date FROM f),
  m AS (SELECT min(CAST(ts AS DATE)) AS minute_first, count(*) AS n_minute FROM (SELECT DISTINCT event_type, date_trunc('minute', ts) AS ts FROM events))
  SELECT n_missing_target, {rounds(['target_mean', 'target_std', 'target_min', 'target_max', 'rows_median', 'zero_ratio'])}, first_date, last_date, n_tickers, rows_min, rows_max, minute_first, n_minute,
    {r6('(last_date - first_date) / 365.25', 'span_years')}, CAST(minute_first - last_date AS INTEGER) AS gap_days,
    array_to_string(list_filter([CASE WHEN abs(target_mean) > 0.05 THEN 'target mean is large' END, CASE WHEN minute_first > last_date THEN 'gap between daily and minute data' END, CASE WHEN zero_ratio > 0.5 THEN 'many zero features' END], lambda x: x IS NOT NULL), '; ') AS issues FROM t, c, m""")
def a16(spark, sf):
    df = predictions(spark, sf).withColumn("target", F.when(F.abs("raw_target") < 2, F.col("target")))
    q = M.quality_report(df, ["ret5", "rev1"], T.bars_minute(spark, sf))
    return rounded(q.withColumn("issues", F.array_join("issues", "; ")))


@query("A17_average_regime_metrics", f"""WITH {PREDS}, src AS (SELECT *, 'Q' || quarter(date) AS regime, year(date) AS file FROM preds), g AS (SELECT regime, file, {metrics_sql()} FROM src GROUP BY regime, file), {rank_sql('src', 'regime, file')}
  SELECT regime, {', '.join(r6(f'avg({c})', c) for c in ('ic', 'directional_accuracy', 'rank_ic'))}, CAST(sum(n_samples) AS BIGINT) AS n_samples FROM g JOIN ric USING (regime, file) GROUP BY regime""")
def a17(spark, sf):
    df = predictions(spark, sf).withColumns({"regime": F.concat(F.lit("Q"), F.quarter("date").cast("string")), "file": F.year("date")})
    m = M.all_metrics(df, by=("regime", "file")).select("regime", "ic", "directional_accuracy", "rank_ic", "n_samples")
    return rounded(M.average_regime_metrics(m))


@query("A21_fold_stability", f"WITH {FM} SELECT fold, {r6('CASE WHEN sum(val_ic) OVER () > 0 THEN val_ic / sum(val_ic) OVER () ELSE 0.0 END', 'val_ic_weight', 5)}, " + ", ".join(r6(f"stddev_pop({c}) OVER ()", f"{c}_std", 5) for c in ("ic", "rank_ic", "sharpe")) + " FROM fm")
def a21(spark, sf):
    return rounded(M.fold_stability(fold_metrics(spark, sf)), 5)


@query("A22_prediction_summary", f"""WITH {PREDS}, l AS (SELECT ticker, arg_max(pred, date) AS pred FROM preds GROUP BY ticker), m AS (SELECT DISTINCT 'S' || (user_id % 100) AS ticker FROM events WHERE event_type = 'error')
  SELECT count(*) AS n_tickers, count(CASE WHEN pred > 0 THEN 1 END) AS n_bullish, count(CASE WHEN NOT pred > 0 THEN 1 END) AS n_bearish, count(m.ticker) AS n_with_minute, {r6('avg(pred)', 'mean_pred')}, {r6('stddev_pop(pred)', 'std_pred')} FROM l LEFT JOIN m USING (ticker)""")
def a22(spark, sf):
    last = predictions(spark, sf).groupBy("ticker").agg(F.max_by("pred", "date").alias("pred"))
    m = T.table(spark, sf, "events").where("event_type = 'error'").select(F.concat(F.lit("S"), F.pmod("user_id", F.lit(100)).cast("string")).alias("ticker")).distinct()
    return rounded(M.prediction_summary(last.join(m.withColumn("has_minute", F.lit(True)), "ticker", "left")))


@query("A23_history_summary", f"""WITH h AS (SELECT l_returnflag AS model, l_linenumber AS epoch, round(avg(l_extendedprice), 4) AS train_loss, round(avg(l_discount * l_extendedprice), 4) AS val_loss,
  CASE WHEN l_linenumber = 3 THEN NULL ELSE round(corr(l_quantity, l_extendedprice), 6) END AS val_ic FROM lineitem GROUP BY 1, 2), z AS (SELECT *, coalesce(val_ic, 0.0) AS ic FROM h)
  SELECT model, count(*) AS n_epochs, arg_min(epoch, val_loss) AS best_loss_epoch, {r6('min(val_loss)', 'best_loss', 4)}, arg_max(epoch, ic) AS best_ic_epoch, {r6('max(ic)', 'best_ic')} FROM z GROUP BY model""")
def a23(spark, sf):
    path = work_dir(spark) + "/history"
    e = F.col("l_linenumber")
    h = T.table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("model"), e.alias("epoch")).agg(
        half_away(F.avg("l_extendedprice"), 4).alias("train_loss"), half_away(F.avg(F.col("l_discount") * F.col("l_extendedprice")), 4).alias("val_loss"),
        half_away(M.safe_corr("l_quantity", "l_extendedprice"), 6).alias("val_ic"),
    ).withColumn("val_ic", F.when(F.col("epoch") != 3, F.col("val_ic").cast("string")).otherwise("nan")).withColumn("val_rank_ic", F.lit(""))
    h.write.partitionBy("model").option("header", True).csv(path)
    s = M.history_summary(M.read_history(spark, path))
    return s.withColumns({"best_loss": half_away("best_loss", 4), "best_ic": half_away("best_ic", 6)})


# --- windows -----------------------------------------------------------------


@query("W1_cs_zscore", f"WITH {PREDS} SELECT ticker, date, {r6('CASE WHEN count(*) OVER (PARTITION BY date) > 1 THEN (pred - avg(pred) OVER (PARTITION BY date)) / stddev_pop(pred) OVER (PARTITION BY date) ELSE pred END', 'pred', 5)} FROM preds")
def w1(spark, sf):
    return rounded(M.cs_zscore(predictions(spark, sf).select("ticker", "date", "pred"), "pred"), 5)


@query("W2_top_k", f"WITH {PREDS}, r AS (SELECT ticker, date, pred, row_number() OVER (PARTITION BY date ORDER BY pred DESC, ticker DESC) AS rank FROM preds) SELECT ticker, date, {r6('pred', 'pred')}, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5")
def w2(spark, sf):
    return rounded(P.top_k(predictions(spark, sf).select("ticker", "date", "pred"), "pred", 5))


DAILY = "dl AS (SELECT date, avg(target * sign(pred)) AS ret FROM preds GROUP BY date)"


def daily_returns(spark, sf):
    return predictions(spark, sf).groupBy("date").agg(F.avg(F.col("target") * F.signum("pred")).alias("ret"))


@query("W3_drawdown", f"WITH {PREDS}, {DAILY}, {perf_sql('dl')} SELECT date, {r6('dd', 'drawdown')}, {r6('min(dd) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)', 'max_drawdown')} FROM perf1")
def w3(spark, sf):
    df = P.drawdown(P.cum_return(daily_returns(spark, sf), "ret"), "equity")
    return rounded(df.select("date", "drawdown", "max_drawdown"))


@query("W4_cum_return", f"WITH {PREDS}, {DAILY} SELECT date, {r6('ln(product(1 + ret) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING))', 'log_equity')} FROM dl")
def w4(spark, sf):
    return rounded(P.cum_return(daily_returns(spark, sf), "ret").select("date", F.log("equity").alias("log_equity")))


def positions_sql(top: int, rule: str = "quarter", name: str = "pos", src: str = "preds", target: str = "target", pred: str = "pred") -> str:
    k = f"least({top}, greatest(1, n // 4))" if rule == "quarter" else f"CASE WHEN n >= {2 * top} THEN {top} ELSE greatest(1, n // 4) END"
    return f"""{name}0 AS (SELECT date, ticker, {target} AS target, count(*) OVER (PARTITION BY date) AS n, row_number() OVER (PARTITION BY date ORDER BY {pred} DESC, ticker DESC) AS rl,
      row_number() OVER (PARTITION BY date ORDER BY {pred}, ticker) AS rs FROM {src}),
  {name} AS (SELECT date, ticker, 1 AS side, target FROM {name}0 WHERE rl <= {k} UNION ALL SELECT date, ticker, -1, target FROM {name}0 WHERE rs <= {k})"""


def turnover_sql(pos: str = "pos", name: str = "tov") -> str:
    return f"""{name}d AS (SELECT date, lag(date) OVER (ORDER BY date) AS prev FROM (SELECT DISTINCT date FROM {pos})),
  {name} AS (SELECT p.date, sum(CASE WHEN o.ticker IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) / count(*) AS turnover FROM {pos} p JOIN {name}d USING (date) LEFT JOIN {pos} o ON o.date = prev AND o.ticker = p.ticker AND o.side = p.side GROUP BY p.date)"""


@query("W5_turnover", f"WITH {PREDS}, {positions_sql(5)}, {turnover_sql()} SELECT date, {r6('turnover', 'turnover')} FROM tov")
def w5(spark, sf):
    return rounded(P.turnover(P.long_short_positions(predictions(spark, sf), 5)))


@query("W6_hold_last", f"WITH {PREDS}, d AS (SELECT *, CASE WHEN pred > 0.5 THEN 1.0 WHEN pred < -0.5 THEN -1.0 END AS d FROM preds) SELECT ticker, date, {r6(f'coalesce(last_value(d IGNORE NULLS) {run()}, 0.0)', 'state')} FROM d")
def w6(spark, sf):
    df = predictions(spark, sf).withColumn("d", F.when(F.col("pred") > 0.5, 1.0).when(F.col("pred") < -0.5, -1.0))
    return rounded(df.withColumn("state", hold_last("d", series())).select("ticker", "date", "state"))
