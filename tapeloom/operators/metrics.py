"""How predictions compare with what happened."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.core import clip, col, div, safe_corr, series
from ..functions.ranks import exact_quantiles, spearman
from ..session import materialize

FLAT = 1e-10  # a deviation below this counts as constant


def ic(pred, target) -> Column:
    """Pearson correlation, 0 when a side is constant."""
    p, t = col(pred), col(target)
    alive = (F.stddev_pop(p) >= FLAT) & (F.stddev_pop(t) >= FLAT)
    return F.when(alive, safe_corr(p, t)).otherwise(0.0)


def _metric_columns(pred: str, target: str) -> list[Column]:
    err = F.col(pred) - F.col(target)
    same = F.when((F.col(pred) > 0) == (F.col(target) > 0), 1.0).otherwise(0.0)
    return [
        F.avg(err * err).alias("mse"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(F.abs(err)).alias("mae"),
        ic(pred, target).alias("ic"),
        F.avg(same).alias("directional_accuracy"),
        F.count(F.lit(1)).alias("n_samples"),
    ]


def regression_metrics(df: DataFrame, pred: str = "pred", target: str = "target", by: tuple[str, ...] = ()) -> DataFrame:
    """A1: mse, rmse, mae, IC and directional accuracy per group; one aggregate, partial on the map side."""
    known = df.where(F.col(pred).isNotNull() & F.col(target).isNotNull())
    return known.groupBy(*by).agg(*_metric_columns(pred, target))


def rank_ic(df: DataFrame, pred: str = "pred", target: str = "target", by: tuple[str, ...] = (), written: bool = False) -> DataFrame:
    """A2: Spearman correlation with average ranks, 0 when a side is constant."""
    return spearman(df, pred, target, by, written=written).withColumn("rank_ic", F.coalesce("rank_ic", F.lit(0.0)))


def all_metrics(df: DataFrame, pred: str = "pred", target: str = "target", by: tuple[str, ...] = (), min_n: int = 1) -> DataFrame:
    known = materialize(df.where(F.col(pred).isNotNull() & F.col(target).isNotNull()).select(*by, pred, target))
    m = regression_metrics(known, pred, target, by).where(F.col("n_samples") >= min_n)
    r = rank_ic(known, pred, target, by, written=True)
    return m.join(r, list(by)) if by else m.join(F.broadcast(r))  # without groups both are one row


def stack_models(df: DataFrame, models: list[str], keep: list[str], ensembles: dict[str, list[str]] | None = None) -> DataFrame:
    """Long form (keep…, model, pred): one row per model, and per ensemble as the plain mean of its members."""
    cols = {m: F.col(m) for m in models}
    for name, members in (ensembles or {}).items():
        cols[name] = reduce(lambda a, b: a + b, [F.col(m) for m in members]) / len(members)
    pairs = F.map_from_arrays(F.array(*[F.lit(m) for m in cols]), F.array(*cols.values()))
    return df.select(*keep, F.explode(pairs).alias("model", "pred"))


def grouped_metrics(df: DataFrame, by: tuple[str, ...], pred: str = "pred", target: str = "target", min_n: int = 10) -> DataFrame:
    """A3: all metrics per group (ticker, regime, sub-model or ensemble) with at least ``min_n`` samples."""
    return all_metrics(df, pred, target, by, min_n)


def fold_summary(folds: DataFrame) -> DataFrame:
    """A4: one row over all folds: mean, deviation, range, consistency, best fold, IC-weighted means.

    ``folds`` has one row per fold: fold, val_ic, ic, rank_ic, directional_accuracy, sharpe.
    """
    cols = ["val_ic", "ic", "rank_ic", "directional_accuracy", "sharpe"]
    stats = []
    for c in cols:
        stats += [
            F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"),
        ]
    total = F.sum("val_ic")

    def weighted(c: str) -> Column:
        return F.when(total > 0, div(F.sum(F.col(c) * F.col("val_ic")), total))

    return folds.agg(
        F.count(F.lit(1)).alias("n_windows"),
        *stats,
        F.sum(F.when(F.col("sharpe") > 0, 1).otherwise(0)).alias("n_positive"),
        F.max_by("fold", F.struct("val_ic", -F.col("fold"))).alias("best_fold"),
        weighted("ic").alias("ic_weighted_mean"),
        weighted("sharpe").alias("sharpe_weighted_mean"),
    )


def ic_over_time(df: DataFrame, pred: str = "pred", target: str = "target", date: str = "date", by: tuple[str, ...] = (), min_n: int = 3) -> DataFrame:
    """Per month the mean and deviation of daily cross-sectional ICs, their rolling
    12-month mean, and the running share of positive months."""
    by = list(by)
    daily = df.where(F.col(pred).isNotNull() & F.col(target).isNotNull()).groupBy(*by, date).agg(
        F.count(F.lit(1)).alias("n"), F.stddev_pop(pred).alias("sp"), F.stddev_pop(target).alias("st"), safe_corr(pred, target).alias("ic")
    ).where((F.col("n") >= min_n) & (F.col("sp") > FLAT) & (F.col("st") > FLAT))
    monthly = daily.groupBy(*by, F.trunc(date, "month").alias("month")).agg(
        F.avg("ic").alias("ic_mean"), F.stddev_pop("ic").alias("ic_std"), F.count(F.lit(1)).alias("n_days")
    )
    # one row per month
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy("month")
    positive = F.avg(F.when(F.col("ic_mean") > 0, 1.0).otherwise(0.0)).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return monthly.withColumns({"ic_12m": F.avg("ic_mean").over(w.rowsBetween(-11, 0)), "share_positive": positive})


def _binned(df: DataFrame, pred: str, bins: int, right_closed: bool) -> DataFrame:
    """Rows with the index of their quantile bin; equal edges are merged."""
    edges = exact_quantiles(df, pred, [i / bins for i in range(bins + 1)], out="__edges")
    edges = edges.select(F.array_distinct("__edges").alias("__edges"))
    inner = F.slice("__edges", 2, F.greatest(F.size("__edges") - 2, F.lit(0)))
    below = (lambda e: e < F.col(pred)) if right_closed else (lambda e: e <= F.col(pred))
    # the edges are one row
    return df.join(F.broadcast(edges)).withColumn("bin", F.size(F.filter(inner, below))).drop("__edges")


def calibration(df: DataFrame, pred: str = "pred", target: str = "target", bins: int = 10, min_n: int = 5) -> DataFrame:
    """Mean outcome and its standard error per prediction decile, spread of the outer ones and slope."""
    known = df.where(F.col(pred).isNotNull() & F.col(target).isNotNull()).select(pred, target)
    b = _binned(known, pred, bins, False)
    g = b.groupBy((F.col("bin") + 1).alias("bin")).agg(
        F.avg(target).alias("mean"), F.try_divide(F.stddev_pop(target), F.sqrt(F.count(F.lit(1)))).alias("sem"), F.count(F.lit(1)).alias("n")
    ).where(F.col("n") >= min_n)
    total = g.agg((F.max_by("mean", "bin") - F.min_by("mean", "bin")).alias("spread"), F.regr_slope("mean", "bin").alias("slope"))
    return g.join(F.broadcast(total))  # at most `bins` rows


def signal_bins(df: DataFrame, pred: str = "pred", target: str = "target", bins: int = 20) -> DataFrame:
    """A10: mean outcome per signal quantile and the least-squares line of outcome on signal."""
    known = df.where(F.col(pred).isNotNull() & F.col(target).isNotNull()).select(pred, target)
    g = _binned(known, pred, bins, True).groupBy("bin").agg(F.avg(target).alias("mean"), F.count(F.lit(1)).alias("n"))
    line = known.agg(F.regr_slope(target, pred).alias("slope"), F.regr_intercept(target, pred).alias("intercept"))
    return g.join(F.broadcast(line))


def return_histogram(df: DataFrame, pred: str = "pred", target: str = "target", edges: int = 70) -> DataFrame:
    """Densities of outcomes and predictions on one grid, cut at the 99th percentile of |outcome|."""
    known = df.where(F.col(pred).isNotNull() & F.col(target).isNotNull())
    limit = exact_quantiles(known, F.abs(F.col(target)), [0.99], out="__q").select(F.col("__q")[0].alias("limit"))
    n_bins = edges - 1
    both = known.select(F.explode(F.map_from_arrays(F.array(F.lit("actual"), F.lit("predicted")), F.array(F.col(target), F.col(pred)))).alias("series", "x"))
    both = both.join(F.broadcast(limit)).where((F.col("x") >= -F.col("limit")) & (F.col("x") <= F.col("limit")))
    at = F.coalesce(F.floor(div(F.col("x") + F.col("limit"), 2 * F.col("limit")) * n_bins), F.lit(0))  # all outcomes 0: one bin without a width
    g = both.withColumn("bin", F.least(at, F.lit(n_bins - 1))).groupBy("series", "bin").agg(F.count(F.lit(1)).alias("n"), F.max("limit").alias("limit"))
    total = F.sum("n").over(Window.partitionBy("series"))  # at most `edges` rows
    width = 2 * F.col("limit") / n_bins
    return g.select("series", "bin", "n", (-F.col("limit") + F.col("bin") * width).alias("left_edge"), div(F.col("n"), total * width).alias("density"))


def ic_by_horizon(preds: DataFrame, bars: DataFrame, horizons: list[int], pred: str = "pred", limit: float = 0.5, min_n: int = 10) -> DataFrame:
    """IC of one prediction against the return h rows ahead, for several h."""
    w = series()
    ahead = {str(h): clip(div(F.lead("close", h).over(w), "close") - 1.0, -limit, limit) for h in horizons}
    targets = bars.where("close > 0").select("ticker", "date", F.map_from_arrays(F.array(*[F.lit(int(h)) for h in ahead]), F.array(*ahead.values())).alias("__a"))
    j = preds.select("ticker", "date", pred).join(targets, ["ticker", "date"]).select(pred, F.explode("__a").alias("horizon", "target"))
    j = j.where(F.col("target").isNotNull() & F.col(pred).isNotNull())
    return j.groupBy("horizon").agg(
        F.when(F.count(F.lit(1)) < min_n, 0.0).otherwise(ic(pred, "target")).alias("ic"), F.count(F.lit(1)).alias("n_samples")
    )


def fold_stability(folds: DataFrame) -> DataFrame:
    """Deviation of IC, rank IC and Sharpe over folds, and each fold's share of validation IC."""
    every = Window.partitionBy(F.lit(0))  # one row per fold
    total = F.sum("val_ic").over(every)
    return folds.select(
        "fold",
        F.when(total > 0, div("val_ic", total)).otherwise(0.0).alias("val_ic_weight"),
        *[F.stddev_pop(c).over(every).alias(f"{c}_std") for c in ("ic", "rank_ic", "sharpe")],
    )


def prediction_summary(preds: DataFrame, pred: str = "pred", has_minute: str = "has_minute") -> DataFrame:
    """Tickers, bullish and bearish counts, minute coverage, mean and deviation."""
    p = F.col(pred)
    return preds.agg(
        F.count(F.lit(1)).alias("n_tickers"),
        F.sum(F.when(p > 0, 1).otherwise(0)).alias("n_bullish"),
        F.sum(F.when(p > 0, 0).otherwise(1)).alias("n_bearish"),
        F.sum(F.when(F.col(has_minute), 1).otherwise(0)).alias("n_with_minute"),
        F.avg(p).alias("mean_pred"),
        F.stddev_pop(p).alias("std_pred"),
    )


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Training history CSV files, one model per ``<model>_history.csv`` or ``model=<model>/`` folder."""
    raw = spark.read.option("header", True).csv(path, inferSchema=False)
    name = F.regexp_extract("_metadata.file_path", r"(?:model=([^/]+)/[^/]+|([^/]+)_history\.csv)$", 1)
    other = F.regexp_extract("_metadata.file_path", r"([^/]+)_history\.csv$", 1)
    number = {c: F.expr(f"try_cast({c} AS double)") for c in ("train_loss", "val_loss", "val_ic", "val_rank_ic")}
    return raw.withColumn("model", F.coalesce(F.nullif(name, F.lit("")), other)).select(
        "model", F.col("epoch").cast("int").alias("epoch"), *[v.alias(c) for c, v in number.items()]
    )


def history_summary(history: DataFrame) -> DataFrame:
    """Per model the epochs with the lowest validation loss and the highest validation IC."""
    h = history.withColumn("val_ic", F.when(F.isnan("val_ic") | F.col("val_ic").isNull(), 0.0).otherwise(F.col("val_ic")))
    return h.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_epochs"),
        F.min_by("epoch", F.struct("val_loss", "epoch")).alias("best_loss_epoch"),
        F.min("val_loss").alias("best_loss"),
        F.max_by("epoch", F.struct("val_ic", -F.col("epoch"))).alias("best_ic_epoch"),
        F.max("val_ic").alias("best_ic"),
    )


def average_regime_metrics(df: DataFrame) -> DataFrame:
    """Metrics per regime averaged over files, samples added up; non-finite values are left out."""
    known = {c: F.when(~F.isnan(c), F.col(c)) for c in ("ic", "directional_accuracy", "rank_ic")}
    return df.groupBy("regime").agg(
        F.avg(known["ic"]).alias("ic"),
        F.coalesce(F.avg(known["directional_accuracy"]), F.lit(0.5)).alias("directional_accuracy"),
        F.coalesce(F.avg(known["rank_ic"]), F.lit(0.0)).alias("rank_ic"),
        F.sum("n_samples").alias("n_samples"),
    ).where("ic IS NOT NULL")


def cs_zscore(df: DataFrame, c: str, by: str = "date", out: str | None = None) -> DataFrame:
    """Z-score within each date; a date with one row keeps its value.

    The moments are aggregated (a large date combines on the map side) and joined
    back; whether that table is broadcast is left to its measured size.
    """
    stats = df.groupBy(by).agg(F.avg(c).alias("__m"), F.stddev_pop(c).alias("__s"), F.count(c).alias("__n"))
    z = F.when(F.col("__n") > 1, div(F.col(c) - F.col("__m"), F.col("__s"))).otherwise(F.col(c))
    return df.join(stats, by, "left").withColumn(out or c, z).drop("__m", "__s", "__n")


def quality_report(features: DataFrame, cols: list[str], minute: DataFrame | None = None, target: str = "target",
                   key: str = "ticker", date: str = "date") -> DataFrame:
    """One row of data quality figures and the list of issues.

    Every ticker counts, none is sampled.
    """
    per = features.groupBy(key).agg(
        F.count(F.lit(1)).alias("__rows"),
        *[F.avg(F.when(F.coalesce(F.col(c), F.lit(0.0)) == 0, 1.0).otherwise(0.0)).alias(f"__z_{c}") for c in cols],
    )
    zero = reduce(lambda a, b: a + b, [F.col(f"__z_{c}") for c in cols]) / len(cols)
    counts = per.agg(
        F.count(F.lit(1)).alias("n_tickers"), F.min("__rows").alias("rows_min"), F.max("__rows").alias("rows_max"), F.avg(zero).alias("zero_ratio")
    )
    middle = exact_quantiles(per, "__rows", [0.5], out="__q").select(F.col("__q")[0].alias("rows_median"))
    t = F.col(target)
    totals = features.agg(
        F.sum(F.when(t.isNull(), 1).otherwise(0)).alias("n_missing_target"),
        F.avg(t).alias("target_mean"), F.stddev_pop(t).alias("target_std"), F.min(t).alias("target_min"), F.max(t).alias("target_max"),
        F.min(date).alias("first_date"), F.max(date).alias("last_date"),
    )
    out = totals.join(F.broadcast(counts)).join(F.broadcast(middle))  # one row each
    if minute is not None:
        m = minute.agg(F.min(date).alias("minute_first"), F.count(F.lit(1)).alias("n_minute"))
        out = out.join(F.broadcast(m))
    else:
        out = out.withColumns({"minute_first": F.lit(None).cast("date"), "n_minute": F.lit(0).cast("bigint")})
    gap = F.datediff("minute_first", "last_date")
    span = F.datediff("last_date", "first_date") / 365.25
    issues = F.array_compact(
        F.array(
            F.when(F.col("target_std") < 1e-6, F.lit("target is constant")),
            F.when(F.abs(F.col("target_mean")) > 0.05, F.lit("target mean is large")),
            F.when(span < 1, F.lit("short daily history")),
            F.when(F.col("n_minute") == 0, F.lit("no minute features")),
            F.when(gap > 0, F.lit("gap between daily and minute data")),
            F.when(F.col("zero_ratio") > 0.5, F.lit("many zero features")),
        )
    )
    return out.withColumns({"span_years": span, "gap_days": F.when(gap > 0, gap), "issues": issues})
