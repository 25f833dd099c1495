"""Learning from outcomes: ridge ablation, drift, reports, weights, trust and attention bias."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import clip, div, finite
from ..functions.ranks import value_ranks

# Thresholds of the report.
MIN_SAMPLES, MIN_REGIME_WIN, MIN_TICKER_WIN, LOSS_TRIGGER, DRIFT_Z = 10, 0.48, 0.45, -0.001, 2.0


def hold_out(df: DataFrame, frac: float = 0.8, date: str = "date") -> DataFrame:
    """``train``: rows of the first dates that together hold at most ``frac`` of all rows.

    Dates are never split between the parts.
    """
    per = df.groupBy(date).agg(F.count(F.lit(1)).alias("__n"))  # one row per date
    w = Window.partitionBy(F.lit(0)).orderBy(date)
    cum = F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("__n").over(Window.partitionBy(F.lit(0)))
    cut = per.select(date, (cum <= F.floor(total * frac)).alias("train"))
    return df.join(cut, date)


MIN_RIDGE_ROWS = 50  # with fewer rows, or none in a part, the IC is 0


def gram(df: DataFrame, cols: list[str], by: str) -> DataFrame:
    """Per value of ``by`` and column ``i``: ``n``, ``mean`` and ``cov``, its covariances with all columns.

    The covariances merge, so tasks send one row for each group and column.
    """
    x = F.array(*[F.col(c) for c in cols])
    long = df.select(by, x.alias("__x"), F.posexplode(x).alias("i", "__v"))
    cov = F.array(*[F.covar_pop("__v", F.element_at("__x", j + 1)) for j in range(len(cols))])
    return long.groupBy(by, "i").agg(F.count(F.lit(1)).alias("n"), F.avg("__v").alias("mean"), cov.alias("cov"))


def _held_ic(parts: dict, use: list[int], ridge: float) -> float:
    """IC on the held-out part of a ridge regression on the columns ``use``; the target is the last column."""
    (n, train), (n_valid, valid) = parts[True], parts[False]
    if not n or not n_valid or n + n_valid < MIN_RIDGE_ROWS:
        return 0.0
    scale = np.sqrt(np.maximum(train.diagonal()[use], 0)) + 1e-6
    xx = n * train[np.ix_(use, use)] / np.outer(scale, scale) + ridge * np.eye(len(use))
    xy = n * train[use, -1] / scale
    try:
        w = np.linalg.solve(xx, xy)
    except np.linalg.LinAlgError:
        w = np.linalg.pinv(xx) @ xy
    w = w / scale
    spread, own = w @ valid[np.ix_(use, use)] @ w, valid[-1, -1]
    if not (spread > 1e-24 and own > 1e-24):
        return 0.0
    ic = float(w @ valid[use, -1] / np.sqrt(spread * own))
    return ic if np.isfinite(ic) else 0.0


def _held_out_parts(df: DataFrame, cols: list[str], target: str, date: str) -> dict:
    """(rows, covariances of the columns and the target) of the earlier and the later dates.

    One pass for the cut and one for the covariances, whatever is fitted later.  The
    driver gets two rows for each column.
    """
    known = df.select(date, *[finite(c).alias(f"__c{i}") for i, c in enumerate([*cols, target])]).dropna()
    width = len(cols) + 1
    parts = {t: (0, np.zeros((width, width))) for t in (True, False)}
    for r in gram(hold_out(known, date=date), [f"__c{i}" for i in range(width)], "train").collect():
        parts[r["train"]][1][r["i"]] = r["cov"]
        parts[r["train"]] = (r["n"], parts[r["train"]][1])
    return parts


def ridge_ic(df: DataFrame, features: list[str], target: str = "target", ridge: float = 1e-3, date: str = "date") -> DataFrame:
    """IC, on the later fifth of the dates, of a ridge regression fitted on the earlier ones.

    Features are scaled by the training part; there is no intercept.  One row:
    ic, n_train, n_valid; the IC is 0 with fewer than 50 rows or an empty part.
    Runs its jobs when called.
    """
    parts = _held_out_parts(df, features, target, date)
    row = (_held_ic(parts, list(range(len(features))), ridge), parts[False][0], parts[True][0])
    return df.sparkSession.createDataFrame([row], "ic double, n_valid bigint, n_train bigint")


def ablate(df: DataFrame, features: list[str], candidates: list[str], target: str = "target", min_gain: float = 0.001, ridge: float = 1e-3,
           date: str = "date") -> DataFrame:
    """For each candidate the IC with it added, the gain, and whether it is promoted.

    All fits use the rows that are complete in features and candidates, so that gains
    compare; covariances are gathered once and each fit solves a part of them.
    """
    parts = _held_out_parts(df, [*features, *candidates], target, date)
    own = list(range(len(features)))
    base = _held_ic(parts, own, ridge)
    rows = [(c, _held_ic(parts, [*own, len(own) + i], ridge), base) for i, c in enumerate(candidates)]
    gain = F.col("ic") - F.col("baseline_ic")
    out = df.sparkSession.createDataFrame(rows, "name string, ic double, baseline_ic double")
    return out.withColumns({"delta_ic": gain, "status": F.when(gain >= min_gain, "promoted").otherwise("rejected")})


def feature_drift(journal: DataFrame, z: float = DRIFT_Z, least: int = 20, ts: str = "timestamp", features: str = "regime_features") -> DataFrame:
    """Per regime feature |mean(recent) - mean(base)| / std(base), and whether it reaches ``z``.

    The base is the first four fifths of the journal by time; entries of one
    moment stay together.  No rows with fewer than ``least`` entries.
    """
    rows = journal.where(F.col(features).isNotNull() & (F.size(features) > 0)).withColumn(
        "__ts", F.unix_micros(F.try_to_timestamp(F.col(ts))).cast("double")
    )
    place = value_ranks(rows, "__ts").where(F.col("total") >= least)
    base = F.col("lo") < F.greatest(F.floor(F.col("total") * 0.8), F.lit(1))
    side = place.select(F.col("v").alias("__ts"), base.alias("__base"))
    long = rows.join(side, "__ts").select("__base", F.explode(features).alias("feature", "__x"))
    long = long.withColumn("__x", finite("__x")).where("__x IS NOT NULL")
    g = long.groupBy("feature").agg(
        F.avg(F.when(F.col("__base"), F.col("__x"))).alias("base_mean"), F.stddev_samp(F.when(F.col("__base"), F.col("__x"))).alias("base_std"),
        F.avg(F.when(~F.col("__base"), F.col("__x"))).alias("recent_mean"),
    )
    score = F.when(F.col("base_std") > 0, F.abs(F.col("recent_mean") - F.col("base_mean")) / (F.col("base_std") + 1e-8))
    return g.withColumn("score", F.coalesce(score, F.lit(0.0))).withColumn("drifted", F.col("score") >= z)


def training_report(journal: DataFrame, min_samples: int = MIN_SAMPLES, min_win: float = MIN_REGIME_WIN, loss: float = LOSS_TRIGGER) -> DataFrame:
    """Win rate and mean return of resolved trades by regime, by ticker and overall; ``flagged`` marks
    weak regimes, unreliable tickers and a losing book.  All three levels come from one pass."""
    done = journal.where("actual_return IS NOT NULL").select(
        F.coalesce("regime_label", F.lit("unknown")).alias("regime"), "ticker", F.col("actual_return").alias("r")
    )
    level = F.struct(F.lit("regime").alias("level"), F.col("regime").alias("name")), F.struct(F.lit("ticker").alias("level"), F.col("ticker").alias("name")), \
        F.struct(F.lit("portfolio").alias("level"), F.lit("all").alias("name"))
    g = done.select("r", F.inline(F.array(*level))).groupBy("level", "name").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("r") > 0, 1.0).otherwise(0.0)).alias("win_rate"), F.avg("r").alias("avg_return")
    )
    bad = (
        F.when(F.col("level") == "regime", (F.col("win_rate") < min_win) | (F.col("avg_return") < 0))
        .when(F.col("level") == "ticker", (F.col("win_rate") < MIN_TICKER_WIN) | (F.col("avg_return") < loss))
        .otherwise(F.col("avg_return") < loss)
    )
    return g.withColumn("flagged", (F.col("n") >= min_samples) & bad)


def should_retrain(report: DataFrame, drift: DataFrame, promoted: int = 0) -> DataFrame:
    """One row: anything flagged, two drifted features, or a promoted formula."""
    d = drift.agg(F.coalesce(F.sum(F.when(F.col("drifted"), 1).otherwise(0)), F.lit(0)).alias("n_drifted"))
    r = report.agg(F.coalesce(F.sum(F.when(F.col("flagged"), 1).otherwise(0)), F.lit(0)).alias("n_flagged"))
    trigger = (F.col("n_flagged") > 0) | (F.col("n_drifted") >= 2) | F.lit(promoted > 0)
    return r.join(F.broadcast(d)).withColumn("trigger_retrain", trigger)


def regime_weights(metrics: DataFrame, base: float = 1.0, top: float = 5.0) -> DataFrame:
    """Weight per regime, larger where IC and directional accuracy are weaker, scaled to [base, top]."""
    weak = (1.0 - F.coalesce("directional_accuracy", F.lit(0.5))) + (1.0 - F.least(F.abs(F.coalesce("ic", F.lit(0.0))), F.lit(1.0)))
    every = Window.partitionBy(F.lit(0))  # one row per regime
    m = metrics.withColumn("__w", weak)
    lo, hi = F.min("__w").over(every), F.max("__w").over(every)
    share = F.coalesce(div(F.col("__w") - lo, hi - lo), F.lit(0.0))
    return m.select("regime", (base + share * (top - base)).alias("weight"))


def sample_weights(samples: DataFrame, labels: DataFrame, weights: DataFrame, default: float = 1.0, date: str = "date") -> DataFrame:
    """The weight of the regime of each sample's date; ``default`` without one."""
    by_date = labels.join(F.broadcast(weights), "regime").select(date, "weight")  # one row per date
    return samples.join(by_date, date, "left").withColumn("weight", F.coalesce("weight", F.lit(default)))


def feature_trust(assessments: DataFrame, decay: float = 0.95, drop_below: float = -0.5, run: str = "run_ts") -> DataFrame:
    """Decayed counts, trust score in [-1, 1], weight, drop flag and rank per feature.

    ``assessments`` (run_ts, feature, suspicious, supportive): an observation fades
    by ``decay`` with every later run.
    """
    runs = assessments.select(F.col(run).cast("double").alias("__run")).distinct()
    later = value_ranks(runs, "__run").select(F.col("v").alias("__run"), (F.col("total") - F.col("lo") - 1).alias("__later"))
    j = assessments.withColumn("__run", F.col(run).cast("double")).join(later, "__run")
    f = F.pow(F.lit(decay), F.col("__later").cast("double"))
    g = j.groupBy("feature").agg(
        F.sum(f).alias("n_seen"), F.sum(F.when(F.col("suspicious"), f).otherwise(0.0)).alias("n_suspicious"),
        F.sum(F.when(F.col("supportive"), f).otherwise(0.0)).alias("n_supportive"),
    )
    score = F.when(F.col("n_seen") < 1e-6, 0.0).otherwise((F.col("n_supportive") - F.col("n_suspicious")) / F.col("n_seen"))
    g = g.withColumn("trust", score)
    # one row per feature of the schema
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("trust"), "feature")
    return g.withColumns(
        {"weight": F.greatest(F.lit(0.0), (F.col("trust") + 1.0) / 2.0), "dropped": F.col("trust") < drop_below, "rank": F.row_number().over(order)}
    )


def journal_attribution(journal: DataFrame, n_models: int, fold: str = "fold") -> DataFrame:
    """Mean credit per sub-model and fold: plus or minus the agreement, shared by all models."""
    sign = F.when(F.col("actual_return") > 0, 1.0).otherwise(-1.0)
    credit = sign * F.coalesce("sub_model_agreement", F.lit(0.5)) / n_models
    return journal.where("actual_return IS NOT NULL").groupBy(fold).agg(F.avg(credit).alias("attribution"))


def attention_bias(metrics: DataFrame, attribution: DataFrame | None = None, strength: float = 0.5, momentum: float = 0.7, limit: float = 2.0,
                   fold: str = "fold") -> DataFrame:
    """Bias per fold and sub-model: z-scored IC (0.7) and z-scored attribution (0.3), scaled,
    smoothed over the folds and clamped.

    ``metrics`` (fold, model, ic), ``attribution`` (fold, model, attribution).
    """
    w = Window.partitionBy(fold)  # the sub-models of one fold

    def z(c: str) -> Column:
        s = F.stddev_pop(c).over(w)
        return F.when(s > 1e-8, (F.col(c) - F.avg(c).over(w)) / s).otherwise(0.0)

    m = metrics.select(fold, "model", F.coalesce("ic", F.lit(0.0)).alias("ic"))
    if attribution is not None:
        m = m.join(attribution.select(fold, "model", "attribution"), [fold, "model"], "left").withColumn("attribution", F.coalesce("attribution", F.lit(0.0)))
        raw = 0.7 * z("ic") + 0.3 * z("attribution")
    else:
        raw = 0.7 * z("ic")
    m = m.withColumn("__raw", raw * strength)
    # folds are few: each model's history is a short ordered array
    hist = Window.partitionBy("model").orderBy(fold).rowsBetween(Window.unboundedPreceding, 0)
    past = F.collect_list("__raw").over(hist)
    smooth = F.aggregate(
        past,
        F.lit(None).cast("double"),
        lambda acc, x: clip(F.when(acc.isNull(), x).otherwise(momentum * acc + (1 - momentum) * x), -limit, limit),
    )
    return m.select(fold, "model", "ic", F.col("__raw").alias("raw_bias"), smooth.alias("bias"))
