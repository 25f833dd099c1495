"""Market regimes, macro and cross-asset features, graph edges and snapshots."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import RobustScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import EPS, TRADING_DAYS, clip, div, finite, pct_change, rolling, rows, series, zero_fill
from ..functions.scan import rolling_moments, rolling_shape

# Names of the regime columns.
REGIME_COLUMNS = [
    "regime_spy_ret5", "regime_spy_vol20", "regime_vix_level", "regime_vix_ret5",
    "regime_tlt_ret5", "regime_gld_ret5", "regime_spy_breadth", "regime_corr_spy_tlt",
]
ANCHOR, VIX_SOURCES, OTHERS = "SPY", ("UVXY", "VIXY"), ("TLT", "GLD")


def _calendar() -> Window:
    """The window over a table with one row per date: its size is the calendar."""
    return Window.partitionBy(F.lit(0)).orderBy("date")


def benchmark_panel(bars: DataFrame, ticker: str = "ticker", close: str = "close") -> DataFrame:
    """Closes of the benchmarks side by side on the anchor's dates, carried forward.

    ``vix`` is the first volatility fund with any data.
    """
    names = [ANCHOR, *VIX_SOURCES, *OTHERS]
    wide = bars.where(F.col(ticker).isin(names)).groupBy("date").agg(
        *[F.max(F.when(F.col(ticker) == n, F.col(close))).alias(n.lower()) for n in names]
    ).where(F.col(ANCHOR.lower()).isNotNull())
    w = _calendar()
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    first, second = (s.lower() for s in VIX_SOURCES)
    has_first = F.max(F.when(F.col(first).isNotNull(), 1)).over(Window.partitionBy(F.lit(0))).isNotNull()
    wide = wide.withColumn("vix", F.when(has_first, F.col(first)).otherwise(F.col(second)))
    keep = [ANCHOR.lower(), "vix", *[o.lower() for o in OTHERS]]
    return wide.select("date", *[F.last(c, ignorenulls=True).over(run).alias(c) for c in keep])


def regime_raw(panel: DataFrame) -> DataFrame:
    """R2: the eight market-wide features, cleaned."""
    w = _calendar()
    df = panel.withColumns({"__r": pct_change("spy", 1, w), "__rt": pct_change("tlt", 1, w)})
    both = F.col("__r").isNotNull() & F.col("__rt").isNotNull()
    df = df.withColumns({"__a": F.when(both, F.col("__r")), "__b": F.when(both, F.col("__rt")), "__sma": rolling(F.avg, "spy", w, 50, 10)})
    frame = rows(w, 20)
    moments = F.try_divide(
        F.covar_pop("__a", "__b").over(frame), F.stddev_pop("__a").over(frame) * F.stddev_pop("__b").over(frame)
    )
    out = {
        "regime_spy_ret5": pct_change("spy", 5, w),
        "regime_spy_vol20": rolling(F.stddev_samp, "__r", w, 20, 5),
        "regime_vix_level": F.col("vix"),
        "regime_vix_ret5": pct_change("vix", 5, w),
        "regime_tlt_ret5": pct_change("tlt", 5, w),
        "regime_gld_ret5": pct_change("gld", 5, w),
        "regime_spy_breadth": div(F.col("spy") - F.col("__sma"), F.col("__sma") + 1e-8),
        "regime_corr_spy_tlt": F.when(F.count("__a").over(frame) >= 5, moments),
    }
    df = df.withColumns(out)
    return df.select("date", *[zero_fill(c).alias(c) for c in REGIME_COLUMNS])


def regime_normalize(df: DataFrame, window: int = 60, cols=tuple(REGIME_COLUMNS)) -> DataFrame:
    """Rolling z-score (from five rows), clamped, one day later, 0 at the head."""
    w = _calendar()
    z = {}
    for c in cols:
        mean = rolling(F.avg, c, w, window, 5)
        std = F.greatest(rolling(F.stddev_samp, c, w, window, 5), F.lit(1e-8))
        z[c] = F.coalesce(clip((F.col(c) - mean) / F.when(F.count(c).over(rows(w, window)) >= 5, std), -5, 5), F.lit(0.0))
    df = df.withColumns(z)
    return df.select("date", *[F.lag(c, 1, 0.0).over(w).alias(c) for c in cols])


# Names of the extended columns.
EXTENDED = [
    "vol_20d", "vol_60d", "vol_120d", "vol_regime", "trend_20d", "trend_60d", "trend_120d", "momentum_20d", "momentum_60d",
    "momentum_120d", "drawdown", "drawdown_pct", "volume_regime", "autocorr_20d", "skew_60d", "kurt_60d", "vix", "vix_regime", "vix_change_5d",
]


def regime_extended(bars: DataFrame, vix: DataFrame | None = None, vol_windows=(20, 60, 120), trend_windows=(20, 60, 120),
                    drawdown_window: int = TRADING_DAYS, key: str = "ticker") -> DataFrame:
    """19 regime features per series; a window that is not full counts as 0.

    ``vix`` is (date, close); without it 100 times the 20-day volatility stands in.
    """
    w = series(key)

    def full(fn, c, n: int) -> Column:
        return rolling(fn, c, w, n, n)

    df = bars.select(key, "date", "close", "volume").withColumn("__r", pct_change("close", 1, w))
    df = df.withColumn("__rl", F.lag("__r").over(w))
    df = rolling_shape(df, "__r", 60, "__g1", "__g2", key)
    df = rolling_moments(df, {"__r": list(vol_windows), "close": list(trend_windows)}, key)
    out = {f"vol_{n}d": F.when(F.col(f"__k___r_{n}") >= n, F.col(f"__d___r_{n}")) * math.sqrt(TRADING_DAYS) for n in vol_windows}
    for n in trend_windows:
        mean = F.when(F.col(f"__k_close_{n}") >= n, F.col(f"__m_close_{n}"))
        out[f"trend_{n}d"] = (F.col("close") - mean) / F.greatest(mean, F.when(mean.isNotNull(), F.lit(0.01)))
    out |= {f"momentum_{n}d": pct_change("close", n, w) for n in (20, 60, 120)}
    peak = F.max("close").over(rows(w, drawdown_window))
    out["drawdown"] = div(F.col("close") - peak, peak)
    vol_mean = full(F.avg, "volume", 20)
    out["volume_regime"] = F.col("volume") / F.when(vol_mean.isNotNull(), F.greatest(vol_mean, F.lit(1.0)))
    # 20 returns give 19 neighbouring pairs
    pairs = rows(w, 19)
    a, b = F.col("__r"), F.col("__rl")
    auto = F.try_divide(F.covar_pop(a, b).over(pairs), F.stddev_pop(a).over(pairs) * F.stddev_pop(b).over(pairs))
    out["autocorr_20d"] = F.when(F.count(b).over(pairs) == 19, auto)
    n = 60.0
    # the built-in moments are population moments; small-sample corrections follow
    g1, g2 = F.col("__g1"), F.col("__g2")
    out["skew_60d"] = g1 * (math.sqrt(n * (n - 1)) / (n - 2))
    out["kurt_60d"] = (g2 * (n + 1) + 6.0) * ((n - 1) / ((n - 2) * (n - 3)))
    df = df.withColumns(out)
    df = df.withColumn("vol_regime", F.col(f"vol_{vol_windows[0]}d") / F.when(
        F.col(f"vol_{vol_windows[-1]}d").isNotNull(), F.greatest(F.col(f"vol_{vol_windows[-1]}d"), F.lit(0.01))
    )).withColumn("drawdown_pct", F.col("drawdown") * 100)
    if vix is None:
        df = df.withColumn("vix", F.col("vol_20d") * 100)
    else:
        v = vix.select("date", F.col("close").alias("__v"))  # one row per date
        df = df.join(F.broadcast(v), "date", "left")
        df = df.withColumn("vix", F.coalesce(F.last("__v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(20.0)))
    df = df.withColumn("vix_regime", F.col("vix") / 20).withColumn("vix_change_5d", pct_change("vix", 5, w))
    return df.select(key, "date", *[zero_fill(c).alias(c) for c in EXTENDED])


def classify_regime(df: DataFrame, out: str = "regime", vol: str = "vol_regime", vix: str = "vix", trend: str = "trend_20d", dd: str = "drawdown") -> DataFrame:
    """One of five labels from raw (not z-scored) features."""
    high = (F.col(vix) > 25) | (F.col(vol) > 1.2)
    up, down, deep = F.col(trend) > 0.02, F.col(trend) < -0.02, F.col(dd) < -0.10
    label = (
        F.when((deep | down) & high, "bear_high_vol")
        .when(down, "bear_low_vol")
        .when(up & high, "bull_high_vol")
        .when(up, "bull_low_vol")
        .otherwise("sideways")
    )
    return df.withColumn(out, label)


def fit_regime_clusters(df: DataFrame, k: int = 6, seed: int = 42, cols=tuple(REGIME_COLUMNS)) -> tuple[object, DataFrame]:
    """Robust scaling and k-means over the regime table; returns the model and (date, cluster)."""
    filled = df.select("date", *[zero_fill(c).alias(c) for c in cols])
    stages = [
        VectorAssembler(inputCols=list(cols), outputCol="__x"),
        RobustScaler(inputCol="__x", outputCol="__s", withCentering=True, withScaling=True),
        KMeans(featuresCol="__s", predictionCol="cluster", k=k, seed=seed, maxIter=500, initSteps=5),
    ]
    model = Pipeline(stages=stages).fit(filled)
    return model, model.transform(filled).select("date", "cluster")


def cluster_check(df: DataFrame, model, cols=tuple(REGIME_COLUMNS)) -> DataFrame:
    """One row that any right clustering passes.

    ``n_dates``, ``n_clusters`` (in use), ``n_off_nearest`` (dates with a centre nearer
    than their own) and ``center_gap`` (largest distance, in scaled columns, of a
    centre from the mean of its members).
    """
    centers = [[float(x) for x in c] for c in model.stages[-1].clusterCenters()]
    placed = model.transform(df.select("date", *[zero_fill(c).alias(c) for c in cols])).select("cluster", vector_to_array("__s").alias("__a"))

    def apart(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)

    points = F.array(*[F.array(*[F.lit(x) for x in c]) for c in centers])  # k rows of literals
    gaps = F.array(*[apart(F.col("__a"), F.element_at(points, i + 1)) for i in range(len(centers))])
    placed = placed.withColumn("__d", gaps)
    placed = placed.withColumn("__off", F.element_at("__d", F.col("cluster") + 1) > F.array_min("__d") * (1 + 1e-9) + 1e-12)
    mean = F.array(*[F.avg(F.element_at("__a", i + 1)) for i in range(len(cols))])
    per = placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("__n"), F.sum(F.col("__off").cast("bigint")).alias("__o"), mean.alias("__m"))
    gap = F.sqrt(apart(F.col("__m"), F.element_at(points, F.col("cluster") + 1)))
    return per.agg(F.sum("__n").alias("n_dates"), F.count(F.lit(1)).alias("n_clusters"), F.sum("__o").alias("n_off_nearest"), F.max(gap).alias("center_gap"))


def cluster_centers(spark, model, cols=tuple(REGIME_COLUMNS)) -> DataFrame:
    """Centres of a fitted clustering as rows (k of them)."""
    rows_ = [(i, *[float(x) for x in c]) for i, c in enumerate(model.stages[-1].clusterCenters())]
    return spark.createDataFrame(rows_, "cluster int, " + ", ".join(f"{c} double" for c in cols))


def name_clusters(centers: DataFrame) -> DataFrame:
    """A name per cluster centre; repeated names are numbered from the second on."""
    ret5, vix, vol = F.col("regime_spy_ret5"), F.col("regime_vix_level"), F.col("regime_spy_vol20")
    base = (
        F.when((ret5 < -1.0) & (vix > 1.0), "crisis")
        .when(ret5 < -0.5, F.when((vix > 0.5) | (vol > 0.5), "bear_high_vol").otherwise("bear_low_vol"))
        .when(ret5 > 0.5, F.when((vix > 0.3) | (vol > 0.3), "bull_high_vol").otherwise("bull_low_vol"))
        .otherwise("choppy")
    )
    n = F.row_number().over(Window.partitionBy("__base").orderBy("cluster")) - 1  # k rows in all
    df = centers.withColumn("__base", base).withColumn("__n", n)
    label = F.when(F.col("__n") == 0, F.col("__base")).otherwise(F.concat_ws("_", "__base", F.col("__n").cast("string")))
    return df.select("cluster", label.alias("label"))


def lookup_regime(df: DataFrame, regime: DataFrame, default: dict[str, object], date: str = "date") -> DataFrame:
    """Regime columns by date, the default where the date is missing."""
    cols = [c for c in regime.columns if c != date]
    j = df.join(F.broadcast(regime), date, "left")  # one row per date
    return j.withColumns({c: F.coalesce(F.col(c), F.lit(default[c])) for c in cols if c in default})


# Names of the macro series and columns.
MACRO_SERIES = ["vix", "vix3m", "tnx", "irx", "sp500", "rsp", "spy", "hyg", "lqd", "gld", "uup", "uso"]
MACRO_COLUMNS = [
    "macro_vix", "macro_vix_sma20_dist", "macro_vix_term_structure", "macro_yield_10y", "macro_yield_2y", "macro_yield_curve",
    "macro_credit_spread", "macro_gold_momentum", "macro_dxy_momentum", "macro_oil_momentum", "macro_breadth",
    "macro_sp500_return_20d", "macro_sp500_vol_20d", "macro_fear_greed_proxy", "macro_risk_on_off",
]


def macro_features(bars: DataFrame, series_long: DataFrame, key: str = "ticker") -> DataFrame:
    """15 macro columns on every bar from twelve (name, date, value) series.

    Everything is computed once per calendar date (series values carried forward)
    and broadcast to the bars.  A series without any rows leaves its columns neutral.
    """
    by_name = Window.partitionBy("name").orderBy("date")
    s = series_long.where(F.col("name").isin(MACRO_SERIES)).withColumns(
        {
            "sma20": F.avg("value").over(rows(by_name, 20)),
            "mom20": pct_change("value", 20, by_name),
            "r1": pct_change("value", 1, by_name),
        }
    )
    s = s.withColumn("vol20", rolling(F.stddev_samp, "r1", by_name, 20, 20) * math.sqrt(TRADING_DAYS))
    wanted = {n: ["value"] for n in MACRO_SERIES} | {
        "vix": ["value", "sma20"], "hyg": ["mom20"], "lqd": ["mom20"], "gld": ["mom20"], "uup": ["mom20"], "uso": ["mom20"], "sp500": ["mom20", "vol20"],
    }
    # a NULL at a series' own date stays a NULL until its next value, as in a plain reindex
    cells = [
        F.max_by(F.struct(F.col(f)), F.when(F.col("name") == n, F.col("date"))).alias(f"__{n}_{f}") for n, fs in wanted.items() for f in fs
    ]
    present = [F.max(F.when(F.col("name") == n, 1)).alias(f"__has_{n}") for n in MACRO_SERIES]
    dates = bars.select("date").distinct().select("date", F.lit(None).cast("string").alias("name"))
    both = s.unionByName(dates, allowMissingColumns=True)
    daily = both.groupBy("date").agg(*cells, *present)
    w = _calendar()
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    ever = Window.partitionBy(F.lit(0))
    # breadth moves on the dates both funds have
    common = F.col("__has_rsp").isNotNull() & F.col("__has_spy").isNotNull()
    ratio = F.when(common, div(F.col("__rsp_value.value"), F.col("__spy_value.value") + EPS))
    daily = daily.withColumn("__ratio", ratio).withColumn("__common", common)
    n_common = F.sum(F.when(F.col("__common"), 1).otherwise(0)).over(run)
    daily = daily.withColumn("__cn", n_common)
    # the ratio 20 common dates before: only common rows are kept in this small table
    past = daily.where("__common").select((F.col("__cn") + 20).alias("__cn"), F.col("__ratio").alias("__ratio20"))
    daily = daily.join(F.broadcast(past), "__cn", "left")  # one row per date
    daily = daily.withColumn("__b", F.when(F.col("__common"), F.struct((div("__ratio", "__ratio20") - 1).alias("v"))))

    def now(n: str, f: str = "value") -> Column:
        return F.last(f"__{n}_{f}", ignorenulls=True).over(run)[f]

    filled = daily.select(
        "date",
        *[now(n, f).alias(f"{n}_{f}") for n, fs in wanted.items() for f in fs],
        F.last("__b", ignorenulls=True).over(run)["v"].alias("breadth"),
        *[F.coalesce(F.max(f"__has_{n}").over(ever), F.lit(0)).alias(f"has_{n}") for n in MACRO_SERIES],
    )

    def has(*names: str) -> Column:
        return reduce(lambda a, b: a & b, [F.col(f"has_{n}") == 1 for n in names])

    def or_else(cond: Column, value: Column, other: float) -> Column:
        return F.when(cond, value).otherwise(F.lit(other))

    y10 = or_else(has("tnx"), F.col("tnx_value"), 0.0)
    y2 = or_else(has("irx"), F.col("irx_value"), 0.0)
    credit = or_else(has("hyg", "lqd"), F.coalesce(finite(F.col("hyg_mom20") - F.col("lqd_mom20")), F.lit(0.0)), 0.0)
    m = {
        "macro_vix": F.col("vix_value") / 100.0,
        "macro_vix_sma20_dist": or_else(has("vix"), div(F.col("vix_value") - F.col("vix_sma20"), F.col("vix_sma20") + EPS), 0.0),
        "macro_vix_term_structure": or_else(has("vix", "vix3m"), div("vix_value", F.col("vix3m_value") + EPS), 1.0),
        "macro_yield_10y": y10 / 100.0,
        "macro_yield_2y": y2 / 100.0,
        "macro_yield_curve": (y10 - y2) / 100.0,
        "macro_credit_spread": credit,
        "macro_gold_momentum": or_else(has("gld"), F.col("gld_mom20"), 0.0),
        "macro_dxy_momentum": or_else(has("uup"), F.col("uup_mom20"), 0.0),
        "macro_oil_momentum": or_else(has("uso"), F.col("uso_mom20"), 0.0),
        "macro_breadth": or_else(has("rsp", "spy"), F.coalesce(F.col("breadth"), F.lit(0.0)), 0.0),
        "macro_sp500_return_20d": or_else(has("sp500"), F.col("sp500_mom20"), 0.0),
        "macro_sp500_vol_20d": or_else(has("sp500"), F.col("sp500_vol20"), 0.0),
    }
    filled = filled.withColumns(m)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    filled = filled.withColumns(
        {
            "macro_fear_greed_proxy": (-zero("macro_vix") * 3 + zero("macro_credit_spread") + zero("macro_breadth")) / 3.0,
            "macro_risk_on_off": zero("macro_sp500_return_20d") - zero("macro_gold_momentum"),
        }
    ).select("date", *MACRO_COLUMNS)
    j = bars.select(key, "date").join(F.broadcast(filled), "date", "left")
    per = series(key).rowsBetween(Window.unboundedPreceding, 0)
    return j.select(key, "date", *[F.coalesce(F.last(finite(c), ignorenulls=True).over(per), F.lit(0.0)).alias(c) for c in MACRO_COLUMNS])


# --- graph and snapshots -----------------------------------------------------


def sector_edges(tickers: DataFrame, key: str = "ticker", sector: str = "sector") -> DataFrame:
    """The same-sector graph with self loops, as hub edges.

    Every pair of tickers of a sector is adjacent, so the pairs grow with the
    square of a sector.  The same graph is stated by one edge from each ticker to
    its sector: two tickers are neighbours if they share a hub.  Rows are
    (src, dst, kind, degree, weight); ``degree`` counts the other tickers of the
    hub.  Unknown and single-ticker sectors have no hub.
    """
    known = tickers.where(F.col(sector).isNotNull() & (F.col(sector) != "Unknown"))
    sizes = known.groupBy(sector).agg(F.count(F.lit(1)).alias("__n")).where("__n >= 2")
    hub = known.join(sizes, sector).select(
        F.col(key).alias("src"), F.col(sector).alias("dst"), F.lit("hub").alias("kind"), (F.col("__n") - 1).alias("degree"), F.lit(1.0).alias("weight")
    )
    loops = tickers.select(
        F.col(key).alias("src"), F.col(key).alias("dst"), F.lit("self").alias("kind"), F.lit(0).cast("bigint").alias("degree"), F.lit(1.0).alias("weight")
    )
    return hub.unionByName(loops)


def neighbor_mean(values: DataFrame, edges: DataFrame, value: str, key: str = "ticker", out: str = "neighbor_mean") -> DataFrame:
    """Mean value over a ticker's neighbours and itself, through the hubs: one sum per sector instead of all pairs."""
    hub = edges.where("kind = 'hub'").select(F.col("src").alias(key), "dst")
    j = values.join(hub, key, "left")
    sums = j.where("dst IS NOT NULL").groupBy("dst").agg(F.avg(value).alias("__m"))
    return j.join(sums, "dst", "left").withColumn(out, F.coalesce("__m", F.col(value))).drop("dst", "__m")


def cross_section(features: DataFrame, cols: list[str], target: str = "target", min_tickers: int = 10, date: str = "date", key: str = "ticker") -> DataFrame:
    """Snapshot rows of the dates with at least ``min_tickers`` targets, as float vectors.

    A snapshot stays a set of rows (date, ticker, node features, target, size)
    rather than one matrix cell, so its size is not bound by a task.
    """
    known = features.where(F.col(target).isNotNull())
    sizes = known.groupBy(date).agg(F.count(F.lit(1)).alias("n_tickers")).where(F.col("n_tickers") >= min_tickers)
    node = F.array(*[F.coalesce(F.col(c), F.lit(0.0)).cast("float") for c in cols]).alias("node_features")
    return known.join(sizes, date).select(date, key, node, F.col(target), "n_tickers")
