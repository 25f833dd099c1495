"""Targets, labels, sequences and time splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import clip, series
from ..functions.ranks import hash_rank
from ..functions.scan import ewm_std

MIN_PRICE = 1e-8
RET_LIMIT, TARGET_LIMIT = 0.20, 5.0
# Label thresholds.
THRESHOLDS_3 = (-0.01, 0.01)
THRESHOLDS_5 = (-0.03, -0.01, 0.01, 0.03)
THRESHOLDS_11 = (-0.05, -0.03, -0.01, -0.005, 0.0, 0.005, 0.01, 0.03, 0.05, 0.10)


def forward_return(df: DataFrame, h: int = 1, log: bool = False, out: str = "fwd_return", key="ticker", order="date") -> DataFrame:
    """Return from this close to the close h rows ahead; NULL at the tail."""
    ahead = F.greatest(F.lead("close", h).over(series(key, order)), F.lit(MIN_PRICE))
    ahead = F.when(F.lead("close", h).over(series(key, order)).isNotNull(), ahead)
    ratio = ahead / F.greatest(F.col("close"), F.lit(MIN_PRICE))
    return df.withColumn(out, F.when(F.col("close") > 0, F.log(ratio) if log else ratio - 1.0))


def open_to_close(df: DataFrame, out: str = "open_to_close", limit: float = RET_LIMIT) -> DataFrame:
    """The row's own open-to-close return, clamped."""
    ret = F.when(F.col("open") > 0, (F.col("close") - F.col("open")) / F.col("open")).otherwise(0.0)
    return df.withColumn(out, clip(ret, -limit, limit))


def _bins(c: Column, edges: list[Column]) -> Column:
    """Index of the bin: number of lower edges at or below the value."""
    label = F.lit(0)
    for e in edges:
        label = label + F.when(c >= e, 1).otherwise(0)
    return label


def class_labels(df: DataFrame, n_classes: int = 3, mode: str = "percentile", value: str = "fwd_return",
                 out: str = "label", key: str = "ticker") -> DataFrame:
    """Class of a return.

    3 or 5 classes cut at per-ticker percentiles or fixed thresholds, 11 classes
    at fixed thresholds.  NULL returns (the tail) are labelled as a zero return.
    """
    v = F.coalesce(F.col(value), F.lit(0.0))
    if n_classes == 11:
        return df.withColumn(out, _bins(v, [F.lit(t) for t in THRESHOLDS_11]))
    if n_classes not in (3, 5):
        raise ValueError("n_classes must be 3, 5 or 11")
    if mode == "fixed":
        edges = [F.lit(t) for t in (THRESHOLDS_3 if n_classes == 3 else THRESHOLDS_5)]
    else:
        probs = (0.333, 0.667) if n_classes == 3 else (0.2, 0.4, 0.6, 0.8)
        every = Window.partitionBy(key)  # one ticker: bounded by the calendar
        edges = [F.percentile(value, p).over(every) for p in probs]
    if n_classes == 3:
        return df.withColumn(out, F.when(v < edges[0], 0).when(v > edges[1], 2).otherwise(1))
    return df.withColumn(out, _bins(v, edges))


def ewma_target(df: DataFrame, span: int = 60, sigma_lag: int = 1, h: int = 1, log: bool = False, key="ticker", order="date") -> DataFrame:
    """T4: forward return over its EW deviation: ``target`` (clamped) and ``raw_target``.

    ``sigma_lag=1`` looks h-1 rows ahead when h > 1; ``sigma_lag=h`` does not.
    """
    df = forward_return(df, h, log, "__ret", key, order)
    df = df.withColumn("__win", clip("__ret", -RET_LIMIT, RET_LIMIT))
    df = df.withColumn("__lagged", F.lag("__win", sigma_lag).over(series(key, order)))
    df = ewm_std(df, "__lagged", "__sigma", span, key, order, start=sigma_lag)
    sigma = F.greatest(F.coalesce(F.col("__sigma"), F.lit(1.0)), F.lit(1e-8))
    return df.withColumns(
        {"target": clip(F.col("__win") / sigma, -TARGET_LIMIT, TARGET_LIMIT), "raw_target": F.col("__win")}
    ).drop("__ret", "__win", "__lagged", "__sigma")


def minute_target(df: DataFrame, h: int = 390, span: int = 390, sigma_lag: int = 1) -> DataFrame:
    """T5: the same target on intraday bars, one session ahead."""
    return ewma_target(df, span, sigma_lag, h, key="ticker", order="ts")


def sequences(df: DataFrame, seq_len: int, stride: int, cols: list[str], target: str = "target", warmup: int = 0,
              horizon: int = 1, key: str = "ticker", order: str = "date") -> DataFrame:
    """For every ``stride``-th row the ``seq_len`` rows before it as an array, with its target.

    Rows are gathered in blocks of ``stride`` rows, each beginning with an anchor; a
    sequence is cut from the blocks before its own.  The whole plan keeps the rows of a
    key where one exchange put them, and copies a row at most once for each block that
    needs it.  A key's rows are bounded by the calendar, as its times are unique.
    """
    w = series(key, order)
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    first = max(warmup, seq_len)
    # anchors are first, first + stride, ...
    placed = df.select(
        key, order, F.col(target).alias("__y"), F.array(*[F.col(c).cast("float") for c in cols]).alias("__x"),
        (F.row_number().over(w) - 1).cast("bigint").alias("__t"), n.alias("__n"),
    ).withColumn("__b", F.floor((F.col("__t") - first) / stride))
    item = F.struct("__t", "__x", F.col(order).alias("__o"), "__y")
    blocks = placed.groupBy(key, "__b").agg(F.array_sort(F.collect_list(item)).alias("__s"), F.max("__n").alias("__n"))
    before = Window.partitionBy(key).orderBy("__b").rowsBetween(-(-(-seq_len // stride)), -1)
    near = F.flatten(F.collect_list(F.transform("__s", lambda s: s["__x"])).over(before))
    anchor = F.col("__s")[0]
    out = blocks.withColumn("__near", near).where((F.col("__b") >= 0) & (anchor["__t"] < F.col("__n") - horizon) & anchor["__y"].isNotNull())
    return out.select(
        key, anchor["__o"].alias(order), anchor["__t"].alias("row"), F.slice("__near", -seq_len, seq_len).alias("sequence"), anchor["__y"].alias(target)
    )


def temporal_split(df: DataFrame, warmup: int = 252, fracs=(0.70, 0.15), horizon: int = 1, key: str = "ticker", order: str = "date") -> DataFrame:
    """train/val/test by row position within each ticker; NULL in the warm-up and the tail."""
    t = F.row_number().over(series(key, order)) - 1
    end = F.count(F.lit(1)).over(Window.partitionBy(key)) - horizon
    df = df.withColumns({"__t": t, "__end": end})
    usable = F.col("__end") - warmup
    train_end = warmup + F.floor(usable * fracs[0])
    val_end = train_end + F.floor(usable * fracs[1])
    row = F.col("__t")
    split = (
        F.when((row < warmup) | (row >= F.col("__end")), None)
        .when(row < train_end, "train")
        .when(row < val_end, "val")
        .otherwise("test")
    )
    return df.withColumn("split", split).drop("__t", "__end")


def global_date_bounds(df: DataFrame, fracs=(0.70, 0.15), date: str = "date") -> DataFrame:
    """One row (train_end, val_end): the dates where validation and test start."""
    dates = df.select(date).distinct()  # bounded by the calendar
    # the constant partition holds one row per date
    w = Window.partitionBy(F.lit(0)).orderBy(date)
    d = dates.select(date, (F.row_number().over(w) - 1).alias("i"), F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))).alias("n"))
    train = F.floor(F.col("n") * fracs[0])
    val = train + F.floor(F.col("n") * fracs[1])
    return d.agg(
        F.coalesce(F.min(F.when(F.col("i") == train, F.col(date))), F.date_add(F.max(date), 1)).alias("train_end"),
        F.coalesce(F.min(F.when(F.col("i") == val, F.col(date))), F.date_add(F.max(date), 1)).alias("val_end"),
    )


def global_date_split(df: DataFrame, fracs=(0.70, 0.15), date: str = "date") -> DataFrame:
    """train/val/test with the same date boundaries for every ticker."""
    bounds = global_date_bounds(df, fracs, date)
    split = F.when(F.col(date) < F.col("train_end"), "train").when(F.col(date) < F.col("val_end"), "val").otherwise("test")
    return df.join(F.broadcast(bounds)).withColumn("split", split).drop("train_end", "val_end")  # bounds: one row


def ticker_split(tickers: DataFrame, fracs=(0.80, 0.10), seed: int = 42, key: str = "ticker") -> DataFrame:
    """train/val/test by ticker, from its exact place in a seeded shuffle."""
    r = hash_rank(tickers.select(key).distinct(), key, seed)
    train = F.floor(F.col("total") * fracs[0])
    val = train + F.floor(F.col("total") * fracs[1])
    split = F.when(F.col("rank") < train, "train").when(F.col("rank") < val, "val").otherwise("test")
    return r.select(key, split.alias("split"))


def walk_forward_windows(df: DataFrame, n: int = 5, expanding: bool = True, purge: int = 5, train_frac: float = 0.70,
                         val_frac: float = 0.15, date: str = "date") -> DataFrame:
    """One row per fold with half-open train, val and test date ranges."""
    b = df.agg(F.min(date).alias("d0"), F.max(date).alias("d1")).withColumn("span", F.datediff("d1", "d0"))
    f = b.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    if expanding:
        f = f.withColumn("start", F.col("d0")).withColumn(
            "stop", F.expr(f"date_add(d0, int(floor(span * ((fold + 1) / {float(n)}D))))")
        )
    else:
        f = f.withColumn("width", F.expr("int(floor(span * 0.6D))"))
        step = f"((span - width) div {max(n - 1, 1)})"
        f = f.withColumn("start", F.expr(f"date_add(d0, int(fold * {step}))")).withColumn("stop", F.expr("date_add(start, width)"))
    f = f.withColumn("stop", F.least("stop", "d1")).withColumn("len", F.datediff("stop", "start"))
    f = f.withColumn("train_base", F.expr(f"date_add(start, int(floor(len * {train_frac}D)))"))
    f = f.withColumn("val_end", F.expr(f"date_add(train_base, int(floor(len * {val_frac}D)))"))
    return f.select(
        "fold",
        F.col("start").alias("train_lo"),
        F.date_sub("train_base", purge).alias("train_hi"),
        F.date_add("train_base", purge).alias("val_lo"),
        F.col("val_end").alias("val_hi"),
        F.col("val_end").alias("test_lo"),
        F.col("stop").alias("test_hi"),
    )


def assign_folds(df: DataFrame, windows: DataFrame, date: str = "date") -> DataFrame:
    """One row per (row, fold, split) whose date lies in the split's [lo, hi)."""
    parts = windows.select(
        "fold",
        F.inline(F.array(*[
            F.struct(F.lit(s).alias("split"), F.col(f"{s}_lo").alias("__lo"), F.col(f"{s}_hi").alias("__hi"))
            for s in ("train", "val", "test")
        ])),
    )
    # three rows per fold
    hit = (F.col(date) >= F.col("__lo")) & (F.col(date) < F.col("__hi"))
    return df.join(F.broadcast(parts), hit).drop("__lo", "__hi")


def minute_split(df: DataFrame, fracs=(0.70, 0.15), purge: int = 5, date: str = "date") -> DataFrame:
    """One window over the whole intraday range with ``purge`` days on both sides of the first cut."""
    b = df.agg(F.min(date).alias("d0"), F.max(date).alias("d1")).withColumn("span", F.datediff("d1", "d0"))
    cut = f"int(floor(span * {fracs[0]}D))"
    end = f"int(floor(span * ({fracs[0]}D + {fracs[1]}D)))"
    w = b.select(
        F.lit(0).alias("fold"),
        F.col("d0").alias("train_lo"),
        F.expr(f"date_add(d0, {cut} - {purge})").alias("train_hi"),
        F.expr(f"date_add(d0, {cut} + {purge})").alias("val_lo"),
        F.expr(f"date_add(d0, {end})").alias("val_hi"),
        F.expr(f"date_add(d0, {end})").alias("test_lo"),
        F.col("d1").alias("test_hi"),
    )
    return assign_folds(df, w, date).drop("fold")


def date_overlap(a: DataFrame, b: DataFrame, date: str = "date") -> DataFrame:
    """Dates both tables have."""
    return a.select(date).intersect(b.select(date))
