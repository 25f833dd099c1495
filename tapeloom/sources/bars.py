"""Reading, building and merging price bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import col
from ..session import materialize

DAILY_SCHEMA = T.StructType(
    [
        T.StructField("date", T.StringType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("adj_close", T.DoubleType()),
        T.StructField("volume", T.DoubleType()),
    ]
)

# Accepted timestamp spellings, tried in this order.
TS_FORMATS = (
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ssXXX",
    "yyyy-MM-dd HH:mm:ssXXX",
    "yyyy-MM-dd HH:mm:ss z",
    "yyyy-MM-dd",
    "MM/dd/yyyy",
)


def parse_ts(c: str | Column) -> Column:
    """Timestamp from text in any accepted spelling, NULL when none fits."""
    text = F.trim(col(c).cast("string"))
    tries = [F.try_to_timestamp(text), *[F.try_to_timestamp(text, F.lit(f)) for f in TS_FORMATS]]
    return F.coalesce(*tries)


def standardize_columns(df: DataFrame, mapping: dict[str, list[str]], types: dict[str, str] | None = None) -> DataFrame:
    """One column per target name from the first alternatives that have a value.

    Alternatives are matched on the trimmed lower-case name; a target without any
    is added as a typed NULL.  Other columns are kept.
    """
    present: dict[str, str] = {}
    for c in df.columns:
        present.setdefault(c.strip().lower(), c)
    out, used = [], set()
    for target, alternatives in mapping.items():
        names: list[str] = []
        for a in [target, *alternatives]:
            found = present.get(a.strip().lower())
            if found is not None and found not in names:
                names.append(found)
        used.update(names)
        kind = (types or {}).get(target)
        c = F.coalesce(*[F.col(f"`{n}`") for n in names]) if names else F.lit(None).cast(kind or "string")
        out.append((c.cast(kind) if kind else c).alias(target))
    rest = [F.col(f"`{c}`") for c in df.columns if c not in used and c not in mapping]
    return df.select(*out, *rest)


def adjust_close(df: DataFrame, close: str = "close", adjusted: str = "adj_close") -> DataFrame:
    """S3: prefer the adjusted close."""
    return df.withColumn(close, F.coalesce(F.col(adjusted), F.col(close)))


def _folder(name: Column) -> Column:
    """Folder name as written: paths are URL-escaped, partition folders once more."""
    once = F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))
    return F.url_decode(F.replace(once, F.lit("+"), F.lit("%2B")))


_MOST_FIELDS = 64  # of a line of prices


def read_daily_bars(spark: SparkSession, path: str) -> DataFrame:
    """Daily bars from ``<path>/<ticker>/*.csv``, one folder per ticker.

    Each file has its own header: order, case and presence of its columns are free.
    Lines are read as text and meet their file's header (the line with a date column
    and a close column) by the file's path.  A file without such a line is left out,
    as are dates that do not parse.
    """
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv*").text(path)
    fields = F.from_csv("value", ", ".join(f"c{i} STRING" for i in range(_MOST_FIELDS)))
    split = lines.select(F.col("_metadata.file_path").alias("_file"), fields.alias("_f")).select("_file", F.array(*[f"_f.c{i}" for i in range(_MOST_FIELDS)]).alias("_v"))
    names = {
        "date": ["date", "timestamp", "datetime"], "open": ["open"], "high": ["high"], "low": ["low"], "close": ["close"],
        "adj_close": ["adj_close", "adj close", "adjclose"], "volume": ["volume", "vol"],
    }
    clean = F.transform("_v", lambda x: F.lower(F.trim(F.regexp_replace(x, "\ufeff", ""))))
    is_header = F.arrays_overlap(clean, F.array(*map(F.lit, names["date"]))) & F.array_contains(clean, "close")
    split = split.withColumn("_header", F.coalesce(is_header, F.lit(False)))
    headers = split.where("_header").groupBy("_file").agg(F.min(clean).alias("_names"))  # one row for each file
    rows = split.where("NOT _header").drop("_header").join(headers, "_file")

    def value(alternatives: list[str]) -> Column:
        found = [F.nullif(F.trim(F.get("_v", (F.array_position("_names", F.lit(a)) - 1).cast("int"))), F.lit("")) for a in alternatives]
        return F.coalesce(*found)

    ticker = _folder(F.regexp_extract("_file", r"(?:ticker=)?([^/=]+)/[^/]+$", 1))
    df = rows.select(ticker.alias("ticker"), *[value(a).alias(n) for n, a in names.items()])
    numbers = {c: F.expr(f"try_cast({c} AS double)") for c in ("open", "high", "low", "close", "adj_close", "volume")}
    return (
        df.withColumns(numbers)
        .withColumn("date", parse_ts("date").cast("date"))
        .where("date IS NOT NULL")
        .select("ticker", "date", "open", "high", "low", "close", "adj_close", "volume")
        .transform(adjust_close)
    )


def read_minute_bars(spark: SparkSession, path: str) -> DataFrame:
    """Minute bars from Parquet, UTC, one row per (ticker, ts).

    One table with a ticker column, or a file (or folder of files) for each ticker
    without one: ``<ticker>.parquet`` or ``ticker=<ticker>/``.
    """
    raw = spark.read.option("recursiveFileLookup", True).option("mergeSchema", True).parquet(path)
    if "ticker" not in [c.strip().lower() for c in raw.columns]:
        file = F.col("_metadata.file_path")
        found = [F.nullif(F.regexp_extract(file, p, 1), F.lit("")) for p in (r"/ticker=([^/]+)/", r"/([^/]+)\.parquet/[^/]+$", r"/([^/]+)\.parquet$")]
        raw = raw.withColumn("ticker", _folder(F.coalesce(*found)))
    return unique_bars(standardize_columns(raw, {"ticker": [], "ts": ["timestamp", "date", "datetime"]}))


def unique_bars(df: DataFrame, key: str = "ticker", ts: str = "ts") -> DataFrame:
    """One bar per (key, ts); of copies the first in the order of their values stays."""
    values = [c for c in df.columns if c not in (key, ts)]
    w = Window.partitionBy(key, ts).orderBy(*values)
    # row_number() = 1 lets Spark drop surplus copies before the shuffle
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def build_bars(ticks: DataFrame, price: str, volume: str, keys: list[str], order: list[str]) -> DataFrame:
    """OHLCV bars from trades: one row per ``keys``.

    Open and close follow ``order``, which must be unique within a bar.  The
    aggregate combines on the map side, so a ticker with most of the trades
    still shuffles one row per bar and task.
    """
    seq = F.struct(*order) if len(order) > 1 else F.col(order[0])
    return ticks.groupBy(*keys).agg(
        F.min_by(price, seq).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, seq).alias("close"),
        F.sum(volume).alias("volume"),
    )


def incremental_daily(existing: DataFrame, new: DataFrame, key: str = "ticker", date: str = "date") -> DataFrame:
    """Append the new rows that are later than the last stored date of their ticker."""
    last = existing.groupBy(key).agg(F.max(date).alias("__last"))
    fresh = new.join(last, key, "left").where(F.col("__last").isNull() | (F.col(date) > F.col("__last"))).drop("__last")
    return existing.unionByName(fresh, allowMissingColumns=True)


def merge_bars(existing: DataFrame, new: DataFrame, key: str = "ticker", ts: str = "ts") -> DataFrame:
    """Union of two bar tables; the stored row wins on the same timestamp."""
    fresh = new.join(existing.select(key, ts), [key, ts], "left_anti")
    return existing.unionByName(fresh, allowMissingColumns=True)


def collection_status(bars: DataFrame, key: str = "ticker", date: str = "date") -> DataFrame:
    """Rows, first and last date and day span per ticker."""
    return bars.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(date).alias("first_date"),
        F.max(date).alias("last_date"),
        F.datediff(F.max(date), F.min(date)).cast("bigint").alias("span_days"),
    )


def backfill_gaps(bars: DataFrame, tickers: DataFrame, start: str, end: str, tolerance_days: int = 5,
                  key: str = "ticker", date: str = "date") -> DataFrame:
    """Which part of [start, end] each ticker still lacks.

    A ticker may start or end up to ``tolerance_days`` inside the range.  One
    row per missing range, or one ``complete`` row.
    """
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    have = bars.groupBy(key).agg(F.min(date).alias("first"), F.max(date).alias("last"))
    j = tickers.select(key).distinct().join(have, key, "left")

    def gap(a, b, status):
        return F.struct(a.alias("fetch_start"), b.alias("fetch_end"), F.lit(status).alias("status"))

    none = F.lit(None).cast("date")
    empty = F.col("first").isNull()
    before = ~empty & (F.col("first") > F.date_add(lo, tolerance_days))
    after = ~empty & (F.col("last") < F.date_sub(hi, tolerance_days))
    parts = F.array_compact(
        F.array(
            F.when(empty, gap(lo, hi, "missing")),
            F.when(before, gap(lo, F.date_sub("first", 1), "before")),
            F.when(after, gap(F.date_add("last", 1), hi, "after")),
            F.when(~empty & ~before & ~after, gap(none, none, "complete")),
        )
    )
    return j.select(key, F.inline(parts))


def viable_tickers(daily: DataFrame, minute: DataFrame, min_daily: int = 750, min_minute: int = 780,
                   max_tickers: int | None = None, key: str = "ticker") -> DataFrame:
    """Tickers with enough daily and minute rows, optionally the first n by name."""
    d = daily.groupBy(key).agg(F.count(F.lit(1)).alias("n_daily")).where(F.col("n_daily") >= min_daily)
    m = minute.groupBy(key).agg(F.count(F.lit(1)).alias("n_minute")).where(F.col("n_minute") >= min_minute)
    out = d.join(m, key)
    return out.orderBy(key).limit(max_tickers) if max_tickers else out


def read_snapshot(spark: SparkSession, path: str, date: str | None = None, column: str = "snapshot") -> DataFrame:
    """One dated snapshot of a table partitioned by ``column``; the latest by default."""
    df = spark.read.parquet(path)
    if date is not None:
        return df.where(F.col(column) == F.lit(date).cast(df.schema[column].dataType))
    latest = df.agg(F.max(column).alias(column))  # metadata-sized: one value
    return df.join(F.broadcast(latest), column, "left_semi")


FINGERPRINTS = "year int, bucket int, ticker string, n bigint, h decimal(38,0), buckets int"


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def write_features(df: DataFrame, path: str, date: str = "date", key: str = "ticker", buckets: int = 16) -> int:
    """Bring the feature table at ``path`` up to date with ``df``; returns the number of partitions written.

    The table is Parquet partitioned by year and a bucket of the ticker's hash.  The
    rows of a (ticker, year) in ``df`` replace those in the table; all other tickers
    and years stay.  A fingerprint of each (ticker, year), its row count and the sum of
    its rows' hashes, lies beside the table (``{path}.fingerprints``): partitions whose
    tickers all have the fingerprint that they had are not written, so a second run
    without changes writes nothing.  What stays of a rewritten partition is merged
    before anything is overwritten, and fingerprints come after the rows: a run that
    fails in between is made good by repeating it.

    ``buckets`` holds from the first write on.  Rows without ticker or date raise; an
    empty ``df`` changes nothing.
    """
    spark = df.sparkSession
    marks = path.rstrip("/") + ".fingerprints"
    known = _exists(spark, marks)
    if known:
        stored = spark.read.schema(FINGERPRINTS).parquet(marks)
        row = stored.select("buckets").first()
        buckets = row[0] if row else buckets
    else:
        stored = spark.createDataFrame([], FINGERPRINTS)
    whole = F.col(key).isNotNull() & F.col(date).isNotNull()
    checked = df.where(F.when(whole, True).otherwise(F.raise_error(F.lit("feature rows need a ticker and a date")).cast("boolean")))
    columns = [c for c in df.columns if c not in ("year", "bucket")]
    new = checked.select(*columns, F.year(date).alias("year"), F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int").alias("bucket"))

    def fingerprints(rows: DataFrame) -> DataFrame:
        h = F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("h")
        return rows.groupBy("year", "bucket", F.col(key).cast("string").alias("ticker")).agg(F.count(F.lit(1)).alias("n"), h)

    fresh = materialize(fingerprints(new))
    was = stored.select("year", "bucket", "ticker", F.col("n").alias("__n"), F.col("h").alias("__h"))
    changed = fresh.join(was, ["year", "bucket", "ticker"], "left").where(~(F.col("n").eqNullSafe(F.col("__n")) & F.col("h").eqNullSafe(F.col("__h"))))
    touched = materialize(changed.select("year", "bucket").distinct())
    count = touched.count()
    if not count:
        return 0
    merged = new.join(touched, ["year", "bucket"], "left_semi")
    stays = stored.join(touched, ["year", "bucket"], "left_semi").join(fresh, ["year", "bucket", "ticker"], "left_anti")
    if known:
        old = spark.read.schema(new.schema).parquet(path).withColumn("__ticker", F.col(key).cast("string"))
        keep = stays.select("year", "bucket", F.col("ticker").alias("__ticker"))
        merged = merged.unionByName(old.join(keep, ["year", "bucket", "__ticker"], "left_semi").drop("__ticker").select(*new.columns))
    merged = materialize(merged)

    def overwrite(rows: DataFrame, where: str) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "bucket").parquet(where)

    # Spark sizes the files at run time: a large partition is split over many tasks, small ones share one
    overwrite(merged.hint("rebalance", F.col("year"), F.col("bucket")).sortWithinPartitions(key, date), path)
    marked = fresh.join(touched, ["year", "bucket"], "left_semi").unionByName(stays.select(*fresh.columns))
    overwrite(materialize(marked).withColumn("buckets", F.lit(buckets)).repartition("year", "bucket"), marks)
    return count
