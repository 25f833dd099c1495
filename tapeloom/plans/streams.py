"""Stream queries (X1-X9): file streams over the tables, run to the end of the data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import rounded
from ..operators import news as N
from ..session import configure, work_dir
from ..sources import tables as T
from ..streaming import bars as X
from ..streaming import epochs as E
from .news import STATS
from .registry import query, r6
from .sql import VECTORS

def source(spark, sf, name, glob=None):
    """A table of the test data as a file stream."""
    configure(spark)
    path = f"{sf.rstrip('/')}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(f"{sf.rstrip('/')}/{glob or name + '*.parquet'}")


def tick_stream(spark, sf):
    return source(spark, sf, "events").select("event_id", F.col("event_type").alias("ticker"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.lit(1.0).alias("qty"))


def finish(spark, df):
    """Run a stream over everything there is and read back what it wrote."""
    base = work_dir(spark)
    X.run_available(df, f"{base}/out", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out")


def ntz(df, *cols):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


@query("X1_stream_bars", "SELECT DISTINCT event_type AS ticker, date_trunc('minute', ts) AS ts FROM events")
def x1(spark, sf):
    bars = tick_stream(spark, sf).withColumn("ts", F.date_trunc("minute", "ts")).select("ticker", "ts")
    return ntz(finish(spark, X.stream_bars(bars)), "ts")


def ohlcv_sql(size: str, slide: str, offsets: int, delay: str) -> str:
    """Windows that the watermark (latest event minus the delay) has passed."""
    return f"""WITH e AS (SELECT event_type AS ticker, ts, value, event_id, time_bucket(INTERVAL {slide}, ts) AS b FROM events), x AS (SELECT e.*, b - o.i * INTERVAL {slide} AS s FROM e, range({offsets}) o(i)),
  w AS (SELECT ticker, s AS ts, s + INTERVAL {size} AS "end", arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, row(ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume FROM x WHERE ts < s + INTERVAL {size} GROUP BY ticker, s)
  SELECT * FROM w WHERE "end" <= (SELECT max(ts) FROM events) - INTERVAL {delay}"""


@query("X2_stream_ohlcv", ohlcv_sql("1 MINUTE", "1 MINUTE", 1, "10 MINUTE"))
def x2(spark, sf):
    return ntz(finish(spark, X.stream_ohlcv(tick_stream(spark, sf), "1 minute", order=["ts", "event_id"])), "ts", "end")


@query("X2_stream_ohlcv_sliding", ohlcv_sql("1 HOUR", "20 MINUTE", 3, "10 MINUTE"))
def x2_sliding(spark, sf):
    return ntz(finish(spark, X.stream_ohlcv(tick_stream(spark, sf), "1 hour", "20 minutes", order=["ts", "event_id"])), "ts", "end")


@query("X3_stream_news", "SELECT DISTINCT source || '/' || (doc_id // 3) AS url FROM documents")
def x3(spark, sf):
    docs = source(spark, sf, "documents").select(
        F.concat_ws("/", "source", F.expr("doc_id div 3").cast("string")).alias("url"), F.timestamp_seconds(F.col("doc_id") * 60 + 1_000_000_000).alias("published_at")
    )
    base = work_dir(spark)
    return E.run_news(docs, base, f"{base}/checkpoint").select("url")


@query("X4_late_bars", """WITH e AS (SELECT event_type AS ticker, date_trunc('hour', ts) AS h, ts, event_id FROM events), l AS (SELECT ticker, h FROM e UNION ALL SELECT ticker, h FROM e WHERE ts < TIMESTAMP '2024-01-20' AND ts >= (SELECT max(ts) FROM e WHERE ts < TIMESTAMP '2024-01-20') - INTERVAL 5 HOUR)
  SELECT ticker, h AS ts, CAST(count(*) AS DOUBLE) AS volume FROM l GROUP BY ticker, h HAVING h + INTERVAL 1 HOUR <= (SELECT max(ts) FROM e) - INTERVAL 6 HOUR""")
def x4(spark, sf):
    base = work_dir(spark)
    ev = T.event_ticks(spark, sf)
    first = ev.where("ts < timestamp '2024-01-20 00:00:00'")
    # the second delivery repeats ticks of the last five hours (in time) and of long ago (too late)
    edge = first.agg(F.max("ts").alias("m"))
    again = first.join(F.broadcast(edge)).where((F.col("ts") >= F.col("m") - F.expr("INTERVAL 5 HOURS")) | (F.col("ts") < F.to_timestamp(F.lit("2024-01-10 00:00:00")))).drop("m")
    first.write.parquet(f"{base}/in")
    def run():
        src = spark.readStream.schema(ev.schema).parquet(f"{base}/in")
        X.run_available(X.stream_ohlcv(src, "1 hour", delay="6 hours"), f"{base}/out", f"{base}/checkpoint")
    run()
    ev.where("ts >= timestamp '2024-01-20 00:00:00'").unionByName(again).write.mode("append").parquet(f"{base}/in")
    run()
    return ntz(spark.read.parquet(f"{base}/out").select("ticker", "ts", "volume"), "ts")


ENR = f"""{VECTORS}, d AS (SELECT ticker, date, {STATS} FROM vectors GROUP BY ticker, date), e AS (SELECT event_id, 'S' || (event_id % 10) AS ticker, DATE '1995-01-02' + CAST(event_id % 2400 AS INTEGER) AS date, value FROM events)"""


@query("X5_stream_enrich", f"WITH {ENR} SELECT event_id, e.ticker, e.date, value, {r6('compound_mean', 'compound_mean')}, n_articles FROM e LEFT JOIN d ON d.ticker = e.ticker AND d.date = e.date - 1")
def x5(spark, sf):
    bars = source(spark, sf, "events").select(
        "event_id", F.concat(F.lit("S"), F.pmod("event_id", F.lit(10)).cast("string")).alias("ticker"),
        F.date_add(F.lit(T.DAY0).cast("date"), F.pmod("event_id", F.lit(2400)).cast("int")).alias("date"), "value",
    )
    daily = N.pool_vectors(T.article_vectors(spark, sf), ["ticker", "date"]).select("ticker", "date", "compound_mean", "n_articles")
    return rounded(finish(spark, X.stream_enrich(bars, daily)))


EXITS = """e AS (SELECT event_type AS ticker, ts, value FROM events), p AS (SELECT event_id AS position_id, event_type AS ticker, ts AS entry_ts, CASE WHEN event_id % 2 = 0 THEN 'long' ELSE 'short' END AS direction, value * CASE WHEN event_id % 2 = 0 THEN 0.1::DOUBLE ELSE 4.0::DOUBLE END AS stop_loss, value * CASE WHEN event_id % 2 = 0 THEN 4.0::DOUBLE ELSE 0.1::DOUBLE END AS take_profit
    FROM events),
  h AS (SELECT position_id, e.ts, CASE WHEN (direction = 'long' AND value <= stop_loss) OR (direction = 'short' AND value >= stop_loss) THEN 'stop_hit' WHEN (direction = 'long' AND value >= take_profit) OR (direction = 'short' AND value <= take_profit) THEN 'tp_hit' END AS exit_reason, stop_loss, take_profit FROM p JOIN e USING (ticker) WHERE e.ts > entry_ts),
  f AS (SELECT *, row_number() OVER (PARTITION BY position_id ORDER BY ts) AS r FROM h WHERE exit_reason IS NOT NULL)"""


@query("X6_stream_exits", f"WITH {EXITS} SELECT position_id, ts, {r6('CASE WHEN exit_reason = $$stop_hit$$ THEN stop_loss ELSE take_profit END', 'exit_price')}, exit_reason FROM f WHERE r = 1".replace("$$", "'"))
def x6(spark, sf):
    even = F.pmod("event_id", F.lit(2)) == 0
    pos = T.table(spark, sf, "events").select(
        F.col("event_id").alias("position_id"), F.col("event_type").alias("ticker"), F.col("ts").cast("timestamp").alias("entry_ts"), F.when(even, "long").otherwise("short").alias("direction"),
        (F.col("value") * F.when(even, 0.1).otherwise(4.0)).alias("stop_loss"), (F.col("value") * F.when(even, 4.0).otherwise(0.1)).alias("take_profit"),
    )
    bars = tick_stream(spark, sf).select("ticker", "ts", F.col("price").alias("high"), F.col("price").alias("low"))
    base = work_dir(spark)
    out = E.run_exits(bars, pos, base, f"{base}/checkpoint")
    return rounded(ntz(out, "ts"))


@query("X7_stream_sessions", f"""WITH e AS (SELECT event_type AS ticker, ts, value, ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts) AS gap FROM events), g AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY ticker ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e),
  w AS (SELECT ticker, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n, sum(value) AS total FROM g GROUP BY ticker, s) SELECT ticker, start, "end", n, {r6('total', 'total', 4)} FROM w WHERE "end" <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def x7(spark, sf):
    return rounded(ntz(finish(spark, X.stream_sessions(tick_stream(spark, sf))), "start", "end"), 4)


@query("X8_stream_quality", """WITH e AS (SELECT event_type AS ticker, time_bucket(INTERVAL 1 HOUR, ts) AS start, value, event_id FROM events), w AS (SELECT ticker, start, start + INTERVAL 1 HOUR AS "end", count(*) AS n_rows, count(CASE WHEN value > 50 THEN 1 END) AS n_null, count(CASE WHEN event_id % 7 = 0 THEN 1 END) AS n_inverted, count(CASE WHEN event_id % 5 = 0 THEN 1 END) AS n_empty FROM e GROUP BY ticker, start)
  SELECT * FROM w WHERE "end" <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def x8(spark, sf):
    p, i = F.col("price"), F.col("event_id")
    bars = tick_stream(spark, sf).select(
        "ticker", "ts", p.alias("open"), p.alias("high"), F.when(F.pmod(i, F.lit(7)) == 0, p + 1).otherwise(p).alias("low"), F.when(p <= 50, p).alias("close"),
        F.when(F.pmod(i, F.lit(5)) == 0, 0.0).otherwise(1.0).alias("volume"),
    )
    return ntz(finish(spark, X.stream_quality(bars)), "start", "end")


@query("X9_stream_ema", f"""WITH RECURSIVE num AS (SELECT event_type AS ticker, ts, event_id AS seq, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS t FROM events),
  ema AS (SELECT ticker, ts, seq, t, CAST(value AS DOUBLE) AS ema FROM num WHERE t = 0 UNION ALL SELECT n.ticker, n.ts, n.seq, n.t, {1 - 2 / 13!r}::DOUBLE * e.ema + {2 / 13!r}::DOUBLE * n.value FROM ema e JOIN num n ON n.ticker = e.ticker AND n.t = e.t + 1) SELECT ticker, ts, seq, {r6('ema', 'ema')} FROM ema""")
def x9(spark, sf):
    base = work_dir(spark)
    out = E.run_ema(tick_stream(spark, sf).withColumnRenamed("price", "close"), base, f"{base}/checkpoint", 12, seq="event_id")
    return rounded(ntz(out, "ts"))
