import random

from pyspark.sql import functions as F

from tapeloom.functions.scan import ema
from tapeloom.streaming import bars as X
from tapeloom.streaming import epochs as E


def ticks(spark, n, start=0, key="A"):
    return spark.range(start, start + n).select(
        F.lit(key).alias("ticker"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 20).alias("ts"), (F.sin(F.col("id")) + 10).alias("close"), F.col("id").alias("seq")
    )


def test_ema_continues_over_batches(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    schema = ticks(spark, 1).schema
    for lo in (0, 40, 70):
        new = ticks(spark, 30 if lo else 40, lo)
        new.unionByName(ticks(spark, 5, lo, "B") if lo != 40 else ticks(spark, 5, lo, "C")).write.mode("append").parquet(src)
        got = E.run_ema(spark.readStream.schema(schema).parquet(src), out, ck, 12, seq="seq")
    want = ema(ticks(spark, 100), "close", "ema", span=12, order="seq").orderBy("seq").toPandas()
    one = got.where("ticker = 'A'").orderBy("seq").toPandas()
    assert len(one) == 100 and abs(one["ema"] - want["ema"]).max() < 1e-12
    assert {r["ticker"]: r["count"] for r in got.groupBy("ticker").count().collect()} == {"A": 100, "B": 10, "C": 5}


def test_a_repeated_epoch_replaces_its_output(spark, tmp_path):
    out = str(tmp_path / "out")
    first = spark.createDataFrame([], "ticker string, ts timestamp, seq bigint, ema double")
    batch = lambda lo: ticks(spark, 20, lo).withColumnRenamed("close", "x")
    for epoch, lo in ((0, 0), (1, 20), (2, 40), (2, 40), (3, 60)):
        E.advance(batch(lo), epoch, out, E.ema_step(12), first)
    got = E.read_epochs(spark, out).orderBy("seq").toPandas()
    want = ema(ticks(spark, 80), "close", "ema", span=12, order="seq").orderBy("seq").toPandas()
    assert len(got) == 80 and abs(got["ema"] - want["ema"]).max() < 1e-12
    assert not (tmp_path / "out" / "state" / "1").exists()  # only what a repetition needs is kept


def test_stream_bars_drops_copies_of_later_files(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    schema = ticks(spark, 1).schema
    for _ in range(2):
        ticks(spark, 20).write.mode("append").parquet(src)
        X.run_available(X.stream_bars(spark.readStream.schema(schema).parquet(src), "1 hour"), out, ck)
    assert spark.read.parquet(out).count() == 20


def test_exit_fires_once_per_position(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    bars = lambda lo: ticks(spark, 10, lo).select("ticker", "ts", (F.col("seq") + 1.0).alias("high"), F.col("seq").cast("double").alias("low"))
    pos = spark.createDataFrame([(1, "A", "long", 0.0, 5.5), (2, "A", "short", 12.5, 0.0), (3, "B", "long", 0.0, 1.0)], "position_id bigint, ticker string, direction string, stop_loss double, take_profit double")
    pos = pos.withColumn("entry_ts", F.timestamp_seconds(F.lit(1_704_067_201)))
    for lo in (0, 10):
        bars(lo).write.mode("append").parquet(src)
        found = E.run_exits(spark.readStream.schema(bars(0).schema).parquet(src), pos, out, ck)
    got = {r["position_id"]: (r["exit_reason"], r["exit_price"]) for r in found.collect()}
    assert got == {1: ("tp_hit", 5.5), 2: ("stop_hit", 12.5)} and found.count() == 2
    assert [r["position_id"] for r in spark.read.parquet(f"{out}/state/1").collect()] == [3]


def test_first_exit_is_that_of_a_scan(spark):
    rng = random.Random(9)
    t0 = 1_704_067_200_000_000
    bars = [(rng.choice("AB"), t0 + int(10 ** rng.uniform(3, 12.9)), 10 + rng.gauss(0, 2)) for _ in range(1500)]
    bars = [(k, t, p + abs(rng.gauss(0, 1)), p - abs(rng.gauss(0, 1))) for k, t, p in bars] + [("A", t0 + 5, None, None)]
    bars += [(k, t, h, 2.0) for k, t, h, _ in bars[:40]]  # more bars of one time
    pos = [(i, rng.choice("ABC"), t0 + int(10 ** rng.uniform(3, 12.9)), rng.choice(["long", "short"]), rng.choice([None, 4.0, 6.0, 17.0]), rng.choice([None, 5.0, 14.0, 16.0, 40.0])) for i in range(300)]
    want = {}
    for i, k, t, side, stop, goal in pos:
        for _, u in sorted({(u, u) for kk, u, _, _ in bars if kk == k and u > t}):
            now = [(h, lo) for kk, uu, h, lo in bars if kk == k and uu == u and h is not None]
            s = stop is not None and any((lo <= stop) if side == "long" else (h >= stop) for h, lo in now)
            g = goal is not None and any((h >= goal) if side == "long" else (lo <= goal) for h, lo in now)
            if s or g:
                want[i] = (u, "stop_hit" if s else "tp_hit", stop if s else goal)
                break
    b = spark.createDataFrame(bars, "ticker string, u bigint, high double, low double").withColumn("ts", F.timestamp_micros("u"))
    p = spark.createDataFrame(pos, "position_id bigint, ticker string, u bigint, direction string, stop_loss double, take_profit double").withColumn("entry_ts", F.timestamp_micros("u"))
    found = E.first_exits(b, p).select("position_id", F.unix_micros("ts").alias("u"), "exit_reason", "exit_price").collect()
    assert {r["position_id"]: (r["u"], r["exit_reason"], r["exit_price"]) for r in found} == want and len(want) > 100


def test_a_url_is_remembered_after_the_watermark(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    day = lambda rows: spark.createDataFrame(rows, "url string, n int, t string").select("url", "n", F.to_timestamp("t").alias("published_at"))
    parts = [[("a", 1, "2020-01-01"), ("b", 2, "2020-01-02"), ("a", 3, "2020-01-01"), (None, 0, "2020-01-01")], [("c", 4, "2023-05-01"), ("b", 5, "2023-05-02")], [("a", 6, "2024-01-01"), ("d", 7, "2024-01-01"), ("c", 8, "2024-01-02")]]
    for rows in parts:
        day(rows).coalesce(1).write.mode("append").parquet(src)
        found = E.run_news(spark.readStream.schema(day(rows).schema).parquet(src), out, ck)
    assert {r["url"]: r["n"] for r in found.collect()}.keys() == {"a", "b", "c", "d"} and found.count() == 4
    assert {r["url"]: r["n"] for r in found.collect()}["d"] == 7


def test_refresh_replaces_an_epoch(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    ticks(spark, 5).write.parquet(src)
    X.refresh_daily(spark.readStream.schema(ticks(spark, 1).schema).parquet(src), out, ck, lambda b: b.groupBy("ticker").count())
    assert spark.read.parquet(out).first()["count"] == 5
