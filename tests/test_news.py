import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import news as N


def brute(bars, arts, least, k, days):
    out = set()
    for b in bars.itertuples():
        mine = arts[(arts["ticker"] == b.ticker) & (arts["sec"] < b.sec)]
        near = mine[mine["sec"] >= b.sec - days * 86400]
        pick = near if len(near) >= least else mine
        pick = pick.sort_values(["impact", "sec", "art_id"], ascending=[False, False, True]).head(k)
        out |= {(b.ticker, b.sec, a) for a in pick["art_id"]}
    return out


@pytest.mark.parametrize("least,k,days", [(5, 15, 10), (3, 4, 2), (1, 2, 1)])
def test_selection_equals_brute_force(spark, least, k, days):
    """Dense, sparse and bursty tickers; articles exactly at bar times and at window edges."""
    rng = np.random.default_rng(9)
    t0 = 1_704_067_200
    rows = []
    for tick, n, span in (("HOT", 900, 40), ("SLOW", 12, 60), ("RARE", 2, 60)):
        sec = t0 + rng.integers(0, span * 24 * 4, n) * 900
        sec[: n // 3] = t0 + 10 * 86400 + 36000  # a third at one moment
        rows += [(tick, int(s), float(rng.integers(0, 50))) for s in sec]
    arts = pd.DataFrame(rows, columns=["ticker", "sec", "impact"])
    arts["art_id"] = range(len(arts))
    bars = pd.DataFrame([(t, int(t0 + h * 3600 * 7 + m * 900)) for t in ("HOT", "SLOW", "RARE", "NONE") for h in range(0, 200, 3) for m in (0, 1)], columns=["ticker", "sec"]).drop_duplicates()
    sa = spark.createDataFrame(arts).select("ticker", "art_id", "impact", F.timestamp_seconds("sec").alias("published_at"))
    sb = spark.createDataFrame(bars).select("ticker", F.timestamp_seconds("sec").alias("ts"))
    got = N.select_articles(sb, sa, least, k, days).select("ticker", F.unix_seconds("ts").alias("s"), "art_id").collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r) for r in got} == brute(bars, arts, least, k, days)


@pytest.mark.parametrize("least,k", [(5, 4), (400, 6)])
def test_selection_inside_minutes(spark, least, k):
    """Articles and bars at single seconds of two hours, now and where the window starts; too few articles as well."""
    rng = np.random.default_rng(4)
    t0, days = 1_704_067_200 + 12 * 3600, 3
    sec = np.concatenate([t0 + rng.integers(0, 7200, 300), t0 - days * 86400 + rng.integers(0, 7200, 300), t0 + np.arange(3540, 3665)])
    arts = pd.DataFrame({"ticker": "HOT", "sec": sec, "impact": rng.integers(0, 30, len(sec)).astype(float), "art_id": range(len(sec))})
    bars = pd.DataFrame({"ticker": "HOT", "sec": np.unique(np.concatenate([t0 + rng.integers(0, 7300, 60), t0 + np.arange(3595, 3606), t0 + np.arange(0, 7200, 600)]))})
    sa = spark.createDataFrame(arts).select("ticker", "art_id", "impact", F.timestamp_seconds("sec").alias("published_at"))
    sb = spark.createDataFrame(bars).select("ticker", F.timestamp_seconds("sec").alias("ts"))
    got = N.select_articles(sb, sa, least, k, days).select("ticker", F.unix_seconds("ts").alias("s"), "art_id").collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r) for r in got} == brute(bars, arts, least, k, days)


def test_lexicon_scores(spark):
    texts = [("Strong growth, a RECORD profit", 1.0), ("weak sales and a lawsuit", -1.0), ("gain and loss", 0.0), ("nothing", 0.0), (None, 0.0), ("x" * 5000 + " beat beat miss", 1 / 3)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "i int, t string")
    got = [r["s"] for r in df.select("i", N.lexicon_sentiment("t").alias("s")).orderBy("i").collect()]
    np.testing.assert_allclose(got, [s for _, s in texts])


def test_text_choice_keeps_whole_texts(spark):
    long = "word " * 1000
    df = spark.createDataFrame([(1, None, long, "title"), (2, "  ", "", "a longer title"), (3, "s", "b", "short")], "i int, Lsa_summary string, body string, title string")
    got = {r["i"]: r["text"] for r in N.choose_text(df).collect()}
    assert got == {1: long, 2: "a longer title"}


def test_cap_is_seeded_and_bounded(spark):
    df = spark.range(100).select(F.lit("A").alias("ticker"), F.lit("d").alias("date"), F.col("id").cast("string").alias("url"))
    a = {r["url"] for r in N.cap_articles(df, 10).collect()}
    b = {r["url"] for r in N.cap_articles(df.repartition(7), 10).collect()}
    assert len(a) == 10 and a == b
