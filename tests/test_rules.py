import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.functions import cleaning as C
from tapeloom.operators import decisions as X
from tapeloom.operators import portfolio as P
from tapeloom.operators import regime as R
from tapeloom.operators import targets as G
from tapeloom.plans.decisions import JOURNAL_SCHEMA
from tapeloom.sources import bars as B
from tapeloom.sources import feeds


def dates(n):
    return pd.bdate_range("2024-01-01", periods=n).date


def test_total_loss_has_no_growth_rate(spark):
    df = spark.createDataFrame(pd.DataFrame({"date": dates(6), "ret": [0.1, -1.2, 0.1, 0.1, 0.1, 0.1]}))
    row = P.performance_summary(df).first()
    assert row["total_return"] < -1 and row["sharpe"] is None and row["ann_return"] is None


def test_turnover_counts_entries_only(spark):
    pos = [("2024-01-01", "A", 1), ("2024-01-01", "B", -1), ("2024-01-02", "A", 1), ("2024-01-02", "C", -1), ("2024-01-03", "A", 1), ("2024-01-03", "C", -1)]
    df = spark.createDataFrame(pos, "date string, ticker string, side int")
    got = {r["date"]: r["turnover"] for r in P.turnover(df).collect()}
    assert got == {"2024-01-01": 1.0, "2024-01-02": 0.5, "2024-01-03": 0.0}


def test_top_k_is_limited_before_the_shuffle(spark):
    df = spark.range(1000).select(F.pmod("id", F.lit(2)).cast("string").alias("date"), F.col("id").cast("string").alias("ticker"), F.col("id").cast("double").alias("pred"))
    top = P.top_k(df, "pred", 3)
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
    assert [r["pred"] for r in top.where("date = '1'").orderBy("rank").collect()] == [999.0, 997.0, 995.0]


def test_ties_in_predictions_are_deterministic(spark):
    df = spark.createDataFrame([("d", t, 1.0, 0.1) for t in "ABCDEFGH"], "date string, ticker string, pred double, target double")
    a = P.long_short_positions(df, 2).orderBy("side", "ticker").collect()
    b = P.long_short_positions(df.repartition(5), 2).orderBy("side", "ticker").collect()
    assert a == b and {r["ticker"] for r in a} == {"A", "B", "G", "H"}


def journal_row(**kw):
    names = [f.split(" ")[0] for f in JOURNAL_SCHEMA.split(", ")]
    return tuple(kw.get(n) for n in names)


def test_outcomes_fill_only_matured_open_rows(spark):
    bars = spark.createDataFrame([("A", f"2024-01-{d:02d}", c) for d, c in ((2, 10.0), (3, 11.0), (4, 12.0))], "ticker string, d string, close double").select("ticker", F.to_date("d").alias("date"), "close")
    rows = [
        journal_row(ticker="A", timestamp="2024-01-02T00:00:00", direction="long", entry_price=10.0),
        journal_row(ticker="A", timestamp="2024-01-02T09:30:00", direction="short", entry_price=10.0),
        journal_row(ticker="A", timestamp="2024-01-04T00:00:00", direction="long", entry_price=12.0),
        journal_row(ticker="A", timestamp="2024-01-02T00:00:00", direction="long", entry_price=10.0, actual_return=0.5, exit_reason="stop_hit"),
    ]
    out = X.fill_outcomes(spark.createDataFrame(rows, JOURNAL_SCHEMA), bars, 1).collect()
    assert sorted((r["actual_return"], r["exit_reason"]) for r in out if r["actual_return"] is not None) == [
        (pytest.approx(-0.1), "time_exit"), (pytest.approx(0.1), "time_exit"), (0.5, "stop_hit")]
    assert sum(r["actual_return"] is None for r in out) == 1


def test_cold_model_stops_everything(spark):
    df = spark.createDataFrame([("cold", 0.1, 0.9, 1.0, 4, 0.1), ("warm", 0.1, 0.9, 1.0, 4, 0.1), ("warm", 0.0, 0.9, 1.0, 2, 0.1)],
                               "confidence string, predicted_return double, overall_agreement double, direction_agreement double, n_active_models int, std_prediction double")
    got = [(r["approved"], len(r["reasons"])) for r in X.approve(df).collect()]
    assert got == [(False, 1), (True, 0), (False, 2)]


def test_splits_are_disjoint_and_ordered(spark, walk):
    _, df = walk
    s = G.global_date_split(df).groupBy("split").agg(F.min("date").alias("lo"), F.max("date").alias("hi")).toPandas().set_index("split")
    assert s.loc["train", "hi"] < s.loc["val", "lo"] and s.loc["val", "hi"] < s.loc["test", "lo"]
    f = G.assign_folds(df.select("ticker", "date"), G.walk_forward_windows(df, 3))
    assert f.groupBy("ticker", "date", "fold").count().where("count > 1").isEmpty()


def test_sequences_hold_the_rows_before(spark, walk):
    _, df = walk
    out = G.sequences(G.forward_return(df, out="target"), 5, 7, ["close"], warmup=10).where("ticker = 'BBB'").orderBy("row").toPandas()
    closes = df.where("ticker = 'BBB'").orderBy("date").toPandas()["close"].tolist()
    assert out["row"].tolist() == list(range(10, 149, 7))
    for row, seq in zip(out["row"], out["sequence"]):
        assert [s[0] for s in seq] == pytest.approx(closes[row - 5:row], rel=1e-6)
    few = df.where("ticker = 'BBB' AND close IS NOT NULL")
    for length, stride, warmup in ((8, 3, 0), (5, 1, 11), (6, 6, 6), (151, 2, 0)):
        out = G.sequences(G.forward_return(few, out="target"), length, stride, ["close"], warmup=warmup).orderBy("row").toPandas()
        assert out["row"].tolist() == list(range(max(length, warmup), 149, stride))
        for row, seq in zip(out["row"], out["sequence"]):
            assert [s[0] for s in seq] == pytest.approx(closes[row - length:row], rel=1e-6)


def test_hub_graph_equals_all_pairs(spark):
    t = spark.createDataFrame([("A", "x"), ("B", "x"), ("C", "x"), ("D", "y"), ("E", "Unknown"), ("F", "Unknown")], "ticker string, sector string")
    e = R.sector_edges(t)
    hub = {r["src"]: r["degree"] for r in e.where("kind = 'hub'").collect()}
    assert hub == {"A": 2, "B": 2, "C": 2} and e.where("kind = 'self'").count() == 6
    v = spark.createDataFrame([("A", 1.0), ("B", 2.0), ("C", 6.0), ("D", 5.0), ("E", 7.0)], "ticker string, v double")
    assert {r["ticker"]: r["neighbor_mean"] for r in R.neighbor_mean(v, e, "v").collect()} == {"A": 3.0, "B": 3.0, "C": 3.0, "D": 5.0, "E": 7.0}


def test_formula_rejects_unknown_names(spark):
    for bad in ("reflect('java.lang.System', 'exit')", "close; 1", "secret + 1", "raise_error(1)"):
        with pytest.raises(ValueError):
            C.check_formula("feat_x", bad, ["close"])
    C.check_formula("feat_x", "log1p(abs(close)) / (close + 1e-6)", ["close"])
    with pytest.raises(ValueError):
        C.check_formula("x", "close", ["close"])


def test_page_text(spark):
    p = "a paragraph that is clearly longer than forty characters, number "
    html = f"<script>var p='<p>{p}0</p>'</script><p>short</p><p class='x'>{p}<b>1</b> &amp; more</p><p>{p}2<p>{p}3</p>"
    row = feeds.extract_article_text(spark.createDataFrame([("http://x", html), ("http://x", "<p>tiny</p>")], "url string, html string")).collect()
    assert row[0]["article"].count("paragraph") == 3 and "& more" in row[0]["article"] and row[1]["article"] is None


def test_unparsable_dates_and_alternates(spark):
    df = spark.createDataFrame([("A", "2024-01-02"), ("B", "02.01.2024"), ("C", None)], "Symbol string, Timestamp string")
    s = B.standardize_columns(df, {"ticker": ["symbol"], "date": ["timestamp"], "close": []}, {"close": "double"})
    out = {r["ticker"]: r["d"] for r in s.select("ticker", B.parse_ts("date").alias("d")).collect()}
    assert out["A"] is not None and out["B"] is None and out["C"] is None and s.schema["close"].dataType.simpleString() == "double"
