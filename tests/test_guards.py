"""Inputs that used to fail or to be read wrongly: zero divisors, empty tables, ties, free file layouts."""

import datetime as dt
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.functions import cleaning, core
from tapeloom.operators import feedback, joins, metrics, minute, targets
from tapeloom.session import work_dir
from tapeloom.sources import bars


def test_formula_with_zero_divisors(spark):
    df = spark.createDataFrame([(6.0, 0.0, 5), (6.0, 2.0, 4), (8.0, 2.0, 3), (9.0, 3.0, 2)], "x double, y double, n int")
    got = [r["feat_a"] for r in cleaning.formula_feature(df, "feat_a", "x / y").collect()]
    assert got == [0.0, 3.0, 4.0, 3.0]
    got = [r["feat_b"] for r in cleaning.formula_feature(df, "feat_b", "x / (y - 3) / -n + log(x % n) * 2").collect()]
    assert got[3] == 0.0 and got[0] == pytest.approx(6 / -3 / -5)  # log(1) is 0; a divisor of 0 counts as not finite
    assert [r["feat_c"] for r in cleaning.formula_feature(df, "feat_c", "2147483647 * n * n").collect()][0] == pytest.approx(2147483647.0 * 25)


def test_histogram_of_zero_outcomes(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.0, 0.0)], "pred double, target double")
    assert {(r["series"], r["bin"], r["n"], r["density"]) for r in metrics.return_histogram(df).collect()} == {("actual", 0, 2, None), ("predicted", 0, 2, None)}


@pytest.mark.parametrize("n", [0, 3])
def test_ridge_on_few_rows(spark, n):
    rows = [(dt.date(2020, 1, 1 + i), float(i), float(i % 2)) for i in range(n)]
    df = spark.createDataFrame(rows, "date date, x double, target double")
    assert feedback.ridge_ic(df, ["x"]).collect()[0]["ic"] == 0.0


@pytest.mark.parametrize("direction", ["forward", "backward"])
@pytest.mark.parametrize("chunk", [None, "month"])
def test_asof_ties_go_to_the_greatest(spark, direction, chunk):
    left = spark.createDataFrame([("a", dt.date(2020, 1, 5 if direction == "forward" else 15))], "k string, ts date")
    right = spark.createDataFrame([("a", dt.date(2020, 1, 10), v) for v in (10, 20, 15)], "k string, ts date, v int")
    assert joins.asof_join(left, right, ["k"], "ts", direction=direction, chunk=chunk).collect()[0]["v"] == 20


def test_daily_files_with_their_own_headers(spark, tmp_path):
    for ticker, text in {
        "AAA": "Date,Open,High,Low,Close,Adj Close,Volume\n2020-01-03,1,2,0.5,1.5,1.4,100\n2020-01-02,1,2,0.5,1.1,,50\n",
        "BRK.B": "volume, close ,low,high,open,date\n7,3,2,4,2.5,2020-01-02\nx,3,2,4,2.5,not a date\n",
        "EMPTY": "",
    }.items():
        (tmp_path / ticker).mkdir()
        (tmp_path / ticker / "price_history.csv").write_text(text)
    got = {(r["ticker"], str(r["date"])): (r["close"], r["volume"], r["open"]) for r in bars.read_daily_bars(spark, str(tmp_path)).collect()}
    assert got == {("AAA", "2020-01-03"): (1.4, 100.0, 1.0), ("AAA", "2020-01-02"): (1.1, 50.0, 1.0), ("BRK.B", "2020-01-02"): (3.0, 7.0, 2.5)}


def test_minute_files_name_their_ticker(spark, tmp_path):
    for ticker in ("AAA", "BRK.B"):
        pd.DataFrame({"timestamp": pd.to_datetime(["2020-01-02 14:30", "2020-01-02 14:31"]).astype("datetime64[us]"), "close": [1.0, 2.0]}).to_parquet(tmp_path / f"{ticker}.parquet")
    got = sorted((r["ticker"], r["close"]) for r in bars.read_minute_bars(spark, str(tmp_path)).collect())
    assert got == [("AAA", 1.0), ("AAA", 2.0), ("BRK.B", 1.0), ("BRK.B", 2.0)]


def test_work_folder_needs_a_setting_on_a_cluster(spark):
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        work_dir(Session())
    assert work_dir(spark)


def test_entities_and_tags(spark):
    from tapeloom.sources import feeds

    df = spark.createDataFrame([("a &amp;lt; b &#8217; &mdash; caf&eacute; &#x41;&nbsp;&unknown; &; & &#0; 5 &lt; 6",), (None,), ("plain",)], "t string")
    got = [r["x"] for r in df.select(feeds.decode_entities("t").alias("x")).collect()]
    assert got == ["a &lt; b \u2019 \u2014 caf\u00e9 A &unknown; &; & &#0; 5 < 6", None, "plain"]


def test_feed_items_are_parsed_and_stripped_once(spark):
    from tapeloom.sources import feeds

    long = "x" * 60
    rows = [(1, '{"link": "u", "content": {"description": "<p>a &amp; b</p>", "summary": "%s"}}' % long), (2, '{"link": "u", "content": {"description": "short"}}'),
            (3, '{"content": {"description": "%s"}}' % (long * 2)), (4, '{"link": "u", "content": {"description": "<b>%s</b> &#38; &apos;"}}' % (long * 2)), (5, None), (6, "broken")]
    out = feeds.normalize_feed(spark.createDataFrame(rows, "id int, item string"))
    assert sorted((r["id"], r["body"]) for r in out.collect()) == [(1, long), (4, long * 2 + "& '")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1 and plan.count("transform(") == 2


def test_publisher_page_keeps_short_paragraphs(spark):
    from tapeloom.sources import feeds

    html = "<p>Menu</p><article><p>Short.</p><p>It&rsquo;s <b>long</b>er.</p></article><p>" + "x" * 120 + "</p>"
    df = spark.createDataFrame([("https://finance.yahoo.com/a", html), ("https://example.org/a", html)], "url string, html string")
    assert [r["article"] for r in feeds.extract_article_text(df).collect()] == ["Short. It\u2019slonger.", "x" * 120]


def test_journal_keeps_lines_of_odd_types(spark, tmp_path):
    from tapeloom.sources import feeds

    (tmp_path / "j.jsonl").write_text('{"ticker": "A", "entry_price": "2.5", "regime_features": {"x": "1.5", "y": 2}}\n{"ticker": 7, "entry_price": "n/a"}\nbroken {\n\n[1]\n')
    got = sorted((r["ticker"], r["entry_price"], r["regime_features"]) for r in feeds.read_journal(spark, str(tmp_path)).collect())
    assert got == [("7", None, None), ("A", 2.5, {"x": 1.5, "y": 2.0})]


def test_growth_from_a_close_of_zero(spark):
    closes = [2.0, 0.0, 3.0, 0.0, 0.0]
    rows = [("A", dt.datetime(2024, 1, 1, 0, i), c) for i, c in enumerate(closes)]
    df = spark.createDataFrame(rows, "ticker string, ts timestamp, close double").withColumns({c: F.col("close") for c in ("high", "low", "volume")})
    got = [r["return_1m"] for r in minute.minute_base(df).orderBy("ts").collect()]
    assert got[:4] == [0.0, -1.0, float("inf"), -1.0] and math.isnan(got[4])


def test_rounding_goes_by_the_product(spark):
    # 32.89 / 6.4 - 1 is written 4.1390625, but a millionth of it is below the half
    df = spark.createDataFrame([(32.89 / 6.4 - 1, 0.5), (-2.5, 0.0), (float("inf"), 0.0), (1e300, 0.0)], "x double, y double")
    assert [r["x"] for r in core.rounded(df).collect()] == [4.139062, -2.5, float("inf"), 1e300]
    assert [r[0] for r in df.select(core.half_away("x", 0)).collect()][:2] == [4.0, -3.0]
    assert df.limit(1).select(core.half_away("y", 0)).collect()[0][0] == 1.0


def test_a_hole_ends_the_deviation_of_a_target(spark):
    # no return from a close of 0: the recursion of the deviation has nothing to go on from, and targets are raw from there
    closes = [10.0, 11.0, 10.5, 11.5, 0.0, 10.0, 10.2, 10.1, 10.4]
    df = spark.createDataFrame([("A", i, c) for i, c in enumerate(closes)], "ticker string, ts int, close double")
    got = targets.ewma_target(df, span=3, order="ts").orderBy("ts").collect()
    assert got[3]["target"] != got[3]["raw_target"] and got[4]["target"] is None
    assert [r["target"] for r in got[6:8]] == [r["raw_target"] for r in got[6:8]] and got[6]["raw_target"] is not None
    late = targets.ewma_target(df.where("ts >= 4"), span=3, order="ts").orderBy("ts").collect()
    assert [r["target"] for r in late] == [r["raw_target"] for r in late]
