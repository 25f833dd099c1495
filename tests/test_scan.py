import numpy as np
import pandas as pd
import pytest

from tapeloom.functions import scan
from tapeloom.functions.core import pct_change, series
from tapeloom.operators import daily as D


def by_ticker(df, *cols):
    return df.select("ticker", "date", *cols).toPandas().sort_values(["ticker", "date"]).reset_index(drop=True)


def expect(pdf, fn):
    pdf = pdf.sort_values(["ticker", "date"])
    return pd.concat([fn(g) for _, g in pdf.groupby("ticker")]).to_numpy()


@pytest.mark.parametrize("span,block", [(5, None), (26, None), (252, None), (12, 64 * 8)])
def test_ema_matches_pandas(walk, span, block):
    pdf, df = walk
    got = by_ticker(scan.ema(df, "close", "e", span=span, block=block), "e")["e"].to_numpy()
    want = expect(pdf, lambda g: g["close"].ewm(span=span, adjust=False).mean())
    np.testing.assert_allclose(got, want, rtol=1e-11)


def test_ema_crosses_blocks(spark):
    n = 5000
    x = np.random.default_rng(1).normal(0, 1, n)
    df = spark.createDataFrame(pd.DataFrame({"ticker": "A", "date": range(n), "x": x}))
    got = scan.ema(df, "x", "e", span=12).orderBy("date").toPandas()["e"]
    np.testing.assert_allclose(got, pd.Series(x).ewm(span=12, adjust=False).mean(), atol=1e-12)


def test_wilder_matches_recursion(walk):
    pdf, df = walk

    def naive(g):
        x = g["close"].to_numpy()
        out = np.full(len(x), np.nan)
        out[14] = x[1:15].mean()
        for i in range(15, len(x)):
            out[i] = (out[i - 1] * 13 + x[i]) / 14
        return pd.Series(out)

    got = by_ticker(scan.wilder(df, "close", "w", 14), "w")["w"].to_numpy(dtype=float)
    np.testing.assert_allclose(got, expect(pdf, naive), rtol=1e-11)


def test_ewm_std_skips_leading_null(walk):
    pdf, df = walk
    df = df.withColumn("r", pct_change("close", 1, series()))
    got = by_ticker(scan.ewm_std(df, "r", "s", 60), "s")["s"].to_numpy(dtype=float)
    want = expect(pdf, lambda g: g["close"].pct_change().ewm(span=60, adjust=False).std())
    np.testing.assert_allclose(got, want, rtol=1e-9)


def test_rolling_moments_and_shape(walk):
    pdf, df = walk
    df = df.withColumn("r", pct_change("close", 1, series()))
    out = by_ticker(scan.rolling_shape(scan.rolling_moments(df, {"r": [60]}), "r", 60, "sk", "ku"), "__m_r_60", "__d_r_60", "__k_r_60", "sk", "ku")
    roll = lambda g: g["close"].pct_change().rolling(60, min_periods=2)
    np.testing.assert_allclose(out["__d_r_60"].to_numpy(dtype=float), expect(pdf, lambda g: roll(g).std()), rtol=1e-8)
    n = 60
    skew = expect(pdf, lambda g: g["close"].pct_change().rolling(60).skew())
    kurt = expect(pdf, lambda g: g["close"].pct_change().rolling(60).kurt())
    got_s = out["sk"].to_numpy(dtype=float) * np.sqrt(n * (n - 1)) / (n - 2)
    got_k = (out["ku"].to_numpy(dtype=float) * (n + 1) + 6) * (n - 1) / ((n - 2) * (n - 3))
    np.testing.assert_allclose(got_s, skew, atol=1e-8)
    np.testing.assert_allclose(got_k, kurt, atol=1e-8)


@pytest.mark.parametrize("window", [20, 33, 252, 7800])
def test_rolling_moments_keep_their_digits(spark, window):
    """Values that fall by many orders leave nothing behind in later frames."""
    import pandas as pd

    rng = np.random.default_rng(0)
    x = np.concatenate([rng.uniform(100, 1000, 15000), 1e9 * rng.uniform(1, 2, 500), 50 + 1e-4 * rng.choice([-1.0, 1.0], 9000)])
    df = spark.createDataFrame(pd.DataFrame({"ticker": "A", "date": np.arange(len(x)), "x": x}))
    got = scan.rolling_moments(df, {"x": [window]}).orderBy("date").toPandas()
    for t in [*range(0, len(x), 997), *range(len(x) - 40, len(x))]:
        frame = x[max(0, t - window + 1) : t + 1]
        assert got[f"__k_x_{window}"][t] == len(frame)
        assert got[f"__m_x_{window}"][t] == pytest.approx(frame.mean(), rel=1e-12)
        if len(frame) > 1:
            assert got[f"__d_x_{window}"][t] == pytest.approx(np.std(frame, ddof=1), rel=1e-6)


def test_rolling_sums_long(walk):
    pdf, df = walk
    got = by_ticker(scan.rolling_sums_long(df, {"s": "volume"}, 37), "s")["s"].to_numpy()
    np.testing.assert_allclose(got, expect(pdf, lambda g: g["volume"].rolling(37, min_periods=1).sum()), rtol=1e-12)


@pytest.mark.parametrize("window,mode", [(20, "add"), (100, "clip")])
def test_zscore_matches_definition(walk, window, mode):
    pdf, df = walk

    def naive(g):
        s = g["volume"]
        least = max(2, window // 2)
        mu = s.rolling(window, min_periods=least).mean().fillna(s.mean())
        sd = s.rolling(window, min_periods=least).std().fillna(s.std())
        den = sd + 1e-10 if mode == "add" else sd.clip(lower=1e-8)
        return ((s - mu) / den).clip(-5, 5)

    got = by_ticker(D.rolling_zscore(df, ["volume"], window, eps_mode=mode), "volume")["volume"].to_numpy()
    np.testing.assert_allclose(got, expect(pdf, naive), atol=1e-9)


def test_zscore_without_warmup_does_not_look_ahead(walk):
    _, df = walk
    cut = df.where("date < date '2020-06-01'")
    full = D.rolling_zscore(df, ["volume"], 50, warmup="null").where("date < date '2020-06-01'")
    part = D.rolling_zscore(cut, ["volume"], 50, warmup="null")
    a, b = by_ticker(full, "volume")["volume"], by_ticker(part, "volume")["volume"]
    np.testing.assert_allclose(a.to_numpy(dtype=float), b.to_numpy(dtype=float), atol=1e-9)


def test_shared_passes_equal_single_operators(walk):
    _, df = walk
    names = ["adx", "di_diff", "rsi", "macd_norm", "macd_signal_norm", "macd_hist_norm"]
    together = by_ticker(D.recursive_features(df), *names)
    single = by_ticker(D.macd(D.rsi(D.adx(df))), *names)
    for c in names:
        np.testing.assert_allclose(together[c].to_numpy(dtype=float), single[c].to_numpy(dtype=float), atol=1e-10)


def edge(spark, closes):
    n = len(closes)
    return spark.createDataFrame(pd.DataFrame({
        "ticker": "A", "date": pd.bdate_range("2020-01-01", periods=n).date, "open": closes, "close": closes, "high": closes, "low": closes, "volume": 10.0,
    }))


def test_constant_price_gives_finite_features(spark):
    out = D.daily_features(edge(spark, [5.0] * 30)).toPandas()
    assert out[D.feature_names()].notna().all().all()
    assert (out["rsi"] == 0.5).all() and (out["realized_vol_20d"] == 0).all()


def test_monotone_price_uses_the_undefined_ratio(spark):
    up = D.rsi(edge(spark, [float(i + 1) for i in range(30)]), undefined_rs=0.0).orderBy("date").toPandas()
    assert (up["rsi"] == 0).all()


def test_series_shorter_than_every_window(spark):
    out = D.daily_features(edge(spark, [1.0, 2.0, 3.0, 2.0, 4.0])).toPandas()
    assert len(out) == 5 and out[D.feature_names()].notna().all().all()


def test_plan_of_full_set_has_one_series_exchange(walk):
    _, df = walk
    plan = D.daily_features(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_full_set_equals_its_groups_in_few_passes(walk, spark):
    _, df = walk
    full = D.daily_features(df)
    plan = full._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") <= 13
    got = full.toPandas().sort_values(["ticker", "date"]).reset_index(drop=True)
    for group, (_, names) in D.GROUPS.items():
        want = D.daily_features(df, groups=(group,)).toPandas().sort_values(["ticker", "date"]).reset_index(drop=True)
        assert np.allclose(got[names], want[names], rtol=1e-9, atol=1e-9), group


def test_full_set_bridges_missing_prices(spark):
    days = pd.date_range("2024-01-01", periods=260).date
    rows = [("A", d, *([None] * 5 if i % 37 == 5 else [10.0 + i % 7, 11.0 + i % 7, 9.0 + i % 5, 10.0 + i % 3, float(i % 4)])) for i, d in enumerate(days)]
    df = spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, volume double")
    got = D.daily_features(df).toPandas().sort_values("date").reset_index(drop=True)
    for group in ("returns", "volatility", "volume"):
        names = D.GROUPS[group][1]
        want = D.daily_features(df, groups=(group,)).toPandas().sort_values("date").reset_index(drop=True)
        assert np.allclose(got[names], want[names], rtol=1e-9, atol=1e-9), group


def test_settings_keep_tasks_small_and_code_compiled(spark):
    from tapeloom.session import configure

    configure(spark)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
    df = spark.range(4_000_000).selectExpr("id % 5000 AS ticker", "id AS date", "rand(1) AS close")
    parts = df.withColumn("r", pct_change("close", 1, series())).rdd.getNumPartitions()
    assert parts >= 12  # about 50 MB are shuffled


def test_half_away_equals_decimal_rounding(spark):
    from tapeloom.functions.core import half_away

    values = [0.5, -0.5, 1.5, 2.5, -2.5, 0.49999999999999994, -0.3, 0.0, 4503599627370497.5, 1.2345678901234567e20, -1e300, float("inf"), None]
    df = spark.createDataFrame([(v,) for v in values], "x double").select("x", half_away("x", 0).alias("y"))
    got = {r["x"]: r["y"] for r in df.collect()}
    assert got == {0.5: 1.0, -0.5: -1.0, 1.5: 2.0, 2.5: 3.0, -2.5: -3.0, 0.49999999999999994: 0.0, -0.3: 0.0, 0.0: 0.0, 4503599627370497.5: 4503599627370498.0,
                   1.2345678901234567e20: 1.2345678901234567e20, -1e300: -1e300, float("inf"): float("inf"), None: None}
    assert "round(" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_series_are_spread_by_bytes_not_by_a_fixed_number(spark):
    from tapeloom.session import configure

    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    configure(spark)
    usual = spark.conf.get(size)
    spark.conf.set(size, "1m")
    try:
        df = spark.range(1_500_000).selectExpr("id % 5000 AS ticker", "id AS date", "rand(1) AS close")
        parts = df.withColumn("r", pct_change("close", 1, series())).rdd.getNumPartitions()
    finally:
        spark.conf.set(size, usual)
    assert parts > int(spark.conf.get("spark.sql.shuffle.partitions"))
