"""Ridge fits from shared covariances, ratios by ticker and column, short series, percent surprises."""

import datetime as dt

import numpy as np
import pytest

from tapeloom.operators import feedback, fundamentals, portfolio, regime


def _ridge(x, y, train, ridge):
    a, b = x[train], x[~train]
    m, s = a.mean(0), a.std(0) + 1e-6
    w = np.linalg.solve(((a - m) / s).T @ ((a - m) / s) + ridge * np.eye(x.shape[1]), ((a - m) / s).T @ y[train])
    return np.corrcoef(((b - m) / s) @ w, y[~train])[0, 1]


def test_ablation_equals_separate_fits(spark):
    r = np.random.default_rng(3)
    n = 600
    x = r.normal(size=(n, 4)) * [1, 50, 0.01, 3] + [0, 1000, 0, 2]
    y = x[:, 0] * 0.2 + x[:, 2] * 30 + r.normal(size=n)
    day = [dt.date(2024, 1, 1) + dt.timedelta(days=i // 6) for i in range(n)]
    rows = [(d, *map(float, v), float(t)) for d, v, t in zip(day, x, y)] + [(day[0], None, 1.0, 1.0, 1.0, 1.0), (day[5], float("nan"), 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "date date, a double, b double, c double, d double, target double")
    train = np.arange(n) < 480
    got = {q["name"]: q for q in feedback.ablate(df, ["a", "b"], ["c", "d"], ridge=2.0).collect()}
    assert got["c"]["baseline_ic"] == pytest.approx(_ridge(x[:, [0, 1]], y, train, 2.0), abs=1e-9)
    assert got["c"]["ic"] == pytest.approx(_ridge(x[:, [0, 1, 2]], y, train, 2.0), abs=1e-9) and got["c"]["status"] == "promoted"
    assert got["d"]["ic"] == pytest.approx(_ridge(x[:, [0, 1, 3]], y, train, 2.0), abs=1e-9)
    one = feedback.ridge_ic(df, ["a", "b", "c"], ridge=2.0).collect()[0]
    assert one["ic"] == pytest.approx(got["c"]["ic"]) and (one["n_train"], one["n_valid"]) == (480, 120)
    assert [q["ic"] for q in feedback.ablate(df.limit(0), ["a"], ["c"]).collect()] == [0.0]
    # a copy of a column makes the matrix singular without a penalty
    twin = df.withColumn("e", df["a"])
    assert feedback.ridge_ic(twin, ["a", "e"], ridge=0.0).collect()[0]["ic"] == pytest.approx(_ridge(x[:, [0]], y, train, 0.0), abs=1e-6)


def test_snapshot_fills_by_ticker_and_column(spark):
    d = dt.date(2024, 1, 2)
    bars = spark.createDataFrame([(t, d) for t in "ABC"], "ticker string, date date")
    ratios = spark.createDataFrame([("A", d, 0.5, 0.1), ("A", dt.date(2023, 1, 1), 0.4, 0.1), ("B", d, 0.5, None), ("B", dt.date(2023, 1, 1), 0.4, None), ("C", d, 0.5, 0.1)], "ticker string, report_date date, roe double, roa double")
    snap = spark.createDataFrame([(t, 0.9, 0.8, 12.0, 0.02) for t in "ABC"], "ticker string, roe double, roa double, trailing_pe double, dividend_yield double")
    out = {r["ticker"]: r for r in fundamentals.fundamental_features(bars, ratios, snap).collect()}
    assert [(out[t]["fund_roe"], out[t]["fund_roa"]) for t in "ABC"] == [(0.5, 0.1), (0.5, 0.8), (0.9, 0.8)]
    assert all(out[t]["fund_trailing_pe"] == 12.0 and out[t]["fund_dividend_yield"] == 0.02 and out[t]["fund_peg_ratio"] == 0.0 for t in "ABC")
    assert len(fundamentals.RATIOS) == 14 and [c for c in fundamentals.fundamental_features(bars, ratios).columns if c.startswith("fund_")] == [f"fund_{n}" for n in fundamentals.RATIOS]


def test_ready_made_surprise(spark):
    e = spark.createDataFrame([("A", 12.5), ("B", None)], "ticker string, surprise_pct double")
    assert [tuple(r) for r in fundamentals.earnings_surprise(e).collect()] == [("A", 0.125)]


def test_short_series_are_not_annualised(spark):
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=i), f"T{k}", float(k), 0.01 * k + 0.001 * i * k) for i in range(6) for k in range(8)]
    df = spark.createDataFrame(rows, "date date, ticker string, pred double, target double")
    full = portfolio.long_short(df, 2).collect()[0]
    assert full["n_days"] == 6 and full["sharpe"] > 0 and full["ann_return"] is not None
    few = portfolio.long_short(df, 2, least_days=7).collect()[0]
    assert (few["n_days"], few["sharpe"], few["total_return"], few["ann_return"]) == (6, 0.0, 0.0, None)
    assert portfolio.long_only(df, 2).collect()[0]["sharpe"] == 0.0 and portfolio.long_only(df, 2, least_days=6).collect()[0]["sharpe"] > 0


def test_cluster_check_sees_a_wrong_model(spark):
    r = np.random.default_rng(1)
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=i), *map(float, r.normal(size=2) + 8 * (i % 3))) for i in range(90)]
    df = spark.createDataFrame(rows, "date date, u double, v double")
    model, labels = regime.fit_regime_clusters(df, 3, cols=("u", "v"))
    good = regime.cluster_check(df, model, ("u", "v")).collect()[0]
    assert (good["n_dates"], good["n_clusters"], good["n_off_nearest"]) == (90, 3, 0) and good["center_gap"] < 0.01
    moved = df.withColumn("u", df["u"] + 3)
    assert regime.cluster_check(moved, model, ("u", "v")).collect()[0]["center_gap"] > 0.1
