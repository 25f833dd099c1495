import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.functions import ranks
from tapeloom.operators import joins as J


def skewed(n=3000):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, n)
    x[: n // 3] = 0.25  # one value holds a third of all rows
    return pd.DataFrame({"g": rng.integers(0, 3, n), "x": x, "y": np.round(x + rng.normal(0, 1, n), 1)})


def test_exact_quantiles_with_a_hot_value(spark):
    pdf = skewed()
    probs = [0.0, 0.01, 0.333, 0.5, 0.9, 1.0]
    df = spark.createDataFrame(pdf)
    got = ranks.exact_quantiles(df, "x", probs).first()["quantiles"]
    np.testing.assert_allclose(got, np.quantile(pdf["x"], probs), atol=1e-12)
    per = ranks.exact_quantiles(df, "x", probs, ("g",), buckets=4).toPandas()
    for g, q in zip(per["g"], per["quantiles"]):
        np.testing.assert_allclose(q, np.quantile(pdf.loc[pdf["g"] == g, "x"], probs), atol=1e-12)


def test_spearman_average_ranks(spark):
    pdf = skewed()
    got = ranks.spearman(spark.createDataFrame(pdf), "x", "y", ("g",)).toPandas().set_index("g")["rank_ic"]
    for g, part in pdf.groupby("g"):
        assert abs(got[g] - np.corrcoef(part["x"].rank(), part["y"].rank())[0, 1]) < 1e-12


def test_spearman_cuts_large_groups_and_joins_no_row_back(spark, monkeypatch):
    monkeypatch.setattr(ranks, "BUCKET_ROWS", 100, raising=False)
    pdf = pd.concat([skewed(), pd.DataFrame({"g": 9, "x": [0.0, -0.0, 1.0], "y": [1.0, 2.0, 3.0]})])
    for by in (("g",), ()):
        df = ranks.spearman(spark.createDataFrame(pdf), "x", "y", by)
        got = {r["g"] if by else None: r["rank_ic"] for r in df.collect()}
        for g, part in pdf.groupby("g") if by else [(None, pdf)]:
            assert abs(got[g] - np.corrcoef(part["x"].rank(), part["y"].rank())[0, 1]) < 1e-12
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_spearman_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert ranks.spearman(df, "x", "y").first()["rank_ic"] is None


def test_hash_rank_is_a_permutation(spark):
    out = ranks.hash_rank(spark.range(500).select(F.col("id").cast("string").alias("k")), "k", 7).toPandas()
    assert sorted(out["rank"]) == list(range(500)) and (out["total"] == 500).all()


@pytest.mark.parametrize("chunk", [None, "day", "hour"])
@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_asof_matches_merge_asof(spark, chunk, strict, direction):
    rng = np.random.default_rng(5)
    t0 = pd.Timestamp("2024-01-01")
    left = pd.DataFrame({"k": rng.choice(["a", "a", "b"], 300), "ts": t0 + pd.to_timedelta(rng.integers(0, 200, 300) * 30, "min"), "i": range(300)})
    right = pd.DataFrame({"k": rng.choice(["a", "b"], 60), "ts": t0 + pd.to_timedelta(rng.integers(0, 200, 60) * 30, "min"), "v": range(60)}).drop_duplicates(["k", "ts"])
    out = J.asof_join(spark.createDataFrame(left), spark.createDataFrame(right), ["k"], "ts", strict, direction, chunk).toPandas().sort_values("i")
    want = pd.merge_asof(left.sort_values("ts"), right.sort_values("ts"), on="ts", by="k", allow_exact_matches=not strict, direction=direction).sort_values("i")
    np.testing.assert_array_equal(out["v"].fillna(-1).to_numpy(), want["v"].fillna(-1).to_numpy())


def test_lookback_join_bounds(spark):
    left = spark.createDataFrame([("a", "2024-01-01 00:10:00")], "k string, t string").select("k", F.to_timestamp("t").alias("ts"))
    times = ["2024-01-01 00:00:00", "2023-12-31 23:59:59", "2024-01-01 00:09:59", "2024-01-01 00:10:00"]
    right = spark.createDataFrame([("a", t) for t in times], "k string, t string").select("k", F.to_timestamp("t").alias("ts"), "t")
    got = {r["t"] for r in J.lookback_join(left, right, ["k"], "ts", 600).collect()}
    assert got == {"2024-01-01 00:00:00", "2024-01-01 00:09:59"}


@pytest.mark.parametrize("seconds", [0, 1, 600])
def test_lookback_join_matches_pairs(spark, monkeypatch, seconds):
    monkeypatch.setattr(J, "BLOCK_ROWS", 3)
    rng = np.random.default_rng(7)
    side = lambda n, name: pd.DataFrame({"k": rng.choice(["a", "b", None], n), "x": rng.integers(-1500, 1500, n) / 2, name: range(n)})
    left, right = side(200, "i"), side(150, "j")
    dated = lambda df: spark.createDataFrame(df, ", ".join(f"{c} {t}" for c, t in zip(df.columns, ("string", "double", "long")))).withColumn("ts", F.timestamp_seconds("x"))
    out = J.lookback_join(dated(left), dated(right), ["k"], "ts", seconds)
    assert out.columns == ["k", "x", "i", "ts", "right_ts", "x", "j"]
    met = left.dropna().merge(right.dropna(), on="k")
    met = met[(met.x_y >= met.x_x - seconds) & (met.x_y < met.x_x)]
    assert sorted((r["i"], r["j"]) for r in out.select("i", "j").collect()) == sorted(zip(met.i, met.j))


def test_lookback_join_pairs_stay_in_blocks(spark):
    # few partitions, sized by the small inputs, did the work of all pairs
    df = spark.range(2000).select(F.lit("a").alias("k"), F.timestamp_seconds(F.col("id") % 50).alias("ts"), "id")
    out = J.lookback_join(df, df.withColumnRenamed("id", "other"), ["k"], "ts", 40)
    out.write.format("noop").mode("overwrite").save()
    plan = out._jdf.queryExecution().toString()
    assert "Generate explode(__block" in plan and "REPARTITION_BY_NUM" in plan


def test_nth_bar_after(spark):
    bars = spark.createDataFrame([("A", f"2024-01-{d:02d}", float(d)) for d in (2, 3, 5, 8)], "ticker string, d string, close double").select("ticker", F.to_date("d").alias("date"), "close")
    ev = spark.createDataFrame([("A", "2024-01-04"), ("A", "2024-01-08"), ("A", "2024-01-09")], "ticker string, d string").select("ticker", F.to_date("d").alias("date"))
    got = {str(r["date"]): (r["entry_price"], r["exit_price"]) for r in J.nth_bar_after(ev, bars, 1).collect()}
    assert got == {"2024-01-04": (5.0, 8.0), "2024-01-08": (8.0, None), "2024-01-09": (None, None)}


def test_forward_asof_is_one_pass(spark):
    # a frame from the current row to the last costs the square of a chunk's rows
    left = spark.createDataFrame([("a", 1.0)], "k string, x double").select("k", F.timestamp_seconds("x").alias("ts"), "x")
    right = left.withColumnRenamed("x", "v")
    plan = J.asof_join(left, right, ["k"], "ts", direction="forward", chunk="day")._jdf.queryExecution().toString().lower()
    assert "windowspec" in plan and "unboundedfollowing" not in plan
