import os
import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parents[1]

JOB = """
import sys
sys.path.insert(0, sys.argv[1])
import __spark_entry__ as entry
from tapeloom.session import local_session, ship

spark = local_session(2, partitions=2, memory="2g")
ship(spark)
ship(spark)  # a second call sends nothing

def run(parts):
    import tapeloom.functions.core as core
    for b in parts:
        yield b

n = spark.range(10).mapInPandas(run, "id bigint").count()
r14 = entry.queries()["R14_similarity_edges"](spark, "/root/testdata/sf0.001").count()
print("rows", n, r14 > 0, len([f for f in spark.sparkContext.listFiles if f.endswith("-sources.zip")]))
"""


def test_a_job_started_in_another_folder_reaches_the_workers(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", JOB, str(ROOT)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 10 True 1" in done.stdout, done.stderr[-2000:]


def test_center_names_follow_the_rule(spark):
    from tapeloom.operators import regime as R

    cells = [(i, r, v, s) for i, (r, v, s) in enumerate((r, v, s) for r in (-1.5, -0.7, 0.0, 0.7) for v in (0.2, 0.4, 0.7, 1.5) for s in (0.2, 0.4, 0.7))]
    centers = spark.createDataFrame(cells, "cluster int, regime_spy_ret5 double, regime_vix_level double, regime_spy_vol20 double")

    def base(r, v, s):
        if r < -1 and v > 1:
            return "crisis"
        if r < -0.5:
            return "bear_high_vol" if v > 0.5 or s > 0.5 else "bear_low_vol"
        if r > 0.5:
            return "bull_high_vol" if v > 0.3 or s > 0.3 else "bull_low_vol"
        return "choppy"

    seen, want = {}, {}
    for i, r, v, s in cells:
        name = base(r, v, s)
        k = seen[name] = seen.get(name, -1) + 1
        want[i] = name if k == 0 else f"{name}_{k}"
    assert {r.cluster: r.label for r in R.name_clusters(centers).collect()} == want


def test_centers_of_a_fit_get_distinct_names(spark):
    import __spark_entry__ as entry

    rows = entry.queries()["R7_center_names"](spark, "/root/testdata/sf0.001").collect()
    assert rows and len({r.label for r in rows}) == len(rows)
    dates = entry.queries()["R6_fit_regime_clusters"](spark, "/root/testdata/sf0.001")
    assert sum(r.n_dates for r in rows) == dates.count()


def test_uneven_attribution_moves_the_bias(spark):
    from tapeloom.operators import feedback as L

    m = spark.createDataFrame([(0, x, 0.1) for x in "abc"], "fold int, model string, ic double")
    att = spark.createDataFrame([(0, "a", 1.0), (0, "b", 2.0), (0, "c", 3.0)], "fold int, model string, attribution double")
    got = {r.model: r.bias for r in L.attention_bias(m, att).collect()}
    z = 1 / (2 / 3) ** 0.5
    assert abs(got["a"] + 0.5 * 0.3 * z) < 1e-9 and abs(got["b"]) < 1e-9 and abs(got["c"] - 0.5 * 0.3 * z) < 1e-9
    even = {r.bias for r in L.attention_bias(m, att.withColumn("attribution", F.lit(0.25))).collect()}
    assert even == {0.0}
