"""Headline queries, timed one after the other; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the
data and the cores.  Every query is computed in full into Spark's no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "S14_build_bars", "A5_ema", "D9_adx", "D20_daily_features", "D21_rolling_zscore", "T4_ewma_target", "T6_sequences", "J1_asof_join",
    "N2_news_daily", "N9_align_news_to_bars", "R4_regime_extended", "R9_macro_features", "R11_fundamental_features", "A2_rank_ic",
    "A9_calibration", "B11_performance_summary", "B13_long_short", "B26_fill_outcomes", "X2_stream_ohlcv",
]


def main() -> None:
    from tapeloom.plans import QUERIES
    from tapeloom.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    QUERIES["S9_collection_status"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the engine
    took = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    spark.stop()
    sf = sf_dir.rstrip("/").rsplit("/sf", 1)[-1]
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
