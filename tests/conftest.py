import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from tapeloom.session import local_session

    return local_session(4, partitions=4, memory="6g")


@pytest.fixture(scope="session")
def walk(spark):
    """Two tickers of random OHLCV bars, interleaved and unsorted."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(42)
    parts = []
    for name, n in (("AAA", 400), ("BBB", 150)):
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        open_ = close * np.exp(rng.normal(0, 0.01, n))
        parts.append(pd.DataFrame({
            "ticker": name, "date": pd.bdate_range("2020-01-01", periods=n).date, "open": open_, "close": close,
            "high": np.maximum(open_, close) * 1.01, "low": np.minimum(open_, close) * 0.99, "volume": rng.integers(1, 1000, n).astype(float),
        }))
    pdf = pd.concat(parts).sample(frac=1, random_state=1).reset_index(drop=True)
    return pdf, spark.createDataFrame(pdf)
