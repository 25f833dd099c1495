import datetime as dt
import os

import pytest

from tapeloom.sources.bars import write_features

SCHEMA = "ticker string, date date, x double"


def rows(*tickers, year=2020, n=5, x=1.0):
    return [(t, dt.date(year, 1, 1 + i), x + i) for t in tickers for i in range(n)]


def files(path):
    return {f: os.stat(os.path.join(d, f)).st_mtime_ns for top in (path, path + ".fingerprints") for d, _, names in os.walk(top) for f in names}


def test_other_tickers_of_a_year_stay(spark, tmp_path):
    path = str(tmp_path / "features")
    table = lambda: sorted((r["ticker"], r["date"], r["x"]) for r in spark.read.parquet(path).collect())
    write = lambda data, **k: write_features(spark.createDataFrame(data, SCHEMA), path, **k)
    first = rows("A", "B", "C", "D") + rows("A", "B", year=2021)
    assert write(first, buckets=2) > 0 and table() == sorted(first)
    before = files(path)
    assert write(first) == 0 and files(path) == before  # nothing changed, nothing written
    assert write(list(reversed(rows("B")))) == 0 and files(path) == before  # a part, in another order
    assert write([]) == 0 and files(path) == before
    again = rows("A", n=3, x=9.0)
    assert write(again, buckets=5) == 1  # the number of buckets holds from the first write on
    want = sorted(again + rows("B", "C", "D") + rows("A", "B", year=2021))
    assert table() == want and write(again) == 0
    assert write(rows("E", year=2022) + rows("E", year=2022)) == 1  # equal rows are kept as often as they come
    assert table() == sorted(want + 2 * rows("E", year=2022))
    with pytest.raises(Exception, match="ticker and a date"):
        write([(None, dt.date(2020, 1, 1), 1.0)])


def test_a_run_that_failed_before_the_fingerprints_is_repeated(spark, tmp_path, monkeypatch):
    from tapeloom.sources import bars

    path = str(tmp_path / "features")
    write_features(spark.createDataFrame(rows("A", "B"), SCHEMA), path, buckets=1)
    new = spark.createDataFrame(rows("A", x=5.0), SCHEMA)
    real, calls = bars.materialize, []

    def fail(df):
        calls.append(1)
        if len(calls) == 4:  # the rows are written, the fingerprints are next
            raise RuntimeError("lost")
        return real(df)

    monkeypatch.setattr(bars, "materialize", fail)
    with pytest.raises(RuntimeError):
        write_features(new, path)
    monkeypatch.undo()
    assert write_features(new, path) == 1 and write_features(new, path) == 0
    assert sorted((r["ticker"], r["date"], r["x"]) for r in spark.read.parquet(path).collect()) == sorted(rows("A", x=5.0) + rows("B"))
