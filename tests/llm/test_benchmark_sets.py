"""A benchmark of several gram sets gives what one set gives."""

import collections

import pytest

from tapeloom.llm import decontaminate


@pytest.fixture
def tables(spark):
    words = [f"w{i}" for i in range(400)]
    items = [(f"i{k}", " ".join(words[20 * k : 20 * k + 20])) for k in range(8)]
    texts = [" ".join(words[5:18] + ["x"] * n) + ". " + " ".join(words[25 + n % 3 : 39]) for n in (0, 40, 500)] + [items[3][1], "clean text, all of it", "", None]
    rows = [(k, t, f"s{k}", "c") for k, t in enumerate(texts)] + [(None, items[4][1], "n", "c"), (None, "clean", "n", "c"), (3, "clean too", "r", "c"), (3, items[3][1], "r", "c"), (3, items[3][1], "r", "c")]
    return spark.createDataFrame(rows, "doc_id long, text string, _row string, _key string"), spark.createDataFrame(items, "item_id string, text string")


def counted(df):
    return collections.Counter(str(r) for r in df.collect())


def test_more_sets_equal_one(tables, monkeypatch):
    docs, items = tables
    runs = {"hits": lambda: decontaminate.digest(decontaminate.hits(docs, items)), "documents": lambda: decontaminate.decontaminate(docs, items), "spans": lambda: decontaminate.decontaminate(docs, items, remove="spans")}
    one = {k: counted(f()) for k, f in runs.items()}
    monkeypatch.setattr(decontaminate, "MAX_WORDS", 60)
    assert decontaminate._slices(items)[1] > 1
    for k, f in runs.items():
        assert counted(f()) == one[k], k
