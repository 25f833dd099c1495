from pathlib import Path

import numpy as np

from tapeloom.llm import jaccard_join


def shuffled(spark) -> dict[str, int]:
    """Bytes of the shuffle files that lie on disk."""
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {str(f): f.stat().st_size for folder in folders for f in Path(folder).rglob("shuffle_*.data")}


def group(spark, sets):
    """``left`` and ``sets`` of one signature whose members are components of their own; the first is the most central."""
    name = lambda k: k * 7919 - 40_000
    top = (1000, name(0), len(sets[0]), name(0))
    left = [(5, name(k), len(x), len(sets) - k, name(k), len(x), top) for k, x in enumerate(sets)]
    schema = "sig bigint, a bigint, n bigint, score bigint, c bigint, v bigint, top struct<score:bigint,a:bigint,n:bigint,c:bigint>"
    return spark.createDataFrame(left, schema), spark.createDataFrame([(name(k), x.tolist()) for k, x in enumerate(sets)], "a bigint, elements array<bigint>"), name


def test_alike_but_not_enough_costs_no_row_for_each_pair(spark, monkeypatch):
    rng = np.random.default_rng(2)
    core = rng.integers(-(2**63), 2**63 - 1, 200)
    sets = [np.concatenate([core[rng.random(200) < 0.9], rng.integers(-(2**63), 2**63 - 1, int(rng.integers(20, 60)))]) for _ in range(500)]
    for k in (40, 130, 131):  # these have a link that does not lead over the centre
        sets.append(np.concatenate([sets[k][5:], rng.integers(-(2**63), 2**63 - 1, 4)]))
    sets.append(rng.integers(-(2**63), 2**63 - 1, 3000))  # a size that no other comes near
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    size = np.array([len(x) for x in sets])
    held = np.zeros((len(sets), len(values)), np.float32)
    held[np.repeat(np.arange(len(sets)), size), at] = 1
    both = held @ held.T
    want = {(int(j), int(i)) for i, j in np.argwhere(both * 100 >= (size[:, None] + size - both) * 80) if j < i}
    assert want >= {(40, 500), (130, 501), (131, 502)} and len(want) < 2000
    left, table, name = group(spark, sets)
    before = shuffled(spark)
    for elements in (jaccard_join.BLOCK_ELEMENTS, 3000):  # one block, and many
        monkeypatch.setattr(jaccard_join, "BLOCK_ELEMENTS", elements)
        got = {frozenset(r) for r in jaccard_join._by_difference(left, table, 80).collect()}
        assert got == {frozenset((name(i), name(j))) for i, j in want}
        if elements > 3000:
            made = sum(n for f, n in shuffled(spark).items() if f not in before)
            assert made < 2e6, made
