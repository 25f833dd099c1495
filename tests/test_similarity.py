import numpy as np

from tapeloom.operators.similarity import similarity_edges

SCHEMA = "batch string, vec_id bigint, embedding array<float>"


def edges(spark, rows, *args, parts=4, **options):
    found = similarity_edges(spark.createDataFrame(rows, SCHEMA).repartition(parts), *args, **options).collect()
    assert len({(r["batch"], r["src"], r["dst"]) for r in found}) == len(found)
    return found


def test_a_large_group_is_searched_with_the_wanted_recall(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(2500, 48))
    x = (np.repeat(centres, 4, 0) + rng.normal(size=(10_000, 48)) * 0.55).astype(np.float32)
    got = {(r["src"], r["dst"]) for r in edges(spark, [("g", i, v.tolist()) for i, v in enumerate(x)], 0.7, recall=0.95)}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    want = set()
    for start in range(0, len(u), 1000):
        a, b = np.nonzero(u[start : start + 1000] @ u.T > 0.7)
        want |= {(int(i) + start, int(j)) for i, j in zip(a, b) if i + start != j}
    assert got <= want and len(want) > 10_000 and len(got) >= 0.95 * len(want)


def test_copies_rings_and_odd_rows(spark):
    one, other = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [("a", i, one) for i in range(3000)] + [("a", 5000, [0.9, 0.1, 0.0])]  # as many copies as one likes: an edge each
    rows += [("ring", 1, one), ("ring", 3, other), ("ring", 2, [0.0, 0.0, 1.0]), ("single", 9, one), (None, 4, one), (None, 6, one)]
    rows += [("a", None, one), ("a", 7000, None), ("zero", 1, [0.0, 0.0, 0.0]), ("zero", 2, one)]
    found = {(r["batch"], r["src"], r["dst"], r["kind"]) for r in edges(spark, rows, 0.5)}
    want = {("a", i, 0, "copy") for i in range(1, 3000)} | {("a", 0, 5000, "similar"), ("a", 5000, 0, "similar"), (None, 6, 4, "copy")}
    want |= {("ring", 1, 2, "ring"), ("ring", 2, 3, "ring"), ("ring", 3, 1, "ring"), ("single", 9, 9, "ring"), ("zero", 1, 2, "ring"), ("zero", 2, 1, "ring")}
    assert found == want
    assert similarity_edges(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_hot_bucket_is_banded_again(spark):
    rng = np.random.default_rng(8)
    tight = np.ones(32) * 3 + rng.normal(size=(700, 32))  # one cone: far more than a bucket should hold, all pairs alike
    rows = [("g", i, v.tolist()) for i, v in enumerate(np.concatenate([tight, rng.normal(size=(800, 32))]).astype(np.float32))]
    x = np.array([r[2] for r in rows])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    a, b = np.nonzero(u @ u.T > 0.95)
    want = {(int(i), int(j)) for i, j in zip(a, b) if i != j}
    got = {(r["src"], r["dst"]) for r in edges(spark, rows, 0.95)}
    assert got <= want and len(want) > 500 and len(got) >= 0.9 * len(want)


def test_a_recall_of_one_loses_no_pair(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2600, 16)).astype(np.float32)
    names = ["g"] * 1500 + [None] * 1100
    got = {(r["batch"], r["src"], r["dst"]) for r in edges(spark, [(b, i, v.tolist()) for i, (b, v) in enumerate(zip(names, x))], 0.3, recall=1.0)}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    want = set()
    for name, lo, hi in (("g", 0, 1500), (None, 1500, 2600)):
        a, b = np.nonzero(u[lo:hi] @ u[lo:hi].T > 0.3)
        want |= {(name, int(i) + lo, int(j) + lo) for i, j in zip(a, b) if i != j}
    assert got == want and len(want) > 100_000
