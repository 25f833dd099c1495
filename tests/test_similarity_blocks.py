from pathlib import Path

import numpy as np

from tapeloom.operators import similarity

SCHEMA = "batch string, vec_id bigint, embedding array<float>"


def shuffled(spark) -> dict[str, int]:
    """Bytes of the shuffle files that lie on disk."""
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {str(f): f.stat().st_size for folder in folders for f in Path(folder).rglob("shuffle_*.data")}


def test_all_pairs_shuffle_vectors_and_write_no_edges(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 32)
    written, write = [], similarity.materialize
    monkeypatch.setattr(similarity, "materialize", lambda df: written.append(write(df)) or written[-1])
    x = np.random.default_rng(4).normal(size=(2000, 32)).astype(np.float32)
    vectors = spark.createDataFrame([("g", i, v.tolist()) for i, v in enumerate(x)], SCHEMA)
    before = shuffled(spark)
    found = {(r["src"], r["dst"]) for r in similarity.similarity_edges(vectors, 0.3, recall=1.0).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    a, b = np.nonzero(u @ u.T > 0.3)
    assert found == {(int(i), int(j)) for i, j in zip(a, b) if i != j} and len(found) > 100_000
    assert sum(n for f, n in shuffled(spark).items() if f not in before) < 8e6  # as often as there are blocks: over 30e6
    assert max(df.count() for df in written) <= 2000


def test_a_pair_of_two_blocks_keeps_its_batch_from_being_a_ring(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 2)
    axes = np.eye(16, dtype=np.float32)
    rows = [(name, i, axes[i].tolist()) for name in ("pair", None, "ring") for i in range(8)]
    rows += [("pair", 9, (axes[0] + axes[1] * 0.1).tolist()), (None, 9, (axes[5] + axes[6] * 0.1).tolist()), ("one", 3, axes[0].tolist())]
    found = similarity.similarity_edges(spark.createDataFrame(rows, SCHEMA), 0.5, recall=1.0).collect()
    want = {("pair", 0, 9, "similar"), ("pair", 9, 0, "similar"), (None, 5, 9, "similar"), (None, 9, 5, "similar"), ("one", 3, 3, "ring")}
    want |= {("ring", i, (i + 1) % 8, "ring") for i in range(8)}
    assert {(r["batch"], r["src"], r["dst"], r["kind"]) for r in found} == want and len(found) == len(want)
