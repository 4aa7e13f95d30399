import numpy as np
from pyspark.sql import functions as F

from lodesift.llm import ann


def _exact(ids, v, k):
    out = {}
    for i, q in zip(ids, v, strict=True):
        if i % 20 == 0:
            score = v.astype(np.float64) @ q.astype(np.float64)
            order = sorted((-s, j) for s, j in zip(score, ids, strict=True) if j != i)[:k]
            out[i] = [j for _, j in order]
    return out


def test_recall_against_brute_force(spark, sf):
    table = spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/embeddings.parquet")
    rows = [(r.vec_id, np.array(r.embedding)) for r in table.collect() if r.embedding is not None]
    want = _exact([i for i, _ in rows], np.array([v for _, v in rows]), 20)
    got = {}
    for r in ann.search(table, "vec_id % 20 = 0").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got.keys() == want.keys()
    assert np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) >= 0.9


def _graph_recall(v):
    """Shares of the 20 largest products that beams find, for each of some vectors."""
    graph = ann.build(v.astype(np.float32))
    q = v[::20]
    hits = graph.products(q, graph.beam(20))
    exact = np.argsort(-(q @ v.T), axis=1)[:, :20]
    return np.array([len(set(a) & set(b)) / 20 for a, b in zip(exact.tolist(), hits.tolist(), strict=True)])


def test_graph_recall_without_clusters():
    found = _graph_recall(np.random.default_rng(1).normal(size=(4000, 64)))
    assert found.mean() >= 0.9
    assert found.min() >= 0.5


def test_graph_recall_of_clusters_and_lengths():
    rng = np.random.default_rng(7)
    v = rng.normal(size=(200, 64))[rng.integers(0, 200, 12_000)] + 0.5 * rng.normal(size=(12_000, 64))
    for of in (v, v / np.linalg.norm(v, axis=1)[:, None], v * rng.lognormal(0, 1, len(v))[:, None]):
        found = _graph_recall(of)
        assert found.mean() >= 0.9
        assert np.mean(found < 0.5) <= 0.02


def test_recall_of_graphs_larger_than_beams(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 24))[rng.integers(0, 60, 8000)] + 0.4 * rng.normal(size=(8000, 24))
    ids = list(range(len(v)))
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").withColumn("shard", F.lit(1)).withColumn("dim", F.lit("x"))
    want = _exact(ids, v, 20)
    got = {}
    for r in ann.search(table, "vec_id % 20 = 0").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got.keys() == want.keys()
    assert np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) >= 0.9


def test_odd_vectors_take_no_part(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [None, 1.0]), (7, [1.0]), (0, [1.0, 0.0]), (20, [0.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in ann.search(table, "vec_id % 20 = 0").orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 2.0), (0, 2, 2, 2.0), (0, 3, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 1, 0.0), (20, 3, 2, 0.0)]
    assert ann.search(table.limit(0), "vec_id % 20 = 0").count() == 0
