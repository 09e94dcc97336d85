import numpy as np
import pytest

from helixframe.llm import ann
from pyspark.sql import functions as F


def brute(rows, k=10):
    out = []
    ids = np.array([i for i, _ in rows])
    m = np.array([v for _, v in rows], dtype=float)
    for i, v in rows:
        if i % 100 == 0:
            d = np.sqrt(((m - np.array(v, dtype=float)) ** 2).sum(1))
            d[ids == i] = np.inf
            best = [j for j in np.lexsort((ids, d)) if np.isfinite(d[j])][:k]
            out += [(i, r, int(ids[j]), d[j]) for r, j in enumerate(best, 1)]
    return out


def recall(got, want):
    a = {(r.query_id, r.vec_id) for r in got}
    b = {(q, v) for q, _, v, _ in want}
    return len(a & b) / len(b)


def test_recall_on_the_driver_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got, want = ann.nearest(df, F.col("vec_id") % 100 == 0).collect(), brute(rows)
    assert len(got) == len(want) and recall(got, want) >= 0.9
    exact = {(q, v): s for q, _, v, s in want}
    assert all(r.score == pytest.approx(exact[r.query_id, r.vec_id], abs=1e-12) for r in got if (r.query_id, r.vec_id) in exact)
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    assert all([x[0] for x in sorted(v)] == list(range(1, 11)) and [x[1:] for x in sorted(v)] == sorted(x[1:] for x in v) for v in by.values())


def test_odd_vectors_and_a_hot_one(spark, monkeypatch):
    monkeypatch.setattr(ann, "PART", 50)
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=4)] if i % 3 else [1.0, 2.0, 3.0, 4.0]) for i in range(600)]
    odd = [(1001, None), (1002, [0.0] * 4), (1003, [1.0, None, 0.0, 0.0]), (1004, [float("nan")] * 4), (1005, [float("inf"), 0.0, 0.0, 0.0]), (1006, [1.0]), (None, [1.0] * 4), (1100, None), rows[300], rows[301]]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumns({"id": F.lit("x"), "list": F.lit(1)})
    got = ann.nearest(df, F.col("vec_id") % 100 == 0).collect()
    want = brute(rows)
    assert len(got) == len(want) and recall(got, want) >= 0.9
    hot = [r for r in got if r.query_id == 300]
    assert [r.vec_id for r in sorted(hot, key=lambda r: r.rank)] == list(range(0, 30, 3)) and all(r.score == 0 for r in hot)


def test_small_and_empty_tables(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 2.0])], schema)
    assert [(r.query_id, r.rank, r.vec_id) for r in ann.nearest(few, F.col("vec_id") % 100 == 0).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]
    for df in (few.where("false"), few.where("vec_id > 0"), few.where("vec_id = 0")):
        assert ann.nearest(df, F.col("vec_id") % 100 == 0).count() == 0


def test_graph_search_finds_nearest():
    rng = np.random.default_rng(4)
    points = rng.normal(size=(300, 8))
    g = ann.Graph.of(points)
    hits = sum(int(ann.squares(points, v[None])[:, 0].argmin()) in g.search(v, 4, 32)[0] for v in rng.normal(size=(100, 8)))
    assert hits >= 95


def test_balance():
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(900, 4)), 5 + 0.1 * rng.normal(size=(100, 4))])
    n = np.bincount(ann.squares(x, ann.balanced_centroids(x, 20)).argmin(1), minlength=20)
    assert n.max() < 5 * n.mean()
