import zlib

import numpy as np

from helixframe.llm.learning import CUT
from helixframe.llm.quality import NAMES, describe, fit, quality, rank, score


def test_features_have_names():
    assert len(describe(b"")) == len(describe("Ä word, two.\n\nlines | x".encode())) == len(NAMES)


def test_ranking_learns_an_order():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] + 0.1 * rng.normal(size=400) > -1).astype(int)
    m = rank(x, y)
    assert ((m.score(x) >= CUT) == (y == 1)).mean() > 0.95


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    y = {r.doc_id: r.quality for r in labels.collect()}
    got = quality(docs, labels).collect()
    held = [r for r in got if r.held_out and r.doc_id in y]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.predicted == y[r.doc_id] for r in held) >= 0.95 * len(held)
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    assert sorted((r.doc_id, r.score) for r in quality(docs, flipped).collect()) == sorted((r.doc_id, r.score) for r in got)


def test_odd_documents(spark, odd_documents):
    labels = spark.createDataFrame([(0, 1), (1, 1), (2, 0), (3, None), (None, 1), (6, 0), (6, 0)], "doc_id long, quality int")
    m = fit(odd_documents, labels)
    got = score(odd_documents, m).collect()
    assert len(got) == odd_documents.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= CUT) for r in got)
    assert score(odd_documents.where("false"), m).count() == 0
    assert all(r.score == 1 for r in quality(odd_documents, labels.where("false")).collect())


def test_learning_equals_plain_gradient_descent():
    """The coefficients minimise the logistic loss of feature differences, as plain descent over the same pairs finds."""
    from helixframe.llm.learning import newton

    rng = np.random.default_rng(3)
    d = rng.normal(size=(500, 4)) + [0.5, -0.2, 0.0, 0.1]
    w = np.zeros(4)
    for _ in range(4000):
        w -= 0.002 * (d.T @ (1 / (1 + np.exp(-d @ w)) - 1) + 0.05 * w)
    assert np.allclose(newton(d, np.ones(500), 0.05), w, atol=1e-4)


def test_scores_equal_a_plain_scorer(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "A b. " * 50_000)], "doc_id long, text string"))
    m = fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    for r in score(docs, m).collect():
        z = [max(-6, min(6, (a - b) / c)) for a, b, c in zip(describe(texts[r.doc_id]), m.mean, m.scale, strict=True)]
        raw = sum(a * b for a, b in zip([*z, *(a * a for a in z)], m.coef, strict=True)) - m.cut + np.log(CUT / (1 - CUT))
        assert np.isclose(r.score, 1 / (1 + np.exp(-np.clip(raw, -30, 30)))) and r.predicted == (r.score >= CUT)
