"""What the two learned operators share: bounded labelled samples and a small logistic fit."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: At most about so many labelled rows are used; the sample is by hash of the id, so it is the same for any partitioning.
MAX_LABELLED = 60_000
#: Fixed value: a row is predicted positive from this score on.
CUT = 0.3


def crc_of(id_col: Column, modulus: int) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % modulus


def labelled_sample(labels: DataFrame, label: str, keep: Column, limit: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, label): one row an id, none with a null, about `limit` at most. Small enough to broadcast whatever the input."""
    rows = labels.where(keep & F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    share = min(1.0, limit / max(1, rows.count()))
    return rows if share == 1 else rows.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, keep: Column | None, limit: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, label, text) of the sample, written: one row an id, the least of its texts, so ids that repeat do not make it larger."""
    sample = labelled_sample(labels, label, F.lit(True) if keep is None else keep, limit)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    return written(rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")), "labelled")


def fold(id_col: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("fold"), id_col), F.lit(n))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def newton(x: np.ndarray, y: np.ndarray, ridge: float, weight: np.ndarray | None = None, steps: int = 25) -> np.ndarray:
    """Coefficients of a ridge logistic regression; a constant column, if wanted, is the caller's."""
    w, weight = np.zeros(x.shape[1]), np.ones(len(y)) if weight is None else weight
    for _ in range(steps):
        p = sigmoid(x @ w)
        grad = x.T @ (weight * (p - y)) + ridge * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + (ridge + 1e-9) * np.eye(x.shape[1])
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def best_cut(z: np.ndarray, y: np.ndarray, measure) -> float:
    """The cut between scores (from a grid of quantiles) that is best by measure(predicted, y)."""
    grid = np.unique(np.quantile(z, np.linspace(0, 1, 401)))
    cuts = (grid[1:] + grid[:-1]) / 2 if len(grid) > 1 else grid
    got = [measure(z >= c, y) for c in cuts]
    best = np.flatnonzero(np.isclose(got, np.max(got)))
    return float(cuts[best[len(best) // 2]])


def to_unit(z: np.ndarray, cut: float, scale: float) -> np.ndarray:
    """Scores in 0 to 1, rising with z, with CUT exactly at the cut."""
    return sigmoid((z - cut) / scale + np.log(CUT / (1 - CUT)))
