"""Nearest neighbours over balanced posting lists.

Centroids come from balanced k-means over a bounded sample; their number is about the square root of the
table's size, up to a parameter. A vector joins the list of its nearest centroid, and a boundary
vector also those of others at almost the same distance. A query finds its lists by walking a neighbour
graph of the centroids in memory, then keeps a few nearest and those within a ratio of the nearest distance; how many
it may keep grows with the number of lists. Lists
are joined with their queries by (list, part): a long list is split into parts of bounded size, so a
vector that fills a third of the table does not fill one task. The ten nearest of each part are merged.

The bounds: SAMPLE vectors on the driver, MAX_LISTS centroids in every task. All vectors are
indexed. Distances are exact, in double precision, on the original vectors; recall is measured in tests.

Defined results: vectors that are null, zero, of another dimension than most or with a null or non-finite
component take no part; equal distances go to the smaller id; rows that repeat an id count once (the first of
their values by text); a table without queries or candidates gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE, ship, written

#: Documented bounds: vectors that centroids are fitted on, centroids, vectors in one part of a list.
SAMPLE, MAX_LISTS, PART = 20_000, 2_048, 4_000


@dataclass
class Graph:
    """The centroids and, for each, its nearest others; a search walks from an entry point to ever nearer ones."""

    points: np.ndarray
    links: np.ndarray
    entries: np.ndarray

    @classmethod
    def of(cls, points: np.ndarray, degree: int = 24, entries: int = 16) -> Graph:
        d = squares(points, points)
        np.fill_diagonal(d, np.inf)
        near = np.argsort(d, axis=1)[:, : min(degree, max(1, len(points) - 1))]
        # entry points lie far apart: each is the one farthest from those before
        chosen, gap = [0], squares(points, points[:1])[:, 0]
        while len(chosen) < min(entries, len(points)):
            chosen.append(int(gap.argmax()))
            gap = np.minimum(gap, squares(points, points[chosen[-1:]])[:, 0])
        return cls(points, near, np.array(chosen))

    def search(self, v: np.ndarray, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest centroids found and their squared distances, nearest first."""
        width = max(width, k)
        ids = self.entries
        dist = ((self.points[ids] - v) ** 2).sum(1)
        seen, open_ = set(ids.tolist()), set(ids.tolist())
        while True:
            order = np.argsort(dist, kind="stable")[:width]
            ids, dist = ids[order], dist[order]
            step = [i for i in ids.tolist() if i in open_][:8]
            if not step:
                return ids[:k], dist[:k]
            open_.difference_update(step)
            fresh = [i for i in np.unique(self.links[step]).tolist() if i not in seen]
            seen.update(fresh)
            open_.update(fresh)
            ids = np.concatenate([ids, np.array(fresh, dtype=ids.dtype)])
            dist = np.concatenate([dist, ((self.points[fresh] - v) ** 2).sum(1)]) if fresh else dist


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T, 0)


def nearest_of(x: np.ndarray, c: np.ndarray, fine: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x, the nearest row of c (with a handicap for each) and its squared distance, a slice at a time."""
    at, d = np.empty(len(x), dtype=np.int64), np.empty(len(x))
    for i in range(0, len(x), 1_000):
        part = squares(x[i : i + 1_000], c)
        at[i : i + 1_000] = (part + fine).argmin(1)
        d[i : i + 1_000] = part.min(1)
    return at, d


def balanced_centroids(x: np.ndarray, k: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """k-means in which a full cluster becomes dearer, so that clusters keep near equal sizes."""
    x = np.unique(x, axis=0)
    k = min(k, len(x))
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)]
    fine = np.zeros(k)
    for _ in range(rounds):
        at = nearest_of(x, c, fine)[0]
        n = np.bincount(at, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        empty = np.flatnonzero(n == 0)
        c[empty] = x[rng.choice(len(x), len(empty), replace=len(empty) > len(x))]
        scale = nearest_of(x, c)[1].mean()
        fine = 0.5 * fine + 0.1 * scale * (n / (len(x) / k) - 1)
    return c


def usable(vector: Column) -> Column:
    """The vector as doubles, or null if it takes no part."""
    v = vector.cast("array<double>")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return F.when(ok, v)


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", copies: int = 4, closure: float = 1.15, lists: int = 48, share: float = 0.15, least: int = 8, ratio: float = 1.6, n_lists: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score for the rows where is_query holds, against every other row.

    A query looks at `least` lists at least, and at most at `lists` or a `share` of all, whichever is more. n_lists: how many lists there
    are; by default the square root of the table's size, up to MAX_LISTS."""
    ship(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), is_query.alias("q"), usable(F.col(vector_col)).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    rows = rows.groupBy("id").agg(F.min(F.struct("v", "q")).alias("r")).select("id", "r.v", "r.q")
    rows = written(rows, "vectors")
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = sizes[0]["d"]
    total = sizes[0]["count"]
    rows = rows.where(F.size("v") == dim)
    drawn = int(1_000_000 * min(1.0, SAMPLE / total))
    sample = rows.where(F.pmod(F.xxhash64(F.lit("centroids"), "id"), F.lit(1_000_000)) < drawn).select("v").limit(2 * SAMPLE).collect()
    x = np.array([r["v"] for r in sample] or [[0.0] * dim])
    graph = Graph.of(balanced_centroids(x, n_lists or int(min(MAX_LISTS, max(1, total**0.5)))))
    probed = max(lists, int(share * len(graph.points)))

    def matrix(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)

    def rows_of(part: pa.RecordBatch, at: np.ndarray, chosen: np.ndarray) -> pa.RecordBatch:
        i = pa.array(at, pa.int64())
        return pa.RecordBatch.from_arrays([part.column(0).take(i), pa.array(chosen, pa.int32()), part.column(1).take(i)], names=["id", "list", "v"])

    def put(batches: Iterator) -> Iterator:
        for b in batches:
            for start in range(0, b.num_rows, SLICE):
                part = b.slice(start, SLICE)
                d = np.sqrt(squares(matrix(part.column(1)), graph.points))
                best = np.argsort(d, axis=1, kind="stable")[:, :copies]
                near = np.take_along_axis(d, best, axis=1)
                i, j = np.nonzero(near <= closure * near[:, :1] + 1e-12)
                yield rows_of(part, i, best[i, j])

    def ask(batches: Iterator) -> Iterator:
        for b in batches:
            for start in range(0, b.num_rows, SLICE):
                part = b.slice(start, SLICE)
                at, chosen = [], []
                for i, v in enumerate(matrix(part.column(1))):
                    ids, d = graph.search(v, probed, 2 * probed)
                    # a query may lie on a centroid, where no ratio reaches beyond it: the `least` nearest lists always count
                    reach = max(ratio * np.sqrt(d[0]), np.sqrt(d[min(least, len(d)) - 1])) + 1e-12
                    kept = ids[np.sqrt(d) <= reach]
                    at += [i] * len(kept)
                    chosen += kept.tolist()
                yield rows_of(part, np.array(at, dtype=np.int64), np.array(chosen, dtype=np.int32))

    shape = "id long, list int, v array<double>"
    posted = written(rows.select("id", "v").mapInArrow(put, shape), "postings")
    parts = posted.groupBy("list").agg(F.ceil(F.count("*") / F.lit(PART)).cast("int").alias("parts"))  # at most MAX_LISTS rows
    posted = posted.join(F.broadcast(parts), "list").select("id", "list", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "v")
    asked = rows.where("q").select("id", "v").mapInArrow(ask, shape).join(F.broadcast(parts), "list")
    asked = asked.select("id", "list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "v")

    def compare(queries: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(held):
            held = held.sort_values("id")
            ids, m = held["id"].to_numpy(), np.stack(held["v"].to_numpy())
            for q, v in zip(queries["id"], queries["v"], strict=True):
                d = ((m - v) ** 2).sum(1)
                d[ids == q] = np.inf
                d = np.sqrt(d)
                # ids ascend, so a stable sort settles ties; the cut keeps all that tie with the last
                short = np.flatnonzero(d <= np.partition(d, min(k, len(d)) - 1)[min(k, len(d)) - 1])
                for i in short[np.argsort(d[short], kind="stable")][:k]:
                    if np.isfinite(d[i]):
                        out.append((q, ids[i], d[i]))
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = asked.groupBy("list", "part").cogroup(posted.groupBy("list", "part")).applyInPandas(compare, "query_id long, vec_id long, score double")
    found = found.distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
