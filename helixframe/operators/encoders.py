"""Sparse encoders over long (row, dim, value) vectors: normalise, encode, sparsify, decode, measure."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def long_form(df: DataFrame, row: str, vector: str, dim: str = "dim", value: str = "x", keep: tuple[str, ...] = ()) -> DataFrame:
    """(row, dim from 0, value); NaN becomes 0."""
    out = df.select(row, *keep, F.posexplode(vector).alias(dim, value))
    return out.withColumn(value, F.nanvl(F.col(value).cast("double"), F.lit(0.0)))


def unit_norm(vector: Column, eps: float = 1e-5) -> Column:
    """(x - mean) / (sample deviation + eps), within one vector."""
    v = vector.cast("array<double>")
    n = F.size(v)
    mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.when(n > 0, n)
    # what all elements share is the one element of an array, so that it is computed once a vector and not once an element
    var = lambda m: F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / F.when(n > 1, n - 1)
    shared = F.transform(F.array(mean), lambda m: F.struct(m.alias("mean"), (F.sqrt(var(m)) + eps).alias("dev")))
    return F.transform(shared, lambda s: F.transform(v, lambda x: (x - s["mean"]) / s["dev"]))[0]


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector.cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x))


def squared_error(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def pre_activations(x: DataFrame, weights: DataFrame, row: str = "row") -> DataFrame:
    """(row, feature, pre): sum over dim of x * w, plus the bias. weights: (feature, dim, w, b), broadcast while small."""
    return x.join(weights, "dim").groupBy(row, "feature").agg((F.sum(F.col("x") * F.col("w")) + F.first("b")).alias("pre"))


#: The most weights (8 bytes each) that encode() hands to every task.
MAX_WEIGHTS = 20_000_000


def encode(df: DataFrame, weights: DataFrame, k: int, row: str = "row", vector: str = "x") -> DataFrame:
    """(row, feature, act): the k highest positive activations of each vector, ties to the lower feature; NaN counts as 0.

    One matrix product a batch, with the k highest taken in the same pass. weights: (feature, dim, w, b), a model of
    bounded size; a larger one takes pre_activations() and top_k(), which join."""
    n = weights.count()
    if n > MAX_WEIGHTS:
        acts = pre_activations(long_form(df, row, vector), weights, row).withColumn("act", relu(F.col("pre")))
        return top_k(acts.drop("pre"), k, row)
    table = weights.select("feature", "dim", "w", "b").toPandas()
    features = np.sort(table["feature"].unique())
    place = np.searchsorted(features, table["feature"])
    w, b = np.zeros((len(features), int(table["dim"].max()) + 1 if n else 0)), np.zeros(len(features))
    w[place, table["dim"]], b[place] = table["w"], table["b"]
    kind = df.schema[row].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for part in batches:
            for at in range(0, part.num_rows, 1024):
                rows = part.slice(at, 1024)
                x = np.nan_to_num(np.array(rows.column(1).to_pylist(), dtype=np.float64).reshape(rows.num_rows, -1), nan=0.0)
                act = np.maximum(x @ w[:, : x.shape[1]].T + b, 0)
                best = np.argsort(-act, axis=1, kind="stable")[:, :k]
                got = np.take_along_axis(act, best, axis=1)
                i, j = np.nonzero(got > 0)
                yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(i)), pa.array(features[best[i, j]].astype(np.int32)), pa.array(got[i, j])], names=[row, "feature", "act"])

    vectors = df.select(row, F.col(vector).cast("array<double>")).where(F.col(vector).isNotNull())
    return vectors.mapInArrow(run, f"`{row}` {kind}, feature int, act double")


def relu(pre: Column) -> Column:
    return F.greatest(pre, F.lit(0.0))


def jump_relu(pre: Column, log_threshold: Column) -> Column:
    return F.when(pre > F.exp(log_threshold), pre).otherwise(F.lit(0.0))


def gated(gate: Column, magnitude: Column) -> Column:
    return F.when(gate > 0, relu(magnitude)).otherwise(F.lit(0.0))


def top_k(acts: DataFrame, k: int, row: str = "row", act: str = "act") -> DataFrame:
    """The k highest positive activations of each row, ties to the lower feature."""
    w = Window.partitionBy(row).orderBy(F.desc(act), F.asc("feature"))
    return acts.where(F.col(act) > 0).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop("__r")


def decode(acts: DataFrame, weights: DataFrame, row: str = "row", act: str = "act") -> DataFrame:
    """(row, dim, x_hat) from sparse activations; rows without any are for the caller to fill with the bias."""
    return acts.join(weights.select("feature", "dim", "w_dec"), "feature").groupBy(row, "dim").agg(F.sum(F.col(act) * F.col("w_dec")).alias("x_hat"))


def frequencies(acts: DataFrame, features: DataFrame, n_rows: int, act: str = "act") -> DataFrame:
    """(feature, n, freq) for every feature, also those that never fire."""
    fired = acts.where(F.col(act) != 0).groupBy("feature").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return features.select("feature").join(fired, "feature", "left").select("feature", n.alias("n"), (n / F.lit(n_rows)).alias("freq"))


def sparsity(freq: DataFrame, n_rows: int, dense: float) -> DataFrame:
    """One row: l0, its share, and how many features are dead, always on and dense."""
    count = lambda c: F.sum(c.cast("long"))
    f = F.col("freq")
    return freq.agg((F.sum("n") / F.lit(n_rows)).alias("l0"), (100 * F.sum("n") / (F.lit(n_rows) * F.count("*"))).alias("l0_pct"), count(f == 0).alias("n_dead"), count(f > 0.5).alias("n_always_on"), count(f > dense).alias("n_dense"), (100 * F.avg("freq")).alias("mean_freq_pct"))


def dense_features(freq: DataFrame, top: int, dense: float) -> DataFrame:
    """The `top` most frequent features and all above the threshold."""
    w = Window.orderBy(F.desc("freq"), F.asc("feature"))
    return freq.withColumn("__r", F.row_number().over(w)).where((F.col("__r") <= top) | (F.col("freq") > dense)).drop("__r")


def dense_limit(k: int, features: int) -> float:
    return 10 * k / features


def energy_share(vector: Column, dims: list[int]) -> Column:
    """The part of a decoder row's length that lies in the given dimensions."""
    v = vector.cast("array<double>")
    return norm(F.filter(v, lambda x, i: i.isin(*dims))) / (norm(v) + 1e-12)


def log_softmax_loss(logits: Column, target: Column) -> Column:
    """Cross-entropy of one position: log-sum-exp minus the target's logit (target from 0)."""
    v = logits.cast("array<double>")
    # as in unit_norm: the greatest is found once a vector
    total = F.transform(F.array(F.array_max(v)), lambda top: top + F.log(F.aggregate(v, F.lit(0.0), lambda a, x: a + F.exp(x - top))))
    return total[0] - F.get(v, target)


def steer(vector: Column, decoder: Column, old: Column, factor: Column) -> Column:
    """vector + (factor - 1) * old activation * decoder row."""
    return F.zip_with(vector.cast("array<double>"), decoder.cast("array<double>"), lambda x, d: x + (factor - 1) * old * d)


def mean_pool(x: DataFrame, keys: list[str]) -> DataFrame:
    return x.groupBy(*keys, "dim").agg(F.avg("x").alias("x"))


def fused(x: DataFrame) -> DataFrame:
    """concept, feature, tp, fires, mse from one pass over (concept, feature, x, x_hat): firing counts and squared error by both, then sums over the small table."""
    res = F.col("x") - F.col("x_hat")
    by = x.groupBy("concept", "feature").agg(F.sum((F.col("x") > 0).cast("long")).alias("tp"), F.avg(res * res).alias("mse"))
    return by.withColumn("fires", F.sum("tp").over(Window.partitionBy("feature")))


def activations(kind: str, x: DataFrame, weights: DataFrame | None = None, row: str = "row") -> DataFrame:
    """Adds act, or encodes: "raw_neuron" takes the values themselves, "relu" the positive part of the pre-activations, "jump" those above exp(threshold)."""
    if kind == "raw_neuron":
        return x.withColumn("act", F.col("x"))
    if weights is None:
        raise ValueError(f"{kind} needs weights")
    pre = pre_activations(x, weights, row)
    if kind == "relu":
        return pre.select(row, "feature", relu(F.col("pre")).alias("act"))
    if kind == "jump":
        limits = weights.select("feature", "log_threshold").distinct()
        return pre.join(limits, "feature").select(row, "feature", jump_relu(F.col("pre"), F.col("log_threshold")).alias("act"))
    raise ValueError(f"unknown kind {kind}")
