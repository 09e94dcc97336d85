"""Permutation null models: labels move within windows, or windows within shards; marginals stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def permutations(df: DataFrame, n: int) -> DataFrame:
    """Each row once a permutation, perm 0..n-1."""
    return df.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def circular_shift(labels: DataFrame, n: int, length: Column, shift: Column, tok: str = "tok") -> DataFrame:
    """Labels re-keyed: the one at tok goes to (tok + shift) mod length; shift may use perm and the window."""
    return permutations(labels, n).withColumn(tok, F.pmod(F.col(tok) + shift, length))


def block_permutation(labels: DataFrame, windows: DataFrame, n: int, order: Column, window: str = "window", shard: str = "shard") -> DataFrame:
    """Labels of a window go to the window that has its place in a permuted order of the shard's windows.

    windows: (shard, window); order: a pseudo-random key from perm and window."""
    w = permutations(windows.select(shard, window).distinct(), n)
    plain = w.withColumn("__r", F.row_number().over(Window.partitionBy(shard, "perm").orderBy(window)))
    mixed = w.withColumn("__r", F.row_number().over(Window.partitionBy(shard, "perm").orderBy(order, window))).withColumnRenamed(window, "__to")
    moved = plain.join(mixed, [shard, "perm", "__r"]).drop("__r")
    return labels.join(moved, [shard, window]).drop(window).withColumnRenamed("__to", window)


def true_positives(active: DataFrame, labels: DataFrame, on: list[str], by: list[str]) -> DataFrame:
    """perm, by..., tp: only this changes from one permutation to the next."""
    return active.join(labels, on).groupBy("perm", *by).agg(F.count("*").alias("tp"))


def summarize(null: DataFrame, observed: DataFrame, by: list[str], value: str, n: int) -> DataFrame:
    """Mean, population deviation, 95th percentile and p-value of each observed value against its null."""
    got = null.join(observed.withColumnRenamed(value, "__obs"), by).groupBy(*by).agg(
        F.first("__obs").alias("observed"), F.avg(value).alias("null_mean"), F.stddev_pop(value).alias("null_std"), F.percentile(value, F.lit(0.95)).alias("null_q95"), F.sum((F.col(value) >= F.col("__obs")).cast("long")).alias("exceed")
    )
    return got.withColumn("p", (1 + F.col("exceed")) / F.lit(1 + n))


def max_over(null: DataFrame, concept: str, value: str) -> DataFrame:
    """Mean and 95th percentile of the largest value over candidates in each permutation."""
    best = null.groupBy(concept, "perm").agg(F.max(value).alias("m"))
    return best.groupBy(concept).agg(F.avg("m").alias("max_mean"), F.percentile("m", F.lit(0.95)).alias("max_q95"))
