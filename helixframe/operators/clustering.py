"""K-means of many groups in one plan: every round assigns all points of all groups and averages them by (group, cluster).

Points stay where they are. The centres are one row a group, broadcast where they are counted to be few, and the sums of a
round are made on the map side, so a group of any size is a few numbers a task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import stored
from .intervals import null_safe_join

#: The most groups whose centres are broadcast.
MAX_GROUPS = 50_000


def with_group(points: DataFrame, groups: DataFrame, group: str) -> DataFrame:
    """The columns of a table of groups, which is computed once."""
    held = stored(groups, "groups")
    return null_safe_join(points, F.broadcast(held) if held.count() <= MAX_GROUPS else held, [group])


def by_dimension(cells: DataFrame, keys: list[str], **values: Column) -> DataFrame:
    """An array a value, in order of the dimensions, from cells (keys..., dim, x)."""
    sums = cells.groupBy(*keys, "dim").agg(*[v.alias(k) for k, v in values.items()])
    rows = sums.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("dim", *values))).alias("__d"))
    return rows.select(*keys, *[F.col("__d")[k].alias(k) for k in values])


def standardised(points: DataFrame, group: str, vector: str) -> DataFrame:
    """Each dimension of a group with mean 0 and population deviation 1 (a constant one becomes 0); null counts as 0."""
    filled = points.withColumn(vector, F.transform(F.col(vector).cast("array<double>"), lambda x: F.coalesce(x, F.lit(0.0))))
    cells = filled.select(group, F.posexplode(vector).alias("dim", "x"))
    moments = by_dimension(cells, [group], __mean=F.avg("x"), __dev=F.stddev_pop("x"))
    out = with_group(filled, moments, group)
    scaled = F.transform(F.arrays_zip(vector, "__mean", "__dev"), lambda z: F.when(z["__dev"] > 0, (z[vector] - z["__mean"]) / z["__dev"]).otherwise(0.0))
    return out.withColumn(vector, scaled).drop("__mean", "__dev")


def distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def seeds(points: DataFrame, group: str, vector: str, key: str, k: int, starts: int, seed: int) -> DataFrame:
    """group, start, cluster, centre: for each start the k distinct points of a group with the lowest hash."""
    distinct = points.groupBy(group, vector).agg(F.min(key).alias("__key"))
    rows = distinct.withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(starts - 1))))
    rows = rows.withColumn("__h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("start").cast("string"), F.col("__key").cast("string")).cast("binary")))
    rank = F.row_number().over(Window.partitionBy(group, "start").orderBy("__h", "__key"))
    return rows.withColumn("cluster", rank - 1).where(F.col("cluster") < k).select(group, "start", "cluster", F.col(vector).alias("centre"))


def kmeans(points: DataFrame, group: str, vector: str, k: int, key: str = "id", rounds: int = 20, starts: int = 3, seed: int = 42) -> DataFrame:
    """Adds cluster (int, from 0): Lloyd rounds over all groups at once, and of several starts the one with the least error.

    A group of fewer than k distinct points has as many clusters as these; ties go to the lower cluster; a cluster
    that loses its points keeps its centre; rounds end early when no centre moves. Rows of a null vector get a null
    cluster, rows of a null group are a group. Standardise first if the dimensions differ in scale."""
    whole = points.where(F.col(vector).isNotNull()).withColumn(vector, F.col(vector).cast("array<double>"))
    centres = stored(seeds(whole, group, vector, key, k, starts, seed), "centres")

    def assigned() -> DataFrame:
        """Every point once a start, with its cluster and error."""
        one = centres.groupBy(group, "start").agg(F.collect_list(F.struct("cluster", "centre")).alias("__c"))
        one = one.groupBy(group).agg(F.collect_list(F.struct("start", "__c")).alias("__starts"))
        rows = with_group(whole, one, group).withColumn("__s", F.explode("__starts"))
        best = F.array_min(F.transform(F.col("__s.__c"), lambda c: F.struct(distance(F.col(vector), c["centre"]).alias("error"), c["cluster"].alias("cluster"))))
        return rows.withColumn("__b", best).select(*whole.columns, F.col("__s.start").alias("__start"), F.col("__b.cluster").alias("cluster"), F.col("__b.error").alias("__error"))

    for _ in range(rounds):
        cells = assigned().select(group, F.col("__start").alias("start"), "cluster", F.posexplode(vector).alias("dim", "x"))
        means = by_dimension(cells, [group, "start", "cluster"], __new=F.avg("x"))
        moved = null_safe_join(centres, means, [group, "start", "cluster"], "left")
        moved = stored(moved.select(group, "start", "cluster", F.coalesce("__new", "centre").alias("centre"), (F.coalesce(distance(F.col("__new"), F.col("centre")), F.lit(0.0)) > 0).alias("moved")), "centres")
        still = moved.where("moved").isEmpty()
        centres = moved.drop("moved")
        if still:
            break
    rows = assigned()
    if starts > 1:
        errors = rows.groupBy(group, "__start").agg(F.sum("__error").alias("__e"))
        best = errors.groupBy(group).agg(F.min(F.struct(F.round("__e", 9).alias("e"), F.col("__start").alias("s")))["s"].alias("__best"))
        rows = with_group(rows, best, group).where("__start = __best").drop("__best")
    out = rows.drop("__start", "__error")
    return out.unionByName(points.where(F.col(vector).isNull()).withColumn(vector, F.col(vector).cast("array<double>")).withColumn("cluster", F.lit(None).cast("int")))
