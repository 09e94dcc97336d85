"""Moments, correlations, percentiles, and corrections for many tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import null_safe_join


def ordered_bin(column: Column, bounds: Column) -> Column:
    """How many of the bounds (ascending) lie below the value: rising with it."""
    return F.size(F.filter(bounds, lambda x: x < column))


def quantile_bounds(column: str, parts: int) -> Column:
    """An aggregate: about equal shares of the values lie between its bounds. A sketch, so of bounded size."""
    return F.array_distinct(F.percentile_approx(column, [i / parts for i in range(1, parts)], 50 * parts))


def bh(df: DataFrame, p: str, keys: Sequence[str], tie: str) -> DataFrame:
    """Adds q: Benjamini-Hochberg over the rows of each key.

    Rows are ranked within bins of p, small ones by magnitude; only one row a bin meets by key."""
    keys = list(keys)
    c = F.col(p)
    small = F.floor(F.log2(F.greatest(c, F.lit(1e-300))) * 8)
    rows = df.withColumn("__bin", F.when(c < 2.0**-10, small).otherwise(F.floor(c * 4096)).cast("long"))
    at = [*keys, "__bin"]
    every = Window.partitionBy(*keys)
    counted = rows.groupBy(*at).agg(F.count("*").alias("__c"))
    base = F.coalesce(F.sum("__c").over(every.orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = counted.select(*at, base.alias("__base"), F.sum("__c").over(every).alias("__n"))
    here = Window.partitionBy(*at).orderBy(c.asc(), F.col(tie).asc())
    scaled = null_safe_join(rows, counted, at).withColumn("__s", c * F.col("__n") / (F.col("__base") + F.row_number().over(here)))
    least = scaled.groupBy(*at).agg(F.min("__s").alias("__least"))
    after = F.min("__least").over(every.orderBy("__bin").rowsBetween(1, Window.unboundedFollowing))
    out = null_safe_join(scaled, least.select(*at, after.alias("__after")), at)
    q = F.least(F.min("__s").over(here.rowsBetween(0, Window.unboundedFollowing)), F.col("__after"))
    return out.withColumn("q", F.least(F.lit(1.0), F.greatest(F.lit(0.0), q))).select(*df.columns, "q")


def empirical_p(exceed: Column, permutations: Column | int) -> Column:
    return (F.lit(1) + exceed) / (F.lit(1) + permutations)


def z_score(value: Column, mean: Column, std: Column) -> Column:
    return F.when(std > 1e-12, (value - mean) / std).otherwise(F.lit(0.0))


def correlation(x: str, y: str, least: int = 2, otherwise: float | None = None) -> Column:
    """Pearson's r from sums in one aggregation; `otherwise` where it is not defined (too few rows, no variance)."""
    ok = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(ok, F.col(x).cast("double")), F.when(ok, F.col(y).cast("double"))
    n = F.count(a)
    va, vb = F.var_pop(a), F.var_pop(b)
    return F.when((n >= least) & (va > 0) & (vb > 0), F.covar_pop(a, b) / F.sqrt(F.when((va > 0) & (vb > 0), va * vb))).otherwise(F.lit(otherwise).cast("double"))


def reconstruction(df: DataFrame, x: str, x_hat: str, dim: str) -> DataFrame:
    """One row: mse, mean, sample deviation and maximum of it by dimension, and variance explained."""
    res = F.col(x) - F.col(x_hat)
    by = df.groupBy(dim).agg(F.avg(res * res).alias("m"), F.var_samp(res).alias("vr"), F.var_samp(x).alias("vx"))
    explained = F.when(F.sum("vx") > 0, 1 - F.sum("vr") / F.when(F.sum("vx") > 0, F.sum("vx"))).otherwise(F.lit(0.0))
    return by.agg(F.avg("m").alias("mse"), F.stddev_samp("m").alias("mse_std"), F.max("m").alias("mse_max"), explained.alias("variance_explained"))


def percentiles(df: DataFrame, column: str, keys: Sequence[str], names: dict[float, str], parts: int = 64) -> DataFrame:
    """keys..., and each percentile (exact, linear interpolation) under its name.

    Bounds from a sketch cut each key's values into parts; ranks are counted by part, and only the parts that hold a
    wanted rank are sorted."""
    keys = list(keys)
    held = df.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).cast("double").alias("__v")).agg(F.count("*").alias("__c"))
    bounds = held.groupBy(*keys).agg(quantile_bounds("__v", parts).alias("__bounds"))
    rows = null_safe_join(held, bounds, keys) if keys else held.crossJoin(F.broadcast(bounds))  # one row of bounds
    rows = rows.withColumn("__part", ordered_bin(F.col("__v"), F.col("__bounds"))).drop("__bounds")
    at = [*keys, "__part"]
    sizes = rows.groupBy(*at).agg(F.sum("__c").alias("__n"))
    every = Window.partitionBy(*keys)
    base = F.coalesce(F.sum("__n").over(every.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*at, "__n", base.alias("__base"), F.sum("__n").over(every).alias("__all"))
    place = lambda q: F.lit(float(q)) * (F.col("__all") - 1)
    wanted = [F.struct(F.lit(name).alias("name"), F.lit(i).alias("side"), (F.floor(place(q)) if i == 0 else F.ceil(place(q))).cast("long").alias("rank"), (place(q) - F.floor(place(q))).alias("share")) for q, name in names.items() for i in (0, 1)]
    asked = sizes.withColumn("__w", F.explode(F.array(*wanted))).where((F.col("__w.rank") >= F.col("__base")) & (F.col("__w.rank") < F.col("__base") + F.col("__n")))
    parts_asked = asked.select(*at, "__base").distinct()
    here = Window.partitionBy(*at).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = null_safe_join(rows, parts_asked, at).withColumn("__to", F.col("__base") + F.sum("__c").over(here)).drop("__base")
    found = null_safe_join(ranked, asked.select(*at, "__w"), at).where((F.col("__w.rank") < F.col("__to")) & (F.col("__w.rank") >= F.col("__to") - F.col("__c")))
    pick = lambda name, side: F.max(F.when((F.col("__w.name") == name) & (F.col("__w.side") == side), F.col("__v")))
    share = lambda name: F.max(F.when(F.col("__w.name") == name, F.col("__w.share")))
    return found.groupBy(*keys).agg(*[(pick(n, 0) + (pick(n, 1) - pick(n, 0)) * share(n)).alias(n) for n in names.values()])


def summary(df: DataFrame, column: str, keys: Sequence[str] = (), percents: Sequence[float] = (0.5, 0.9, 0.99, 0.999)) -> DataFrame:
    """count, mean, std, min, max and exact percentiles (linear interpolation)."""
    c, keys = F.col(column), list(keys)
    names = {p: "p" + f"{100 * p:g}".replace(".", "_") for p in percents}
    plain = df.groupBy(*keys).agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"))
    cut = percentiles(df, column, keys, names)
    return null_safe_join(plain, cut, keys, "left") if keys else plain.join(cut, F.lit(True), "left")


def value_counts(df: DataFrame, column: str, top: int) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(column)).limit(top)


def funnel(df: DataFrame, steps: Sequence[tuple[str, Column]]) -> DataFrame:
    """Rows that pass each step and all before it, in one pass: step, name, n."""
    passed, sums = F.lit(True), [F.count("*").alias("c0")]
    for i, (_, condition) in enumerate(steps, 1):
        passed = passed & F.coalesce(condition, F.lit(False))
        sums.append(F.sum(passed.cast("long")).alias(f"c{i}"))
    rows = [F.struct(F.lit(i).alias("step"), F.lit(n).alias("name"), F.coalesce(F.col(f"c{i}"), F.lit(0)).alias("n")) for i, n in enumerate(["all", *(n for n, _ in steps)])]
    return df.agg(*sums).select(F.inline(F.array(*rows)))


def recovered(original: Column, ablated: Column, replaced: Column) -> Column:
    """Share of the loss recovered, in percent, 0 if ablation changes nothing."""
    gap = ablated - original
    return F.when(F.abs(gap) > 1e-12, 100 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - (replaced - original) / F.when(F.abs(gap) > 1e-12, gap)))).otherwise(F.lit(0.0))


def score_summary(df: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """keys..., max, mean, sample std and median of the values that are numbers (none: all null)."""
    v = F.nanvl(F.col(column), F.lit(None).cast("double"))
    return df.groupBy(*keys).agg(F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.median(v).alias("median"))


def group_sizes(df: DataFrame, keys: Sequence[str], top: int) -> DataFrame:
    """The `top` largest groups, on a tie in order of their keys."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *keys).limit(top)


def qc_report(df: DataFrame, steps: Sequence[tuple[str, Column]], names: Sequence[str], length: str, top: int = 30) -> DataFrame:
    """section, name, value: rows that pass each filter and their share of all, the commonest values of some columns, and the lengths' distribution over the rows that pass all."""
    counts = funnel(df, steps)
    total = F.max(F.when(F.col("step") == 0, F.col("n")))
    passed = counts.select(F.lit("rows").alias("section"), "name", F.col("n").cast("double").alias("value"))
    shares = counts.crossJoin(F.broadcast(counts.agg(total.alias("__t")))).select(F.lit("share").alias("section"), "name", (F.col("n") / F.col("__t")).alias("value"))  # one row
    kept = df
    for _, condition in steps:
        kept = kept.where(condition)
    out = passed.union(shares)
    for name in names:
        out = out.union(value_counts(kept, name, top).select(F.lit(name).alias("section"), F.col(name).cast("string").alias("name"), F.col("n").cast("double").alias("value")))
    cut = summary(kept.select(length), length)
    cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in cut.columns])
    return out.union(cut.select(F.explode(cells).alias("x")).select(F.lit(length).alias("section"), "x.name", "x.value"))
