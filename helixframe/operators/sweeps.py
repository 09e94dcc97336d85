"""Threshold sweeps and comparisons over stored association tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The least lead that counts as a win, and the tolerance around a trivial F1 of 2/3.
WIN, TRIVIAL, TRIVIAL_ABS, TRIVIAL_REL = 1e-4, 2 / 3, 1e-3, 1e-5


def trivial(f1: Column) -> Column:
    return F.abs(f1 - TRIVIAL) <= TRIVIAL_ABS + TRIVIAL_REL * TRIVIAL


def grid(spark, **axes: Sequence[float]) -> DataFrame:
    """The cross product of a few short axes."""
    out = None
    for name, values in axes.items():
        axis = spark.range(1).select(F.explode(F.array(*[F.lit(float(v)) for v in values])).alias(name))
        out = axis if out is None else out.crossJoin(axis)
    return out


def polysemanticity(scores: DataFrame, taus: DataFrame, score: str = "f1", feature: str = "feature") -> DataFrame:
    """tau, mean concepts per feature, the same among interpretable ones, and how many are mono- and polysemantic.

    Features without a concept above tau count as 0."""
    per = scores.crossJoin(F.broadcast(taus)).groupBy("tau", feature).agg(F.sum((F.col(score) >= F.col("tau")).cast("long")).alias("c"))
    some = F.col("c") > 0
    return per.groupBy("tau").agg(
        F.avg("c").alias("mean_concepts"), F.avg(F.when(some, F.col("c"))).alias("mean_interpretable"), F.sum(some.cast("long")).alias("n_interpretable"),
        F.sum((F.col("c") == 1).cast("long")).alias("n_mono"), F.sum((F.col("c") >= 2).cast("long")).alias("n_poly"),
    )


def recovered_rate(tpr: Column, fpr: Column, prevalence: Column) -> Column:
    """A feature's firing rate from its rates in and outside a concept."""
    return tpr * prevalence + fpr * (1 - prevalence)


def rate_of_features(df: DataFrame, degenerate: Sequence[str] = (), concept: str = "concept", feature: str = "feature") -> DataFrame:
    """The median recovered rate over the concepts that are not degenerate."""
    rows = df.where(~F.col(concept).isin(*degenerate)) if degenerate else df
    return rows.groupBy(feature).agg(F.median(recovered_rate(F.col("recall"), F.col("fpr"), F.col("prevalence"))).alias("rate"))


def wins(ours: DataFrame, base: DataFrame, taus: DataFrame, key: str = "concept", value: str = "f1") -> DataFrame:
    """tau, wins (ahead and both at least tau), ties (whatever tau)."""
    both = ours.select(key, F.col(value).alias("a")).join(base.select(key, F.col(value).alias("b")), key).crossJoin(F.broadcast(taus))
    won = (F.col("a") > F.col("b") + WIN) & (F.col("a") >= F.col("tau")) & (F.col("b") >= F.col("tau"))
    return both.groupBy("tau").agg(F.sum(won.cast("long")).alias("wins"), F.sum((F.abs(F.col("a") - F.col("b")) <= WIN).cast("long")).alias("ties"), F.count("*").alias("n"))


def cell(best: DataFrame, base: DataFrame, key: str = "concept", value: str = "f1") -> DataFrame:
    """One row: mean and best value, mean lead over the baseline, and how many are trivial."""
    rows = best.select(key, F.col(value).alias("v")).join(base.select(key, F.col(value).alias("b")), key, "left")
    return rows.agg(F.avg("v").alias("mean_best"), F.max("v").alias("max_best"), F.avg(F.col("v") - F.col("b")).alias("mean_delta"), F.sum(trivial(F.col("v")).cast("long")).alias("n_trivial"))


def best_step(df: DataFrame, group: str, step: str, dead: str) -> DataFrame:
    """The step with the fewest dead features, the earliest on a tie."""
    return df.groupBy(group).agg(F.min_by(step, F.struct(dead, step)).alias("best_step"))


def best_layer(df: DataFrame, concept: str, layer: str, value: str) -> DataFrame:
    """The layer with the highest value (missing counts as -1), the lowest on a tie."""
    v = F.coalesce(F.nanvl(F.col(value), F.lit(None).cast("double")), F.lit(-1.0))
    return df.groupBy(concept).agg(F.min_by(layer, F.struct(-v, F.col(layer))).alias("best_layer"), F.max(v).alias("best_value"))


def pivoted(df: DataFrame, row: str, column: str, value: str, columns: Sequence) -> DataFrame:
    """row by column; two values in one cell raise."""
    one = F.when(F.count(value) > 1, F.raise_error(F.lit("more than one value in a cell")).cast("double")).otherwise(F.first(value))
    return df.groupBy(row, column).agg(one.alias("v")).groupBy(row).pivot(column, list(columns)).agg(F.first("v"))


def last_of(df: DataFrame, group: str, step: str) -> DataFrame:
    """The last row of each group by step."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(step)))).where("__r = 1").drop("__r")


def canonical(df: DataFrame, run: str, size: str) -> DataFrame:
    """The rows of runs that have the commonest size (on a tie the smaller)."""
    sizes = df.groupBy(size).agg(F.countDistinct(run).alias("n")).orderBy(F.desc("n"), F.asc(size)).limit(1).select(size)
    return df.join(F.broadcast(sizes), size, "left_semi")


def series(df: DataFrame, key: str, step: str, value: str) -> DataFrame:
    """Each key's values in order of step."""
    return df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(step, value))).alias("series"))


def listed(df: DataFrame, key: str, name: str, score: str, top: int) -> DataFrame:
    """key, the names of its `top` best scores joined by "|"."""
    w = Window.partitionBy(key).orderBy(F.desc(score), F.asc(name))
    rows = df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= top)
    return rows.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__r", name))), lambda s: s[name]), "|").alias("names"))


def final_table(ours: DataFrame, base: DataFrame, degenerate: Sequence[str] = (), layer: str = "layer", step: str = "step", concept: str = "concept", value: str = "f1") -> DataFrame:
    """layer, feature_f1, neuron_f1, delta: means over the concepts that count, at each layer's last step, beside the baseline's."""
    counts = ~F.col(concept).isin(*degenerate) if degenerate else F.lit(True)
    last = ours.groupBy(layer).agg(F.max(step).alias(step))
    mine = ours.where(counts).join(last, [layer, step]).groupBy(layer).agg(F.avg(value).alias("feature_f1"))
    theirs = base.where(counts).groupBy(layer).agg(F.avg(value).alias("neuron_f1"))
    return mine.join(theirs, layer, "left").withColumn("delta", F.col("feature_f1") - F.col("neuron_f1"))


def baseline_delta(rows: DataFrame, base: DataFrame, degenerate: Sequence[str] = (), key: str = "concept", value: str = "f1") -> DataFrame:
    """concept, best, base, delta, degenerate, place: each concept's best value beside the baseline's, the best first."""
    best = rows.groupBy(key).agg(F.max(value).alias("best")).join(base.groupBy(key).agg(F.max(value).alias("base")), key, "left")
    out = best.withColumns({"delta": F.col("best") - F.col("base"), "degenerate": F.col(key).isin(*degenerate) if degenerate else F.lit(False)})
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc("best"), F.asc(key))))  # a row a concept


def name_union(tables: Sequence[DataFrame], name: str = "concept") -> DataFrame:
    """The sorted union of the names of several runs, with their places from 1."""
    out = tables[0].select(name)
    for df in tables[1:]:
        out = out.union(df.select(name))
    return out.distinct().withColumn("place", F.row_number().over(Window.orderBy(name)))  # a row a name


def step_list(dirs: DataFrame, column: str, prefix: str = "step") -> DataFrame:
    """step, place: the distinct step numbers of folder names, in numeric order."""
    steps = dirs.select(F.regexp_extract(column, rf"{prefix}[_=]?(\d+)", 1).try_cast("long").alias("step")).where("step IS NOT NULL").distinct()
    return steps.withColumn("place", F.row_number().over(Window.orderBy("step")))


def plot_rows(df: DataFrame, observed: str = "observed", limit: str = "q95", flag: str = "significant_bh", tie: str = "concept") -> DataFrame:
    """Adds significant (from a text flag, or whether the observed value is above the limit) and place, in rising order of the observed value."""
    above = F.col(observed) > F.col(limit)
    said = F.lower(F.col(flag).cast("string")).isin("true", "1") if flag in df.columns else F.lit(None).cast("boolean")
    return df.withColumns({"significant": F.coalesce(said, above), "place": F.row_number().over(Window.orderBy(observed, tie)) - 1})
