"""Top-k per group, crosstabs of memberships, matching of controls, and joins that override."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import stored
from .intervals import null_safe_join, small
from .statistics import ordered_bin, quantile_bounds


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each key; partial limits run before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def rank_slice(df: DataFrame, keys: Sequence[str], order: Sequence[Column], first: int, last: int, rank: str = "rank") -> DataFrame:
    """Ranks first..last (from 1) of each key."""
    return top_n(df, keys, order, last, rank).where(F.col(rank) >= first)


def top_windows(df: DataFrame, n: int, feature: str, window: Sequence[str], act: str, tie: str) -> DataFrame:
    """The n highest activations of a feature, then the best one of each window, ranked anew from 0; fewer than n may stay."""
    best = top_n(df, [feature], [F.desc(act), F.asc(tie)], n, "__r")
    one = top_n(best, [feature, *window], [F.desc(act), F.asc(tie)], 1, "__w")
    again = F.row_number().over(Window.partitionBy(feature).orderBy(F.desc(act), F.asc(tie))) - 1
    return one.withColumn("rank", again).drop("__r", "__w")


def batch_top(df: DataFrame, batch: str, k: int, act: str, tie: str) -> DataFrame:
    """The k highest positive activations of a whole batch."""
    return top_n(df.where(F.col(act) > 0), [batch], [F.desc(act), F.asc(tie)], k, "__r").drop("__r")


def threshold(kept: DataFrame, batch: str, act: str) -> DataFrame:
    """One row: the mean over batches of the least activation kept."""
    return kept.groupBy(batch).agg(F.min(act).alias("m")).agg(F.avg("m").alias("theta"))


def crosstab(tokens: DataFrame, members: DataFrame, feature: str = "feature", token: str = "token", concept: str = "concept") -> DataFrame:
    """feature, concept, n_total, n, pct: tokens of a feature that lie in a concept, for all pairs that occur on either side."""
    total = tokens.groupBy(feature).agg(F.count("*").alias("n_total"))
    hit = tokens.join(members.select(token, concept).distinct(), token).groupBy(feature, concept).agg(F.count("*").alias("n"))
    grid = total.crossJoin(small(members.select(concept).distinct()))
    n = F.coalesce("n", F.lit(0))
    return grid.join(hit, [feature, concept], "left").select(feature, concept, "n_total", n.alias("n"), F.when(F.col("n_total") > 0, 100 * n / F.col("n_total")).alias("pct"))


def wide(df: DataFrame, key: str, concept: str, values: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """<value>_<concept> columns; the concepts are named so that no pass is spent on finding them."""
    out = df.groupBy(key).pivot(concept, list(columns)).agg(*[F.first(v).alias(v) for v in values])
    return out.withColumnsRenamed({f"{c}_{v}": f"{v}_{c}" for c in columns for v in values})


def neither(tokens: DataFrame, members: DataFrame, feature: str = "feature", token: str = "token") -> DataFrame:
    """feature, n_neither: tokens in no concept."""
    out = tokens.join(members.select(token).distinct().withColumn("__in", F.lit(1)), token, "left")
    return out.groupBy(feature).agg(F.sum(F.col("__in").isNull().cast("long")).alias("n_neither"))


def venn(tokens: DataFrame, members: DataFrame, pairs: DataFrame, feature: str = "feature", token: str = "token", concept: str = "concept") -> DataFrame:
    """feature, a, b, n_total, n_a, n_b, n_both, n_neither for each pair (a, b); membership is computed once."""
    held = members.select(token, concept).groupBy(token).agg(F.sort_array(F.collect_set(concept)).alias("__c"))  # a token's concepts, few
    # equal sets of concepts are one row before pairs are looked at
    sets = tokens.join(held, token, "left").groupBy(feature, "__c").agg(F.count("*").alias("__n"))
    rows = sets.crossJoin(small(pairs))
    a, b = (F.coalesce(F.array_contains("__c", F.col(x)), F.lit(False)) for x in "ab")
    n = lambda c: F.sum(F.when(c, F.col("__n")).otherwise(0))
    return rows.groupBy(feature, "a", "b").agg(F.sum("__n").alias("n_total"), n(a & ~b).alias("n_a_only"), n(b & ~a).alias("n_b_only"), n(a & b).alias("n_both"), n(~a & ~b).alias("n_neither"))


def concept_pairs(concepts: DataFrame, concept: str = "concept") -> DataFrame:
    """Unordered pairs of a small set of names."""
    c = concepts.select(concept).distinct()
    return c.select(F.col(concept).alias("a")).crossJoin(small(c.select(F.col(concept).alias("b")))).where("a < b")


def scaled_0_10(value: Column, group: Column | str) -> Column:
    """Nonnegative values as whole numbers 0..10 of the group's maximum, rounded half to even."""
    v = F.greatest(value, F.lit(0.0))
    top = F.max(v).over(Window.partitionBy(group))
    return F.when(top > 0, F.bround(10 * v / F.when(top > 0, top), 0)).otherwise(F.lit(0.0)).cast("int")


def nearest_control(targets: DataFrame, pool: DataFrame, limit: float, keys: Sequence[str] = ()) -> DataFrame:
    """For each target the row of the pool with the nearest rate (rate > 0, abs(mcc) <= limit, not itself; ties to the lower id).

    targets: (target, rate, keys...), pool: (id, rate, mcc, keys...). For few targets, as every one meets the whole pool; nearest_controls() is for all rows."""
    fit = pool.where((F.col("rate") > 0) & (F.abs("mcc") <= limit))
    on = [F.col(f"t.{k}") == F.col(f"p.{k}") for k in keys] + [F.col("t.target") != F.col("p.id")]
    pairs = fit.alias("p").join(small(targets).alias("t"), on)
    gap = F.abs(F.col("p.rate") - F.col("t.rate"))
    best = pairs.groupBy(*[F.col(f"t.{k}").alias(k) for k in keys], F.col("t.target").alias("target")).agg(F.min(F.struct(gap.alias("gap"), F.col("p.id").alias("id"))).alias("b"))
    return best.select(*keys, "target", F.col("b.id").alias("control"), F.col("b.gap").alias("gap"))


def nearest_controls(rows: DataFrame, limit: float, per_bin: int = 2_000, keys: Sequence[str] = ()) -> DataFrame:
    """nearest_control for every row of (id, rate, mcc, keys...), without pairs: keys..., target, control, gap.

    The nearest is at the row's own rate (the lowest other id) or at the next lower or higher rate of the pool.
    Rates are walked by bin; only one row a bin meets in order."""
    keys = list(keys)
    fit = rows.where((F.col("rate") > 0) & (F.abs("mcc") <= limit)).select(*keys, "id", "rate")
    first = fit.groupBy(*keys, "rate").agg(F.min("id").alias("a"))
    second = fit.join(first, [*keys, "rate"]).where(F.col("id") != F.col("a")).groupBy(*keys, "rate").agg(F.min("id").alias("b"))
    held = rows.where("rate IS NOT NULL").select(*keys, "rate").distinct().join(first, [*keys, "rate"], "left").join(second, [*keys, "rate"], "left")
    low, high, n = held.agg(F.min("rate"), F.max("rate"), F.count("*")).first()
    width = ((high - low) / (n // per_bin + 1) or 1.0) if n else 1.0
    held = held.withColumn("__bin", F.floor((F.col("rate") - F.lit(low)) / F.lit(width)))
    pick = F.when(F.col("a").isNotNull(), F.struct("rate", F.col("a").alias("id")))
    here = Window.partitionBy(*keys, "__bin").orderBy("rate")
    down, up = here.rowsBetween(Window.unboundedPreceding, -1), here.rowsBetween(1, Window.unboundedFollowing)
    inside = held.withColumns({"__down": F.last(pick, ignorenulls=True).over(down), "__up": F.first(pick, ignorenulls=True).over(up)})
    ends = held.groupBy(*keys, "__bin").agg(F.max(pick).alias("__max"), F.min(pick).alias("__min"))
    order = Window.partitionBy(*keys).orderBy("__bin") if keys else Window.orderBy("__bin")
    carried = ends.select(*keys, "__bin", F.last("__max", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("__before"), F.first("__min", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("__after"))
    near = inside.join(carried, [*keys, "__bin"]).select(*keys, "rate", "a", "b", F.coalesce("__down", "__before").alias("__down"), F.coalesce("__up", "__after").alias("__up"))
    same = F.when(F.col("a") != F.col("target"), F.col("a")).otherwise(F.col("b"))
    at = lambda side: F.when(F.col(side).isNotNull(), F.struct(F.abs(F.col(f"{side}.rate") - F.col("rate")).alias("gap"), F.col(f"{side}.id").alias("id")))
    own = F.when(same.isNotNull(), F.struct((F.col("rate") - F.col("rate")).alias("gap"), same.alias("id")))
    best = F.array_min(F.filter(F.array(own, at("__down"), at("__up")), lambda x: x.isNotNull()))
    out = rows.select(*keys, F.col("id").alias("target"), "rate").join(near, [*keys, "rate"]).select(*keys, "target", best.alias("c")).where("c IS NOT NULL")
    return out.select(*keys, "target", F.col("c.id").alias("control"), F.col("c.gap").alias("gap"))


def greedy_controls(targets: DataFrame, pool: DataFrame, size: int, limit: float, keys: Sequence[str]) -> DataFrame:
    """For each key, its first `size` targets by id in turn take the nearest free row of the pool (ties to the lower id); none if the
    pool is smaller than the group. Targets themselves are not in their key's pool.

    A target's row is among its `size` nearest, as the others take fewer than that. So each target keeps that many, found
    on the map side first, and only these (at most size * size a key) meet for the turns, however large the pool."""
    keys = list(keys)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("target"))
    wanted = stored(targets.select(*keys, "target", "rate").withColumn("__turn", rank).where(F.col("__turn") <= size), "targets")
    group = wanted.groupBy(*keys).agg(F.count("*").alias("__group"), F.collect_set("target").alias("__taken"))
    fit = pool.where((F.col("rate") > 0) & (F.abs("mcc") <= limit)).select(*keys, "id", F.col("rate").alias("__rate"))
    fit = null_safe_join(fit, small(group), keys).where(~F.array_contains("__taken", F.col("id"))).drop("__taken")
    enough = fit.groupBy(*keys).agg(F.count("*").alias("__n"), F.first("__group").alias("__g")).where("__n >= __g").select(*keys)
    near = null_safe_join(fit, small(wanted), keys).withColumn("__gap", F.abs(F.col("__rate") - F.col("rate")))
    order = Window.partitionBy(*keys, "__turn").orderBy("__gap", "id")
    near = near.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= size)
    near = null_safe_join(near.select(*keys, "__turn", "target", "__gap", "id"), enough, keys, "left_semi")

    def match(rows: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        for (_, target), some in rows.sort_values(["__turn", "__gap", "id"]).groupby(["__turn", "target"], sort=True):
            control = next(i for i in some["id"] if i not in used)
            used.add(control)
            out.append({**{k: rows[k].iloc[0] for k in keys}, "target": target, "control": control})
        return pd.DataFrame(out, columns=[*keys, "target", "control"])

    types = dict(near.dtypes)
    return near.groupBy(*keys).applyInPandas(match, ", ".join(f"{k} {types[k]}" for k in keys) + f", target {types['target']}, control {types['id']}")


def override(left: DataFrame, right: DataFrame, key: str, take: Column, columns: Sequence[str]) -> DataFrame:
    """left, with `columns` from right where `take` (over l and r) holds; other rows keep their own."""
    joined = left.alias("l").join(right.alias("r"), F.col(f"l.{key}") == F.col(f"r.{key}"), "left")
    use = F.coalesce(take, F.lit(False))
    return joined.select(*[F.when(use, F.col(f"r.{c}")).otherwise(F.col(f"l.{c}")).alias(c) if c in columns else F.col(f"l.{c}") for c in left.columns], use.alias("overridden"))


def runs(df: DataFrame, key: Sequence[str], order: str, zero: Column) -> DataFrame:
    """Adds run: how many rows in a row, up to this one, were zero (0 on the others)."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    reset = F.sum(F.when(zero, 0).otherwise(1)).over(w)
    rows = df.withColumn("__z", zero.cast("int")).withColumn("__g", reset)
    return rows.withColumn("run", F.sum("__z").over(Window.partitionBy(*key, "__g").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))).drop("__z", "__g")


def seeded_sample(df: DataFrame, n: int, columns: Sequence[str], seed: int) -> DataFrame:
    """Exactly n rows (or all), the same for any partitioning: those with the least hash of the seed and the columns as text."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns])
    return df.orderBy(F.substring(F.md5(text), 1, 15), *columns).limit(n)


def weighted_sample(df: DataFrame, n: int, weight: str, tie: str, parts: int = 64) -> DataFrame:
    """n draws with replacement in proportion to weight, at evenly spaced points of the weights cumulated by tie (a number).

    Weights are summed within parts of about equal size, and the parts' sums are carried on."""
    rows = df.where(F.col(weight) > 0)
    bounds = rows.agg(quantile_bounds(tie, parts)).first()[0] or []
    rows = rows.withColumn("__part", ordered_bin(F.col(tie), F.array(*[F.lit(x) for x in bounds]).cast("array<double>")))
    sums = rows.groupBy("__part").agg(F.sum(weight).alias("__sum"))
    order = Window.orderBy("__part")  # at most `parts` rows
    before = F.coalesce(F.sum("__sum").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    sums = sums.select("__part", before.alias("__before"), F.sum("__sum").over(Window.partitionBy()).alias("__total"))
    run = F.col("__before") + F.sum(weight).over(Window.partitionBy("__part").orderBy(tie).rowsBetween(Window.unboundedPreceding, 0))
    c = rows.join(F.broadcast(sums), "__part").withColumn("__run", run)
    c = c.withColumns({"__hi": F.col("__run") / F.col("__total") * n, "__lo": (F.col("__run") - F.col(weight)) / F.col("__total") * n})
    hits = F.ceil(F.col("__hi") - 0.5) - F.ceil(F.col("__lo") - 0.5)
    out = c.withColumn("__n", hits).where("__n > 0").withColumn("draw", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))))
    return out.select(*df.columns, "draw")


def ordinal(df: DataFrame, column: str, order: str, parts: int = 64) -> DataFrame:
    """Adds code: 0, 1, ... by first appearance of the value in order of a number; equal first places share a code.

    Codes are counted within parts of about equal size, and the parts' counts are carried on."""
    first = df.groupBy(column).agg(F.min(order).alias("__f"))
    bounds = first.agg(quantile_bounds("__f", parts)).first()[0] or []
    first = first.withColumn("__part", ordered_bin(F.col("__f"), F.array(*[F.lit(x) for x in bounds]).cast("array<double>")))
    sizes = first.groupBy("__part").agg(F.countDistinct("__f").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # at most `parts` rows
    code = F.col("__before") + F.dense_rank().over(Window.partitionBy("__part").orderBy("__f")) - 1
    codes = first.join(F.broadcast(sizes.select("__part", before.alias("__before"))), "__part").withColumn("code", code.cast("int"))
    return df.join(codes.select(column, "code"), column)


def appended(tables: Sequence[DataFrame]) -> DataFrame:
    """One table of all rows; columns that a table lacks are null there."""
    out = tables[0]
    for df in tables[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def shuffled_batches(df: DataFrame, shard: str, keys: Sequence[str], size: int, seed: int) -> DataFrame:
    """Adds place (from 0) and batch: each shard's rows in an order drawn from the seed, in batches of `size`; what does not fill a shard's last batch is left out."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in keys])
    w = Window.partitionBy(shard)
    rows = df.withColumns({"place": F.row_number().over(w.orderBy(F.substring(F.md5(text), 1, 15), *keys)) - 1, "__n": F.count("*").over(w)})
    rows = rows.withColumn("batch", F.floor(F.col("place") / size).cast("int"))
    return rows.where((F.col("batch") + 1) * size <= F.col("__n")).drop("__n")
