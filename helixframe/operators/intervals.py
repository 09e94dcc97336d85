"""Interval operators over (key, start, end) rows, 0-based and half-open.

No operator hands all rows of one key to one task: coordinates are cut into bins, work is done by
(key, bin), where equal starts are one row, and only one row a bin meets by key to be carried on.

Points look intervals up in one of two ways. A set that is counted to be small becomes an index that every task holds
(interval_index), and points are not shuffled. A larger one meets the distinct (key, position) of the points by (key, bin), so
a bin holds at most its width of either, however hot the key, and the answers join the points by key and position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import stored
from .blocks import bitmap_overlap
from .interval_index import label_index, labels_of, span_index, spans_of

#: Width of the bins that spread a key's rows, in coordinate units.
BIN = 1 << 16


#: The most rows of a side that is sent to every task.
MAX_SMALL = 100_000

#: Rows that a task merges of a set that was counted.
TASK_ROWS = 1_500_000


def small(df: DataFrame, limit: int = MAX_SMALL) -> DataFrame:
    """The table, computed once; to be broadcast if it is counted to be small, else Spark chooses."""
    kept = stored(df, "side")
    return F.broadcast(kept) if kept.count() <= limit else kept


def keys_of(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """An equi-join in which null keys meet null keys, with the left side's key columns."""
    other = right.withColumnsRenamed({c: f"__r_{c}" for c in on})
    return left.join(other, [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in on], how).drop(*[f"__r_{c}" for c in on])


def merge_intervals(df: DataFrame, keys: str | Sequence[str] = "key", bin_width: int = BIN) -> DataFrame:
    """Overlapping or touching intervals of a key become one.

    What reaches into a bin is carried from the bins before it, so islands are found inside bins; the
    island that leaves a bin takes the greatest end of its parts in later bins."""
    keys = keys_of(keys)
    at = [*keys, "__bin"]
    rows = df.where("start IS NOT NULL AND end IS NOT NULL").groupBy(*keys, "start").agg(F.max("end").alias("end"))
    rows = rows.withColumn("__bin", F.floor(F.col("start") / bin_width))
    bins = rows.groupBy(*at).agg(F.max("end").alias("__reach"))
    before = Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    carried = bins.select(*at, F.max("__reach").over(before).alias("__carry"))
    here = Window.partitionBy(*at).orderBy("start")
    so_far = here.rowsBetween(Window.unboundedPreceding, 0)
    reach = F.greatest(F.col("__carry"), F.max("end").over(here.rowsBetween(Window.unboundedPreceding, -1)))
    flagged = null_safe_join(rows, carried, at).withColumns({"__new": F.when(F.col("start") <= reach, 0).otherwise(1), "__next": F.lead("start").over(here)})
    # island 0 of a bin is the rest of one that began in an earlier bin; an island's last row knows where it began and how far it reaches
    parts = flagged.withColumns({"__i": F.sum("__new").over(so_far), "__begun": F.max(F.when(F.col("__new") == 1, F.col("start"))).over(so_far), "__to": F.max("end").over(so_far)})
    parts = parts.where(F.col("__next").isNull() | (F.col("__next") > F.greatest("__carry", "__to"))).select(*at, "__i", F.col("__begun").alias("start"), F.col("__to").alias("end"))
    ends = parts.groupBy(*at).agg(F.max("__i").alias("__last"), F.max(F.when(F.col("__i") == 0, F.col("end"))).alias("__rest"))
    begun = (F.col("__last") > 0).cast("long")
    upto = Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0)
    # bins in which islands began are numbered; a rest belongs to the last number before its bin
    ends = ends.withColumn("__to", F.sum(begun).over(upto)).withColumn("__from", F.col("__to") - begun)
    rests = ends.where("__rest IS NOT NULL").groupBy(*keys, F.col("__from").alias("__to")).agg(F.max("__rest").alias("__rest"))
    leaving = null_safe_join(ends.where("__last > 0").select(*at, "__last", "__to"), rests, [*keys, "__to"]).select(*at, F.col("__last").alias("__i"), "__rest")
    out = null_safe_join(parts.where("__i > 0"), leaving, [*at, "__i"], "left")
    return out.select(*keys, "start", F.greatest("end", "__rest").alias("end"))


def gaps(df: DataFrame, keys: str | Sequence[str] = "key", bin_width: int = BIN) -> DataFrame:
    """What lies between the merged intervals of a key (introns between exons)."""
    keys = keys_of(keys)
    merged = merge_intervals(df.dropna(subset=keys), keys, bin_width).withColumn("__bin", F.floor(F.col("start") / bin_width))
    after = F.lead("start").over(Window.partitionBy(*keys, "__bin").orderBy("start"))
    firsts = merged.groupBy(*keys, "__bin").agg(F.min("start").alias("__first"))
    carried = firsts.select(*keys, "__bin", F.lead("__first").over(Window.partitionBy(*keys).orderBy("__bin")).alias("__later"))
    out = merged.withColumn("__next", after).join(carried, [*keys, "__bin"]).withColumn("__next", F.coalesce("__next", "__later"))
    return out.where(F.col("end") < F.col("__next")).select(*keys, F.col("end").alias("start"), F.col("__next").alias("end"))


def same_types(a: DataFrame, b: DataFrame, names: Sequence[str]) -> bool:
    return all(a.schema[n].dataType == b.schema[n].dataType for n in names)


def with_predecessor(points: DataFrame, intervals: DataFrame, keys: str | Sequence[str] = "key", pos: str = "pos", bin_width: int = BIN) -> DataFrame:
    """Adds p_start, p_end: the interval of the key with the greatest start <= pos (ties: the greatest end), or nulls.

    Null keys meet null keys; a null pos and intervals without a start or end find nothing."""
    return _looked_up(points, intervals, keys_of(keys), pos, bin_width, reach=False)


def _looked_up(points: DataFrame, intervals: DataFrame, keys: list[str], pos: str, bin_width: int, reach: bool) -> DataFrame:
    """with_predecessor(); or, with reach, a p_end that lies after pos exactly if any interval holds it."""
    held, index = span_index(intervals, keys)
    names = [c for c in points.columns if c not in ("p_start", "p_end")]
    if index is not None and same_types(points, held, keys):
        return points.select(*names, spans_of(index, keys, pos, reach).alias("__p")).select(*names, "__p.p_start", "__p.p_end")
    found = _predecessors(points.select(*keys, F.col(pos).cast("long").alias("__at")).distinct(), held, keys, bin_width, reach)
    at = points.select(*names).withColumn("__at", F.col(pos).cast("long"))
    return null_safe_join(at, found, [*keys, "__at"], "left").select(*names, "p_start", "p_end")


def _predecessors(spots: DataFrame, held: DataFrame, keys: list[str], bin_width: int, reach: bool) -> DataFrame:
    """keys, __at, p_start, p_end of distinct spots: a window in each (key, bin), and one row a bin carried to later ones.

    With reach, p_end is the greatest end of all spans that start at or before the spot, so that none need be merged."""
    kind = "struct<start:bigint,end:bigint>"
    left = spots.select(*keys, "__at", F.lit(1).alias("__kind"), F.lit(None).cast(kind).alias("__span"))
    right = held.select(*keys, F.col("start").cast("long").alias("__at"), F.lit(0).alias("__kind"), F.struct("start", "end").cast(kind).alias("__span"))
    both = left.unionByName(right).withColumn("__bin", F.floor(F.col("__at") / bin_width))
    here = Window.partitionBy(*keys, "__bin").orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    if reach:
        ends = {"start": F.max("__span.start"), "end": F.max("__span.end")}
        in_bin = both.withColumns({f"__in_{c}": e.over(here) for c, e in ends.items()}).where("__kind = 1")
        bins = both.groupBy(*keys, "__bin").agg(*[e.alias(f"__last_{c}") for c, e in ends.items()])
        carried = bins.select(*keys, "__bin", *[F.max(f"__last_{c}").over(before).alias(f"__carry_{c}") for c in ends])
        out = null_safe_join(in_bin, carried, [*keys, "__bin"], "left")
        return out.select(*keys, "__at", *[F.greatest(f"__in_{c}", f"__carry_{c}").alias(f"p_{c}") for c in ends])
    in_bin = both.withColumn("__in", F.last("__span", ignorenulls=True).over(here)).where("__kind = 1")
    bins = both.groupBy(*keys, "__bin").agg(F.max("__span").alias("__last"))
    carried = bins.select(*keys, "__bin", F.last("__last", ignorenulls=True).over(before).alias("__carry"))
    got = F.coalesce("__in", "__carry")
    out = null_safe_join(in_bin, carried, [*keys, "__bin"], "left")
    return out.select(*keys, "__at", got["start"].alias("p_start"), got["end"].alias("p_end"))


def asof_contains(points: DataFrame, intervals: DataFrame, keys: str | Sequence[str] = "key", pos: str = "pos", mode: str = "predecessor", bin_width: int = BIN) -> DataFrame:
    """Adds hit. "predecessor" looks at the last interval that starts at or before pos; "overlap" at all."""
    found = _looked_up(points, intervals, keys_of(keys), pos, bin_width, reach=mode == "overlap")
    return found.withColumn("hit", F.coalesce(F.col("p_end") > F.col(pos), F.lit(False))).drop("p_start", "p_end")


def overlaps(rows: DataFrame, intervals: DataFrame, keys: str | Sequence[str] = "key", bin_width: int = BIN) -> DataFrame:
    """Adds hit: whether the row's [start, end) overlaps any interval of its key.

    That is a question to those that start before the row's end: how far they reach."""
    found = _looked_up(rows.withColumn("__last", F.col("end") - 1), intervals, keys_of(keys), "__last", bin_width, reach=True)
    return found.withColumn("hit", F.coalesce(F.col("p_end") > F.col("start"), F.lit(False))).drop("__last", "p_start", "p_end")


def overlap_semi(rows: DataFrame, intervals: DataFrame, keys: str | Sequence[str] = "key") -> DataFrame:
    return overlaps(rows, intervals, keys).where("hit").drop("hit")


def overlap_anti(rows: DataFrame, intervals: DataFrame, keys: str | Sequence[str] = "key") -> DataFrame:
    return overlaps(rows, intervals, keys).where("NOT hit").drop("hit")


def label_points(points: DataFrame, intervals: DataFrame, label: str = "concept", keys: str | Sequence[str] = "key", pos: str = "pos", bin_width: int = 4096) -> DataFrame:
    """(point columns, label) for every label with an interval around the point.

    Intervals of one label are merged inside a bin, so a point meets a label once. A small set is an index of pieces with
    their labels; a larger one is a range join by bins."""
    keys = keys_of(keys)
    held, n, index = label_index(intervals, label, keys)
    if index is not None and same_types(points, held, keys):
        return points.select("*", F.explode(labels_of(index, held.schema[label].dataType, keys, pos)).alias(label))
    cut = _merged_by_bin(held, n, [label, *keys], bin_width)
    at = points.withColumn("__bin", F.floor(F.col(pos) / bin_width))
    return null_safe_join(at, cut, [*keys, "__bin"]).where((F.col("start") <= F.col(pos)) & (F.col(pos) < F.col("end"))).drop("__bin", "start", "end")


def _merged_by_bin(held: DataFrame, n: int, keys: list[str], bin_width: int) -> DataFrame:
    """keys, __bin, start, end: what the n rows cover of each bin they touch, as intervals that lie apart inside the bin.

    One shuffle to tasks of about TASK_ROWS rows, whatever their number, and one sort. Ends may lie beyond the bin."""
    at = [*keys, "__bin"]
    rows = held.select(*keys, F.floor(F.col("start") / bin_width).alias("__bin"), "start", "end")
    # of the rows that leave their bin, how far they reach goes to each bin up to the next that has such rows
    last = F.floor((F.col("end") - 1) / bin_width)
    leaving = rows.where(last > F.col("__bin")).groupBy(*at).agg(F.max("end").alias("end"))
    bins = Window.partitionBy(*keys).orderBy("__bin")
    reach = F.max("end").over(bins.rowsBetween(Window.unboundedPreceding, 0))
    carried = leaving.select(*at, reach.alias("end"), F.lead("__bin").over(bins).alias("__next"))
    carried = carried.where(last > F.col("__bin")).withColumn("__bin", F.explode(F.sequence(F.col("__bin") + 1, F.least(last, "__next"))))
    carried = carried.select(*at, (F.col("__bin") * bin_width).alias("start"), "end")
    dealt = rows.unionByName(carried).repartition(max(n // TASK_ROWS + 1, held.sparkSession.sparkContext.defaultParallelism), *at)
    here = Window.partitionBy(*at).orderBy("start")
    before = F.max("end").over(here.rowsBetween(Window.unboundedPreceding, -1))
    out = dealt.withColumns({"__before": before, "__next": F.lead("start").over(here)})
    begun = F.max(F.when(F.col("__before").isNull() | (F.col("start") > F.col("__before")), F.col("start"))).over(here.rowsBetween(Window.unboundedPreceding, 0))
    # the last row of an island knows where it began and how far it reaches
    out = out.select(*at, begun.alias("start"), F.greatest("__before", "end").alias("end"), "__next")
    return out.where(F.col("__next").isNull() | (F.col("__next") > F.col("end"))).drop("__next")


def clamp(df: DataFrame, low: int, high: int) -> DataFrame:
    """The parts of the intervals inside [low, high)."""
    hit = df.where((F.col("start") < high) & (F.col("end") > low))
    return hit.withColumns({"start": F.greatest("start", F.lit(low)), "end": F.least("end", F.lit(high))})


def nonnegative(df: DataFrame) -> DataFrame:
    return df.withColumn("start", F.greatest("start", F.lit(0))).where("start < end")


def tumble(df: DataFrame, window: int, stride: int | None = None, keep_tail: bool = False, keys: str | Sequence[str] = "key", length: str = "length") -> DataFrame:
    """Windows [i * stride, i * stride + window) over each key's length; a short tail only if asked for."""
    stride = stride or window
    last = F.col(length) - (1 if keep_tail else window)
    rows = df.where(F.col(length) >= (1 if keep_tail else window))
    rows = rows.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"), F.lit(stride).cast("long"))))
    return rows.select(*keys_of(keys), "start", F.least(F.col("start") + window, F.col(length).cast("long")).alias("end"))


def bins_of(df: DataFrame, width: int, keys: str | Sequence[str] = "key", distinct: bool = True) -> DataFrame:
    """The (key, bin) that intervals touch."""
    rows = df.where("start < end").withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))))
    rows = rows.select(*keys_of(keys), "bin")
    return rows.distinct() if distinct else rows


def set_overlap(bins: DataFrame, label: str, on: Sequence[str]) -> DataFrame:
    """a, b, n_a, n_b, both, jaccard, b_given_a for every pair of labels, also those that share no bin.

    Bins may repeat. Where the last of `on` is a whole number, sets are bitmaps and their pairs are counted bucket by bucket;
    else distinct bins are joined."""
    shared = bitmap_overlap(bins, label, on)
    if shared is None:
        held = bins.select(label, *on).distinct()
        shared = null_safe_join(held.withColumnRenamed(label, "a"), held.withColumnRenamed(label, "b"), list(on)).groupBy("a", "b").agg(F.count("*").alias("both"))
    shared = stored(shared, "shared-bins")
    sizes = shared.where(F.col("a").eqNullSafe(F.col("b")))
    pairs = sizes.select("a", F.col("both").alias("n_a")).crossJoin(small(sizes.select("b", F.col("both").alias("n_b"))))
    both = F.coalesce("both", F.lit(0))
    out = null_safe_join(pairs, shared, ["a", "b"], "left").withColumn("both", both)
    return out.withColumns({"jaccard": F.col("both") / (F.col("n_a") + F.col("n_b") - F.col("both")), "b_given_a": F.col("both") / F.col("n_a")})


def redundant(pairs: DataFrame, limit: float) -> DataFrame:
    """The label of each too similar pair that goes: the longer name, on a tie the later one."""
    p = pairs.where((F.col("a") < F.col("b")) & (F.col("jaccard") >= limit))
    return p.select(F.when(F.length("a") > F.length("b"), F.col("a")).otherwise(F.col("b")).alias("dropped")).distinct()


def mask_bins(df: DataFrame, length: int, width: int, keys: str | Sequence[str] = "key") -> DataFrame:
    """key, bin, any, all, frac of the covered positions 0..length-1; a padded last bin is never "all"."""
    keys = keys_of(keys)
    inside = clamp(merge_intervals(df, keys), 0, length)
    cut = inside.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))))
    covered = F.least(F.col("end"), (F.col("bin") + 1) * width) - F.greatest(F.col("start"), F.col("bin") * width)
    held = cut.groupBy(*keys, "bin").agg(F.sum(covered).alias("n"))
    every = df.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((length - 1) // width).cast("long"))))
    n = F.coalesce("n", F.lit(0))
    return every.join(held, [*keys, "bin"], "left").select(*keys, "bin", (n > 0).cast("int").alias("any"), (n == width).cast("int").alias("all"), (n / width).alias("frac"))


def coverage(df: DataFrame, keys: str | Sequence[str] = "key") -> DataFrame:
    """Covered positions and the sum of the raw lengths, which counts overlaps twice."""
    keys = keys_of(keys)
    merged = merge_intervals(df, keys).groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("covered"))
    return merged.join(df.groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("raw")), keys)


def prefixed(name: Column, use_chr: bool) -> Column:
    """A chromosome name with, or without, the prefix "chr"."""
    bare = F.regexp_replace(name, "^(chr)+", "")
    return F.concat(F.lit("chr"), bare) if use_chr else F.when(name.startswith("chr"), F.substring(name, 4, 1 << 20)).otherwise(name)


def uses_prefix(df: DataFrame, name: str) -> DataFrame:
    """One row: whether at least half of the names have the prefix."""
    with_ = F.sum(F.col(name).startswith("chr").cast("long"))
    return df.agg((F.coalesce(with_, F.lit(0)) * 2 >= F.count(name)).alias("use_chr"))


def split_of(name: Column, train: Sequence[str], test: Sequence[str]) -> Column:
    return F.when(name.isin(*train), "train").when(name.isin(*test), "test").otherwise("other")
