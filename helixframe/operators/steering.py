"""What steering and null runs need around their model: targets, candidates, windows to probe, and loss tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import token_midpoint
from .intervals import asof_contains


def feature_group(df: DataFrame, limit: float, metric: str = "mcc", feature: str = "feature") -> DataFrame:
    """The distinct features that reach the limit in any concept."""
    return df.where(F.col(metric) >= limit).select(feature).distinct().orderBy(feature)


def candidates(df: DataFrame, top: int, concept: str = "concept", feature: str = "feature", rank: str = "rank") -> DataFrame:
    """The distinct (concept, feature) among the first `top` ranks."""
    return df.where(F.col(rank) <= top).select(concept, feature).distinct()


def own_candidates(rows: DataFrame, own: DataFrame, concept: str = "concept", feature: str = "feature") -> DataFrame:
    """Rows of a concept's own candidates; a concept without any keeps all its rows."""
    marked = rows.join(own.select(concept, feature).distinct().withColumn("__own", F.lit(True)), [concept, feature], "left")
    some = own.select(concept).distinct().withColumn("__some", F.lit(True))
    return marked.join(some, concept, "left").where(F.col("__own") | F.col("__some").isNull()).drop("__own", "__some")


def resolved_targets(specs: DataFrame, best: DataFrame, default_layer: int, spec: str = "spec") -> DataFrame:
    """concept, layer, feature of specs "concept[:layer[:feature]]"; what is missing comes from the best features (concept, layer, feature)."""
    parts = F.split(spec, ":")
    rows = specs.select(F.get(parts, F.lit(0)).alias("concept"), F.coalesce(F.get(parts, F.lit(1)).try_cast("int"), F.lit(default_layer)).alias("layer"), F.get(parts, F.lit(2)).try_cast("int").alias("__f"))
    known = best.select("concept", "layer", F.col("feature").alias("__best"))
    return rows.join(known, ["concept", "layer"], "left").select("concept", "layer", F.coalesce("__f", "__best").alias("feature"))


def probed_windows(windows: DataFrame, intervals: DataFrame, n: int, step: int = 8, key: str = "key", order: str = "id") -> DataFrame:
    """The first n windows (key, start, end, id) with an interval at one of their probe points, `step` apart."""
    points = windows.where("start < end").withColumn("pos", F.explode(F.sequence(F.col("start"), F.col("end") - 1, F.lit(step).cast("long"))))
    hit = asof_contains(points, intervals, key, "pos", "overlap").where("hit").select(order).distinct()
    return windows.join(hit, order, "left_semi").orderBy(order).limit(n)


def loss_changes(df: DataFrame, keys: Sequence[str], loss: str = "loss", factor: str = "factor", active: str = "active", inside: str = "inside") -> DataFrame:
    """keys..., factor, mean loss over all, active and concept positions, and the change of each against factor 1."""
    sets = {"all": F.lit(True), "active": F.col(active), "concept": F.col(inside)}
    means = df.groupBy(*keys, factor).agg(*[F.avg(F.when(c, F.col(loss))).alias(f"ce_{n}") for n, c in sets.items()])
    base = Window.partitionBy(*keys)
    return means.withColumns({f"dce_{n}": F.col(f"ce_{n}") - F.max(F.when(F.col(factor) == 1, F.col(f"ce_{n}"))).over(base) for n in sets})


def top_columns(df: DataFrame, key: str, columns: Sequence[str], top: int) -> DataFrame:
    """key, column, value, rank: the `top` highest of some columns of each row, ties by name."""
    long = df.unpivot([key], list(columns), "column", "value").where("value IS NOT NULL")
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("value"), F.asc("column")))
    return long.withColumn("rank", rank).where(F.col("rank") <= top)


def warm_then_cosine(step: Column, warm: int, total: int, peak: float) -> Column:
    """A rate that rises linearly and then falls along a half cosine."""
    along = (step - warm) / F.lit(max(1, total - warm))
    return F.when(step < warm, peak * (step + 1) / F.lit(max(1, warm))).otherwise(peak * 0.5 * (1 + F.cos(F.least(F.lit(1.0), along) * F.lit(3.141592653589793))))


def numbered(sequences: Column) -> Column:
    """"Seq 01: ..." lines of an array of strings."""
    return F.array_join(F.transform(sequences, lambda s, i: F.format_string("Seq %02d: %s", i + 1, s)), "\n")


def window_of(one: Column, tokens: Column) -> Column:
    """(chrom, start, end) of a window from its triple or, in the older form, from its tokens' triples; null without a chromosome."""
    span = F.when(F.size(tokens) > 0, F.struct(tokens[0]["chrom"].alias("chrom"), tokens[0]["start"].alias("start"), F.element_at(tokens, -1)["end"].alias("end")))
    w = F.coalesce(one, span)
    return F.when((w["chrom"] != "") & w["start"].isNotNull() & w["end"].isNotNull(), w)


def place_text(window: Column) -> Column:
    return F.concat(window["chrom"], F.lit(":"), window["start"].cast("string"), F.lit("-"), window["end"].cast("string"))


def token_bases(rows: DataFrame, length: int | None = None, tok: str = "tok") -> DataFrame:
    """start, end become the one base in the middle of the token's share of the window; without a length a token is a base."""
    size = F.lit(length) if length else F.greatest(F.lit(1), F.col("end") - F.col("start"))
    mid = token_midpoint(F.col("start"), F.col("end"), F.col(tok), size)
    return rows.withColumn("__mid", mid).withColumns({"start": F.col("__mid"), "end": F.col("__mid") + 1}).drop("__mid")
