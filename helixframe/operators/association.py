"""Feature-by-concept association: counts first, metrics as expressions over counts, ranks over metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import small

INF, NAN = float("inf"), float("nan")


def counts(active: DataFrame, labels: DataFrame, total: int, token: str = "token", feature: str = "feature", concept: str = "concept") -> DataFrame:
    """concept, feature, tp, fp, n_pos, n_neg for every pair.

    active: the (token, feature) that fire; labels: the (token, concept) that hold. One join on the token,
    aggregated before and after its shuffle; what fires outside a concept is a difference of marginals."""
    fires = active.groupBy(feature).agg(F.count("*").alias("fires"))
    holds = labels.groupBy(concept).agg(F.count("*").alias("n_pos"))
    both = active.join(labels, token).groupBy(concept, feature).agg(F.count("*").alias("tp"))
    grid = small(holds).crossJoin(fires)  # one row of features by concept is the result's own size
    out = grid.join(both, [concept, feature], "left").withColumn("tp", F.coalesce("tp", F.lit(0)))
    return out.select(concept, feature, "tp", (F.col("fires") - F.col("tp")).alias("fp"), "n_pos", (F.lit(total) - F.col("n_pos")).alias("n_neg"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is not above 0."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def with_metrics(df: DataFrame) -> DataFrame:
    """Adds the metrics of (tp, fp, n_pos, n_neg). Infinite enrichment is a value, never a division by zero."""
    tp, fp, n_pos, n_neg = (F.col(c).cast("double") for c in ("tp", "fp", "n_pos", "n_neg"))
    fn, tn = n_pos - tp, n_neg - fp
    df = df.withColumns({"recall": ratio(tp, n_pos), "fpr": ratio(fp, n_neg), "precision": ratio(tp, tp + fp)})
    den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    r, f, p = F.col("recall"), F.col("fpr"), F.col("precision")
    enrichment = F.when(f > 0, r / F.when(f > 0, f)).when(r > 0, F.lit(INF)).otherwise(F.lit(0.0))
    df = df.withColumns(
        {
            "mcc": ratio(tp * tn - fp * fn, den),
            "f1": ratio(2 * p * r, p + r),
            "specificity": ratio(tn, n_neg),
            "fnr": ratio(fn, n_pos),
            "prevalence": ratio(n_pos, n_pos + n_neg),
            "balanced_f1": ratio(2 * r, 1 + r + f),
            "enrichment": enrichment,
        }
    )
    e = F.col("enrichment")
    return df.withColumn("log2_enrichment", F.when(e == INF, F.lit(INF)).when(e > 0, F.log2(F.when(e > 0, e))).otherwise(F.lit(-INF)))


def finite(c: Column) -> Column:
    """The value, or null if it is not a finite number."""
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(INF)), c)


def rank_order(metric: str, tie: str) -> list[Column]:
    """Finite values descending, then all others; ties go to the lower id."""
    return [finite(F.col(metric)).desc_nulls_last(), F.col(tie).asc()]


def ranked(df: DataFrame, metric: str, concept: str = "concept", feature: str = "feature", top: int | None = None) -> DataFrame:
    out = df.withColumn("rank", F.row_number().over(Window.partitionBy(concept).orderBy(*rank_order(metric, feature))))
    return out.where(F.col("rank") <= top) if top else out


def exclude(df: DataFrame, indices: DataFrame, feature: str = "feature") -> DataFrame:
    return df.join(indices.select(feature).distinct(), feature, "left_anti")


def counts_from_rates(df: DataFrame) -> DataFrame:
    """tp and fp again from stored rates, rounded half to even."""
    return df.withColumns({"tp": F.bround("tp", 0).cast("long"), "fp": F.bround(F.col("fpr") * F.col("n_neg"), 0).cast("long")})


def firing_rate() -> Column:
    return ratio(F.col("tp").cast("double") + F.col("fp"), F.col("n_pos").cast("double") + F.col("n_neg"))
