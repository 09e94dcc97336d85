"""Interpretation records: prompts from ranked examples, scores from answers, and the atlas that joins them.

Asking a model is a function that the caller passes in; everything around it is relational."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import int_list, quality_flag, score_category, section
from ..operators.statistics import correlation
from ..operators.steering import numbered
from ..operators.topk import override, rank_slice, scaled_0_10, top_n


def normalised(examples: DataFrame, feature: str = "feature", act: str = "act") -> DataFrame:
    return examples.withColumn("norm", scaled_0_10(F.col(act), feature))


def prompts(examples: DataFrame, enrichment: DataFrame, shown: int, holdout: tuple[int, int], feature: str = "feature") -> DataFrame:
    """feature, prompt, holdout_sequences, holdout_activations: the best examples are shown, a slice of ranks is held out."""
    best = top_n(examples, [feature], [F.desc("norm"), F.asc("rank")], shown, "__r")
    line = F.format_string("%02d. %s (%d)", F.col("__r"), F.col("context"), F.col("norm"))
    block = best.groupBy(feature).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__r", line.alias("l")))), lambda s: s["l"]), "\n").alias("block"))
    held = rank_slice(examples, [feature], [F.asc("rank")], holdout[0], holdout[1], "__h")
    lists = held.groupBy(feature).agg(F.sort_array(F.collect_list(F.struct("__h", "context", "norm"))).alias("h"))
    out = block.join(lists, feature, "left").join(enrichment, feature, "left")
    text = F.concat(F.lit("Annotations: "), F.coalesce("enrichment", F.lit("none known")), F.lit("\nExamples:\n"), F.col("block"))
    empty = F.array().cast("array<string>"), F.array().cast("array<int>")
    return out.select(feature, text.alias("prompt"), F.coalesce(F.transform("h", lambda s: s["context"]), empty[0]).alias("holdout_sequences"), F.coalesce(F.transform("h", lambda s: s["norm"]), empty[1]).alias("holdout_activations"))


class Transient(Exception):
    """What a caller's model raises when another try may help."""


def asked(df: DataFrame, prompt: str, ask: Callable[[str], str], answer: str = "answer", tries: int = 3, wait: float = 0.0, transient: type[Exception] = Transient) -> DataFrame:
    """Adds the answer to each prompt, error (null if there is none) and attempts.

    A transient error is tried again after attempt * wait seconds, any other one is final; both leave a null answer."""
    fields = ", ".join(f"`{n}` {t}" for n, t in df.dtypes if n not in (answer, "error", "attempts")) + f", `{answer}` string, error string, attempts int"

    def one(p: str) -> tuple[str | None, str | None, int]:
        import time

        for k in range(1, tries + 1):
            try:
                return ask(p), None, k
            except transient as e:
                error = str(e)
                if k < tries:
                    time.sleep(wait * k)
            except Exception as e:
                return None, str(e), k
        return None, error, tries

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            got = [one(p) for p in b.column(prompt).to_pylist()]
            cols = [pa.array([g[i] for g in got], t) for i, t in enumerate((pa.string(), pa.string(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, answer, "error", "attempts"])

    return df.drop(answer, "error", "attempts").mapInArrow(run, fields)


def explanations(df: DataFrame, answer: str = "answer") -> DataFrame:
    """Adds hypothesis, evidence, confidence (lower case) and parse_ok: whether hypothesis and confidence are there."""
    a = F.col(answer)
    sure = F.nullif(F.lower(F.regexp_extract(a, r"(?i)CONFIDENCE\s*:\s*(HIGH|MEDIUM|LOW)", 1)), F.lit(""))
    ok = F.col("hypothesis").isNotNull() & F.col("confidence").isNotNull()
    return df.withColumns({"hypothesis": section(a, "HYPOTHESIS"), "evidence": section(a, "EVIDENCE"), "confidence": sure}).withColumn("parse_ok", ok)


#: What a model is told and asked, by step; braces are filled from columns of the same name.
TEMPLATES = {
    "explain_system": "You see stretches of sequence on which one feature is most active, with what is annotated there.",
    "explain": "Feature {feature}\n{prompt}\nName the pattern as HYPOTHESIS, EVIDENCE and CONFIDENCE (high, medium or low), a line each.",
    "simulate_system": "You predict how active a feature is, as a whole number from 0 to 10 for each sequence.",
    "simulate": "Hypothesis: {hypothesis}\n{n_examples} sequences:\n{sequences}\nAnswer with a JSON list of {n_examples} numbers.",
    "recluster_system": "A feature may have several meanings; each group of its examples is explained for itself.",
    "recluster": "Feature {feature} scored {score} with: {hypothesis}\n{blocks}\nFor each group write SUBCLUSTER n: and then HYPOTHESIS, EVIDENCE and CONFIDENCE.",
    "consistency_system": "You compare a hypothesis with the share of examples in each annotation.",
    "consistency": "Feature {feature}\nHypothesis: {hypothesis}\n{annotations}\nAnswer with CONSISTENT: yes, no or partial, then ISSUES and REVISED_HYPOTHESIS.",
    "label_system": "You name groups of hypotheses in a few words.",
    "label": "Group {cluster} of {n} features:\n{hypotheses}\nAnswer with LABEL and DESCRIPTION.",
}


def filled(template: str) -> Column:
    """The template with each {column} replaced by the column's text, null as nothing."""
    parts = re.split(r"\{(\w+)\}", TEMPLATES.get(template, template))
    return F.concat(*[F.coalesce(F.col(p).cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def simulations(df: DataFrame, sequences: str = "holdout_sequences") -> DataFrame:
    """Adds prompt: the held-out sequences, numbered, under the hypothesis."""
    rows = df.withColumns({"n_examples": F.size(sequences), "sequences": numbered(F.col(sequences))})
    return rows.withColumn("prompt", filled("simulate")).drop("n_examples", "sequences")


def recluster_prompts(examples: DataFrame, explained: DataFrame, shown: int = 10, feature: str = "feature") -> DataFrame:
    """feature, prompt, n_clusters: each cluster with its size, mean activation and best examples, under the first hypothesis.

    examples: feature, cluster, norm, place, context; explained: feature, hypothesis, score."""
    size = examples.groupBy(feature, "cluster").agg(F.count("*").alias("n"), F.round(F.avg("norm"), 2).alias("mean"))
    best = top_n(examples, [feature, "cluster"], [F.desc("norm"), F.asc("place")], shown, "__r")
    line = F.format_string("  [%d] activation %d/10 | %s\n      %s", F.col("__r"), F.col("norm"), F.col("place"), F.col("context"))
    text = best.groupBy(feature, "cluster").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__r", line.alias("l")))), lambda s: s["l"]), "\n").alias("lines"))
    block = F.format_string("Sub-cluster %d (%d examples, mean activation %.2f):\n%s", F.col("cluster") + 1, F.col("n"), F.col("mean"), F.col("lines"))
    blocks = size.join(text, [feature, "cluster"]).groupBy(feature).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("cluster", block.alias("b")))), lambda s: s["b"]), "\n\n").alias("blocks"), F.count("*").alias("n_clusters"))
    return blocks.join(explained, feature).withColumn("prompt", filled("recluster")).select(feature, "prompt", "n_clusters")


def recluster_answers(df: DataFrame, answer: str = "answer", feature: str = "feature") -> DataFrame:
    """feature, cluster (from 1), hypothesis, evidence, confidence, parse_ok for each "SUBCLUSTER n:" part of an answer."""
    parts = df.select(feature, F.explode(F.regexp_extract_all(F.col(answer), F.lit(r"(?is)(SUBCLUSTER\s+\d+\s*:.*?)(?=\n\s*SUBCLUSTER\s+\d+\s*:|\z)"), F.lit(1))).alias("part"))
    number = F.regexp_extract("part", r"(?i)SUBCLUSTER\s+(\d+)", 1).cast("int")
    body = F.regexp_replace("part", r"(?i)^SUBCLUSTER\s+\d+\s*:\s*", "")
    return explanations(parts.select(feature, number.alias("cluster"), body.alias("part")), "part").drop("part")


def best_of(first: DataFrame, parts: DataFrame, feature: str = "feature") -> DataFrame:
    """feature, hypothesis, r, improved: the best scored part where it is above the first score, else the first (a missing score counts as -2)."""
    best = parts.groupBy(feature).agg(F.max(F.struct(F.coalesce("r", F.lit(-2.0)).alias("r"), (-F.col("cluster")).alias("c"), "hypothesis")).alias("b"))
    rows = first.join(best, feature, "left")
    better = F.coalesce(F.col("b.r") > F.coalesce("r", F.lit(-2.0)), F.lit(False))
    return rows.select(feature, F.when(better, F.col("b.hypothesis")).otherwise(F.col("hypothesis")).alias("hypothesis"), F.when(better, F.col("b.r")).otherwise(F.col("r")).alias("r"), better.alias("improved"))


def consistency(df: DataFrame, answer: str = "answer") -> DataFrame:
    """Adds verdict (YES, NO, PARTIAL or UNKNOWN), consistent (null unless yes or no), issues, revised (the hypothesis if the answer has none)."""
    a = F.col(answer)
    said = F.nullif(F.upper(F.regexp_extract(a, r"(?i)CONSISTENT\s*:\s*(YES|NO|PARTIAL)", 1)), F.lit(""))
    verdict = F.coalesce(said, F.lit("UNKNOWN"))
    return df.withColumns({"verdict": verdict, "consistent": F.when(said == "YES", True).when(said == "NO", False), "issues": F.coalesce(section(a, "ISSUES"), F.lit("")), "revised": F.coalesce(section(a, "REVISED_HYPOTHESIS"), F.col("hypothesis"))})


def cluster_labels(df: DataFrame, answer: str = "answer", cluster: str = "cluster") -> DataFrame:
    """Adds label ("Cluster n" if the answer has none) and description."""
    a = F.col(answer)
    found = lambda n: F.nullif(F.trim(F.regexp_extract(a, rf"{n}\s*:\s*([^\n]*)", 1)), F.lit(""))
    return df.withColumns({"label": F.coalesce(found("LABEL"), F.concat(F.lit("Cluster "), F.col(cluster).cast("string"))), "description": F.coalesce(found("DESCRIPTION"), F.lit(""))})


def label_prompts(df: DataFrame, cluster: str = "cluster", shown: int = 15) -> DataFrame:
    """cluster, n, prompt over the first hypotheses of each cluster, by feature."""
    first = top_n(df, [cluster], [F.asc("feature")], shown, "__r")
    line = F.format_string("  [%d] %s", F.col("__r"), F.col("hypothesis"))
    text = first.groupBy(cluster).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__r", line.alias("l")))), lambda s: s["l"]), "\n").alias("hypotheses"))
    return df.groupBy(cluster).agg(F.count("*").alias("n")).join(text, cluster).withColumn("prompt", filled("label")).drop("hypotheses")


def star(features: DataFrame, sides: dict[str, DataFrame], feature: str = "feature") -> DataFrame:
    """One row a feature with the columns of all side tables, each of them null where it has no row."""
    for df in sides.values():
        features = features.join(df, feature, "left")
    return features


def scores(df: DataFrame, feature: str = "feature", answer: str = "answer", real: str = "holdout_activations") -> DataFrame:
    """feature, predicted, r (0 if undefined, null if the answer cannot be read), category."""
    rows = df.withColumn("predicted", int_list(F.col(answer), F.size(real)))
    pairs = rows.where("predicted IS NOT NULL").select(feature, F.explode(F.arrays_zip(F.col("predicted").alias("p"), F.col(real).alias("a"))).alias("z")).select(feature, "z.*")
    r = pairs.groupBy(feature).agg(correlation("p", "a", 3, 0.0).alias("r"))
    return rows.join(r, feature, "left").withColumn("category", score_category(F.col("r")))


def merged(first: DataFrame, again: DataFrame, key: str = "feature", columns: Sequence[str] = ("hypothesis", "r")) -> DataFrame:
    """The rescored row where it is marked as improved and scores higher."""
    take = F.col("r.improved") & (F.col("r.r") > F.coalesce(F.col("l.r"), F.lit(-2.0)))
    return override(first, again, key, take, columns)


def atlas(rows: DataFrame) -> DataFrame:
    return rows.withColumn("flag", quality_flag(F.col("r"), F.col("consistent")))


def clusters(df: DataFrame, vector: Sequence[str], k: int, seed: int = 42) -> DataFrame:
    """Adds cluster: k-means over standardised columns (null counts as 0)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    filled = df.fillna(0.0, list(vector))
    raw = VectorAssembler(inputCols=list(vector), outputCol="__v").transform(filled)
    scaled = StandardScaler(inputCol="__v", outputCol="__s", withMean=True).fit(raw).transform(raw)
    out = KMeans(k=k, seed=seed, featuresCol="__s", predictionCol="cluster").fit(scaled).transform(scaled)
    return out.drop("__v", "__s")


def cluster_summary(df: DataFrame, chrom: str, act: str, keys: Sequence[str]) -> DataFrame:
    """keys..., n, mean_act, the three commonest chromosomes."""
    n = df.groupBy(*keys, chrom).agg(F.count("*").alias("c"))
    top = n.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("c"), F.asc(chrom)))).where("__r <= 3")
    names = top.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__r", chrom))), lambda s: s[chrom].cast("string")), ",").alias("top"))
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(act).alias("mean_act")).join(names, list(keys))


def feature_reports(table: DataFrame, dense: float, top: int = 10) -> DataFrame:
    """feature, place, kind ("sparse" or "dense"), report: a block of text a feature, sparse ones first, each kind by best f1.

    table: concept, feature, f1, rate. A concept names a feature if it is among its `top` by f1."""
    ranked = top_n(table, ["concept"], [F.desc_nulls_last("f1"), F.asc("feature")], top, "__r").select("concept", "feature", F.lit(True).alias("__top"))
    rows = table.join(ranked, ["concept", "feature"], "left")
    name = F.col("concept").cast("string")
    per = rows.groupBy("feature").agg(F.first("rate").alias("rate"), F.max(F.struct("f1", name.alias("c"))).alias("best"), F.sort_array(F.collect_list(F.when(F.col("__top"), name))).alias("named"))
    kind = F.when(F.col("rate") > dense, "dense").otherwise("sparse")
    text = F.concat(
        F.format_string("## Feature %d (%s, fires on %.2f %% of tokens)\n", "feature", kind, F.round(100 * F.col("rate"), 2)),
        F.format_string("Best match: %s, F1 %.3f\n", F.col("best.c"), F.round("best.f1", 3)),
        F.when(F.size("named") > 0, F.format_string("Among the first %d of %d concepts: %s", F.lit(top), F.size("named"), F.array_join("named", ", "))).otherwise(F.lit("Among the first of no concept")),
    )
    place = F.row_number().over(Window.orderBy(F.desc("kind"), F.desc("__f1"), F.asc("feature")))
    return per.select("feature", kind.alias("kind"), F.col("best.f1").alias("__f1"), text.alias("report")).withColumn("place", place).drop("__f1")


def run_steps(steps: Sequence[tuple[str, Callable[[], None]]], start: str | None = None, only: Sequence[str] = ()) -> list[str]:
    """Runs the named steps in order from `start`; stops at the first that raises."""
    names = [n for n, _ in steps]
    todo = [(n, f) for n, f in steps[names.index(start) if start else 0 :] if not only or n in only]
    done = []
    for name, f in todo:
        f()
        done.append(name)
    return done
