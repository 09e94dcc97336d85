"""Writers: annotation text formats, fan-outs by label, result trees. Spark's commit protocol makes each write whole or absent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import number_text
from ..operators.association import rank_order


def bed(df: DataFrame, path: str, label: str | None = None, distinct: bool = False) -> None:
    out = df.select("chrom", "start", "end", *([F.lit(label).alias("label")] if label else []))
    out = out.distinct().orderBy("chrom", "start", "end") if distinct else out
    out.write.csv(path, sep="\t")


def fan_out(df: DataFrame, path: str, label: str, core: Column | None = None) -> None:
    """One folder a label; rows in `core` go to CORE__<label> as well."""
    rows = df.select("chrom", "start", "end", F.col(label).alias("label"))
    if core is not None:
        rows = rows.unionByName(df.where(core).select("chrom", "start", "end", F.concat(F.lit("CORE__"), F.col(label)).alias("label")))
    rows.write.partitionBy("label").csv(path, sep="\t")


def fan_out_tags(df: DataFrame, path: str, tags: Column, wanted: Sequence[str]) -> None:
    """A row goes to the folder of each of its wanted tags."""
    rows = df.withColumn("tag", F.explode(tags)).where(F.col("tag").isin(*wanted))
    rows.select("chrom", "start", "end", "tag").write.partitionBy("tag").csv(path, sep="\t")


def metric_rows(df: DataFrame, numbers: Sequence[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: number_text(F.col(c), digits) for c in numbers})


def result_tree(df: DataFrame, path: str, metric: str, numbers: Sequence[str], top: int = 10, concept: str = "concept", feature: str = "feature") -> None:
    """all/, top/ and summary/ of the ranked rows, partitioned by concept (the summary is one row a concept)."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(concept).orderBy(*rank_order(metric, feature)))
    ranked = metric_rows(df.withColumn("rank", rank), numbers)
    for name, rows in (("all", ranked), ("top", ranked.where(F.col("rank") <= top))):
        rows.write.partitionBy(concept).option("header", True).csv(f"{path}/{name}")
    ranked.where("rank = 1").write.option("header", True).csv(f"{path}/summary")


def jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "errorifexists").json(path)


def append_csv(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


def label_tracks(rows: DataFrame, path: str, bins: int, window: str = "window", concept: str = "concept", place: str = "bin") -> None:
    """window, concept, track: an array of `bins` flags for each window and concept with any row (window, bin, concept)."""
    held = rows.groupBy(window, concept).agg(F.collect_set(place).alias("__held"))  # at most `bins` places
    track = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.array_contains("__held", i).cast("int"))
    held.select(window, concept, track.alias("track")).write.parquet(path)


def null_tables(candidates: DataFrame, concepts: DataFrame, path: str, metadata: dict) -> None:
    """The permutation results by candidate and by concept, and how they were made."""
    candidates.write.option("header", True).csv(f"{path}/candidates")
    concepts.write.option("header", True).csv(f"{path}/concepts")
    about = candidates.sparkSession.range(1).select(*[F.lit(v).alias(k) for k, v in metadata.items()])
    sidecar(about, f"{path}/metadata")


def sidecar(df: DataFrame, path: str) -> None:
    """A few rows of run metadata, as JSON."""
    df.coalesce(1).write.json(path)


def meme_text(df: DataFrame, name: str, rows: str) -> DataFrame:
    """value: one MEME motif a row; rows: arrays of A, C, G, T weights."""
    matrix = F.array_join(F.transform(rows, lambda r: F.format_string("%.6f %.6f %.6f %.6f", r[0], r[1], r[2], r[3])), "\n")
    return df.select(F.concat(F.lit("MOTIF "), F.col(name), F.lit("\nletter-probability matrix: alength= 4 w= "), F.size(rows).cast("string"), F.lit("\n"), matrix, F.lit("\n")).alias("value"))


#: Fixed value: what a MEME file begins with.
MEME_HEAD = "MEME version 4\n\nALPHABET= ACGT\n\nstrands: + -\n\nBackground letter frequencies\nA 0.25 C 0.25 G 0.25 T 0.25\n"


def meme(df: DataFrame, path: str, name: str, rows: str) -> None:
    """The head, then the motifs; one file."""
    head = df.sparkSession.range(1).select(F.lit(0).alias("o"), F.lit("").alias("n"), F.lit(MEME_HEAD).alias("value"))
    body = meme_text(df.orderBy(name), name, rows).select(F.lit(1).alias("o"), F.split("value", "\n")[0].alias("n"), "value")
    head.union(body).orderBy("o", "n").coalesce(1).select("value").write.text(path)
