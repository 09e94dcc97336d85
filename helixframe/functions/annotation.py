"""From annotation records to interval sets: filters and strand-aware projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.intervals import gaps, nonnegative
from .scalar import collapsed

#: The feature types that become interval sets.
FEATURE_TYPES = ("exon", "CDS", "five_prime_UTR", "three_prime_UTR", "transcript", "gene")


def zero_based(start: Column, end: Column) -> tuple[Column, Column]:
    """1-based inclusive to 0-based half-open."""
    return start - 1, end


def of_type(gtf: DataFrame, feature: str) -> DataFrame:
    return gtf.where(F.col("feature") == feature)


def splice_sites(exons: DataFrame, radius: int) -> DataFrame:
    """site (donor, acceptor), chrom, start, end: +-radius around exon ends; any strand but "+" counts as minus."""
    plus = F.col("strand") == "+"
    donor, acceptor = F.when(plus, F.col("end")).otherwise(F.col("start")), F.when(plus, F.col("start")).otherwise(F.col("end"))
    sites = F.array(F.struct(F.lit("donor").alias("site"), donor.alias("at")), F.struct(F.lit("acceptor").alias("site"), acceptor.alias("at")))
    rows = exons.withColumn("s", F.explode(sites)).select("chrom", "s.site", (F.col("s.at") - radius).alias("start"), (F.col("s.at") + radius).alias("end"))
    return nonnegative(rows)


def promoters(transcripts: DataFrame, up: int, down: int) -> DataFrame:
    """[tss - up, tss + down] along the strand; on "-" the tss is the last base."""
    plus = F.col("strand") == "+"
    tss = F.when(plus, F.col("start")).otherwise(F.col("end") - 1)
    rows = transcripts.select("chrom", F.when(plus, tss - up).otherwise(tss - down).alias("start"), F.when(plus, tss + down + 1).otherwise(tss + up + 1).alias("end"))
    return nonnegative(rows)


def introns(exons: DataFrame) -> DataFrame:
    return gaps(exons, ["transcript_id", "chrom", "strand"])


def labelled_union(sets: dict[str, DataFrame]) -> DataFrame:
    """label, chrom, start, end of all sets; labels may overlap."""
    out = None
    for name, df in sets.items():
        rows = df.select(F.lit(name).alias("label"), "chrom", "start", "end")
        out = rows if out is None else out.unionByName(rows)
    return out


def variant_steps(assembly: str, origin: str, types: Sequence[str], longest: int, significance: Sequence[str]) -> list[tuple[str, Column]]:
    """The filters of a variant summary in order, for funnel() or for where()."""
    start, stop = F.col("Start").try_cast("long"), F.col("Stop").try_cast("long")
    return [
        ("complete", F.col("Chromosome").isNotNull() & F.col("Start").isNotNull() & F.col("Stop").isNotNull()),
        ("assembly", F.col("Assembly") == assembly),
        ("origin", F.contains(F.lower("OriginSimple"), F.lit(origin))),
        ("type", collapsed(F.col("Type")).isin(*[t.lower() for t in types])),
        ("numeric", start.isNotNull() & stop.isNotNull()),
        ("length", stop - start + 1 > 0),
        ("short", stop - start + 1 <= longest),
        ("significance", collapsed(F.col("ClinicalSignificance")).isin(*significance)),
    ]


def variants(df: DataFrame, steps: Sequence[tuple[str, Column]]) -> DataFrame:
    """chrom, start, end of the rows that pass all steps, distinct but not merged."""
    for _, condition in steps:
        df = df.where(condition)
    chrom = F.regexp_replace(F.concat(F.lit("chr"), F.col("Chromosome")), "^(chr)+", "chr")
    rows = df.select(chrom.alias("chrom"), F.greatest(F.col("Start").try_cast("long") - 1, F.lit(0)).alias("start"), F.col("Stop").try_cast("long").alias("end"))
    return rows.where("end > start").distinct()
