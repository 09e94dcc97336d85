"""Sequence profiles and displays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the order that settles ties between bases.
BASES = "ACGTN"


def sanitized(seq: Column) -> Column:
    """Upper case, anything but A, C, G, T and N as N."""
    return F.regexp_replace(F.upper(seq), "[^ACGTN]", "N")


def n_fraction(seq: Column) -> Column:
    """The share of N; an empty sequence counts as all N."""
    n = F.length(seq)
    return F.when(n > 0, (n - F.length(F.translate(seq, "Nn", ""))) / F.when(n > 0, n)).otherwise(F.lit(1.0))


def characters(df: DataFrame, seq: str, keep: Sequence[str] = ()) -> DataFrame:
    """(pos from 0, base) of each sequence."""
    return df.select(*keep, F.posexplode(F.split(seq, "")).alias("pos", "base")).where("base <> ''")


def pfm(df: DataFrame, seq: str, keys: Sequence[str] = ()) -> DataFrame:
    """Counts and frequencies by position and base."""
    n = characters(df, seq, keys).groupBy(*keys, "pos", "base").agg(F.count("*").alias("n"))
    return n.withColumn("freq", F.col("n") / F.sum("n").over(Window.partitionBy(*keys, "pos")))


def consensus(profile: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The commonest base of each position; ties in the order of BASES."""
    order = F.expr(f"instr('{BASES}', base)")
    w = Window.partitionBy(*keys, "pos").orderBy(F.desc("n"), order)
    return profile.withColumn("__r", F.row_number().over(w)).where("__r = 1").select(*keys, "pos", "base")


def centered(seq: Column, k: int) -> Column:
    """The 2 * (k // 2) + 1 characters around the middle; null if the sequence is shorter."""
    size = 2 * (k // 2) + 1
    start = (F.length(seq) / 2).cast("int") - k // 2
    return F.when(F.length(seq) >= size, seq.substr(start + 1, F.lit(size)))


def centered_kmers(df: DataFrame, seq: str, k: int, top: int) -> DataFrame:
    rows = df.select(centered(F.col(seq), k).alias("kmer")).where("kmer IS NOT NULL")
    return rows.groupBy("kmer").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kmer").limit(top)


def pwm(seq: Column, pseudo: float = 0.1) -> Column:
    """One array of A, C, G, T weights a character: one-hot with a pseudocount, normalised."""
    total = 1 + 4 * pseudo
    return F.transform(F.filter(F.split(F.upper(seq), ""), lambda c: c != ""), lambda c: F.array(*[F.when(c == b, (1 + pseudo) / total).when(c.isin(*"ACGT"), pseudo / total).otherwise(0.25) for b in "ACGT"]))


def highlighted(seq: Column, at: Column) -> Column:
    """The character at the offset in brackets; unchanged if it lies outside."""
    inside = (at >= 0) & (at < F.length(seq))
    return F.when(inside, F.concat(seq.substr(F.lit(1), at), F.lit("["), seq.substr(at + 1, F.lit(1)), F.lit("]"), seq.substr(at + 2, F.length(seq)))).otherwise(seq)


def shortened(seq: Column, limit: int) -> Column:
    """At most `limit` characters around the bracketed one (or the middle), with "..." where cut."""
    mark = F.instr(seq, "[")
    mid = F.when(mark > 0, mark).otherwise((F.length(seq) / 2).cast("int") + 1)
    start = F.greatest(F.lit(1), F.least(mid - limit // 2, F.length(seq) - limit + 1))
    cut = F.concat(F.when(start > 1, "...").otherwise(""), seq.substr(start, F.lit(limit)), F.when(start + limit <= F.length(seq), "...").otherwise(""))
    return F.when(F.length(seq) <= limit, seq).otherwise(cut)


def centered_window(seq: Column, at: Column, radius: int) -> Column:
    """2 * radius + 1 characters around the offset (from 0), padded with N beyond the ends."""
    before = F.greatest(F.lit(0), F.lit(radius) - at)
    left = F.greatest(F.lit(0), at - radius)
    body = seq.substr(left + 1, F.greatest(F.lit(0), F.lit(2 * radius + 1) - before))
    return F.rpad(F.concat(F.repeat(F.lit("N"), before.cast("int")), body), 2 * radius + 1, "N")


def pfm_text(profile: DataFrame, keys: Sequence[str] = (), bases: str = BASES) -> DataFrame:
    """keys..., text: a line of counts and a line of frequencies for each base, by position; missing cells are 0."""
    cells = profile.groupBy(*keys, "pos").pivot("base", list(bases)).agg(F.first("n"), F.first("freq"))
    rows = F.sort_array(F.collect_list(F.struct("pos", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in cells.columns if c not in (*keys, "pos")])))
    line = lambda b, of, form: F.concat(F.lit(f"{b}\t"), F.array_join(F.transform("rows", lambda r: F.format_string(form, r[of])), "\t"))
    first, second = (f"first({x})" for x in ("n", "freq"))
    text = F.concat_ws("\n", *[line(b, f"{b}_{first}", "%d") for b in bases], *[line(b, f"{b}_{second}", "%.4f") for b in bases])
    return cells.groupBy(*keys).agg(rows.alias("rows")).select(*keys, text.alias("text"))
