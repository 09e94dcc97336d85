"""Mixing sources to target weights.

Sizes are counted a document, summed a source, and turned into targets: every source gets its weight's share of the
mix, but at most `most` times its own size; what is over is shared again by weight among the others. A source's rate is its
target over its size: each document is taken floor(rate) times, and once more if its draw, a number made from its id by
hash, is below the rate's fraction.

A single seed leaves a source of few or very uneven documents away from its target, by a standard deviation of
sqrt(f * (1 - f) * sum of squared sizes) words. So each source tries `trials` seeds, each a whole set of draws of the same
probability, and keeps the one that comes nearest (of equal ones the first).

Everything is DataFrame code. Documents are not shuffled: their sizes are summed on the map side, and the table of
sources comes back to them by broadcast where it is counted to be small, else by a join in which each source is spread over
SALT keys. Sources are ranked in ranges and the water line of the targets is found by sums over their table, so nothing
of theirs is held in one task or in the driver but sums.

Defined results: a null text has size 0; a null source is a source of its own, after all others; a source without
words has target 0 and is not taken; rows that repeat an id have the same draw; rows of null id draw by their text
where there is one; an empty table gives an empty table; input columns are kept, and those named like an added one are
replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_name, written

WORD = r"[^\x20\x09-\x0D]+"
#: The most sources that are broadcast, and the keys over which a source is spread beyond that.
MAX_SOURCES, SALT = 100_000, 64
ADDED = ["size", "source_size", "target", "copies", "taken"]


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draws(key: Column, trials: int) -> list[Column]:
    """A 32-bit draw for each seed: a quarter of the MD5 of `block:key` each."""
    digests = [F.md5(F.concat(F.lit(f"{b}:"), key).cast("binary")) for b in range(-(-trials // 4))]
    return [F.conv(F.substring(digests[j // 4], 8 * (j % 4) + 1, 8), 16, 10).cast("long") for j in range(trials)]


def source_targets(sized: DataFrame, source: str, size: str, weights: Sequence[int], share: float, most: int) -> DataFrame:
    """source, source_size, weight, target: one row a source of the rows' (source, size)."""
    name, total = fresh_name(sized, "__s"), fresh_name(sized, "__n")
    groups = sized.groupBy(F.col(source).alias(name)).agg(F.sum(size).alias(total))
    order = F.col(name).asc_nulls_last()
    # ranges of the sorted sources are numbered where they lie; a source's rank is its range's offset and its place there
    ranged = written(groups.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "mix-sources")
    parts = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(parts.select("part", before.alias("before")))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    out = ranged.join(offsets, "part").select(F.col(name).alias("source"), F.col(total).alias("source_size"), weight.alias("weight"))
    out = written(out.withColumn("cap", F.col("source_size") * most), "mix-weights")

    # the water line: caps below it are filled, the others share the rest by weight; each step can only raise it
    wanted, line = share * (out.agg(F.sum("source_size")).first()[0] or 0), 0.0
    while True:
        full = F.col("cap") <= F.lit(line) * F.col("weight")
        filled, open_ = out.agg(F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        raised = (wanted - (filled or 0)) / open_ if open_ else line
        if raised <= line:
            break
        line = raised
    low = F.lit(line) * F.col("weight")
    return out.select("source", "source_size", "weight", F.when(F.col("cap") <= low, F.col("cap").cast("double")).otherwise(low).alias("target"))


def with_source(rows: DataFrame, source: str, per_source: DataFrame, salt: Column) -> DataFrame:
    """Adds the columns of a table of sources (null meets null), whose key is `source`, to rows."""
    key, salted = fresh_name(rows, "__source"), fresh_name(rows, "__salt")
    per_source = per_source.withColumnRenamed("source", key)
    same = F.col(source).eqNullSafe(F.col(key))
    if per_source.limit(MAX_SOURCES + 1).count() <= MAX_SOURCES:
        return rows.join(F.broadcast(per_source), same).drop(key)
    spread = per_source.withColumn(salted + "r", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    rows = rows.withColumn(salted, F.pmod(F.xxhash64(salt), F.lit(SALT)).cast("int"))
    return rows.join(spread, same & (F.col(salted) == F.col(salted + "r"))).drop(key, salted, salted + "r")


def mixed(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: int = 2, trials: int = 16, source: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds size, source_size (long), target (double), copies (int) and taken (long) to every document.

    weights: of the sources in order of code points, repeated as often as needed; share: the mix's size as a part of all
    sizes; most: how often a document may be taken; trials: the seeds that a source tries."""
    if share <= 0 or share > most or not weights or min(weights) <= 0 or trials < 1:
        raise ValueError("weights must be positive, and the mix must not be larger than `most` copies of all")
    docs = docs.select(*[c for c in docs.columns if c not in ADDED])
    sized = docs.withColumn("size", size_of(F.col(text_col).cast("string")))
    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text:"), F.md5(F.col(text_col).cast("binary"))), F.lit(""))
    narrow = written(sized.select(F.col(source).alias("s"), key.alias("k"), "size"), "mix-sizes")
    rated = source_targets(narrow, "s", "size", weights, share, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rated = rated.withColumn("whole", F.floor(rate).cast("int")).withColumn("limit", (rate - F.col("whole")) * float(1 << 32))
    rated = written(rated, "mix-rates")

    tried = with_source(narrow, "s", rated, F.col("k"))
    sums = [F.sum(F.when(d < F.col("limit"), F.col("size")).otherwise(0)).alias(f"t{j}") for j, d in enumerate(draws(F.col("k"), trials))]
    per = tried.groupBy("s").agg(F.first("source_size").alias("n"), F.first("target").alias("t"), F.first("whole").alias("w"), *sums)
    missed = [F.abs(F.col("w") * F.col("n") + F.col(f"t{j}") - F.col("t")) for j in range(trials)]
    seed = F.array_position(F.array(*missed), F.least(*missed) if trials > 1 else missed[0]).cast("int") - 1
    seeds = written(per.select(F.col("s").alias("source"), seed.alias("seed")), "mix-seeds")
    rated = rated.alias("r").join(seeds.alias("q"), F.expr("r.source <=> q.source")).select("r.*", "q.seed")
    add = ["source_size", "target", "whole", "limit", "seed"]
    own = {c: fresh_name(sized, f"__{c}") for c in add}
    out = with_source(sized, source, rated.select("source", *[F.col(c).alias(n) for c, n in own.items()]), key)
    draw = F.element_at(F.array(*draws(key, trials)), F.col(own["seed"]) + 1)
    copies = F.col(own["whole"]) + F.when(draw < F.col(own["limit"]), 1).otherwise(0)
    out = out.withColumn(own["whole"], copies.cast("int"))
    n = F.col(own["whole"])
    return out.select(*sized.columns, F.col(own["source_size"]).alias("source_size"), F.col(own["target"]).alias("target"), n.alias("copies"), (n * F.col("size")).alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, numbered from 0 in `copy` (int)."""
    out = mixed(docs, **options).where("copies > 0")
    names = [c for c in out.columns if c not in (*ADDED, "copy")]
    return out.select(*names, F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
