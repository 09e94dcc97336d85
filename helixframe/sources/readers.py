"""Readers: annotation text formats as DataFrames with the columns that the operators take."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.intervals import clamp, prefixed
from . import fasta

#: Lines that are no records, and the keys under which index lists are stored.
SKIPPED = r"^\s*$|^(#|track|browser)"
GTF_COLUMNS = ("chrom", "source", "feature", "start", "end", "score", "strand", "frame", "attributes")


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def stem(path: Column) -> Column:
    """A file's name without folders and extension: the concept's name."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*(\.gz)?$", "")


def bed(spark: SparkSession, path: str, strict: bool = True, length: int | None = None, concept: bool = False) -> DataFrame:
    """chrom, start, end (and concept from the file name).

    strict: tabs only, rows with fewer than three fields, without whole numbers or with end <= start go.
    Lenient: tabs or white space, no check of the ends, and a bad number raises."""
    rows = lines(spark, path).select("value", stem(F.col("_metadata.file_path")).alias("concept")).where(~F.col("value").rlike(SKIPPED))
    value = F.regexp_replace("value", r"\r$", "")
    cells = F.split(value, "\t") if strict else F.split(F.trim(value), r"\s+")
    if not strict:
        cells = F.when(F.contains(value, F.lit("\t")), F.split(value, "\t")).otherwise(cells)
    rows = rows.withColumn("c", cells).where(F.size("c") >= 3)
    to = (lambda c: c.try_cast("long")) if strict else (lambda c: c.cast("long"))
    rows = rows.select("concept", F.col("c")[0].alias("chrom"), to(F.col("c")[1]).alias("start"), to(F.col("c")[2]).alias("end"))
    if strict:
        rows = rows.where("start IS NOT NULL AND end IS NOT NULL AND end > start")
    if length is not None:
        rows = rows.where(F.col("end") - F.col("start") == length)
    return rows if concept else rows.drop("concept")


def region(intervals: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """What overlaps the region, clamped to it."""
    return clamp(intervals.where(F.col("chrom") == chrom), start, end)


def gtf(spark: SparkSession, path: str) -> DataFrame:
    """The nine columns with start moved to 0-based, and gene_id, transcript_id from the attributes."""
    schema = ", ".join(f"{c} {'long' if c in ('start', 'end') else 'string'}" for c in GTF_COLUMNS)
    rows = spark.read.csv(path, sep="\t", comment="#", schema=schema, quote="")
    ids = {n: F.nullif(F.regexp_extract("attributes", rf'{n} "([^"]+)"', 1), F.lit("")) for n in ("gene_id", "transcript_id")}
    return rows.withColumn("start", F.col("start") - 1).withColumns(ids)


def hashed_table(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """A table whose header line begins with "#": all strings, names trimmed and without quotes."""
    first = lines(spark, path).where(F.col("value").startswith("#")).first()
    if first is None:
        raise ValueError(f"no header line in {path}")
    names = [n.strip().strip('"') for n in first[0].lstrip("#").split(sep)]
    schema = ", ".join(f"`{n}` string" for n in names)
    return spark.read.csv(path, sep=sep, comment="#", schema=schema, quote='"')


def column_of(df: DataFrame, candidates: Sequence[str]) -> str:
    """The first of the names that the table has, whatever the case."""
    held = {c.lower(): c for c in df.columns}
    for c in candidates:
        if c.lower() in held:
            return held[c.lower()]
    raise KeyError(f"none of {list(candidates)} among {df.columns}")


def ccre(spark: SparkSession, path: str) -> DataFrame:
    """The six columns of a cCRE file, as strings."""
    names = ("chrom", "start", "end", "dhs_id", "ccre_id", "tags")
    rows = spark.read.csv(path, sep="\t")
    if len(rows.columns) < len(names):
        raise ValueError(f"{path} has {len(rows.columns)} columns; {len(names)} are needed")
    return rows.select(*[F.col(c).alias(n) for c, n in zip(rows.columns, names, strict=False)])


def embl(spark: SparkSession, path: str) -> DataFrame:
    """name, description, seq of each record; letters other than ACGT become N. All columns of a sequence line count."""
    records = spark.read.option("lineSep", "//\n").text(path).where(F.col("value").rlike(r"(?m)^ID\s"))
    body = F.regexp_extract("value", r"(?s)\nSQ[^\n]*\n(.*)\z", 1)
    seq = F.regexp_replace(F.upper(F.regexp_replace(body, r"[\s\d/]+", "")), "[^ACGT]", "N")
    return records.select(F.regexp_extract("value", r"(?m)^ID\s+([^\s;]+)", 1).alias("name"), F.trim(F.regexp_extract("value", r"(?m)^DE\s+(.*)$", 1)).alias("description"), seq.alias("seq")).where("seq <> ''")


def fasta_chunks(spark: SparkSession, path: str, chunk: int = 1 << 16, range_bytes: int = fasta.RANGE) -> DataFrame:
    """chrom, chunk, start, seq: a file or folder in pieces of at most `chunk` letters, upper case, read by byte ranges."""
    return fasta.fasta_pieces(spark, fasta.fasta_index(spark, path, range_bytes), chunk)


def fetch(windows: DataFrame, chunks: DataFrame, chunk: int = 1 << 16, keys: Sequence[str] = ("chrom", "start", "end")) -> DataFrame:
    """Adds seq: the letters of [start, end), clamped to what the chromosome has; an equi-join on (chrom, chunk).

    Every distinct window is fetched once and given to all rows that ask for it; unknown names and empty windows get ''."""
    w = windows.select(*keys).distinct().withColumn("__from", F.greatest(F.col("start"), F.lit(0)))
    w = w.where(F.col("end") > F.col("__from"))
    w = w.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("__from") / chunk), F.floor((F.col("end") - 1) / chunk))))
    part = w.join(chunks.withColumnRenamed("start", "__at"), ["chrom", "chunk"])
    lo = F.greatest(F.col("__from") - F.col("__at"), F.lit(0))
    n = F.least(F.col("end") - F.col("__at"), F.length("seq")) - lo
    part = part.where(n > 0).withColumn("__s", F.col("seq").substr((lo + 1).cast("int"), n.cast("int")))
    got = part.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__at", "__s"))), lambda x: x["__s"]), "").alias("seq"))
    return windows.join(got, list(keys), "left").withColumn("seq", F.coalesce("seq", F.lit("")))


def fetch_flanked(windows: DataFrame, chunks: DataFrame, flank: int, chunk: int = 1 << 16) -> DataFrame:
    """Adds seq with `flank` letters on both sides, clamped to the chromosome; names meet with or without "chr"."""
    named = chunks.withColumn("chrom", prefixed(F.col("chrom"), True))
    wide = windows.select("*", prefixed(F.col("chrom"), True).alias("__c"), F.greatest(F.col("start") - flank, F.lit(0)).alias("__s"), (F.col("end") + flank).alias("__e"))
    got = fetch(wide.select(F.col("__c").alias("chrom"), F.col("__s").alias("start"), F.col("__e").alias("end")).distinct(), named, chunk)
    got = got.select(F.col("chrom").alias("__c"), F.col("start").alias("__s"), F.col("end").alias("__e"), "seq")
    return wide.join(got, ["__c", "__s", "__e"], "left").drop("__c", "__s", "__e")


def fetch_centered(points: DataFrame, chunks: DataFrame, radius: int, pos: str = "pos", chunk: int = 1 << 16) -> DataFrame:
    """Adds seq: 2 * radius + 1 letters around the position, N beyond the ends and for unknown chromosomes."""
    at = points.withColumns({"__s": F.greatest(F.col(pos) - radius, F.lit(0)), "__e": F.greatest(F.col(pos) + radius + 1, F.lit(0))})
    got = fetch(at.select("chrom", F.col("__s").alias("start"), F.col("__e").alias("end")).distinct(), chunks, chunk)
    got = got.select("chrom", F.col("start").alias("__s"), F.col("end").alias("__e"), F.col("seq").alias("__got"))
    left = F.repeat(F.lit("N"), F.greatest(F.lit(0), F.lit(radius) - F.col(pos)).cast("int"))
    seq = F.rpad(F.concat(left, F.coalesce("__got", F.lit(""))), 2 * radius + 1, "N")
    return at.join(got, ["chrom", "__s", "__e"], "left").withColumn("seq", seq).drop("__s", "__e", "__got")


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; blank lines are skipped."""
    rows = lines(spark, path).where(F.trim("value") != "")
    return rows.select(F.from_json("value", schema).alias("r")).select("r.*")


def index_lists(spark: SparkSession, paths: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """feature: the distinct indices of JSON files that hold a list, or lists under some of the keys."""
    whole = spark.read.text(list(paths), wholetext=True)
    lists = [F.from_json("value", "array<long>"), *[F.from_json(F.get_json_object("value", f"$.{k}"), "array<long>") for k in keys]]
    every = F.flatten(F.array(*[F.coalesce(x, F.array().cast("array<bigint>")) for x in lists]))
    return whole.select(F.explode(every).alias("feature")).distinct()


def indented(text: str) -> dict:
    """Nested "key: value" lines with two blanks a level, as a small metrics file has them."""
    out: dict = {}
    levels = [out]
    for line in text.splitlines():
        m = re.match(r"^((?:  )*)([^\s:#][^:]*):\s*(.*?)\s*$", line)
        if not m:
            continue
        depth, key, value = len(m[1]) // 2, m[2].strip(), m[3]
        del levels[depth + 1 :]
        if value == "":
            levels[-1][key] = {}
            levels.append(levels[-1][key])
        else:
            try:
                levels[-1][key] = json.loads(value)
            except ValueError:
                levels[-1][key] = value.strip("'\"")
    return out


def metrics_file(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """path, metrics (a map of dotted names to numbers) of small metrics files, each parsed in the task that reads it."""

    def flat(text: str) -> dict[str, float]:
        out: dict[str, float] = {}
        todo = [("", indented(text))]
        while todo:
            prefix, d = todo.pop()
            for k, v in d.items():
                if isinstance(v, dict):
                    todo.append((f"{prefix}{k}.", v))
                elif isinstance(v, (int, float)):
                    out[prefix + k] = float(v)
        return out

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            maps = [list(flat(t).items()) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(maps, pa.map_(pa.string(), pa.float64()))], names=["path", "metrics"])

    files = spark.read.text([path] if isinstance(path, str) else list(path), wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), "value").mapInArrow(run, "path string, metrics map<string, double>")


def result_tree(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV results under .../layer<N>/step<N>/<concept>/ with layer, step and concept as columns."""
    rows = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).csv(path).withColumn("__p", F.col("_metadata.file_path"))
    return rows.withColumns({"layer": F.regexp_extract("__p", r"layer[_=]?(\d+)", 1).try_cast("int"), "step": F.regexp_extract("__p", r"step[_=]?(\d+)", 1).try_cast("long"), "concept": F.regexp_extract("__p", r"([^/]+)/[^/]+$", 1)}).drop("__p")


def with_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The named columns with their types; one that the file lacks is null, a value that does not fit as well."""
    return df.select(*[(F.col(c).try_cast(t) if c in df.columns else F.lit(None).cast(t)).alias(c) for c, t in columns.items()])


def required(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The table itself, if it has the columns."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"the input lacks {missing}; it has {df.columns}")
    return df


def labelled_paths(arguments: Sequence[str]) -> dict[str, str]:
    """label -> path of "LABEL=PATH" arguments; a plain path is labelled by its file name."""
    out = {}
    for a in arguments:
        label, equals, path = a.partition("=")
        out[label if equals else re.sub(r"\.[^./]*(\.gz)?$", "", a.rsplit("/", 1)[-1])] = path if equals else a
    return out


def shards(spark: SparkSession, path: str, splits: Sequence[str], layer: int) -> DataFrame:
    """split, shard, place: the shards of some splits of a layer in order of the splits and their names; raises if there is none."""
    order = F.array_position(F.array(*[F.lit(x) for x in splits]), F.col("split"))
    files = spark.read.parquet(path).where(F.col("split").isin(*splits) & (F.col("layer") == layer))
    plan = files.select("split", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("shard")).distinct()
    plan = plan.withColumn("place", order.cast("int"))
    if plan.isEmpty():
        raise FileNotFoundError(f"no shard of {list(splits)}, layer {layer} under {path}")
    return plan


def first_existing(spark: SparkSession, paths: Sequence[str]) -> str:
    """The first path that exists."""
    jvm = spark.sparkContext._jvm
    for p in paths:
        jp = jvm.org.apache.hadoop.fs.Path(p)
        if jp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jp):
            return p
    raise FileNotFoundError(f"none of {list(paths)}")


def evolved(df: DataFrame, name: str, older: Sequence[str]) -> DataFrame:
    """The column under its present name, read from an older one where that is what the file has."""
    held = [c for c in (name, *older) if c in df.columns]
    if not held:
        raise KeyError(name)
    return df.withColumn(name, F.coalesce(*held)).drop(*[c for c in held if c != name])


def embeddings(spark: SparkSession, path: str, splits: Sequence[str], layer: int) -> DataFrame:
    """Token rows of some splits of a layer; partitions that are not asked for are not read."""
    return spark.read.parquet(path).where(F.col("split").isin(*splits) & (F.col("layer") == layer))
