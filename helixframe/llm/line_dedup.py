"""Line deduplication over levelled sorted runs of line hashes.

Documents come in batches of ascending id. A batch's line keys, as 128-bit hashes with the smallest
id that holds them, are merge-joined with the runs of earlier batches; those not found form a
new sorted run at level 0. When a level holds `fanout` runs, they are merged into one run of the
next level. So the runs together hold each key once, with its smallest document. Lines whose key
belongs to a smaller document go.

Runs are tables bucketed and sorted by hash, all with the same number of buckets, so neither the joins nor
the merges move a run again: only the batch is shuffled. A batch also notes which of its keys a second
document holds; these alone, far fewer than the lines, meet the lines at the end.

Everything is DataFrame code. Only hashes are shuffled to find lines; texts move once, to meet their
dropped positions. A line in a third of all documents is one row of a run after map-side
aggregation, and the join that spreads it over its holders is broadcast, or one that adaptive execution splits.

Defined results: null or empty text is one empty line; a null id counts as one document after all
others; rows that repeat an id count as one document, so equal lines in them stay; a document that
loses every line keeps an empty text; an empty table gives an empty table; other columns are kept, whatever
their names; texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, ascii_lower, drop_written, fresh_name, new_path, written

#: The most repeated keys that are broadcast (24 bytes each), and the lines of a bucket beyond which there are more buckets.
MAX_REPEATED, PER_BUCKET = 300_000, 4_000_000
KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


class Runs:
    """The levelled runs: level -> list of bucketed tables (h1, h2, first_doc, again, fresh). A table of level 0 also holds its batch's keys that are not fresh."""

    def __init__(self, fanout: int, buckets: int | None = None):
        self.fanout, self.buckets, self.levels, self.stored = fanout, buckets, [], []

    def all(self) -> DataFrame | None:
        out = None
        for run in (r for level in self.levels for r in level):
            out = self._keys(run) if out is None else out.union(self._keys(run))
        return out

    @staticmethod
    def _keys(run: DataFrame) -> DataFrame:
        return run.where("fresh").select(*KEY, "first_doc")

    def _put(self, rows: DataFrame, level: int) -> DataFrame:
        spark = rows.sparkSession
        path = new_path(spark, f"line-run-l{level}")
        name = "helixframe_" + path.rsplit("/", 1)[-1].replace("-", "_")
        # adaptive execution does not split or merge the buckets of a join
        buckets = min(100_000, self.buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
        rows.write.bucketBy(buckets, *KEY).sortBy(*KEY).option("path", path).saveAsTable(name)
        out = spark.table(name)
        out._helix_path, out._helix_name = path, name
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(out)
        self.stored.append(out)
        return out

    def add(self, batch: DataFrame, last: bool = False) -> None:
        """batch: (h1, h2, first_doc), each hash once, and maybe again: whether two documents of the batch hold it.

        last: no other batch will be joined with the runs, so they are not merged."""
        rows = batch if "again" in batch.columns else batch.withColumn("again", F.lit(False))
        for i, run in enumerate(r for level in self.levels for r in level):
            held = self._keys(run).withColumnsRenamed({"first_doc": f"held{i}"}).withColumn(f"in{i}", F.lit(True))
            rows = rows.join(held.hint("merge"), KEY, "left")
        n = sum(map(len, self.levels))
        known = F.coalesce(*[F.col(f"in{i}") for i in range(n)], F.lit(False))
        found = F.coalesce(*[F.col(f"held{i}") for i in range(n)], F.col("first_doc"))
        self._put(rows.select(*KEY, found.alias("first_doc"), (F.col("again") | known).alias("again"), (~known).alias("fresh")), 0)
        level = 0
        while not last and len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            # no hash is in two runs, so a full join of sorted runs is their merge
            merged = self._keys(old[0])
            for run in old[1:]:
                other = self._keys(run).withColumnRenamed("first_doc", "other")
                merged = merged.join(other.hint("merge"), KEY, "full").select(*KEY, F.coalesce("first_doc", "other").alias("first_doc"))
            self._put(merged.withColumns({"again": F.lit(False), "fresh": F.lit(True)}), level + 1)
            level += 1

    def repeated(self) -> DataFrame | None:
        """h1, h2, first_doc of the keys that two documents hold."""
        out = None
        for run in self.stored:
            rows = run.where("again").select(*KEY, "first_doc")
            out = rows if out is None else out.union(rows)
        return out.groupBy(*KEY).agg(F.min("first_doc").alias("first_doc"))

    def drop(self) -> None:
        for run in self.stored:
            run.sparkSession.sql(f"DROP TABLE IF EXISTS {run._helix_name}")
            drop_written(run)
        self.levels, self.stored = [], []


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, batches: int = 4, fanout: int = 2) -> DataFrame:
    """The input columns, with text_col reduced to the lines that stay, and n_lines, n_dropped (long)."""
    spark = docs.sparkSession
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    t, k1, k2, gone_at, parts = (fresh_name(docs, n) for n in ("__t", "__k1", "__k2", "__gone", "__lines"))
    doc, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # two seeds make 128 bits: xxhash64 of (salt, value) starts from the salt's hash
    keys = [F.xxhash64(doc, F.lit("text"), text), F.xxhash64(F.lit("second"), doc, F.lit("text"), text)]

    rows = docs.select(doc.alias("id"), text.alias("t"), keys[0].alias("k1"), keys[1].alias("k2"))
    bounds = rows.select(F.percentile_approx("id", [i / batches for i in range(1, batches)], 1000)).first()[0] if batches > 1 else None
    batch = F.lit(0)
    for b in bounds or []:
        batch = batch + (F.col("id") > F.lit(b)).cast("int")
    batch = F.coalesce(batch, F.lit(batches - 1))
    lines = rows.select("id", "k1", "k2", batch.alias("batch"), F.posexplode(F.split("t", "\n", -1)).alias("pos", "line")).withColumn("key", line_key(F.col("line")))
    lines = lines.where(F.char_length("key") >= min_chars).select("id", "k1", "k2", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"), "batch")
    lines = written(lines, "lines")

    runs = Runs(fanout, max(int(spark.conf.get("spark.sql.shuffle.partitions")), lines.count() // (batches * PER_BUCKET)))
    for b in range(batches):
        one = lines.where(F.col("batch") == b).groupBy(*KEY).agg(F.min("id").alias("first_doc"), F.max("id").alias("last_doc"), F.max(F.col("id").isNull()).alias("nil"))
        again = F.coalesce((F.col("first_doc") != F.col("last_doc")) | F.col("nil"), F.lit(False)) & F.col("first_doc").isNotNull()
        runs.add(one.select(*KEY, "first_doc", again.alias("again")), last=b == batches - 1)
    repeated = written(runs.repeated(), "repeated-lines")
    runs.drop()
    few = repeated.count() <= MAX_REPEATED
    later = F.coalesce(F.col("id") > F.col("first_doc"), F.col("first_doc").isNotNull())
    gone = lines.join(F.broadcast(repeated) if few else repeated, KEY).where(later)
    gone = gone.groupBy(F.col("k1").alias(k1), F.col("k2").alias(k2)).agg(F.collect_set("pos").alias(gone_at))

    whole = docs.select(*names).withColumns({t: text, k1: keys[0], k2: keys[1]})
    out = whole.join(gone, [k1, k2], "left").withColumn(parts, F.split(t, "\n", -1))
    keep = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(gone_at)))
    kept = F.array_join(F.transform(keep, lambda i: F.col(parts)[i]), "\n")
    kept = F.when(F.col(gone_at).isNull(), F.col(t)).otherwise(kept)
    others = [kept.alias(c) if c == text_col else F.col(c) for c in names]
    return out.select(*others, F.size(parts).cast("long").alias("n_lines"), F.coalesce(F.size(gone_at), F.lit(0)).cast("long").alias("n_dropped"))
