"""Incremental work: counts that grow file by file, resumable steps, and event-time windows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..cluster import stored
from ..operators.intervals import null_safe_join


def arriving(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """A Parquet folder as a stream; each file is read once."""
    return spark.readStream.schema(like.schema).parquet(path)


def daily_counts(events: DataFrame, ts: str, keys: Sequence[str], late: str = "1 day") -> DataFrame:
    """day, keys..., n, total of value; rows later than the watermark are dropped once their day is closed."""
    timed = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    agg = timed.groupBy(F.window("__ts", "1 day"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return agg.select(F.to_date("window.start").alias("day"), *keys, "n", "total")


def sessions(events: DataFrame, ts: str, key: str, gap: str, late: str = "1 day") -> DataFrame:
    """key, start, end, n of the runs of events at most `gap` apart."""
    timed = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    agg = timed.groupBy(F.session_window("__ts", gap).alias("s"), key).agg(F.count("*").alias("n"))
    return agg.select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def drain(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """All that is there now, through the streaming engine, as an in-memory table; for results of bounded size."""
    spark = stream.sparkSession
    query: StreamingQuery = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends to Parquet; after a failure the checkpoint resumes with the next file."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def accumulate(stream: DataFrame, count: Callable[[DataFrame], DataFrame], keys: Sequence[str], path: str, checkpoint: str) -> StreamingQuery:
    """Adds each batch's counts to a table of partial counts, one folder a batch, so a repeated batch replaces its own."""

    def put(batch: DataFrame, batch_id: int) -> None:
        counts = count(batch)
        counts.select(*keys, *[c for c in counts.columns if c not in keys]).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def accumulated(spark: SparkSession, path: str, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    return spark.read.parquet(path).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


def remaining(todo: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What a resumed step still has to do. A null key is a key like others."""
    return null_safe_join(todo, done.select(*keys).distinct(), list(keys), "left_anti")


def completed(expected: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    return expected.select(*keys).intersect(done.select(*keys))


def valid_state(state: DataFrame, fingerprint: str) -> DataFrame:
    """Rows of a state table that were made under the same fingerprint; with another, nothing counts as done."""
    return state.where(F.col("fingerprint") == fingerprint)


def exists(spark: SparkSession, path: str) -> bool:
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath)


def cleared(spark: SparkSession, path: str) -> None:
    """Deletes a state that is no longer needed."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


def resumed(parts: DataFrame, part: str, count: Callable[[DataFrame], DataFrame], keys: Sequence[str], sums: Sequence[str], state: str, fingerprint: str, at_most: int | None = None) -> DataFrame | None:
    """Counts by part, resumable: what `count` gives for the parts that the state does not hold is added to it.

    The state is a folder of tables under the fingerprint of the run; states of other fingerprints go, as their
    counts mean something else. Every write holds the counts of some parts and a mark for each of these, so a part is
    done also if it has no counts; a null part is a part. at_most: how many parts this call may take, in order.
    Gives the sums over all parts once none is left, and clears nothing by itself: see cleared(). Returns None while
    parts are left."""
    spark, own = parts.sparkSession, f"{state}/fingerprint={fingerprint}"
    if not exists(spark, own):
        cleared(spark, state)
    held = spark.read.parquet(own) if exists(spark, own) else None
    todo = remaining(parts, held.where("__done"), [part]) if held is not None else parts
    taken = todo.select(part).distinct()
    if at_most is not None:
        taken = taken.orderBy(part).limit(at_most)
    taken = stored(taken, "taken-parts")
    counts = count(null_safe_join(todo, taken, [part], "left_semi")).withColumn("__done", F.lit(False))
    counts.unionByName(taken.withColumn("__done", F.lit(True)), allowMissingColumns=True).write.mode("append").parquet(own)
    held = spark.read.parquet(own)
    if not remaining(parts, held.where("__done"), [part]).isEmpty():
        return None
    return held.where("NOT __done").groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


def append_new(rows: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Appends the rows whose keys the table does not hold yet, each key once, so a repeated append adds nothing.

    Null keys equal null keys: the first row without a key is kept, later ones add nothing."""
    spark = rows.sparkSession
    rows = rows.dropDuplicates(list(keys))
    if exists(spark, path):
        rows = remaining(rows, spark.read.schema(rows.schema).json(path), keys)
    rows.write.mode("append").json(path)


def exactly_once(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], ts: str | None = None, late: str = "1 day") -> StreamingQuery:
    """Appends each key of a stream once, whatever is delivered or run again; read with committed().

    Keys that were seen are state of the query: for ever, or, with ts, until the watermark has passed them by `late`. A
    batch is written to a folder of its number, which a second run of the batch replaces, and only then noted in the
    manifest: what a crash left before that is not read. Null keys equal null keys."""
    if ts:
        stream = stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))
    else:
        stream = stream.dropDuplicates(list(keys))

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/data/batch={batch_id}")
        noted = batch.sparkSession.range(1).select(F.lit(batch_id).cast("long").alias("batch"))
        noted.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/noted={batch_id}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def committed(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The rows of the batches that the manifest of exactly_once() lists; the folders of other batches are not opened."""
    if not exists(spark, f"{path}/manifest"):
        return spark.createDataFrame([], like.schema)
    noted = [r.batch for r in spark.read.parquet(f"{path}/manifest").select("batch").distinct().collect()]
    return spark.read.schema(like.schema).parquet(*[f"{path}/data/batch={b}" for b in noted]) if noted else spark.createDataFrame([], like.schema)
