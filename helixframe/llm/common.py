"""What the operators share: written tables in the cluster's shared folder and small column helpers."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The white space that the text contracts strip or split at.
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a context, so that they need no copy of their own."""
    sc = spark.sparkContext
    if getattr(sc, "_helixframe_sent", False):
        return
    package = Path(__file__).resolve().parent.parent
    folder = os.path.realpath(tempfile.mkdtemp())
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "helixframe.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(path)
    sc._helixframe_sent = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A local session without one gets its own; a cluster must name it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), "checkpoints", f"helixframe-{os.getpid()}")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """Cuts the lineage: the rows are in the shared folder before this returns, so a lost executor costs a read, not a rerun."""
    spark = df.sparkSession
    ship(spark)
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._helix_path = path
    return out


def drop_written(df: DataFrame) -> None:
    """Deletes the files of a table that written() made and that no later plan reads."""
    spark, path = df.sparkSession, getattr(df, "_helix_path", None)
    if path:
        jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Returns this Python worker's free memory to the system: Spark uses workers again, and theirs counts as the executor's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def lean(make: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same function of batches, between tasks that begin and end without what earlier ones left in the worker."""

    def run(batches: Iterator) -> Iterator:
        give_back()
        try:
            yield from make(batches)
        finally:
            give_back()

    return run


#: Texts that a task turns into Python objects at once.
SLICE = 256


def fresh_name(df: DataFrame, name: str) -> str:
    """The name, lengthened until the table has no such column."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


def extend(df: DataFrame, column: Column, make: Callable[[pa.Array], list], added: str) -> DataFrame:
    """Adds the columns that make(values) -> list of Arrow arrays computes from slices of a column.

    Only that column goes to Python, and only the new ones come back: the other columns wait in the JVM."""
    ship(df.sparkSession)
    shape = StructType.fromDDL(added)

    def one(values: pa.Array) -> pa.Array:
        parts = [pa.StructArray.from_arrays(make(values.slice(i, SLICE)), names=shape.names) for i in range(0, max(1, len(values)), SLICE)]
        return pa.concat_arrays(parts)

    @F.arrow_udf(shape)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from lean(lambda held: map(one, held))(batches)

    got = fresh_name(df, "__got")
    # not deterministic for the optimizer, which otherwise evaluates it once a use
    out = df.withColumn(got, run.asNondeterministic()(column))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(got)[n].alias(n) for n in shape.names])


def raw(column: pa.Array) -> list:
    """The texts of an Arrow string column as UTF-8 bytes; null as empty."""
    return [x or b"" for x in column.cast("binary").to_pylist()]


def slices(column: pa.Array) -> Iterator[list]:
    """The same, a slice at a time."""
    for i in range(0, len(column), SLICE):
        yield raw(column.slice(i, SLICE))
