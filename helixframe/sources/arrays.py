"""NumPy archives (.npz) as tables: one row of numbers a row of a member, read member by member, and written.

Archives are opened by pyarrow, so local, HDFS, S3 and GS paths work. A task reads one member in blocks of rows, whatever its
size; a member in column order is read whole. Members of one dimension have one number a row, a single number is row 0.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import ship

#: Numbers that a task reads or writes at once.
BLOCK = 1 << 20


def located(path: str) -> tuple[pa.fs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return pa.fs.FileSystem.from_uri(path if "://" in path else "file://" + path)


def header(f) -> tuple[tuple[int, ...], bool, np.dtype]:
    """Shape, whether it is in column order, and type, of an array file that stands at its beginning."""
    version = np.lib.format.read_magic(f)
    return (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)


def members_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column(0).to_pylist():
            store, name = located(path)
            with store.open_input_file(name) as f, zipfile.ZipFile(f) as z:
                found = [(path, m.removesuffix(".npy"), *self_described(z, m)) for m in z.namelist() if m.endswith(".npy")]
            columns = list(zip(*found, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.list_(pa.int64())), pa.array(columns[3], pa.string())], names=["path", "member", "shape", "type"])


def self_described(z: zipfile.ZipFile, member: str) -> tuple[list[int], str]:
    with z.open(member) as f:
        shape, _, kind = header(f)
    return list(shape), kind.str


def npz_members(spark: SparkSession, path: str) -> DataFrame:
    """path, member, shape, type of an archive or a folder of them."""
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path").where(F.col("path").endswith(".npz"))
    return files.mapInArrow(members_of, "path string, member string, shape array<long>, type string")


def blocks_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, member in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            store, name = located(path)
            with store.open_input_file(name) as raw, zipfile.ZipFile(raw) as z, z.open(member + ".npy") as f:
                shape, columns_first, kind = header(f)
                if kind.kind not in "biuf":
                    raise ValueError(f"{member} of {path} holds {kind}, not numbers")
                n, width = (shape[0] if shape else 1), int(np.prod(shape[1:], dtype=np.int64)) if len(shape) > 1 else 1
                whole = np.frombuffer(f.read(), dtype=kind).reshape(shape, order="F").reshape(n, width) if columns_first and len(shape) > 1 else None
                step = max(1, BLOCK // max(1, width))
                for low in range(0, n, step):
                    k = min(step, n - low)
                    x = whole[low : low + k] if whole is not None else np.frombuffer(f.read(k * width * kind.itemsize), dtype=kind).reshape(k, width)
                    flat = pa.array(np.ascontiguousarray(x).reshape(-1).astype(np.float64))
                    values = pa.ListArray.from_arrays(pa.array(np.arange(k + 1, dtype=np.int32) * width), flat)
                    yield pa.RecordBatch.from_arrays([pa.array([path] * k), pa.array([member] * k), pa.array(np.arange(low, low + k)), values], names=["path", "member", "row", "values"])


def read_npz(spark: SparkSession, path: str, members: list[str] | None = None) -> DataFrame:
    """path, member, row, values (array<double>): every member in a task of its own."""
    held = npz_members(spark, path).select("path", "member")
    if members is not None:
        held = held.where(F.col("member").isin(*members))
    n = held.count()
    return held.repartition(max(1, min(10_000, n))).mapInArrow(blocks_of, "path string, member string, row long, values array<double>")


def write_npz(df: DataFrame, path: str) -> DataFrame:
    """Writes rows (file, member, row, values) as path/file.npz of float64 members, and gives file, rows, bytes.

    Rows of a member go in order of `row`, which numbers them from 0; all have one length, and members whose rows are of length
    1 get one dimension. An archive is a file, so one task writes it, row by row; give large members archives of their own. A
    task that runs again replaces its file, which gets its name when it is complete."""
    spark = df.sparkSession
    ship(spark)
    keys = ["file", "member"]
    sizes = df.groupBy(*keys).agg(F.count("*").alias("n"), F.max(F.size("values")).alias("width"), F.min(F.size("values")).alias("least"), F.max("row").alias("last"))
    wrong = sizes.where("width <> least OR last <> n - 1").first()
    if wrong:
        raise ValueError(f"rows of {wrong.member} in {wrong.file} differ in length or are not numbered from 0")
    rows = df.select("file", "member", F.col("row").cast("long").alias("row"), F.col("values").cast("array<double>").alias("values")).join(sizes.select(*keys, "n", "width"), keys)
    rows = rows.repartition("file").sortWithinPartitions("file", "member", "row")

    def put(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = located(path)
        store.create_dir(base, recursive=True)
        done, at, out, archive, inner = [], (None, None), None, None, None

        def close(file: bool) -> None:
            nonlocal inner, archive, out
            if inner is not None:
                inner.close()
                inner = None
            if file and archive is not None:
                archive.close()
                out.close()
                store.move(f"{base}/.{at[0]}.part", f"{base}/{at[0]}.npz")
                done[-1][2] = store.get_file_info(f"{base}/{at[0]}.npz").size
                archive = None

        for batch in batches:
            values = batch.column(3)
            for i, (file, member, n, width) in enumerate(zip(*(batch.column(j).to_pylist() for j in (0, 1, 4, 5)), strict=True)):
                if (file, member) != at:
                    close(file != at[0])
                    if file != at[0]:
                        out = store.open_output_stream(f"{base}/.{file}.part")
                        archive = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
                        done.append([file, 0, 0])
                    at = (file, member)
                    inner = archive.open(member + ".npy", "w", force_zip64=True)
                    np.lib.format.write_array_header_1_0(inner, {"descr": "<f8", "fortran_order": False, "shape": (n, width) if width != 1 else (n,)})
                inner.write(np.asarray(values[i].values, dtype="<f8").tobytes())
                done[-1][1] += 1
        close(True)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["file", "rows", "bytes"])

    return rows.mapInArrow(put, "file string, rows long, bytes long")


def weights(spark: SparkSession, path: str, w: str = "w_enc", b: str = "b_enc") -> DataFrame:
    """feature, dim, w, b: what encode() takes, from a matrix (features by dimensions) and a vector of biases, 0 if there is none."""
    rows = read_npz(spark, path, [w, b])
    bias = rows.where(F.col("member") == b).select(F.col("row").cast("int").alias("feature"), F.col("values")[0].alias("b"))
    cells = rows.where(F.col("member") == w).select(F.col("row").cast("int").alias("feature"), F.posexplode("values").alias("dim", "w"))
    return cells.join(bias, "feature", "left").withColumn("b", F.coalesce("b", F.lit(0.0)))
