"""FASTA files read by byte range, whatever their line widths.

One pass over the ranges counts the letters of every record's part in each range; running sums over these few rows
give the record and position at which each range begins. This index is kept as Parquet. The data source then reads
the ranges in parallel, and those that no filter on chrom and start can meet not at all.

    index = fasta_index(spark, path)
    pieces = fasta_pieces(spark, index).where("chrom = 'chr1'")

Files are opened by pyarrow, so local, HDFS, S3 and GS paths work; a compressed file is one range, as it cannot be entered
in its middle. A header line is at most HEADER bytes. Letters before the first header belong to no record and are dropped; names
are the first word of a header; white space in sequences is skipped; records of one name follow each other only in
name, so keep names distinct.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..cluster import new_path, ship

#: Bytes of a range, of a read within it, and the longest header line.
RANGE, BLOCK, HEADER = 32 << 20, 4 << 20, 1 << 16
PACKED = {".gz": "gzip", ".bgz": "gzip", ".bz2": "bz2", ".zst": "zstd"}
PIECE = "chrom string, chunk long, start long, seq string"


def compression(path: str) -> str | None:
    return next((how for end, how in PACKED.items() if path.endswith(end)), None)


def opened(path: str) -> BinaryIO:
    """The file, to be read from any place; a packed one only from its beginning."""
    if "://" not in path and not path.startswith("file:"):
        path = "file://" + path
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    store, name = pa.fs.FileSystem.from_uri(path)
    how = compression(path)
    return store.open_input_stream(name, compression=how) if how else store.open_input_file(name)


def events(path: str, low: int, high: int | None) -> Iterator[tuple[str | None, bytes]]:
    """What lies in the bytes [low, high): (name, b"") for a record whose header begins there, (None, letters) for a part of its sequence.

    A header that begins inside is read to its end; one that began before is skipped."""
    with opened(path) as f:
        header, skip, fresh = None, False, True
        if low:
            back = max(0, low - HEADER)
            f.seek(back)
            before = f.read(low - back)
            line = before[before.rfind(b"\n") + 1 :]
            fresh = before.endswith(b"\n")
            # a line without a beginning in sight is sequence: headers are shorter
            if not fresh and line.startswith(b">") and (b"\n" in before or back == 0):
                header, skip = b"", True
        at = low
        while high is None or at < high or header is not None:
            data = f.read(BLOCK if high is None or at >= high else min(BLOCK, high - at))
            if not data:
                break
            if high is not None and at >= high:
                data = data.split(b"\n", 1)[0] + b"\n" if b"\n" in data else data
            at += len(data)
            pos = 0
            while pos < len(data):
                if header is not None:
                    end = data.find(b"\n", pos)
                    header += data[pos : len(data) if end < 0 else end]
                    if end < 0:
                        break
                    if not skip:
                        yield (header.split() or [b""])[0].decode("utf-8", "replace"), b""
                    header, skip, fresh, pos = None, False, True, end + 1
                elif fresh and data[pos : pos + 1] == b">":
                    header, pos = b"", pos + 1
                else:
                    end = data.find(b"\n>", pos)
                    part = data[pos:] if end < 0 else data[pos:end]
                    letters = part.translate(None, b" \t\r\n")
                    if letters:
                        yield None, letters
                    if end < 0:
                        fresh = data.endswith(b"\n")
                        break
                    header, pos = b"", end + 2
        if header is not None and not skip:
            yield (header.split() or [b""])[0].decode("utf-8", "replace"), b""


def survey(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each range the letters before its first header, then each header with the letters after it."""
    for batch in batches:
        for path, low, high in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found: list[list] = [[None, 0]]
            for name, letters in events(path, low, high):
                if name is None:
                    found[-1][1] += len(letters)
                else:
                    found.append([name, 0])
            n = len(found)
            yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array([low] * n, pa.int64()), pa.array([high] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.int64())], names=["path", "low", "high", "i", "name", "n"])


def fasta_index(spark: SparkSession, path: str, range_bytes: int = RANGE) -> str:
    """The path of the index of a file or a folder of files: path, low, high, i, chrom, start, n, one row a record's part in a range."""
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    packed = F.lit(False)
    for end in PACKED:
        packed = packed | F.col("path").endswith(end)
    last = F.floor((F.greatest(F.col("length"), F.lit(1)) - 1) / range_bytes)
    ranges = files.select("path", "length", packed.alias("packed"), F.explode(F.sequence(F.lit(0).cast("long"), F.when(packed, 0).otherwise(last))).alias("r"))
    low = F.col("r") * range_bytes
    ranges = ranges.select("path", low.alias("low"), F.when(~F.col("packed"), F.least(low + range_bytes, F.col("length"))).alias("high"))
    counted = ranges.repartition(max(1, min(100_000, ranges.count()))).mapInArrow(survey, "path string, low long, high long, i long, name string, n long")
    so_far = Window.partitionBy("path").orderBy("low", "i").rowsBetween(Window.unboundedPreceding, 0)
    rows = counted.withColumns({"chrom": F.last("name", ignorenulls=True).over(so_far), "record": F.count("name").over(so_far)})
    within = Window.partitionBy("path", "record").orderBy("low", "i").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("path", "low", "high", "i", "chrom", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("start"), "n")
    out = new_path(spark, "fasta-index")
    rows.write.parquet(out)
    return out


class Range(InputPartition):
    def __init__(self, path: str, low: int, high: int | None, chrom: str | None, start: int):
        super().__init__((path, low))
        self.path, self.low, self.high, self.chrom, self.start = path, low, high, chrom, start


class FastaReader(DataSourceReader):
    def __init__(self, index: str, chunk: int):
        self.index, self.chunk, self.names, self.least, self.most = index, chunk, None, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Notes what chrom and start may be. Spark evaluates all filters again, as a piece is more than its bounds say."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("chrom",):
                names = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = names if self.names is None else self.names & names
            elif f.__class__ in (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual) and f.attribute == ("start",):
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.least = max(f.value, self.least if self.least is not None else f.value)
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.most = min(f.value, self.most if self.most is not None else f.value)
            yield f

    def wanted(self, chrom: str | None, start: int, n: int) -> bool:
        """Whether pieces of [start, start + n) can pass."""
        if chrom is None or n == 0 or (self.names is not None and chrom not in self.names):
            return False
        return (self.least is None or start + n > self.least) and (self.most is None or start <= self.most)

    def partitions(self) -> list[Range]:
        path = self.index if "://" in self.index or self.index.startswith("file:") else "file://" + self.index
        store, name = pa.fs.FileSystem.from_uri(path if not path.startswith("file:/") or path.startswith("file://") else "file://" + path[5:])
        rows = pq.read_table(name, filesystem=store).sort_by([("path", "ascending"), ("low", "ascending"), ("i", "ascending")]).to_pylist()
        first, used = {}, {}
        for r in rows:
            key = r["path"], r["low"]
            first.setdefault(key, r)
            used[key] = used.get(key, False) or self.wanted(r["chrom"], r["start"], r["n"])
        return [Range(r["path"], r["low"], r["high"], r["chrom"], r["start"]) for key, r in first.items() if used[key]]

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no range is wanted
            return
        chrom, at, held, size = partition.chrom, partition.start, [], 0
        out, letters_out = [], 0

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["chrom", "chunk", "start", "seq"])

        def piece() -> None:
            nonlocal at, held, size, letters_out
            if size and self.wanted(chrom, at, size):
                out.append((chrom, at // self.chunk, at, b"".join(held).upper().decode("ascii", "replace")))
                letters_out += size
            at, held, size = at + size, [], 0

        for name, letters in events(partition.path, partition.low, partition.high):
            if name is not None:
                piece()
                chrom, at = name, 0
            view = memoryview(letters)
            while len(view):
                room = self.chunk - (at + size) % self.chunk
                part = view[:room]
                held.append(part)
                size, view = size + len(part), view[room:]
                if len(part) == room:
                    piece()
            if letters_out >= BLOCK:
                yield batch()
                out, letters_out = [], 0
        piece()
        if out:
            yield batch()


class FastaSource(DataSource):
    """Options: index (of fasta_index), chunk."""

    @classmethod
    def name(cls) -> str:
        return "helix_fasta"

    def schema(self) -> str:
        return PIECE

    def reader(self, schema) -> FastaReader:
        return FastaReader(self.options["index"], int(self.options.get("chunk", 1 << 16)))


def fasta_pieces(spark: SparkSession, index: str, chunk: int = 1 << 16) -> DataFrame:
    """chrom, chunk, start, seq: pieces in upper case that end where a chunk, a record or a range does; a chunk is one or two pieces."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FastaSource)
    return spark.read.format("helix_fasta").option("index", index).option("chunk", chunk).load()


def fasta_lengths(spark: SparkSession, index: str) -> DataFrame:
    """chrom, length: of the index alone."""
    return spark.read.parquet(index).where("chrom IS NOT NULL").groupBy("chrom").agg(F.sum("n").alias("length"))
