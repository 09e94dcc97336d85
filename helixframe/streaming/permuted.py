"""Epochs over a table in a keyed order that is computed, not sorted, so any position can be continued from.

Rows are numbered from 0 where they lie. A permutation of these numbers, keyed by a seed, says which row stands at which
place; it is a column expression in both directions. A batch is a range of places. To give a whole table its order,
each row's place is computed; to read on from a position, the rows whose places come next are taken.

The permutation is a Feistel network over pairs of numbers below a and b, a * b >= n; what falls outside n is mapped
again until it lies inside. Fewer than a of the a * b pairs lie outside, so 64 steps are enough (for small n that is certain,
for large n the chance of more is below 1e-100).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..cluster import new_path, ship, stored

ROUNDS, STEPS = 4, 64

#: The most ranges of places, and so reads of the table, that a streamed epoch takes.
TURNS = 16


def _sides(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def _mixed(x: Column, seed: int, turn: int, below: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(turn), x.cast("long")), F.lit(below))


def _network(at: Column, n: int, seed: int, back: bool) -> Column:
    """One pass: halves (left below a, right below b) take turns in being shifted by a hash of the other."""
    a, b = _sides(n)
    sign = -1 if back else 1

    def turned(turn: int):
        def left(p: Column) -> Column:
            return F.struct(F.pmod(p["l"] + sign * _mixed(p["r"], seed, turn, a), F.lit(a)).alias("l"), p["r"].alias("r"))

        def right(p: Column) -> Column:
            return F.struct(p["l"].alias("l"), F.pmod(p["r"] + sign * _mixed(p["l"], seed, turn, b), F.lit(b)).alias("r"))

        return right if turn % 2 else left

    # a pair is the one element of an array, so that each turn evaluates the last one once
    pair = F.array(F.struct(F.call_function("div", at, F.lit(b)).alias("l"), F.pmod(at, F.lit(b)).cast("long").alias("r")))
    for turn in reversed(range(ROUNDS)) if back else range(ROUNDS):
        pair = F.transform(pair, turned(turn))
    return F.transform(pair, lambda p: p["l"] * b + p["r"])[0]


def _walked(at: Column, n: int, seed: int, back: bool) -> Column:
    first = _network(at.cast("long"), n, seed, back)
    again = F.sequence(F.lit(1), F.lit(STEPS))
    return F.aggregate(again, first, lambda x, _: F.when(x < n, x).otherwise(_network(x, n, seed, back)))


def place_of(row: Column, n: int, seed: int) -> Column:
    """Where the row of that number stands; distinct for distinct rows below n."""
    return _walked(row, n, seed, back=False)


def row_at(place: Column, n: int, seed: int) -> Column:
    """The number of the row that stands there: the inverse of place_of."""
    return _walked(place, n, seed, back=True)


def numbered(df: DataFrame, name: str = "row") -> tuple[DataFrame, int]:
    """The rows with a number from 0, and how many they are: written once, then numbered by file and place in it, without a sort."""
    spark, path = df.sparkSession, new_path(df.sparkSession, "numbered")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path).select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at"))
    files = out.groupBy("__file").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row a file
    starts = files.select("__file", before.alias("__before"), "__n")
    n = starts.agg(F.sum("__n")).first()[0] or 0
    rows = out.join(F.broadcast(starts.drop("__n")), "__file").withColumn(name, F.col("__before") + F.col("__at"))
    return rows.select(*df.columns, name), n


def epoch(rows: DataFrame, n: int, size: int, seed: int, start: int = 0, stop: int | None = None, name: str = "row") -> DataFrame:
    """The rows at places [start, stop) of the seed's order, with place and batch (long); no row moves."""
    placed = rows.withColumn("place", place_of(F.col(name), n, seed))
    stop = n if stop is None else min(stop, n)
    return placed.where((F.col("place") >= start) & (F.col("place") < stop)).withColumn("batch", F.floor(F.col("place") / size))


class PositionReader(SimpleDataSourceStreamReader):
    def __init__(self, stop: int, width: int, first: int):
        self.stop, self.width, self.first = stop, width, first

    def initialOffset(self) -> dict:
        return {"position": self.first}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        low = start["position"]
        end = {"position": max(low, min(self.stop, low - low % self.width + self.width))}
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        low, high = start["position"], end["position"]
        return iter([(low, high)] if low < high else [])

    def commit(self, end: dict) -> None:
        pass


class PositionSource(DataSource):
    """Options: stop, width, start. Each micro-batch is one row, the rest of a range of `width` places; the offset is the position."""

    @classmethod
    def name(cls) -> str:
        return "helix_positions"

    def schema(self) -> str:
        return "__low long, __high long"

    def simpleStreamReader(self, schema) -> PositionReader:
        return PositionReader(int(self.options["stop"]), int(self.options["width"]), int(self.options.get("start", 0)))


def stream_epoch(rows: DataFrame, n: int, size: int, seed: int, start: int = 0, stop: int | None = None, name: str = "row", turns: int = TURNS) -> DataFrame:
    """The same batches as a stream up to `stop`: its checkpoint holds the position, so a query that is started again goes on there.

    A micro-batch is a range of places, which every task compares with its rows' places; these are computed once and stored. Each
    reads the whole table, so it takes as many whole batches as let an epoch end after `turns` ranges, however long it is."""
    spark: SparkSession = rows.sparkSession
    ship(spark)
    spark.dataSource.register(PositionSource)
    width = size * max(1, -(-n // (size * turns)))
    places = spark.readStream.format("helix_positions").option("stop", n if stop is None else min(stop, n)).option("width", width).option("start", start).load()
    placed = stored(epoch(rows, n, size, seed, start, stop, name), "placed")
    inside = (F.col("place") >= F.col("__low")) & (F.col("place") < F.col("__high"))
    return placed.join(F.broadcast(places), inside).select(name, "place", "batch", *[c for c in rows.columns if c != name])
