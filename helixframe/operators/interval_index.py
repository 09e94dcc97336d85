"""Interval sets as sorted arrays that every task holds, searched batch by batch.

Annotation is small and points are many: the arrays are built once, from a set that was counted to be small, and
broadcast; points stay where they are, and only their keys and positions go to Python. A set of more rows than
MAX_INDEX is not indexed: operators.intervals then shuffles.

Keys of any type and number are coded by their own dictionaries, null included. Two searches find a point's place:
one for its position among all distinct starts, one for (key, that rank) among the sorted (key, rank) of the set.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from ..cluster import ship, stored

#: The most intervals that are indexed (about 40 bytes each in every Python worker), and the most labels of all pieces.
MAX_INDEX, MAX_CELLS = 1_000_000, 20_000_000


def _whole(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


class Places:
    """The sorted distinct (key, position) of a set, and the last of them at or before a point's."""

    def __init__(self, keys: list[pa.Array], at: np.ndarray):
        self.dictionaries, code = [], np.zeros(len(at), dtype=np.int64)
        for column in keys:
            coded = column.dictionary_encode(null_encoding="encode")
            self.dictionaries.append(coded.dictionary)
            code = code * (len(coded.dictionary) + 1) + np.asarray(coded.indices, dtype=np.int64)
        # keys are numbered anew, so that the pair below stays far from the limits of 64 bits
        self.codes, group = np.unique(code, return_inverse=True)
        self.positions = np.unique(at)
        pair = group * (len(self.positions) + 1) + np.searchsorted(self.positions, at) + 1
        #: of: the place of each row that the set was built from
        self.pairs, self.of = np.unique(pair, return_inverse=True)

    def groups(self, keys: list[pa.Array]) -> np.ndarray:
        """The number of each key, -1 where the set has no such key."""
        code, known = np.zeros(len(keys[0]), dtype=np.int64), np.ones(len(keys[0]), dtype=bool)
        for column, values in zip(keys, self.dictionaries, strict=True):
            found = pc.index_in(column, value_set=values)
            known &= np.asarray(found.is_valid())
            code = code * (len(values) + 1) + np.asarray(found.fill_null(0), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.codes, code), max(0, len(self.codes) - 1))
        return np.where(known & (self.codes[at] == code), at, -1) if len(self.codes) else np.full(len(code), -1)

    def last(self, keys: list[pa.Array], at: pa.Array) -> np.ndarray:
        """The place of the key with the greatest position at or before each point, or -1."""
        group = np.where(np.asarray(at.is_valid()), self.groups(keys), -1)
        base = group * (len(self.positions) + 1)
        rank = np.searchsorted(self.positions, np.asarray(at.fill_null(0)), side="right")
        place = np.searchsorted(self.pairs, base + rank, side="right") - 1
        return np.where((group >= 0) & (place >= 0) & (self.pairs[np.maximum(place, 0)] > base), place, -1) if len(self.pairs) else np.full(len(group), -1)


def running_max(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The greatest value so far within each group; groups are numbered in order of the rows."""
    kinds, rank = np.unique(value, return_inverse=True)
    return kinds[np.maximum.accumulate(group * (len(kinds) + 1) + rank) - group * (len(kinds) + 1)] if len(value) else value


def _taken(values: np.ndarray, place: np.ndarray) -> pa.Array:
    held = values[np.maximum(place, 0)] if len(values) else np.zeros(len(place), dtype=np.int64)
    return pa.array(held, mask=place < 0)


class SpanIndex:
    """For each point the interval of its key with the greatest start at or before it (of equal starts the greatest end);
    or, as `reached`, how far that one and all before it reach, which tells whether any holds the point."""

    def __init__(self, keys: list[pa.Array], start: np.ndarray, end: np.ndarray):
        self.places = Places(keys, start)
        self.start, self.end = (np.full(len(self.places.pairs), np.iinfo(np.int64).min) for _ in range(2))
        self.start[self.places.of] = start
        np.maximum.at(self.end, self.places.of, end)
        self.reach = running_max(self.places.pairs // (len(self.places.positions) + 1), self.end)

    def spans(self, keys: list[pa.Array], at: pa.Array) -> pa.Array:
        place = self.places.last(keys, at)
        return pa.StructArray.from_arrays([_taken(self.start, place), _taken(self.end, place)], names=["p_start", "p_end"])

    def reached(self, keys: list[pa.Array], at: pa.Array) -> pa.Array:
        place = self.places.last(keys, at)
        return pa.StructArray.from_arrays([_taken(self.start, place), _taken(self.reach, place)], names=["p_start", "p_end"])


class LabelIndex:
    """For each point all labels with an interval around it: a key is cut at every start and end, each piece holds its labels."""

    def __init__(self, label: pa.Array, keys: list[pa.Array], start: np.ndarray, end: np.ndarray):
        # intervals of one label and key are merged first
        own = SpanIndex([label, *keys], start, end)
        group = own.places.pairs // (len(own.places.positions) + 1)
        new = np.ones(len(group), dtype=bool)
        new[1:] = (group[1:] != group[:-1]) | (own.start[1:] > own.reach[:-1])
        first_row = np.zeros(len(group), dtype=np.int64)
        first_row[own.places.of] = np.arange(len(start))
        begins = np.flatnonzero(new)
        lasts = np.concatenate([begins[1:], [len(group)]]) - 1 if len(begins) else begins
        take = pa.array(first_row[begins])
        label, keys, start, end = label.take(take), [k.take(take) for k in keys], own.start[begins], own.reach[lasts]

        n = len(start)
        twice = [pa.concat_arrays([k, k]) for k in keys]
        self.places = Places(twice, np.concatenate([start, end]))
        first, after = self.places.of[:n], self.places.of[n:]
        width = after - first
        self.cells = int(width.sum())
        if self.cells > MAX_CELLS:
            return
        coded = label.dictionary_encode(null_encoding="encode")
        self.labels = coded.dictionary
        piece = np.repeat(first - np.concatenate([[0], np.cumsum(width)[:-1]]).astype(np.int64), width) + np.arange(self.cells) if n else np.zeros(0, dtype=np.int64)
        held = np.repeat(np.asarray(coded.indices, dtype=np.int32), width)
        order = np.lexsort((held, piece))
        self.held = held[order]
        self.begin = np.searchsorted(piece[order], np.arange(len(self.places.pairs) + 1))

    def around(self, keys: list[pa.Array], at: pa.Array) -> pa.Array:
        place = self.places.last(keys, at)
        known = np.maximum(place, 0)
        n = np.where(place >= 0, self.begin[known + 1] - self.begin[known], 0) if len(self.held) else np.zeros(len(place), dtype=np.int64)
        offsets = np.concatenate([[0], np.cumsum(n)])
        inner = np.arange(offsets[-1]) - np.repeat(offsets[:-1], n) + np.repeat(self.begin[known] if len(self.held) else known, n)
        values = self.labels.take(pa.array(self.held[inner])) if len(inner) else self.labels.slice(0, 0)
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


def _columns(df: DataFrame, names: Sequence[str]) -> tuple[list[pa.Array], np.ndarray, np.ndarray]:
    got = df.select(*names, F.col("start").cast("long").alias("__from"), F.col("end").cast("long").alias("__to")).toArrow()
    arrays = [_whole(c) for c in got.columns]
    return arrays[:-2], np.asarray(arrays[-2]), np.asarray(arrays[-1])


def span_index(intervals: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, Broadcast | None]:
    """The set, one row a start, and its index if it is small. The set is computed once, for both."""
    rows = intervals.where("start IS NOT NULL AND end IS NOT NULL").groupBy(*keys, "start").agg(F.max("end").alias("end"))
    rows = stored(rows, "intervals")
    if rows.count() > MAX_INDEX:
        return rows, None
    index = SpanIndex(*_columns(rows, keys))
    return rows, _sent(rows.sparkSession, index)


def label_index(intervals: DataFrame, label: str, keys: Sequence[str]) -> tuple[DataFrame, int, Broadcast | None]:
    """The rows with labels, how many there are, and their index if distinct starts are estimated to be few.

    Large sets become one row a start only where that halves them, as a task would hold all starts of its part of the
    input. The pieces of small sets that overlap too much for MAX_CELLS are not indexed either."""
    rows = stored(intervals.where("start < end").select(label, *keys, "start", "end"), "labelled-intervals")
    n, starts = rows.agg(F.count("*"), F.approx_count_distinct(F.xxhash64(label, *keys, "start"))).first()
    by_start = rows.groupBy(label, *keys, "start").agg(F.max("end").alias("end"))
    if starts > MAX_INDEX:
        return (by_start, starts, None) if n > 2 * starts else (rows, n, None)
    arrays, start, end = _columns(by_start, [label, *keys])
    index = LabelIndex(arrays[0], arrays[1:], start, end)
    return by_start, starts, None if index.cells > MAX_CELLS else _sent(rows.sparkSession, index)


def _sent(spark: SparkSession, index: SpanIndex | LabelIndex) -> Broadcast:
    ship(spark)
    index.places.of = None  # only building needs it
    return spark.sparkContext.broadcast(index)


def look_up(index: Broadcast, method: str, returns: DataType, keys: Sequence[str], pos: str) -> Column:
    """What the index's method gives for each row's keys and position, a batch at a time."""

    @F.arrow_udf(returns)
    def run(at: pa.Array, *columns: pa.Array) -> pa.Array:
        return getattr(index.value, method)(list(columns), at)

    return run(F.col(pos).cast("long"), *[F.col(k) for k in keys])


def spans_of(index: Broadcast, keys: Sequence[str], pos: str, reach: bool = False) -> Column:
    return look_up(index, "reached" if reach else "spans", StructType.fromDDL("p_start long, p_end long"), keys, pos)


def labels_of(index: Broadcast, label_type: DataType, keys: Sequence[str], pos: str) -> Column:
    return look_up(index, "around", ArrayType(label_type), keys, pos)
