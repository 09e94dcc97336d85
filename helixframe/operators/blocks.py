"""Partial results as blocks that tasks fill and Spark adds up: what is shuffled does not grow with the tokens.

Counts: where tokens hold their labels, a task counts concept by feature in a matrix and emits one row of numbers a concept.
Shifts: where windows hold their tokens, a task counts the hits of all shifts of a window by one correlation.
Set overlaps: where labels are bitmaps over buckets, a task counts the bits that pairs of them share.

A task gives out its block and begins another when that has CELLS numbers, so memory is bounded whatever the number of
concepts, features or labels.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..cluster import ship, stored

#: Numbers of a task's block, of a slice of tokens, and columns of an emitted row.
CELLS, SLICE, WIDTH = 4_000_000, 4_000_000, 4096


def _matrix(lists: pa.Array, width: int, index: bool = False) -> np.ndarray:
    """Rows of lists as a matrix of `width` columns; null and NaN are 0. index: the lists name the columns that are 1."""
    parent = np.asarray(pc.list_parent_indices(lists))
    flat = pc.list_flatten(lists)
    out = np.zeros((len(lists), width))
    if index:
        out[parent, np.asarray(flat.fill_null(0))] = 1
        return out
    # the place of a value in its list: lists lie one after the other
    n = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
    place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    out[parent, place] = np.nan_to_num(np.asarray(flat.fill_null(0.0)), nan=0.0)
    return out


class Block:
    """Sums by (label, column): a label has a row of the matrices, which grow as labels come."""

    def __init__(self, width: int, squares: bool):
        self.width, self.rows, self.labels = width, {}, []
        self.n, self.tokens = np.zeros((8, width), dtype=np.int64), np.zeros(8, dtype=np.int64)
        self.s = np.zeros((8, width)) if squares else None

    def places(self, labels: list) -> np.ndarray:
        for label in labels:
            if label not in self.rows:
                self.rows[label] = len(self.labels)
                self.labels.append(label)
        while len(self.labels) > len(self.tokens):
            self.n, self.tokens = np.concatenate([self.n, np.zeros_like(self.n)]), np.concatenate([self.tokens, np.zeros_like(self.tokens)])
            self.s = None if self.s is None else np.concatenate([self.s, np.zeros_like(self.s)])
        return np.array([self.rows[x] for x in labels], dtype=np.int64)

    def add(self, labels: pa.Array, active: np.ndarray, squares: np.ndarray | None) -> None:
        """labels: a list of labels a token; active, squares: tokens by columns."""
        coded = pc.list_flatten(labels).dictionary_encode()
        at = self.places(coded.dictionary.to_pylist())
        code = at[np.asarray(coded.indices.fill_null(0))] if len(at) else np.zeros(0, dtype=np.int64)
        order = np.argsort(code, kind="stable")
        token = np.asarray(pc.list_parent_indices(labels))[order]
        held, begin, n = np.unique(code[order], return_index=True, return_counts=True)
        if len(held):
            self.n[held] += np.add.reduceat(active[token], begin, axis=0).astype(np.int64)
            self.tokens[held] += n
            if squares is not None:
                self.s[held] += np.add.reduceat(squares[token], begin, axis=0)

    def emitted(self, known: bool) -> Iterator[pa.RecordBatch]:
        for first in range(0, self.width, WIDTH):
            cut = slice(first, min(self.width, first + WIDTH))
            for label, row in self.rows.items():
                n = self.n[row, cut]
                s = np.zeros(len(n)) if self.s is None else self.s[row, cut]
                yield pa.RecordBatch.from_arrays([pa.array([known]), pa.array([label], pa.string()), pa.array([first], pa.int32()), pa.array([self.tokens[row]], pa.int64()), pa.array([n], pa.list_(pa.int64())), pa.array([s], pa.list_(pa.float64()))], names=["known", "concept", "first", "tokens", "n", "s"])


def count_blocks(tokens: DataFrame, width: int, labels: str = "labels", vector: str | None = None, active: str | None = None, rebuilt: str | None = None) -> DataFrame:
    """concept, feature (int, from 0), tp, fires, n_pos, total (long) and mse (double), for every concept with a token and every feature.

    A token is a row: labels (an array of distinct strings, or a string), and either vector (an array of `width` numbers, of
    which those above 0 fire; NaN counts as 0) or active (an array of the features that fire). rebuilt: a second vector;
    mse is the mean squared difference over the concept's tokens, 0 without it. Null labels and null vectors hold nothing."""
    if (vector is None) == (active is None):
        raise ValueError("give vector or active")
    ship(tokens.sparkSession)
    said = F.col(labels)
    held = F.array_compact(said if tokens.schema[labels].dataType.typeName() == "array" else F.array(said.cast("string")))
    given = F.col(vector).cast("array<double>") if vector else F.array_distinct(F.col(active)).cast("array<int>")
    columns = [held.cast("array<string>").alias("labels"), given.alias("given"), *([F.col(rebuilt).cast("array<double>").alias("rebuilt")] if rebuilt else [])]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, every = Block(width, bool(rebuilt)), Block(width, bool(rebuilt))
        step = max(16, SLICE // max(1, width))
        for batch in batches:
            for low in range(0, batch.num_rows, step):
                part = batch.slice(low, step)
                x = _matrix(part.column(1), width, index=active is not None)
                squares = (x - _matrix(part.column(2), width)) ** 2 if rebuilt else None
                fires = x > 0
                by.add(part.column(0), fires, squares)
                every.add(pa.array([[""]] * part.num_rows, pa.list_(pa.string())), fires, squares)
                if len(by.labels) * width > CELLS:
                    yield from by.emitted(True)
                    by = Block(width, bool(rebuilt))
        yield from by.emitted(True)
        yield from every.emitted(False)

    rows = tokens.select(*columns).mapInArrow(run, "known boolean, concept string, first int, tokens long, n array<long>, s array<double>")
    cells = rows.select("known", "concept", "first", "tokens", F.posexplode(F.arrays_zip("n", "s")).alias("at", "v"))
    sums = cells.groupBy("known", "concept", (F.col("first") + F.col("at")).cast("int").alias("feature")).agg(F.sum("v.n").alias("n"), F.sum("v.s").alias("s"), F.sum("tokens").alias("tokens"))
    sums = stored(sums, "count-blocks")
    every = sums.where("NOT known").select("feature", F.col("n").alias("fires"), F.col("tokens").alias("total"))
    by = sums.where("known").select("concept", "feature", F.col("n").alias("tp"), F.col("tokens").alias("n_pos"), (F.col("s") / F.col("tokens")).alias("mse"))
    # one row a feature: as many as the model's width
    return by.join(F.broadcast(every) if width <= 1_000_000 else every, "feature").select("concept", "feature", "tp", "fires", "n_pos", "total", "mse")


def association_counts(tokens: DataFrame, width: int, **columns: str) -> DataFrame:
    """concept, feature, tp, fp, n_pos, n_neg as association.counts gives them."""
    out = count_blocks(tokens, width, **columns)
    return out.select("concept", "feature", "tp", (F.col("fires") - F.col("tp")).alias("fp"), "n_pos", (F.col("total") - F.col("n_pos")).alias("n_neg"))


def shift_hits(active: DataFrame, labels: DataFrame, shifts: DataFrame, length: int, window: str = "window", tok: str = "tok", feature: str = "feature", concept: str = "concept") -> DataFrame:
    """concept, feature, hits: for each of n circular shifts how many tokens hold the shifted label and the feature.

    shifts: (window, shifts), an array of n whole numbers a window: labels at tok go to (tok + shift) mod length. Tokens
    meet once a window, not once a shift: a window's counts for all shifts are the circular correlation of its labels and
    activations, taken by Fourier transform and rounded (counts of at most `length` are exact). Pairs that share a window have
    a row, with the zeros of shifts that hit nothing. A window is the unit of work: its tokens are one row."""
    ship(active.sparkSession)

    def by_window(df: DataFrame, name: str, out: str) -> DataFrame:
        item = F.struct(F.col(name).cast("string").alias("name"), F.pmod(F.col(tok), F.lit(length)).cast("int").alias("tok"))
        return df.groupBy(F.col(window).alias("w")).agg(F.collect_set(item).alias(out))

    by_shift = shifts.select(F.col(window).alias("w"), F.col("shifts").cast("array<long>").alias("shifts"))
    rows = by_window(labels, concept, "held").join(by_window(active, feature, "fired"), "w").join(by_shift, "w")

    def marks(items: pa.Array) -> tuple[list, np.ndarray]:
        coded = pc.struct_field(items, "name").dictionary_encode(null_encoding="encode")
        out = np.zeros((len(coded.dictionary), length))
        out[np.asarray(coded.indices), np.asarray(pc.struct_field(items, "tok"))] = 1
        return coded.dictionary.to_pylist(), np.fft.rfft(out, axis=1)

    def emitted(sums: dict) -> Iterator[pa.RecordBatch]:
        keys = list(sums)
        for low in range(0, len(keys), 256):
            some = keys[low : low + 256]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in some], pa.string()), pa.array([k[1] for k in some], pa.string()), pa.array([sums[k] for k in some], pa.list_(pa.int64()))], names=["concept", "feature", "n"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            for i in range(batch.num_rows):
                names, held = marks(batch.column(0)[i].values)
                features, fired = marks(batch.column(1)[i].values)
                shift = np.mod(np.asarray(batch.column(2)[i].values), length)
                for name, spectrum in zip(names, held, strict=True):
                    # hits of shift s: labels at t, activations at t + s
                    hits = np.rint(np.fft.irfft(np.conj(spectrum)[None, :] * fired, n=length, axis=1)).astype(np.int64)[:, shift]
                    for f, row in zip(features, hits, strict=True):
                        key = (name, f)
                        sums[key] = sums[key] + row if key in sums else row
                if len(sums) * max(1, len(shift)) > CELLS:
                    yield from emitted(sums)
                    sums = {}
        yield from emitted(sums)

    parts = rows.select("held", "fired", "shifts").mapInArrow(run, "concept string, feature string, n array<long>")
    cells = parts.select("concept", "feature", F.posexplode("n").alias("perm", "n")).groupBy("concept", "feature", "perm").agg(F.sum("n").alias("tp"))
    return cells.select(F.col("perm").cast("int").alias("perm"), F.col("concept").cast(labels.schema[concept].dataType).alias(concept), F.col("feature").cast(active.schema[feature].dataType).alias(feature), "tp")


def bitmap_overlap(bins: DataFrame, label: str, on: Sequence[str]) -> DataFrame | None:
    """a, b, both: the bins that two labels share, for pairs that share any, a label with itself included; None if the last of `on` is no whole number.

    The sets are bitmaps of 32,768 bins a bucket, filled on the map side, so repeated bins cost nothing; a bucket's bitmaps
    (4 KB a label) are one row, whose pairs are counted word by word."""
    if not isinstance(bins.schema[on[-1]].dataType, IntegralType):
        return None
    ship(bins.sparkSession)
    keys, at = list(on[:-1]), F.col(on[-1]).cast("long")
    maps = bins.where(F.col(on[-1]).isNotNull()).groupBy(*keys, F.bitmap_bucket_number(at).alias("__bucket"), F.col(label).cast("string").alias("__label")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("__bits"))
    rows = maps.groupBy(*keys, "__bucket").agg(F.collect_list(F.struct(F.col("__label").alias("label"), F.col("__bits").alias("bits"))).alias("maps"))

    def emitted(sums: dict) -> Iterator[pa.RecordBatch]:
        keys = list(sums)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([sums[k] for k in keys], pa.int64())], names=["a", "b", "both"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            for i in range(batch.num_rows):
                held = batch.column(0)[i].values
                labels = pc.struct_field(held, "label").to_pylist()
                words = np.frombuffer(b"".join(pc.struct_field(held, "bits").to_pylist()), dtype=np.uint64).reshape(len(labels), -1)
                for j, a in enumerate(labels):
                    for b, n in zip(labels, np.bitwise_count(words[j] & words).sum(axis=1, dtype=np.int64), strict=True):
                        if n:
                            sums[a, b] = sums.get((a, b), 0) + int(n)
                if len(sums) > CELLS // 8:
                    yield from emitted(sums)
                    sums = {}
        yield from emitted(sums)

    kind = bins.schema[label].dataType
    shared = rows.select("maps").mapInArrow(run, "a string, b string, both long").groupBy("a", "b").agg(F.sum("both").alias("both"))
    return shared.select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"), "both")
