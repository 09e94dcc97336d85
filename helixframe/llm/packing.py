"""Packing of tokenised documents into fixed-length sequences by exact-complement hashing.

The pieces' lengths form a histogram of at most `capacity` entries, whatever the corpus. From the
longest length down, the gap that a piece leaves is looked up among single lengths, pair sums and
triple sums of what is still available; a combination that fills it exactly is consumed as often as
its counts allow. Where none exists, the longest piece that fits goes in (best fit) and the smaller
gap is looked up again. Each step uses up a length or closes a pattern, so the plan has a few
thousand rows for any corpus; pieces find their place in it by their rank among equal lengths.

Defined results: null text is empty, one separator long; every input row is a document of its own,
also when ids repeat; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE, lean, ship, written

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Fixed value: the characters for which the fast encoder is tested equal to the tokenizer file's own library; texts with others take that library.
PLAIN = r"[\t\n\r -~\u00a1-\u024f\u2010-\u2027\u2030-\u205e\u20ac]*"


def tokenizer_paths() -> tuple[str, str]:
    """The vocabulary as a tokenizers file and as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Token ids as the tokenizers file gives them. Plain texts take the same vocabulary's rank form, which is ten times as fast."""

    _held: dict = {}

    def __init__(self, json_path: str, rank_path: str):
        import public_tokenizers
        import tiktoken

        with open(rank_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.json_path = json_path
        self.plain = re.compile(PLAIN).fullmatch

    @cached_property
    def exact(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.json_path)

    @classmethod
    def get(cls, *paths: str) -> Encoder:
        if paths not in cls._held:
            cls._held[paths] = cls(*paths)
        return cls._held[paths]

    def __call__(self, text: str) -> list[int]:
        if self.plain(text) and "<|" not in text:
            return self.fast(text)
        return self.exact.encode(text, add_special_tokens=False).ids


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: only the first may be shorter than the capacity when it is cut."""
    if n <= capacity:
        return [(0, n)]
    first = n - capacity * ((n - 1) // capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def tokenize(docs: DataFrame, capacity: int, separator: int, paths: tuple[str, str]) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        encode = Encoder.get(*paths)
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                rows = []  # row of the slice, piece, start, length, checksum
                for i, text in enumerate(b.column(1).slice(at, SLICE).to_pylist()):
                    ids = np.array([*encode(text or ""), separator], dtype="<u4")
                    rows += [(i, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(cut(len(ids), capacity))]
                cols = [pa.array(x, pa.int32() if c == 1 else pa.int64()) for c, x in enumerate(zip(*rows, strict=True))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, SLICE).take(cols[0]), *cols[1:]], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), PIECES)


def pair(total: int, avail: np.ndarray) -> tuple[int, int] | None:
    """Two available lengths with this sum, the first as long as can be."""
    low = np.arange(1, total // 2 + 1)
    both = low[(avail[low] > 0) & (avail[total - low] > 0)]
    for x in both[:2]:  # only the middle one can fail the count
        if total != 2 * x or avail[x] > 1:
            return int(total - x), int(x)
    return None


def complement(gap: int, avail: np.ndarray) -> tuple[int, ...] | None:
    """One, two or three available lengths that fill the gap exactly, the longest first. avail: counts by length."""
    if avail[gap]:
        return (gap,)
    if found := pair(gap, avail):
        return found
    for longest in np.flatnonzero(avail[:gap])[::-1]:
        if 3 * longest < gap:
            break
        avail[longest] -= 1
        found = pair(int(gap - longest), avail)
        avail[longest] += 1
        if found and found[0] <= longest:
            return (int(longest), *found)
    return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences); every piece of the histogram is in one."""
    avail = np.zeros(capacity + 1, dtype=np.int64)
    for n, c in counts.items():
        avail[n] = c
    out = [((capacity,), int(avail[capacity]))] if avail[capacity] else []
    avail[capacity] = 0
    for first in range(capacity - 1, 0, -1):
        while avail[first]:
            made, gap = [first], capacity - first
            avail[first] -= 1
            while gap:
                if found := complement(gap, avail):
                    made += found
                    gap = 0
                    for x in found:
                        avail[x] -= 1
                else:
                    fits = np.flatnonzero(avail[: gap + 1])
                    if not len(fits):
                        break
                    made.append(int(fits[-1]))
                    avail[fits[-1]] -= 1
                    gap -= int(fits[-1])
            more = min(int(avail[x]) // made.count(x) for x in set(made))
            for x in made:
                avail[x] -= more
            out.append((tuple(made), more + 1))
    return out


def places(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int]]:
    """(length, first rank, first sequence, offset): the piece with rank first + i goes to sequence + i."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, times in patterns:
        offset = 0
        for n in lengths:
            rows.append((n, used.get(n, 0), sequence, offset))
            used[n] = used.get(n, 0) + times
            offset += n
        sequence += times
    return sorted(rows)


def pack(docs: DataFrame, capacity: int = 2048, separator: int = 0, paths: tuple[str, str] | None = None, rows_a_group: int = 500) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row a piece."""
    ship(docs.sparkSession)
    pieces = written(tokenize(docs, capacity, separator, paths or tokenizer_paths()), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    rows = places(plan(counts, capacity))
    # ranks among equal lengths: a frequent length is dealt over groups, whose sizes give each group its first rank
    spread = docs.sparkSession.createDataFrame([(n, -(-c // rows_a_group)) for n, c in sorted(counts.items())], "length long, __groups long")
    dealt = pieces.join(F.broadcast(spread), "length").withColumn("__g", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("__groups"))).drop("__groups")
    sizes = dealt.groupBy("length", "__g").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("length").orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "__g", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy("length", "__g").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = dealt.join(sizes, ["length", "__g"]).withColumn("__rank", F.col("__base") + F.row_number().over(within) - 1)

    def place(batches: Iterator) -> Iterator:
        lens, ranks, seqs, offs = (np.array(x, dtype=np.int64) for x in zip(*rows, strict=True)) if rows else [np.zeros(0, np.int64)] * 4
        keys = lens * 2**50 + ranks
        for b in batches:
            length, rank = (b.column(c).to_numpy() for c in ("length", "__rank"))
            at = np.searchsorted(keys, length * 2**50 + rank, "right") - 1
            held = [b.column(i) for i in range(5)]
            yield pa.RecordBatch.from_arrays([*held, pa.array(seqs[at] + rank - ranks[at]), pa.array(offs[at])], names=[*b.schema.names[:5], "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "__rank").mapInArrow(lean(place), PIECES + ", sequence_id long, offset long")
