"""Benchmark decontamination by a prefix-filtered set join over item-sized windows.

A window is `size` consecutive words of an item (an item of fewer is one window). Its shingles are
ordered by rarity, which one pass over all documents counts. A document that holds the whole window
holds every shingle of it, so the prefix that has to be joined is the rarest shingle alone (for a
containment below 1 the prefix would be longer; exact occurrence is what is asked here). The place
of that shingle in the window bounds where the window can lie: a position too near to either end of
the document is dropped by length; what stays is verified word by word. Windows with fewer words
than a shingle are their own shingle.

The benchmark is read in blocks of bounded size, and one block's index at a time is made and sent to the
tasks. Documents do not move: the first block's hits are columns beside them, and only texts are read by
Python. Hits of further blocks are written, by the text's hash, before the next block is read, and joined
at the end.

Defined results: a null text or item has no words and hits nothing; every input row gives one row, and
results depend on its text alone, so rows that repeat an id are marked each by its own text; a
repeated item counts once per distinct id, a null id being the text "null"; an empty benchmark leaves
every document clean; other columns stay, and those named like an output column are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from sys import intern

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extend, fresh_name, lean, raw, ship, slices, written

#: Words are runs of digits, letters and non-ASCII bytes of the UTF-8 text; A-Z become a-z.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: The most item bytes in one block: its index takes a task about forty times that.
BLOCK_BYTES = 2_000_000
OUT = ("n_words", "n_hit", "n_items", "item_ids", "contaminated")

Words = tuple[bytes, ...]
#: Rarest shingle -> [(its place in the window, the window's item, its start and length there, the ids of its items)].
Index = dict[Words, list[tuple[int, list[bytes], int, int, frozenset]]]


def words(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def windows(item: list[bytes] | Words, size: int) -> list[Words]:
    return [tuple(item[i : i + size]) for i in range(len(item) - size + 1)] or ([tuple(item)] if item else [])


def blocks(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items as (id, text), in lists of bounded size, of which one is held at a time."""
    held, size = [], 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")), F.coalesce(F.col("text").cast("string"), F.lit("")))
    for item_id, text in rows.toLocalIterator():
        text = text.encode()
        if held and size + len(text) > limit:
            yield held
            held, size = [], 0
        held.append((item_id, text))
        size += len(text)
    yield held


def shingle_counts(docs: DataFrame, wanted: frozenset, shingle: int) -> Counter:
    """In how many documents each wanted shingle occurs; a task sends one row a shingle, not one a document."""

    def run(batches: Iterator) -> Iterator:
        firsts, lengths = {s[0] for s in wanted}, sorted({len(s) for s in wanted})
        seen: Counter = Counter()
        for b in batches:
            for texts in slices(b.column(0)):
                for w in map(words, texts):
                    at = [i for i, x in enumerate(w) if x in firsts]
                    for n in lengths:
                        seen.update(wanted.intersection([tuple(w[i : i + n]) for i in at]))
        yield pa.RecordBatch.from_pydict({"s": [b" ".join(s) for s in seen], "n": pa.array(list(seen.values()), pa.int64())})

    rows = docs.mapInArrow(lean(run), "s binary, n long").groupBy("s").agg(F.sum("n").alias("n"))
    return Counter({tuple(bytes(r["s"]).split()): r["n"] for r in rows.collect()})  # at most the block's own shingles


def prefix_index(items: list[tuple[str, bytes]], size: int, shingle: int, df: Counter) -> Index:
    holders: dict[Words, list] = {}
    known: dict[bytes, bytes] = {}
    for item_id, text in items:
        held = [known.setdefault(w, w) for w in words(text)]
        for start, w in enumerate(windows(held, size)):
            holders.setdefault(w, [held, start, set()])[2].add(intern(item_id))
    sets: dict[frozenset, frozenset] = {}
    index: Index = {}
    for w, (held, start, ids) in holders.items():
        at, rare = min(enumerate(windows(w, shingle)), key=lambda x: (df[x[1]], x[1]))
        ids = frozenset(ids)
        index.setdefault(rare, []).append((at, held, start, len(w), sets.setdefault(ids, ids)))
    return index


def occurrences(w: list[bytes], index: Index, firsts: set[bytes], lengths: list[int]) -> Iterator[tuple[int, int, frozenset]]:
    """(start, end, item ids) of every window in the words."""
    for i in [i for i, x in enumerate(w) if x in firsts]:
        for n in lengths:
            for at, held, begin, size, ids in index.get(tuple(w[i : i + n]), ()):
                start = i - at
                if start >= 0 and start + size <= len(w) and w[start : start + size] == held[begin : begin + size]:
                    yield start, start + size, ids


def merged(spans: list[int]) -> list[int]:
    """The union of flat (start, end) pairs, as disjoint pairs in order."""
    out: list[int] = []
    for start, end in sorted(zip(spans[::2], spans[1::2], strict=True)):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += (start, end)
    return out


def marker(index: Index) -> Callable[[pa.Array], list]:
    """For each text: how many words, the hit words as flat (start, end) pairs, and the ids of the items hit."""

    firsts, lengths = {s[0] for s in index}, sorted({len(s) for s in index})

    def mark(texts: pa.Array) -> list:
        counts, spans, ids = [], [], []
        for t in raw(texts):
            w = words(t)
            found = list(occurrences(w, index, firsts, lengths))
            counts.append(len(w))
            spans.append(merged([x for f in found for x in f[:2]]))
            ids.append(sorted({i for f in found for i in f[2]}))
        return [pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(ids, pa.list_(pa.string()))]

    return mark


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, shingle: int = 2, text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The input columns with n_words, n_hit, n_items (long), item_ids (sorted strings), contaminated."""
    ship(docs.sparkSession)
    keep = [c for c in docs.columns if c not in OUT]
    text = F.col(text_col).cast("string")
    base = docs.select(text.alias("t"))
    words_col, spans, items = (fresh_name(docs, n) for n in ("__words", "__spans", "__items"))
    shape = f"`{words_col}` long, `{spans}` array<int>, `{items}` array<string>"
    keys = [F.xxhash64("t").alias("h1"), F.xxhash64(F.lit("second"), "t").alias("h2")]
    rows, later = None, []
    for block in blocks(benchmark, block_bytes):
        wanted = frozenset(s for _, t in block for w in windows(words(t), size) for s in windows(w, shingle))
        mark = marker(prefix_index(block, size, shingle, shingle_counts(base, wanted, shingle) if wanted else Counter()))
        if rows is None:
            rows = extend(docs.select(*keep), text, mark, shape)
        else:
            hits = extend(base, F.col("t"), mark, shape).where(F.size(spans) > 0)
            later.append(written(hits.select(*keys, F.col(spans).alias("more"), F.col(items).alias("more_items")).dropDuplicates(["h1", "h2"]), "block-hits"))
    if later:
        hits = later[0]
        for x in later[1:]:
            hits = hits.union(x)
        h1, h2, more, more_items = (fresh_name(rows, n) for n in ("__h1", "__h2", "__more", "__more_items"))
        # a row a text and block
        hits = hits.groupBy("h1", "h2").agg(F.flatten(F.collect_list("more")).alias(more), F.flatten(F.collect_list("more_items")).alias(more_items)).withColumnsRenamed({"h1": h1, "h2": h2})
        rows = rows.withColumns({h1: F.xxhash64(text), h2: F.xxhash64(F.lit("second"), text)}).join(hits, [h1, h2], "left")
        rows = rows.withColumns({spans: F.concat(spans, F.coalesce(more, F.array())), items: F.array_sort(F.array_distinct(F.concat(items, F.coalesce(more_items, F.array()))))})
    pairs = F.transform(F.sequence(F.lit(1), F.size(spans) - 1, F.lit(2)), lambda i: F.sequence(F.col(spans)[i - 1], F.col(spans)[i] - 1))
    hit = F.when(F.size(spans) > 0, F.size(F.array_distinct(F.flatten(pairs)))).otherwise(0).cast("long")
    return rows.select(*keep, F.col(words_col).alias("n_words"), hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.col(items).alias("item_ids"), (hit > 0).alias("contaminated"))
