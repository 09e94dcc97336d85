"""Near-duplicate grouping by circulant MinHash, banding and exact Jaccard verification.

A document's set is its distinct `words`-word shingles. One permutation sends shingles to a ring of
2^32 places, a second one, shifted around the ring by k, gives signature coordinate k; the two make
all coordinates. Documents with equal sets form a class at once. Classes that agree in a band of
coordinates share a bucket; with 32 bands of 4, a pair at the limit of 0.75 misses every bucket with
probability 5e-6.

Buckets are worked off in rounds, never as all their pairs. In a round each bucket names a few hubs
(1, 4, 16, ... of its smallest classes), and only members of other components are compared with them,
after a bound from the set sizes. Verified links merge components, so a large group of copies is
settled by its first hubs, and hubs leave the bucket once compared with all of it. Buckets that are
still large and mixed after the first round hold documents that share much, but mostly less than the limit: their members leave
for an exact prefix-filtered join of full sets, whose rarest shingles tell them apart. A bucket is done
when one component is left in it; until then no pair is skipped, so no cap and no loss is involved. Links
are confirmed on full sets, which are made again for candidates alone.

Texts do not move, and neither links nor components come to the driver.

Defined results: null or empty text has an empty set, is linked with nothing and stays; a null id counts
as larger than any other, and documents of null ids alone have a null component and stay; rows that repeat
an id and its text are one document and share its fate, while rows that repeat an id with other texts each
follow their own text; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE, lean, raw, ship, written

#: Of the shingle hash and the second permutation (odd multipliers, so that the latter is one).
STEP = np.uint64(0x9E3779B97F4A7C15)
MIX = (np.uint32(0x7FEB352D), np.uint32(0x846CA68B))
#: Shingles handled at once: their permuted places stay in a core's cache.
CHUNK = 1 << 17
#: Mixed buckets above this size go to the prefix-filtered join.
LARGE = 24
#: So many members of a component are tried in that join before all are.
MEMBERS = 8
#: So many shingles that several members hold (16 bytes each) are handed to every task.
MAX_SHARED = 1_000_000
#: So many shingles before one tell whether a pair has met already.
BEFORE = 16
#: Candidate ids that may be broadcast (16 bytes each), and hubs (32 bytes).
MAX_BROADCAST, MAX_HUBS = 2_000_000, 300_000


class WordHashes(dict):
    """Hashes by word; forgets them all when it has become large."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingles(texts: list[bytes], words: int, seen: WordHashes) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out = []
    for text in texts:
        w = text.lower().split()
        if not w:
            out.append(np.zeros(0, np.uint64))
            continue
        a = np.array([seen[x] for x in w], dtype=np.uint64)
        n = max(1, len(a) - words + 1)
        h = np.full(n, min(len(a), words), dtype=np.uint64)
        for i in range(min(len(a), words)):
            h = (h + a[i : i + n]) * STEP
            h ^= h >> np.uint64(29)
        out.append(np.unique(h))
    return out


def signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """size coordinates (uint32) for each set; an empty set's are not used."""
    sig = np.full((size, len(sets)), 0xFFFFFFFF, dtype=np.uint32)
    begin = 0
    while begin < len(sets):
        end, held = begin, 0
        while end < len(sets) and (held == 0 or held + len(sets[end]) <= CHUNK):
            held += len(sets[end])
            end += 1
        full = [i for i in range(begin, end) if len(sets[i])]
        if full:
            # the first permutation: the hash's upper half is its place on the ring
            ring = (np.concatenate([sets[i] for i in full]) >> np.uint64(32)).astype(np.uint32)
            starts = np.cumsum([0, *(len(sets[i]) for i in full[:-1])])
            x, y = np.empty_like(ring), np.empty_like(ring)
            for k in range(size):
                np.add(ring, np.uint32(k), out=x)  # the ring turned by k, then the second permutation
                np.right_shift(x, 16, out=y)
                np.bitwise_xor(x, y, out=x)
                np.multiply(x, MIX[0], out=x)
                np.right_shift(x, 15, out=y)
                np.bitwise_xor(x, y, out=x)
                np.multiply(x, MIX[1], out=x)
                sig[k, full] = np.minimum.reduceat(x, starts)
        begin = end
    return sig


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """(documents, bands): a 64-bit key for each band's coordinates and place."""
    bands = sig.shape[0] // rows
    keys = np.empty((sig.shape[1], bands), dtype=np.uint64)
    for b in range(bands):
        h = np.full(sig.shape[1], b + 1, dtype=np.uint64)
        for k in range(b * rows, (b + 1) * rows):
            h = (h + sig[k]) * STEP
            h ^= h >> np.uint64(31)
        keys[:, b] = h
    return keys


def _flat(arrays: list[np.ndarray]):
    import pyarrow as pa

    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *arrays]).view(np.int64)))


def _set_hashes(sets: list[np.ndarray]) -> list:
    import pyarrow as pa
    import xxhash

    both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), dtype="<i8").reshape(-1, 2)
    return [pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())]


def sketch(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """docs: doc_id, key, text. doc_id, key, n, h1, h2 (the set's 128-bit hash), bands. The result is small beside the texts."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen = WordHashes()
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                sets = shingles(raw(b.column(2).slice(at, SLICE)), words, seen)
                keys = band_keys(signatures(sets, bands * rows), rows)
                lists = _flat([keys[i] if len(s) else keys[i][:0] for i, s in enumerate(sets)])
                cols = [b.column(0).slice(at, SLICE), b.column(1).slice(at, SLICE), pa.array([len(s) for s in sets], pa.int64()), *_set_hashes(sets), lists]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "key", "n", "h1", "h2", "bands"])

    return docs.mapInArrow(lean(run), "doc_id long, key long, n long, h1 long, h2 long, bands array<long>")


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    """h1, h2, and the whole shingle set of each row."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen = WordHashes()
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                sets = shingles(raw(b.column(0).slice(at, SLICE)), words, seen)
                yield pa.RecordBatch.from_arrays([*_set_hashes(sets), _flat(sets)], names=["h1", "h2", "items"])

    return docs.mapInArrow(lean(run), "h1 long, h2 long, items array<long>")


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, comp): the smallest node reachable, by spreading minima and jumping along labels."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    sent = F.broadcast if both.count() <= MAX_BROADCAST else lambda df: df  # labels are at most as many as edges
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")), "labels")
    while True:
        near = both.join(sent(labels.withColumnsRenamed({"node": "b"})), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("m"))
        spread = labels.join(sent(near), "node").select("node", F.col("comp").alias("old"), F.least("comp", "m").alias("to"))
        target = labels.select(F.col("node").alias("to"), F.col("comp").alias("further"))
        jumped = written(spread.join(sent(target), "to", "left").select("node", "old", F.least("to", F.coalesce("further", "to")).alias("comp")), "labels")
        done = jumped.where("comp <> old").isEmpty()
        labels = jumped.select("node", "comp")
        if done:
            return labels


def row_key(id_col: str, text_col: str) -> Column:
    """A hash of id and text: equal for rows that are one document."""
    return F.xxhash64(F.col(id_col).cast("long"), F.lit("text"), F.col(text_col).cast("string"))


def with_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75, bands: int = 32, rows: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, and key (row_key() of the row): one row an input row."""
    ship(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    sig = written(sketch(base, words, bands, rows), "signatures")
    classes = sig.where("n > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.min("key").alias("key"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("cls"), "*"), "classes")

    members = classes.select(F.explode("bands").alias("bucket"), "cls", "n")
    # most buckets hold one class: they are told apart by counts, so only members of shared buckets move
    shared = written(members.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1").select("bucket"), "shared")
    live = written(members.join(F.broadcast(shared) if shared.count() <= MAX_BROADCAST else shared, "bucket"), "buckets")
    comp = verified(live, classes, base, words, percent)

    known = classes.select("h1", "h2", "first", "cls")
    if comp is not None:
        named = known.join(comp.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
        least = named.groupBy("comp").agg(F.min("first").alias("component"))
        known = named.join(least, "comp")
    else:
        known = known.withColumn("component", F.col("first"))
    out = sig.select("doc_id", "key", "n", "h1", "h2").join(known.select("h1", "h2", "component"), ["h1", "h2"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "key")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row an input row. Options: those of with_keys()."""
    return with_keys(docs, **options).drop("key")


def prefixes(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """cls, n, token, pos, short, prev: the rarest shingles of each member (cls, n), which linked sets must share.

    Shingles are ordered by how few of the members hold them; those that one member holds count as places but make no
    rows. Linked sets share a shingle within the first n - ceil(p n) + 1 of the larger and n - ceil(2 p n / (1 + p)) + 1
    (marked short) of the smaller one. prev: the BEFORE shared shingles before this one in the member's order."""
    rows = members.join(sets, "cls").select("cls", "n", "items")

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            tokens, n = np.unique(b.column(0).flatten().to_numpy(zero_copy_only=False), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array(n, pa.int64())], names=["token", "n"])

    # a row a shingle and batch of sets, not one a set
    held = rows.select("items").mapInArrow(lean(count), "token long, n long").groupBy("token").agg(F.sum("n").alias("df"))
    shared = written(held.where("df > 1"), "shared-shingles")
    if shared.count() > MAX_SHARED:
        return ordered_by_join(rows, shared, percent)
    table = shared.orderBy("token").toArrow()
    tokens, df = table["token"].to_numpy(), table["df"].to_numpy()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for i in range(b.num_rows):
                items = b.column(2)[i].values.to_numpy(zero_copy_only=False)
                n = len(items)
                at = np.searchsorted(tokens, items)
                known = np.zeros(n, dtype=bool) if not len(tokens) else tokens[np.minimum(at, len(tokens) - 1)] == items
                often = np.zeros(n, dtype=np.int64)
                often[known] = df[at[known]]
                probe = n - -(-percent * n // 100) + 1
                short = n - -(-2 * percent * n // (100 + percent)) + 1
                alone = min(probe, int((often == 0).sum()))  # these come first
                first = items[np.lexsort((items, often))[alone:probe]]
                ends = np.arange(len(first))
                starts = np.maximum(ends - BEFORE, 0)
                sizes = ends - starts
                inner = np.repeat(starts - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
                prev = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(first[inner]))
                one = lambda x: pa.array(np.full(len(first), x, dtype=np.int64))
                pos = ends + alone + 1
                cols = [one(b.column(0)[i].as_py()), one(n), pa.array(first), pa.array(pos, pa.int64()), pa.array(pos <= short), prev]
                yield pa.RecordBatch.from_arrays(cols, names=["cls", "n", "token", "pos", "short", "prev"])

    return written(rows.mapInArrow(lean(run), "cls long, n long, token long, pos long, short boolean, prev array<long>"), "prefixes")


def ordered_by_join(rows: DataFrame, shared: DataFrame, percent: int) -> DataFrame:
    """prefixes() where the shared shingles are too many for every task: they are joined to the members' shingles."""
    order = F.row_number().over(Window.partitionBy("cls").orderBy(F.coalesce("df", F.lit(0)), "token"))
    probe = F.col("n") - F.expr(f"({percent} * n + 99) div 100") + 1
    index = F.col("n") - F.expr(f"({2 * percent} * n + {99 + percent}) div {100 + percent}") + 1
    tokens = rows.select("cls", "n", F.explode("items").alias("token")).join(shared, "token", "left")
    prefix = tokens.withColumn("pos", order.cast("long")).where((F.col("pos") <= probe) & F.col("df").isNotNull())
    prev = F.collect_list("token").over(Window.partitionBy("cls").orderBy("pos").rowsBetween(-BEFORE, -1))
    return written(prefix.select("cls", "n", "token", "pos", (F.col("pos") <= index).alias("short"), prev.alias("prev")), "prefixes")


def prefix_pairs(prefix: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """Pairs in different components (cls, comp) that may be linked: an exact filter, not a sketch.

    At their first common shingle enough of both sets must be left to reach the needed overlap. A pair is made there
    and not again at later ones, as far as the shingles before show that they are later."""
    named = prefix.join(comps, "cls")
    x, y = named.alias("x"), named.where("short").alias("y")
    c = {k: F.col(k) for k in ("x.cls", "x.n", "x.pos", "x.comp", "x.prev", "y.cls", "y.n", "y.pos", "y.comp", "y.prev")}
    needed = F.ceil(percent * (c["x.n"] + c["y.n"]) / F.lit(100 + percent))
    smaller = (c["y.n"] < c["x.n"]) | ((c["y.n"] == c["x.n"]) & (c["y.cls"] < c["x.cls"]))
    left = 1 + F.least(c["x.n"] - c["x.pos"], c["y.n"] - c["y.pos"])
    fits = smaller & (100 * c["y.n"] >= percent * c["x.n"]) & (c["x.comp"] != c["y.comp"]) & (left >= needed) & ~F.arrays_overlap(c["x.prev"], c["y.prev"])
    both = x.join(y, (F.col("x.token") == F.col("y.token")) & fits)
    a, b = F.struct("x.cls", "x.n", "x.comp"), F.struct("y.cls", "y.n", "y.comp")
    pairs = both.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    return pairs.select(F.col("a.cls").alias("cls"), F.col("b.cls").alias("hub"), F.col("a.n").alias("n"), F.col("b.n").alias("hub_n"), F.col("a.comp").alias("comp"), F.col("b.comp").alias("hub_comp"))


def with_comp(rows: DataFrame, comp: DataFrame | None) -> DataFrame:
    """Adds comp: the class's component so far, itself at first."""
    if comp is None:
        return rows.withColumn("comp", F.col("cls"))
    named = comp.withColumnRenamed("node", "cls")
    named = F.broadcast(named) if comp.count() <= MAX_BROADCAST else named
    return rows.join(named, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))


def verified(live: DataFrame, classes: DataFrame, base: DataFrame, words: int, percent: int) -> DataFrame | None:
    """(node, comp) over the classes that true links join; None if there are no candidates."""
    ids = written(live.select("cls").distinct().join(classes.select("cls", "key", "h1", "h2"), "cls"), "candidates")
    n = ids.count()
    if not n:
        return None
    firsts = ids.select("key").distinct()
    firsts = F.broadcast(firsts) if n <= MAX_BROADCAST else firsts
    sets = full_sets(base.join(firsts, "key", "left_semi").select("text"), words).join(ids.select("cls", "h1", "h2"), ["h1", "h2"])
    sets = written(sets.dropDuplicates(["cls"]).select("cls", "items"), "sets")

    comp, failed, hubs, prefix, left = None, None, 1, None, live.count()
    while True:
        at = with_comp(live, comp).select("bucket", "cls", "n", "comp")
        mixed = at.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket")
        at = written(at.join(F.broadcast(mixed) if left <= MAX_HUBS else mixed, "bucket"), "open")
        left = at.count()
        if not left and prefix is None:
            return comp
        apart = None
        if hubs == 4:  # after the first round, once and for all
            large = at.groupBy("bucket").agg(F.count("*").alias("c")).where(F.col("c") > LARGE).select("bucket")
            members = written(at.join(large, "bucket", "left_semi").select("cls", "n").distinct(), "large")
            at = written(at.join(large, "bucket", "left_anti"), "open")
            left = at.count()
            if not members.isEmpty():
                prefix = prefixes(members, sets, percent)
                # first a few members of each component, which settle most of what joins a large one ...
                few = F.row_number().over(Window.partitionBy("comp").orderBy(F.xxhash64("cls"), "cls"))
                apart = with_comp(members, comp).withColumn("r", few).where(F.col("r") <= MEMBERS).select("cls", "comp")
        elif prefix is not None:  # ... then, in the next round, all
            apart = with_comp(members, comp).select("cls", "comp")
        if hubs == 1:
            chosen = at.groupBy("bucket").agg(F.min(F.struct("cls", "n", "comp")).alias("h")).select("bucket", "h.*")
        else:
            rank = F.row_number().over(Window.partitionBy("bucket").orderBy("cls"))
            chosen = at.withColumn("r", rank).where(F.col("r") <= hubs).drop("r")
        chosen = chosen.withColumnsRenamed({"cls": "hub", "n": "hub_n", "comp": "hub_comp"})
        if left <= MAX_HUBS:  # hubs are rows of it
            chosen = F.broadcast(chosen)
        near = (F.col("cls") > F.col("hub")) & (F.col("comp") != F.col("hub_comp")) & (100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n"))
        pairs = at.join(chosen, "bucket").where(near).select("cls", "hub", "n", "hub_n", "comp", "hub_comp").distinct()
        if apart is not None:
            pairs = pairs.union(prefix_pairs(prefix, written(apart, "apart"), percent).select(pairs.columns)).distinct()
            prefix = prefix if hubs == 4 else None
        if failed is not None:
            pairs = pairs.join(failed, ["cls", "hub"], "left_anti")
        both = pairs.join(sets, "cls").join(sets.withColumnsRenamed({"cls": "hub", "items": "hub_items"}), "hub")
        common = F.size(F.array_intersect("items", "hub_items"))
        judged = both.select("cls", "hub", "comp", "hub_comp", (100 * common >= percent * (F.col("n") + F.col("hub_n") - common)).alias("linked"))
        judged = written(judged, "judged")
        links = judged.where("linked").select(F.col("comp").alias("a"), F.col("hub_comp").alias("b"))
        if not links.isEmpty():
            merged = components(links)
            if comp is None:
                comp = merged
            else:
                moved = comp.join(merged.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left")
                alone = merged.join(comp.select("node"), "node", "left_anti")
                comp = written(moved.select("node", F.coalesce("to", "comp").alias("comp")).union(alone), "comp")
        bad = judged.where("not linked").select("cls", "hub")
        failed = bad if failed is None else failed.union(bad)
        live = at.select("bucket", "cls", "n").join(chosen.select("bucket", F.col("hub").alias("cls")), ["bucket", "cls"], "left_anti")
        hubs *= 4
