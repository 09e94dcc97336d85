import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from helixframe.operators import association, blocks, intervals, nullmodel
from tests.conftest import rows


@pytest.fixture(params=[4_000_000, 20])
def cells(request, monkeypatch):
    """Blocks that hold everything, and blocks that are given out again and again."""
    monkeypatch.setattr(blocks, "CELLS", request.param)
    monkeypatch.setattr(blocks, "WIDTH", 4096 if request.param > 20 else 3)


def tokens(spark, n=300, width=7):
    rng = random.Random(n)
    out = []
    for i in range(n):
        labels = None if i % 29 == 3 else rng.sample(["a", "b", "c", "hot"], rng.randint(0, 3)) + (["hot2"] if i % 3 == 0 else [])
        x = None if i % 31 == 2 else [rng.choice([0.0, -1.0, 0.5, 2.0, math.nan]) for _ in range(width)]
        out.append((i, labels, x, x and [v / 2 for v in x]))
    return spark.createDataFrame(out, "id int, labels array<string>, x array<float>, y array<float>").repartition(5), out


def brute(out, width):
    zero = lambda v: 0.0 if math.isnan(v) else v
    vec = [([zero(v) for v in x] if x else [0.0] * width, [zero(v) for v in y] if y else [0.0] * width, ls or []) for _, ls, x, y in out]
    got = []
    for c in {c for _, _, ls in vec for c in ls}:
        mine = [(x, y) for x, y, ls in vec if c in ls]
        for f in range(width):
            got.append((c, f, sum(x[f] > 0 for x, _ in mine), sum(x[f] > 0 for x, _, _ in vec), len(mine), len(vec), round(sum((x[f] - y[f]) ** 2 for x, y in mine) / len(mine), 9)))
    return sorted(got, key=repr)


def test_counts_and_errors(spark, cells):
    df, out = tokens(spark)
    got = blocks.count_blocks(df, 7, vector="x", rebuilt="y").withColumn("mse", F.round("mse", 9))
    assert rows(got) == brute(out, 7)


def test_active_lists_give_the_same_counts(spark, cells):
    df, _ = tokens(spark)
    sparse = df.select("labels", F.expr("filter(transform(x, (v, i) -> IF(v > 0 AND NOT isnan(v), i, NULL)), i -> i IS NOT NULL)").alias("on"))
    names = ["concept", "feature", "tp", "fires", "n_pos", "total"]
    assert rows(blocks.count_blocks(sparse, 7, active="on"), *names) == rows(blocks.count_blocks(df, 7, vector="x"), *names)


def test_equal_to_the_join_of_tokens(spark):
    df, _ = tokens(spark)
    active = df.select("id", F.posexplode("x").alias("feature", "v")).where("v > 0 AND NOT isnan(v)").select(F.col("id").alias("token"), "feature")
    held = df.select(F.col("id").alias("token"), F.explode("labels").alias("concept"))
    names = ["concept", "feature", "tp", "fp", "n_pos", "n_neg"]
    assert rows(blocks.association_counts(df, 7, vector="x"), *names) == rows(association.counts(active, held, df.count()), *names)


def test_no_tokens_and_bad_calls(spark):
    df, _ = tokens(spark)
    assert blocks.count_blocks(df.where("false"), 7, vector="x").count() == 0
    with pytest.raises(ValueError):
        blocks.count_blocks(df, 7)


def test_tokens_are_not_shuffled(spark):
    """What is exchanged is a task's block: as many rows from a hundred tokens as from ten thousand."""
    df, _ = tokens(spark, 20)
    many = df.coalesce(2).crossJoin(F.broadcast(spark.range(200))).drop("id")
    seen = []
    for part in (df.coalesce(2), many.coalesce(2)):
        got = blocks.count_blocks(part.select("labels", "x"), 7, vector="x")
        seen.append(got.count())
    assert seen[0] == seen[1]


@pytest.mark.parametrize("length", [5, 64, 100])
def test_all_shifts(spark, cells, length):
    rng = random.Random(length)
    n = 9
    held = {(rng.randint(0, 5), rng.randint(0, length - 1), rng.choice(["a", "b"])) for _ in range(150)}
    fired = {(rng.randint(0, 6), rng.randint(0, length - 1), rng.randint(0, 3)) for _ in range(150)}
    shift = {w: [rng.randint(-300, 300) for _ in range(n)] for w in range(8)}
    want = Counter()
    for w in range(8):
        mine, acts = [x for x in held if x[0] == w], [x for x in fired if x[0] == w]
        for c in {x[2] for x in mine}:
            for f in {x[2] for x in acts}:
                for p in range(n):
                    at = {(t + shift[w][p]) % length for _, t, k in mine if k == c}
                    want[p, c, f] += sum(t in at for _, t, k in acts if k == f)
    df = lambda x, schema: spark.createDataFrame(sorted(x), schema).repartition(3)
    active, labels = df(fired, "window int, tok int, feature int"), df(held, "window int, tok int, concept string")
    got = blocks.shift_hits(active, labels, spark.createDataFrame(list(shift.items()), "window int, shifts array<int>"), length)
    assert {(r.perm, r.concept, r.feature): r.tp for r in got.collect()} == dict(want)
    # the same hits as from labels that are moved row by row
    moved = nullmodel.circular_shift(labels, n, F.lit(length), F.element_at(F.create_map(*[F.lit(x) for w, s in shift.items() for x in (w, 0)]), F.col("window")) + 3 * F.col("perm"))
    rowwise = nullmodel.true_positives(active, moved, ["window", "tok"], ["concept", "feature"])
    step = spark.range(8).select(F.col("id").cast("int").alias("window"), F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda p: 3 * p).alias("shifts"))
    got = blocks.shift_hits(active, labels, step, length).where("tp > 0")
    assert rows(got, "perm", "concept", "feature", "tp") == rows(rowwise, "perm", "concept", "feature", "tp")


def test_bitmaps_equal_joined_bins(spark, cells):
    rng = random.Random(5)
    bins = [(rng.choice(["a", "b", "c", None, "lonely"]), rng.choice(["x", "y", None]), b) for b in [rng.choice([-70_000, -1, 0, 1, 32_768, 32_769, 5, 6, 10**12, None]) for _ in range(200)]]
    bins = [(*b[:2], 77) if b[0] == "lonely" else b for b in bins]
    df = spark.createDataFrame(bins, "label string, key string, bin long").repartition(4)
    held = defaultdict(set)
    for label, key, b in bins:
        if b is not None:
            held[label].add((key, b))
    got = intervals.set_overlap(df, "label", ["key", "bin"])
    want = sorted(((a, b, len(held[a]), len(held[b]), len(held[a] & held[b])) for a in held for b in held), key=repr)
    assert rows(got, "a", "b", "n_a", "n_b", "both") == want
    as_text = df.where("bin IS NOT NULL").withColumn("bin", F.col("bin").cast("string"))
    assert rows(intervals.set_overlap(as_text.where("key IS NOT NULL AND label IS NOT NULL"), "label", ["key", "bin"]), "a", "b", "both") == rows(intervals.set_overlap(df.where("key IS NOT NULL AND label IS NOT NULL"), "label", ["key", "bin"]), "a", "b", "both")
    assert intervals.set_overlap(df.where("false"), "label", ["key", "bin"]).count() == 0
