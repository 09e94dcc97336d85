import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from helixframe.operators import clustering
from helixframe.plans import interpret


def plain(points, k, rounds, starts, seed=42):
    """points: (id, vector) of one group; -> {id: cluster}, group by group and start by start."""
    best = None
    first = {}
    for i, v in points:
        first[v] = min(first.get(v, i), i)
    for start in range(starts):
        order = sorted(first.items(), key=lambda x: (hashlib.md5(f"{seed}|{start}|{x[1]}".encode()).hexdigest(), x[1]))
        centres = [list(v) for v, _ in order[:k]]
        pick = lambda v, centres=centres: min((math.fsum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))
        for _ in range(rounds):
            at = [pick(v)[1] for _, v in points]
            for j in range(len(centres)):
                mine = [v for (_, v), c in zip(points, at) if c == j]
                if mine:
                    centres[j] = [math.fsum(x) / len(mine) for x in zip(*mine)]
        error = round(sum(pick(v)[0] for _, v in points), 9)
        if best is None or error < best[0]:
            best = (error, {i: pick(v)[1] for i, v in points})
    return best[1]


@pytest.fixture
def many(spark):
    """A feature with a third of all examples, one with two distinct points, a null feature, null vectors."""
    rng = random.Random(11)
    out = []
    for i in range(400):
        g = "hot" if i % 3 == 0 else "few" if i % 3 == 1 and i < 30 else rng.choice(["a", "b", None])
        v = (1.0, float(i % 2)) if g == "few" else tuple(rng.gauss(4 * rng.randint(0, 2), 1) for _ in range(2))
        out.append((i, g, None if i % 57 == 5 else v))
    return out


def as_table(spark, many):
    return spark.createDataFrame([(i, g, list(v) if v else None) for i, g, v in many], "id int, feature string, v array<double>").repartition(3)


@pytest.mark.parametrize("starts", [1, 3])
def test_all_groups_equal_one_group_at_a_time(spark, many, starts, monkeypatch):
    monkeypatch.setattr(clustering, "MAX_GROUPS", 50_000 if starts == 1 else 2)
    got = {r.id: r.cluster for r in clustering.kmeans(as_table(spark, many), "feature", "v", 3, rounds=6, starts=starts).collect()}
    want = {i: None for i, _, v in many if v is None}
    for g in {x[1] for x in many}:
        want |= plain([(i, v) for i, x, v in many if x == g and v is not None], 3, 6, starts)
    assert got == want


def test_standardised(spark, many):
    rows = clustering.standardised(as_table(spark, many).where("v IS NOT NULL"), "feature", "v").select("feature", F.posexplode("v").alias("d", "x"))
    for r in rows.groupBy("feature", "d").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).collect():
        assert abs(r.m) < 1e-9 and (abs(r.s - 1) < 1e-9 or (r.feature, r.d) == ("few", 0))


def test_reclustered_features_have_summaries(spark, many):
    """The recluster step: examples of each feature in clusters, a summary a cluster."""
    df = as_table(spark, many).withColumn("chrom", F.concat(F.lit("chr"), F.col("id") % 4))
    out = clustering.kmeans(df.where("v IS NOT NULL AND feature IS NOT NULL"), "feature", "v", 3, rounds=3, starts=1)
    got = interpret.cluster_summary(out, "chrom", "id", ["feature", "cluster"])
    assert {r.feature: r.c for r in got.groupBy("feature").agg(F.count("*").alias("c")).collect()} == {"hot": 3, "few": 2, "a": 3, "b": 3}
    assert got.agg(F.sum("n")).first()[0] == out.count()


def test_empty_table(spark, many):
    assert clustering.kmeans(as_table(spark, many).where("false"), "feature", "v", 3, rounds=2).count() == 0
