import math
import time

import pytest
from pyspark.sql import functions as F

from helixframe.operators import association as a
from helixframe.operators import encoders as e
from helixframe.operators import nullmodel as n
from helixframe.operators import statistics as s
from helixframe.operators import sweeps as w
from helixframe.operators import topk as t
from tests.conftest import rows


def metrics(spark, *counts):
    df = spark.createDataFrame([counts], "tp long, fp long, n_pos long, n_neg long")
    return a.with_metrics(df).first()


def test_metrics(spark):
    m = metrics(spark, 30, 10, 40, 60)
    want = {"precision": 0.75, "recall": 0.75, "f1": 0.75, "fpr": 1 / 6, "enrichment": 4.5, "log2_enrichment": 2.169925, "mcc": 0.583333, "balanced_f1": 0.782609}
    for k, v in want.items():
        assert m[k] == pytest.approx(v, abs=1e-6)


def test_extreme_metrics(spark):
    m = metrics(spark, 40, 60, 40, 60)
    assert (m.mcc, m.enrichment) == (0, 1) and m.balanced_f1 == pytest.approx(2 / 3)
    m = metrics(spark, 5, 0, 40, 60)
    assert m.enrichment == math.inf and m.log2_enrichment == math.inf
    m = metrics(spark, 0, 0, 40, 60)
    assert (m.enrichment, m.log2_enrichment, m.mcc, m.f1) == (0, -math.inf, 0, 0)
    assert metrics(spark, 2 * 10**9, 10**9, 3 * 10**9, 4 * 10**9).mcc > 0


def test_rank_puts_what_is_not_finite_last(spark):
    df = spark.createDataFrame([("c", 1, math.inf), ("c", 2, 3.0), ("c", 3, math.nan), ("c", 4, -1.0)], "concept string, feature int, enrichment double")
    assert [r.feature for r in a.ranked(df, "enrichment").orderBy("rank").collect()] == [2, 4, 1, 3]


def test_counts_keep_the_marginals(spark):
    active = spark.createDataFrame([(i, f) for i in range(20) for f in (1, 2, 3) if i % f == 0], "token long, feature int")
    labels = spark.createDataFrame([(i, "x") for i in range(5)] + [(i, "y") for i in range(4, 9)], "token long, concept string")
    got = {(r.concept, r.feature): (r.tp, r.fp, r.n_pos, r.n_neg) for r in a.counts(active, labels, 20).collect()}
    assert got["x", 1] == (5, 15, 5, 15) and got["x", 2] == (3, 7, 5, 15) and got["y", 3] == (1, 6, 5, 15)


def test_bh(spark):
    df = spark.createDataFrame(list(enumerate([0.01, 0.04, 0.03, 0.2, 0.005])), "i int, p double").withColumn("k", F.lit(1))
    assert [round(r.q, 6) for r in s.bh(df, "p", ["k"], "i").orderBy("i").collect()] == [0.025, 0.05, 0.05, 0.2, 0.025]


def test_percentile_and_deviation(spark):
    null = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, 2.0, 3.0, 10.0])], "perm int, v double").withColumn("c", F.lit("c"))
    got = n.summarize(null, spark.createDataFrame([("c", 3.0)], "c string, v double"), ["c"], "v", 4).first()
    assert got.null_q95 == pytest.approx(8.95) and got.null_std == pytest.approx(3.535534) and got.p == pytest.approx(3 / 5)


def test_correlation_without_variance(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 1.0, 3.0), (2, 1.0, 1.0), (2, 2.0, 2.0), (3, 1.0, 1.0)], "k int, x double, y double")
    got = df.groupBy("k").agg(s.correlation("x", "y").alias("nan"), s.correlation("x", "y", 3, 0.0).alias("zero")).orderBy("k").collect()
    assert [(r.nan, r.zero) for r in got] == [(None, 0.0), (pytest.approx(1.0), 0.0), (None, 0.0)]


def test_recovered(spark):
    got = spark.range(1).select(*[s.recovered(F.lit(1.0), F.lit(z), F.lit(v)).alias(f"r{i}") for i, (z, v) in enumerate([(2.0, 1.25), (2.0, 3.0), (1.0, 5.0)])]).first()
    assert list(got) == [75.0, 0.0, 0.0]


def test_circular_shift_keeps_labels(spark):
    labels = spark.createDataFrame([("w", 1), ("w", 2)], "window string, tok int")
    assert sorted(r.tok for r in n.circular_shift(labels, 1, F.lit(8), F.lit(3)).collect()) == [4, 5]
    assert n.circular_shift(labels, 5, F.lit(8), F.col("perm")).groupBy("perm").count().where("count <> 2").count() == 0


def test_top_windows(spark):
    df = spark.createDataFrame([("f", 0, 1, 9.0), ("f", 0, 2, 8.0), ("f", 1, 3, 7.0), ("f", 2, 4, 6.0)], "feature string, window int, id int, act double")
    assert rows(t.top_windows(df, 2, "feature", ["window"], "act", "id"), "window", "act", "rank") == [(0, 9.0, 0)]


def test_batch_top(spark):
    df = spark.createDataFrame([(0, 1, 3.0), (0, 2, 2.0), (0, 3, 1.0), (0, 4, 0.0)], "batch int, id int, act double")
    kept = t.batch_top(df, "batch", 2, "act", "id")
    assert sorted(r.act for r in kept.collect()) == [2.0, 3.0] and t.threshold(kept, "batch", "act").first().theta == 2.0


def test_scaled(spark):
    df = spark.createDataFrame([(1, 4.0), (2, 2.0), (3, 1.0), (4, -3.0)], "i int, v double").withColumn("f", F.lit(1))
    assert [r.n for r in df.select("i", t.scaled_0_10(F.col("v"), "f").alias("n")).orderBy("i").collect()] == [10, 5, 2, 0]


def test_greedy_controls(spark):
    targets = spark.createDataFrame([("c", 1, 0.5), ("c", 2, 0.5)], "c string, target int, rate double")
    pool = spark.createDataFrame([("c", 1, 0.5, 0.0), ("c", 3, 0.51, 0.0), ("c", 4, 0.4, 0.0), ("c", 5, 0.5, 0.9)], "c string, id int, rate double, mcc double")
    assert rows(t.greedy_controls(targets, pool, 2, 0.1, ["c"]), "target", "control") == [(1, 3), (2, 4)]
    assert t.greedy_controls(targets, pool.where("id = 3"), 2, 0.1, ["c"]).count() == 0


@pytest.mark.parametrize("per_bin", [3, 2_000])
def test_every_row_gets_its_nearest_control(spark, per_bin):
    import random

    rng = random.Random(per_bin)
    data = [(i, rng.choice([0, 1, 2, 3, 5, 8, 40, 41, 90]) / 8 if i % 2 else rng.randint(0, 200) / 8, rng.choice([0.0, 0.04, 0.2])) for i in range(150)]
    got = t.nearest_controls(spark.createDataFrame(data, "id int, rate double, mcc double"), 0.05, per_bin)
    want = [(i, *min((abs(r - q), j) for j, q, m in data if j != i and q > 0 and m <= 0.05)[::-1]) for i, r, _ in data]
    assert rows(got, "target", "control", "gap") == sorted(want, key=repr)
    assert t.nearest_controls(spark.createDataFrame(data, "id int, rate double, mcc double").where("false"), 0.05).count() == 0


def test_weighted_sample_is_whole(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 3.0), (3, 0.0)], "id int, w double")
    got = t.weighted_sample(df, 8, "w", "id").groupBy("id").count()
    assert rows(got) == [(1, 2), (2, 6)]


def test_runs(spark):
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate([0, 0, 5, 0, 0, 0])], "k string, i int, v int")
    assert [r.run for r in t.runs(df, ["k"], "i", F.col("v") == 0).orderBy("i").collect()] == [1, 2, 0, 1, 2, 3]


def test_encoders(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "v array<double>")
    got = df.select(e.unit_norm(F.col("v"), 0.0).alias("z"), e.norm(F.col("v")).alias("n"), e.log_softmax_loss(F.col("v"), F.lit(2)).alias("ce"), e.energy_share(F.col("v"), [2]).alias("s"), e.steer(F.col("v"), F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)), F.lit(2.0), F.lit(0.0)).alias("st")).first()
    assert got.z == [-1.0, 0.0, 1.0] and got.n == pytest.approx(14**0.5) and got.ce == pytest.approx(0.407606, abs=1e-6)
    assert got.s == pytest.approx(3 / 14**0.5) and got.st == [-1.0, 2.0, 3.0]
    acts = spark.createDataFrame([(0.5, 0.1, 1.0, 2.0), (-1.0, 0.1, -1.0, 2.0)], "p double, lt double, g double, m double")
    assert rows(acts.select(e.relu(F.col("p")), e.jump_relu(F.col("p"), F.log("lt")), e.gated(F.col("g"), F.col("m")))) == [(0.0, 0.0, 0.0), (0.5, 0.5, 2.0)]


def test_long_vectors_are_normalised_in_time_of_their_length(spark):
    began = time.monotonic()
    v = F.transform(F.sequence(F.lit(1), F.col("id") + 1999), lambda x: x.cast("double"))
    z, ce = spark.range(1, 2).select(e.unit_norm(v, 0.0), e.log_softmax_loss(v, F.lit(1999))).first()
    dev = (2000 * 2001 / 12) ** 0.5
    assert z[0] == pytest.approx(-999.5 / dev) and z[1999] == pytest.approx(999.5 / dev) and ce == pytest.approx(math.log(math.e / (math.e - 1)))
    # each element once, not the whole vector for each element: that took minutes
    assert time.monotonic() - began < 30
    short = spark.createDataFrame([(0, None), (1, []), (2, [3.0])], "i int, v array<double>")
    assert [r.z for r in short.orderBy("i").select(e.unit_norm(F.col("v")).alias("z")).collect()] == [None, [], [None]]


def test_sweeps(spark):
    df = spark.createDataFrame([("m", 100, 5), ("m", 200, 3), ("m", 300, 3)], "g string, step int, dead int")
    assert w.best_step(df, "g", "step", "dead").first().best_step == 200
    f = spark.createDataFrame([(2 / 3,), (0.6661,), (0.66,)], "f double").select(w.trivial(F.col("f")).alias("t"))
    assert sorted(r.t for r in f.collect()) == [False, True, True]
    with pytest.raises(Exception, match="more than one value"):
        w.pivoted(df.withColumn("step", F.lit(1)), "g", "step", "dead", [1]).collect()


def test_targets_and_lines(spark):
    from helixframe.operators import steering as st

    best = spark.createDataFrame([("a", 3, 7), ("b", 5, 9)], "concept string, layer int, feature int")
    specs = spark.createDataFrame([("a",), ("b:5",), ("a:2:4",), ("c",)], "spec string")
    assert rows(st.resolved_targets(specs, best, 3)) == sorted([("a", 3, 7), ("b", 5, 9), ("a", 2, 4), ("c", 3, None)], key=repr)
    assert spark.range(1).select(st.numbered(F.array(F.lit("x"), F.lit("y"))).alias("t")).first().t == "Seq 01: x\nSeq 02: y"
