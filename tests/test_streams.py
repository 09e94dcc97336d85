import random

import pytest
from pyspark.sql import functions as F

from helixframe.operators import topk
from helixframe.streaming import permuted, state
from tests.conftest import rows


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 16, 97, 1000])
def test_places_are_a_permutation(spark, n):
    df = spark.range(n).select("id", permuted.place_of(F.col("id"), n, 5).alias("place"))
    got = [r.place for r in df.orderBy("id").collect()]
    assert sorted(got) == list(range(n))
    back = df.select("id", permuted.row_at(F.col("place"), n, 5).alias("row")).collect()
    assert all(r.id == r.row for r in back)
    if n > 90:
        other = [r.place for r in spark.range(n).select("id", permuted.place_of(F.col("id"), n, 6).alias("place")).orderBy("id").collect()]
        assert got != list(range(n)) and got != other and sum(a == b for a, b in zip(got, other)) < n // 10
        # neighbours do not stay near each other
        assert sum(abs(a - b) < 3 for a, b in zip(got, got[1:])) < n // 8


def test_large_tables_have_places(spark):
    n = 10**15 + 37
    df = spark.createDataFrame([(i,) for i in (0, 1, n - 1, 123_456_789_012)], "id long")
    got = df.select("id", permuted.place_of(F.col("id"), n, 1).alias("p")).select("id", "p", permuted.row_at(F.col("p"), n, 1).alias("back")).collect()
    assert all(0 <= r.p < n and r.back == r.id for r in got) and len({r.p for r in got}) == 4


def test_halves_equal_one_run_at_any_position(spark):
    table, n = permuted.numbered(spark.range(500).select((F.col("id") * 3).alias("x")).repartition(4))
    assert n == 500 and rows(table, "row") == [(i,) for i in sorted(range(500), key=lambda i: repr((i,)))]
    whole = {(r.batch, r.place): r.x for r in permuted.epoch(table, n, 64, 9).collect()}
    assert sorted(p for _, p in whole) == list(range(500)) and all(b == p // 64 for b, p in whole)
    for cut in (1, 64, 333, 499):
        halves = permuted.epoch(table, n, 64, 9, 0, cut).union(permuted.epoch(table, n, 64, 9, cut))
        assert {(r.batch, r.place): r.x for r in halves.collect()} == whole
    plan = permuted.epoch(table, n, 64, 9)._jdf.queryExecution().executedPlan().toString()
    # only the list of files is sorted and exchanged
    assert plan.count("Sort [") == plan.count("Sort [__file") and plan.count("Exchange hashpartitioning") == plan.count("Exchange hashpartitioning(__file")


def test_a_stream_goes_on_from_its_position(spark, tmp_path):
    table, n = permuted.numbered(spark.range(300).withColumnRenamed("id", "x").repartition(3))
    for stop in (130, 131, None):
        q = permuted.stream_epoch(table, n, 50, 4, stop=stop).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).start()
        q.processAllAvailable()
        q.stop()
        if stop == 130:
            assert rows(spark.read.parquet(str(tmp_path / "out")), "place") == sorted(((i,) for i in range(130)), key=repr)
    assert rows(spark.read.parquet(str(tmp_path / "out")), "batch", "place", "x") == rows(permuted.epoch(table, n, 50, 4), "batch", "place", "x")


def test_a_streamed_epoch_takes_few_micro_batches_however_long_it_is(spark, tmp_path):
    table, n = permuted.numbered(spark.range(3000).withColumnRenamed("id", "x").repartition(3))
    for stop in (1234, None):
        q = permuted.stream_epoch(table, n, 10, 4, stop=stop).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).start()
        q.processAllAvailable()
        q.stop()
    assert rows(spark.read.parquet(str(tmp_path / "out")), "batch", "place", "x") == rows(permuted.epoch(table, n, 10, 4), "batch", "place", "x")
    # 300 batches in 16 ranges, one of them in two parts
    assert len([f for f in (tmp_path / "ck" / "commits").iterdir() if f.name.isdigit()]) <= permuted.TURNS + 1


def test_silent_runs_over_interrupted_queries(spark, tmp_path):
    rng = random.Random(1)
    events = [(rng.choice(["hot", "a", "b", None]), i, rng.choice([0, 0, 0, 1, None])) for i in range(240)]
    want, run = [], {}
    for key, i, v in events:
        run[key] = run.get(key, 0) + 1 if v == 0 else 0
        want.append((i, run[key]))
    for low in range(0, 240, 60):
        spark.createDataFrame(events[low : low + 60], "k string, at long, v int").repartition(2).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if low % 120 == 60:
            stream = spark.readStream.schema("k string, at long, v int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            state.silent_runs(stream, "k", "at", "v = 0").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.at, r.run) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == want


def test_silent_runs_of_many_keys_share_their_calls(spark, tmp_path, monkeypatch):
    # calls are of buckets of keys, a key's own call cost more than its rows
    monkeypatch.setattr(state, "BUCKETS", 3)
    rng = random.Random(5)
    events = [(rng.choice([None, *range(50)]), i, rng.choice([0, 0, 1, None])) for i in range(900)]
    want, run = [], {}
    for key, i, v in events:
        run[key] = run.get(key, 0) + 1 if v == 0 else 0
        want.append((key, i, run[key]))
    for low in (0, 300, 600):
        spark.createDataFrame(events[low : low + 300], "k long, at long, v int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("k long, at long, v int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = state.silent_runs(stream, "k", "at", "v = 0").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out")), "k", "at", "run") == sorted(want, key=repr)


def test_greedy_controls_equal_turns_over_the_whole_pool(spark):
    rng = random.Random(2)
    pool = [(k, i, rng.choice([0.0, 0.1, 0.2, 0.3, 0.35, 0.9]), rng.choice([0.0, 0.5])) for k in ("a", "b", "hot", None) for i in range(300 if k == "hot" else 9)]
    targets = [(k, i, rng.random()) for k in ("a", "b", "hot", None, "none") for i in rng.sample(range(9), 5)]
    want = []
    for k in {t[0] for t in targets}:
        wanted = sorted((i, r) for x, i, r in targets if x == k)[:4]
        free = {i: r for x, i, r, m in pool if x == k and r > 0 and abs(m) <= 0.1 and i not in {w[0] for w in wanted}}
        if len(free) >= len(wanted):
            for i, r in wanted:
                best = min(free, key=lambda j: (abs(free[j] - r), j))
                want.append((k, i, best))
                del free[best]
    got = topk.greedy_controls(spark.createDataFrame(targets, "key string, target int, rate double"), spark.createDataFrame(pool, "key string, id int, rate double, mcc double"), 4, 0.1, ["key"])
    assert rows(got, "key", "target", "control") == sorted(want, key=repr)
