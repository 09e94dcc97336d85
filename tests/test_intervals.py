import random

import pytest

from helixframe.operators import intervals as iv
from tests.conftest import rows

SPAN = "key string, start long, end long"


def spans(spark, *pairs, key="k"):
    return spark.createDataFrame([(key, a, b) for a, b in pairs], SPAN)


def fold(pairs):
    out = []
    for a, b in sorted(pairs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def test_merge(spark):
    assert rows(iv.merge_intervals(spans(spark, (0, 10), (10, 20), (25, 30), (26, 28))), "start", "end") == [(0, 20), (25, 30)]


@pytest.mark.parametrize("width", [4, 16, 1 << 16])
def test_merge_equals_a_fold_for_any_bins(spark, width):
    rng = random.Random(width)
    pairs = [(a, a + rng.randint(1, 30)) for a in (rng.randint(0, 600) for _ in range(120))]
    got = iv.merge_intervals(spans(spark, *pairs), bin_width=width)
    assert sorted(rows(got, "start", "end")) == fold(pairs)
    assert sorted(rows(iv.merge_intervals(got, bin_width=width), "start", "end")) == fold(pairs)


def test_gaps(spark):
    got = iv.gaps(spans(spark, (0, 10), (5, 20), (30, 40), (40, 50), (60, 70)))
    assert rows(got, "start", "end") == [(20, 30), (50, 60)]


def test_touching_intervals_do_not_overlap(spark):
    a = spans(spark, (0, 10))
    assert iv.overlap_semi(a, spans(spark, (10, 20))).count() == 0 and iv.overlap_anti(a, spans(spark, (10, 20))).count() == 1
    assert iv.overlap_semi(a, spans(spark, (9, 20))).count() == 1 and iv.overlap_semi(a, spans(spark, (0, 20), (3, 4))).count() == 1


def test_nested_intervals_differ_by_mode(spark):
    points = spark.createDataFrame([("k", 50)], "key string, pos long")
    held = spans(spark, (0, 100), (10, 12))
    hit = lambda mode, of: iv.asof_contains(points, of, mode=mode).first().hit
    assert not hit("predecessor", held) and hit("overlap", held) and hit("predecessor", iv.merge_intervals(held))


@pytest.mark.parametrize("width", [8, 1 << 16])
def test_predecessor_equals_brute_force(spark, width):
    rng = random.Random(7)
    held = [(a, a + rng.randint(1, 20)) for a in (rng.randint(0, 300) for _ in range(60))]
    at = [rng.randint(0, 330) for _ in range(80)]
    got = iv.with_predecessor(spark.createDataFrame([("k", i, p) for i, p in enumerate(at)], "key string, i int, pos long"), spans(spark, *held), bin_width=width)
    want = sorted((i, *max(((a, b) for a, b in held if a <= p), default=(None, None))) for i, p in enumerate(at))
    assert sorted(tuple(r) for r in got.select("i", "p_start", "p_end").collect()) == want


def test_labels_of_points(spark):
    held = spark.createDataFrame([("a", "k", 0, 10), ("a", "k", 5, 12), ("b", "k", 11, 9000), ("b", "z", 0, 5)], "concept string, key string, start long, end long")
    points = spark.createDataFrame([("k", 7), ("k", 11), ("k", 8999), ("k", 9000)], "key string, pos long")
    assert rows(iv.label_points(points, held), "pos", "concept") == sorted([(7, "a"), (11, "a"), (11, "b"), (8999, "b")], key=repr)


def test_tumble(spark):
    df = spark.createDataFrame([("c", 5000), ("short", 100)], "key string, length long")
    assert rows(iv.tumble(df, 2048), "start", "end") == [(0, 2048), (2048, 4096)]
    assert (4096, 5000) in rows(iv.tumble(df, 2048, keep_tail=True), "start", "end") and iv.tumble(df, 2048, keep_tail=True).count() == 4


def test_bins_and_overlap(spark):
    a, b = spans(spark, (0, 250), key="A"), spans(spark, (200, 400), key="B")
    got = {(r.a, r.b): r for r in iv.set_overlap(iv.bins_of(a.union(b), 100), "key", ["bin"]).collect()}
    assert got["A", "B"].jaccard == 0.25 and got["B", "A"].b_given_a == 0.5 and got["A", "B"].b_given_a == pytest.approx(1 / 3)


def test_mask_bins(spark):
    got = iv.mask_bins(spans(spark, (0, 1), (2, 5)), 5, 2)
    assert sorted((r.bin, r["any"], r["all"], r.frac) for r in got.collect()) == [(0, 1, 0, 0.5), (1, 1, 1, 1.0), (2, 1, 0, 0.5)]


def test_clamp_and_redundant(spark):
    assert rows(iv.clamp(spans(spark, (0, 5), (8, 20)), 3, 10), "start", "end") == [(3, 5), (8, 10)]
    pairs = spark.createDataFrame([("ab", "b", 0.9), ("a", "b", 0.9), ("a", "c", 0.1)], "a string, b string, jaccard double")
    assert rows(iv.redundant(pairs, 0.5)) == [("ab",), ("b",)]


@pytest.fixture(params=["index", "shuffle"])
def way(request, monkeypatch):
    from helixframe.operators import interval_index

    if request.param == "shuffle":
        monkeypatch.setattr(interval_index, "MAX_INDEX", -1)
    return request.param


def hot_points(spark, n=900):
    """A third of all points has one key, a tenth one position of it; null keys and positions occur."""
    rng = random.Random(3)
    rows = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else None if i % 50 == 1 else f"k{i % 7}"
        rows.append((i, key, i % 5, None if i % 97 == 5 else 77 if i % 10 == 0 else rng.randint(-5, 320)))
    return spark.createDataFrame(rows, "i int, a string, b long, pos long"), rows


def hot_intervals(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["x", "y", None]), "hot" if i % 3 == 0 else rng.choice([None, "k1", "k2", "k5", "none"]), i % 5, s, s + rng.randint(0, 25)) for i, s in enumerate(rng.randint(-10, 300) for _ in range(500))]
    rows += [("x", "hot", 0, None, 5), ("x", "hot", 0, 5, None)]
    return spark.createDataFrame(rows, "concept string, a string, b long, start long, end long"), [r for r in rows if None not in r[3:]]


@pytest.mark.parametrize("width", [16, 1 << 16])
def test_hot_keys_nulls_and_two_key_columns(spark, way, width):
    points, at = hot_points(spark)
    held, spans_ = hot_intervals(spark)
    got = {r.i: (r.p_start, r.p_end) for r in iv.with_predecessor(points, held, ["a", "b"], bin_width=width).collect()}
    semi = {r.i for r in iv.overlap_semi(points.withColumns({"start": points.pos, "end": points.pos + 4}), held.where("start < end"), ["a", "b"]).collect()}
    assert len(got) == len(at)
    for i, a, b, p in at:
        same = [(s, e) for _, x, y, s, e in spans_ if (x, y) == (a, b)]
        assert got[i] == max(((s, e) for s, e in same if p is not None and s <= p), default=(None, None))
        assert (i in semi) == (p is not None and any(s < e and s < p + 4 and p < e for s, e in same))


def test_labels_of_hot_points(spark, way):
    points, at = hot_points(spark)
    held, spans_ = hot_intervals(spark)
    got = rows(iv.label_points(points, held, keys=["a", "b"]), "i", "concept")
    want = {(i, c) for i, a, b, p in at for c, x, y, s, e in spans_ if p is not None and (x, y) == (a, b) and s <= p < e}
    assert got == sorted(want, key=repr)


def test_empty_sides(spark, way):
    points, _ = hot_points(spark, 20)
    held, _ = hot_intervals(spark)
    assert {r.p_start for r in iv.with_predecessor(points, held.where("false"), ["a", "b"]).collect()} == {None}
    assert iv.label_points(points, held.where("false"), keys=["a", "b"]).count() == 0
    assert iv.with_predecessor(points.where("false"), held, ["a", "b"]).count() == 0


def test_small_sets_do_not_move_the_points(spark):
    points, _ = hot_points(spark)
    held, _ = hot_intervals(spark)
    for df in (iv.with_predecessor(points, held, ["a", "b"]), iv.label_points(points, held, keys=["a", "b"]), iv.asof_contains(points, held, ["a", "b"], mode="overlap")):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_other_key_types_take_the_shuffle(spark):
    points = spark.createDataFrame([(1, 5)], "key int, pos long")
    held = spark.createDataFrame([(1, 0, 9)], "key long, start long, end long")
    assert iv.asof_contains(points, held).first().hit


def test_reach_of_a_large_set_needs_no_merge(spark, monkeypatch):
    from helixframe.operators import interval_index

    monkeypatch.setattr(interval_index, "MAX_INDEX", -1)
    rng = random.Random(8)
    keys = ["a", "b", None]
    held = [(rng.choice(keys), a, a + rng.choice([0, 1, 5, 60])) for a in (rng.randrange(-200, 200) for _ in range(60))]
    points = [(i, rng.choice([*keys, "none"]), rng.choice([None, *range(-220, 280)])) for i in range(400)]
    got = iv.asof_contains(spark.createDataFrame(points, "id int, key string, pos long"), spark.createDataFrame(held, SPAN), mode="overlap", bin_width=16)
    want = [(i, p is not None and any(k == h and a <= p < b for h, a, b in held)) for i, k, p in points]
    assert rows(got, "id", "hit") == sorted(want, key=repr)
    # one window in a bin and one over bins; merging took four more
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 2


@pytest.mark.parametrize("width, times", [(8, 1), (64, 2), (1 << 12, 5)])
def test_labels_of_a_large_set_take_one_shuffle_of_bounded_tasks(spark, monkeypatch, width, times):
    from helixframe.operators import interval_index

    monkeypatch.setattr(interval_index, "MAX_INDEX", -1)
    monkeypatch.setattr(iv, "TASK_ROWS", 20, raising=False)
    rng = random.Random(width)
    keys, labels = ["a", "b", None], ["x", "y", None]
    held = [(rng.choice(labels), rng.choice(keys), a, a + rng.choice([-1, 0, 1, 5, 30, 300])) for a in (rng.randrange(-400, 400) for _ in range(90))] * times
    held += [("x", "a", None, 5), ("x", "a", 5, None)]
    points = [(i, rng.choice([*keys, "none"]), rng.choice([None, *range(-420, 720)])) for i in range(500)]
    points += points[:20]  # a repeated point has its labels as often
    got = iv.label_points(spark.createDataFrame(points, "id int, key string, pos long"), spark.createDataFrame(held, "concept string, key string, start int, end int"), bin_width=width)
    spans_ = [r for r in held if None not in r[2:]]
    want = [(i, c) for i, k, p in points for c in labels if p is not None and any((c, k) == (x, h) and a <= p < b for x, h, a, b in spans_)]
    assert got.columns == ["id", "key", "pos", "concept"] and rows(got, "id", "concept") == sorted(want, key=repr)
    # one window over bins and two over one sort in them; merging whole took eleven, and starts were made distinct whatever that saved
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 3
    if times == 1:
        valid = sum(a < b for *_, a, b in spans_)
        assert f", {max(valid // 20 + 1, 4)}" in next(x for x in plan.splitlines() if "RepartitionByExpression" in x)
        assert plan.count("Aggregate [") == 1  # of those that leave their bin


def test_islands_are_not_aggregated(spark):
    pairs = [(0, 10), (5, 20), (21, 22), (30, 50)]
    got = iv.merge_intervals(spans(spark, *pairs), bin_width=8)
    grouped = [x.split("], [")[0] for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate [" in x]
    assert grouped and not any("__i#" in x for x in grouped)
    assert rows(got, "start", "end") == fold(pairs)
