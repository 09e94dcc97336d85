from collections import Counter

import pytest

from helixframe.llm.sharding import assign, assign_groups, lookup_table, write_shards

NAMES = [f"shard-{i:02d}" for i in range(16)]


def test_slots_are_shared_evenly():
    n = Counter(lookup_table(NAMES, 2039)).values()
    assert max(n) - min(n) <= 1


def test_losing_a_shard_moves_little():
    before, after = lookup_table(NAMES, 2039), lookup_table(NAMES[:-1], 2039)
    moved = sum(a != b for a, b in zip(before, after) if a != 15)
    assert moved < 0.25 * 2039


def test_bad_tables():
    for names, size in ((NAMES, 2040), (NAMES, 13), (["a", "a"], 7), ([], 7)):
        with pytest.raises(ValueError):
            lookup_table(names, size)


def test_rows_keep_their_columns(spark, odd_documents):
    got = assign(odd_documents.withColumnRenamed("h1", "slot"), NAMES, 2039).collect()
    assert len(got) == odd_documents.count() and all(0 <= r.shard < 16 for r in got)
    assert len({r.shard for r in got if r.doc_id == 6}) == 1
    assert assign(odd_documents.where("false"), NAMES, 2039).count() == 0


def test_a_hot_group_is_split(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('s', id % 200) END AS source")
    got = assign_groups(df, NAMES, "source", 2039).select("source", "shard").collect()
    by = Counter(r.shard for r in got)
    assert len({r.shard for r in got if r.source == "hot"}) > 4 and max(by.values()) < 3 * 3000 / 16
    assert all(len({r.shard for r in got if r.source == s}) == 1 for s in ("s1", "s2"))


def test_written_shards(spark, tmp_path):
    write_shards(assign(spark.range(100).withColumnRenamed("id", "doc_id"), NAMES, 2039), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 100


def test_no_python_on_the_main_path(spark, odd_documents):
    plan = assign(odd_documents, NAMES, 2039)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "BroadcastHashJoin" in plan


def test_clashing_names(spark):
    names = "doc_id long, __slot int, __shard int, __g string, __parts int, __key string, source string"
    df = spark.createDataFrame([(i, 100 + i, 7, "g", 3, "k", "hot" if i % 3 == 0 else f"s{i}") for i in range(60)], names)
    plain = {r.doc_id: (r.slot, r.shard) for r in assign(df.select("doc_id"), NAMES, 2039).collect()}
    got = assign(df, NAMES, 2039)
    assert got.columns == [*df.columns, "slot", "shard"]
    assert all((r["__slot"], r["__shard"]) == (100 + r.doc_id, 7) and (r.slot, r.shard) == plain[r.doc_id] for r in got.collect())
    groups = assign_groups(df, NAMES, "source", 2039)
    assert groups.columns == [*df.columns, "slot", "shard"] and all((r["__g"], r["__parts"], r["__key"]) == ("g", 3, "k") for r in groups.collect())
