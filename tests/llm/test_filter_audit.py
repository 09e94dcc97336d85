import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from helixframe.llm import filter_audit
from helixframe.llm.filter_audit import audit, repeated_classes
from tests.conftest import rows


def brute(docs, labels):
    """Applies every order to every part, document by document."""
    first, fails = {}, []
    last = float("inf")
    for i, t, _ in docs:
        first[t or ""] = min(first.get(t or "", last), last if i is None else i)
    for i, t, s in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {n for n, bad in zip("ABCD", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t))), strict=True) if bad}
        if (last if i is None else i) > first[t]:
            f.add("E")
        q = [x for x in labels if x[0] == i and i is not None]
        fails.append((s or "", f, any(x[1] == 1 for x in q), any(x[2] == 1 for x in q)))
    out, shapley = [], Counter()
    for part in {x[0] for x in fails}:
        for order in permutations("ABCDE"):
            left, gone = [x for x in fails if x[0] == part], []
            for step, name in enumerate(order, 1):
                hit = [x for x in left if name in x[1]]
                left = [x for x in left if name not in x[1]]
                shapley[part, name] += len(hit)
                out.append((part, "".join(order), step, len(left), len(hit), sum(name in x[1] for x in gone), sum(x[0] == part and x[1] == {name} for x in fails), sum(x[2] for x in hit), sum(x[3] for x in hit)))
                gone += hit
    return sorted(((*x, shapley[x[0], x[1][x[2] - 1]]) for x in out), key=repr)


def check(docs, labels):
    assert rows(audit(docs, labels)) == brute([(r.doc_id, r.text, r.source) for r in docs.collect()], [tuple(r) for r in labels.collect()])


def test_equal_to_every_order_applied(spark):
    d = "/root/testdata/sf0.001"
    check(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))


@pytest.fixture
def odd_labels(spark):
    return spark.createDataFrame([(6, 1, 0), (6, 0, 1), (None, 1, 1), (7, None, 1), (99, 1, 1), (2, 1, None)], "doc_id long, quality int, toxic int")


def test_odd_documents(spark, odd_documents, odd_labels):
    docs = odd_documents.withColumnRenamed("h1", "mask").withColumnRenamed("score", "step")
    again = docs.withColumn("doc_id", F.col("doc_id") + 100)
    check(docs.union(again).union(docs.where("doc_id = 7").withColumn("doc_id", F.lit(None).cast("long"))), odd_labels)
    assert audit(docs.where("false"), odd_labels).count() == 0
    check(docs, odd_labels.where("false"))


def test_hash_collisions_are_told_apart(spark, odd_labels, monkeypatch):
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(["aaa", "bbb", "aaa", "ccc", "bbb", "dd", "e" * 9000, "e" * 9000, "e" * 8999 + "f"])], "doc_id long, text string, source string")
    check(docs, odd_labels)
    monkeypatch.setattr(filter_audit, "block_hash", lambda text, start, end: F.lit(7).cast("long"))
    check(docs, odd_labels)


def test_levels_drop_singletons(spark):
    long = "x" * 70_000
    docs = spark.createDataFrame([(0, long + "a"), (1, long + "b"), (2, long + "a"), (3, "short"), (4, "y" + "x" * 69_999 + "b"), (5, "other text"), (6, "tother tex")], "doc_id long, text string")
    seen = filter_audit.measured(docs.withColumn("s", F.lit("")), filter_audit.standard_filters, dict(A=1, B=2, C=4, D=8), "s", "doc_id", "text")
    assert [r.len for r in repeated_classes(seen.drop("text")).collect()] == [70_001]


def test_groups_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "MAX_GROUPS", 1)
    d = "/root/testdata/sf0.001"
    check(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))


def test_bad_filters(spark, odd_documents, odd_labels):
    with pytest.raises(ValueError):
        audit(odd_documents, odd_labels, copies="A")
