import hashlib
import re
from collections import Counter, defaultdict

import pytest

from helixframe.llm import mixing
from helixframe.llm.mixing import mix, mixed


def brute(docs, weights=(5, 2, 1), share=1.5, most=2, trials=16):
    """docs: (id, text, source); -> (id, size, source_size, target, copies, taken) of every row, with plain resharing rounds."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in docs]
    total = defaultdict(int)
    for (_, _, s), n in zip(docs, size, strict=True):
        total[s] += n
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, target = share * sum(total.values()), set(order), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if unit * weight[s] >= most * total[s]}
        for s in full:
            target[s] = float(most * total[s])
            left -= target[s]
        if not full:
            target |= {s: unit * weight[s] for s in open_}
            break
        open_ -= full
    out = []

    def draw(i, t, j):
        key = str(i) if i is not None else "" if t is None else "text:" + hashlib.md5(t.encode()).hexdigest()
        return int(hashlib.md5(f"{j // 4}:{key}".encode()).hexdigest()[8 * (j % 4) :][:8], 16) / 2**32

    for s in order:
        rate = target[s] / total[s] if total[s] else 0.0
        rows = [(i, t, n) for (i, t, x), n in zip(docs, size, strict=True) if x == s]
        copies = [[int(rate) + (draw(i, t, j) < rate % 1) for i, t, _ in rows] for j in range(trials)]
        best = min(copies, key=lambda c: abs(sum(k * n for k, (_, _, n) in zip(c, rows, strict=True)) - target[s]))
        out += [(i, n, total[s], round(target[s], 6), k, k * n) for k, (i, _, n) in zip(best, rows, strict=True)]
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.copies, r.taken) for r in df.collect()), key=repr)


def given(docs):
    return [(r.doc_id, r.text, r.source) for r in docs.select("doc_id", "text", "source").collect()]


def test_equal_to_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert got(mixed(docs)) == brute(given(docs))
    assert got(mixed(docs, weights=(1, 3), share=0.7, most=3, trials=1)) == brute(given(docs), (1, 3), 0.7, 3, 1)


def test_odd_documents(spark, odd_documents):
    docs = odd_documents.withColumnRenamed("h1", "target").withColumnRenamed("score", "__source")
    out = mixed(docs)
    assert got(out) == brute(given(docs))
    assert out.columns == [c for c in docs.columns if c != "target"] + mixing.ADDED
    assert mixed(docs.where("false")).count() == 0


def test_many_sources_are_joined_by_salt(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "w " * (i % 50), None if i % 3 == 0 else f"s{i % 40}") for i in range(600)], "doc_id long, text string, source string")
    want = brute(given(docs))
    monkeypatch.setattr(mixing, "MAX_SOURCES", 5)
    assert got(mixed(docs)) == want


def test_taken_comes_near_its_target(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixed(docs).collect()
    taken, target = Counter(), {r.source: r.target for r in rows}
    for r in rows:
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    assert all(abs(taken[s] - t) <= 0.02 * t for s, t in target.items())
    assert abs(sum(target.values()) - 1.5 * sum(r.size for r in rows)) < 1


def test_mix_repeats_documents(spark, odd_documents):
    counts = Counter((r.doc_id, r.text) for r in mix(odd_documents).collect())
    want = Counter()
    for r in mixed(odd_documents).collect():
        want[r.doc_id, r.text] += r.copies
    assert counts == +want


def test_bad_parameters(spark, odd_documents):
    for options in ({"share": 3.0}, {"weights": ()}, {"weights": (0, 1)}, {"trials": 0}):
        with pytest.raises(ValueError):
            mixed(odd_documents, **options)


def test_no_python_on_the_main_path(spark, odd_documents):
    plan = mixed(odd_documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
