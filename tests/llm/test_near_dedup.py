import re

import numpy as np
import pytest

from helixframe.llm.near_dedup import WordHashes, components, near_duplicates, shingles, signatures
from tests.conftest import rows


def brute(docs, words=5, percent=75):
    sets = {}
    for i, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = {tuple(w[j : j + words]) for j in range(max(1, len(w) - words + 1))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                a1, b1 = find(a), find(b)
                parent[max(a1, b1)] = min(a1, b1)
    return sorted(((i, len(sets[i]), find(i), find(i) == i) for i in ids), key=repr)


def test_small_tables_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert rows(near_duplicates(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_large_group_of_near_copies_and_a_chain(spark):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(120):
        w = list(base)
        for j in rng.choice(200, 5, replace=False):
            w[j] = f"x{i}_{j}"
        texts.append((i, " ".join(w)))
    texts += [(200 + k, " ".join(f"c{j}" for j in range(12 * k, 12 * k + 120))) for k in range(8)]
    got = rows(near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")))
    assert got == brute(texts)


def test_large_buckets_take_the_prefix_join(spark, monkeypatch):
    from helixframe.llm import near_dedup

    monkeypatch.setattr(near_dedup, "LARGE", 5)
    rng = np.random.default_rng(8)
    base, texts = [f"w{i}" for i in range(120)], []
    for i in range(90):
        w = list(base)
        for j in rng.choice(120, int(rng.integers(1, 8)), replace=False):
            w[j] = f"x{i}_{j}"
        texts.append((i, " ".join(w)))
    assert rows(near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"))) == brute(texts)


def test_odd_documents(spark, odd_documents):
    got = near_duplicates(odd_documents).collect()
    assert len(got) == odd_documents.count()
    by = {(r.doc_id, r.n_shingles): r for r in got}
    assert by[3, 0].kept and by[4, 0].component_id == 4 and by[8, 0].kept
    assert not by[6, 57].kept and by[6, 57].component_id == 5
    assert [r.component_id for r in got if r.doc_id is None] == [2] and by[2, 1].kept
    assert near_duplicates(odd_documents.where("false")).count() == 0


def test_permutations_are_one_shifted(spark):
    s = shingles([b"a b c d e f g h i j"], 5, WordHashes())
    sig = signatures(s, 8)
    moved = [(s[0] + (np.uint64(3) << np.uint64(32)))]
    assert (signatures(moved, 5)[:, 0] == sig[3:8, 0]).all()


def test_signatures_estimate_jaccard():
    a = [f"t{i}" for i in range(1000)]
    b = a[:850] + [f"u{i}" for i in range(150)]
    sets = shingles([" ".join(a).encode(), " ".join(b).encode()], 1, WordHashes())
    true = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
    sig = signatures(sets, 1024)
    assert (sig[:, 0] == sig[:, 1]).mean() == pytest.approx(true, abs=0.06)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(50, 40), (50, 60), (7, 3)], "a long, b long")
    assert rows(components(edges)) == sorted([(i, 1) for i in range(1, 31)] + [(i, 40) for i in (40, 50, 60)], key=repr)


def test_repeated_ids_follow_their_own_texts(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    docs = spark.createDataFrame([(5, a), (6, a), (6, b), (6, b), (2**63 - 1, b + " c"), (None, a), (None, "alone here")], "doc_id long, text string")
    got = rows(near_duplicates(docs), "doc_id", "component_id", "kept")
    want = [(5, 5, True), (6, 5, False), (6, 6, True), (6, 6, True), (2**63 - 1, 6, False), (None, 5, False), (None, None, True)]
    assert got == sorted(want, key=repr)


def test_prefixes_are_those_of_a_plain_order(spark, monkeypatch):
    from helixframe.llm import near_dedup as nd

    rng = np.random.default_rng(11)
    sets = {c: sorted({int(x) for x in rng.integers(-400, 40, int(rng.integers(1, 60)))}) for c in range(60)}
    df = {t: sum(t in s for s in sets.values()) for t in range(-400, 40)}
    want = []
    for c, s in sets.items():
        n, order = len(s), sorted(s, key=lambda t: (df[t] if df[t] > 1 else 0, t))
        alone = sum(df[t] == 1 for t in s)
        for k, t in enumerate(order[: n - -(-75 * n // 100) + 1]):
            if df[t] > 1:
                want.append((c, n, t, k + 1, k + 1 <= n - -(-150 * n // 175) + 1, order[max(alone, k - nd.BEFORE) : k]))
    members = spark.createDataFrame([(c, len(s)) for c, s in sets.items()], "cls long, n long")
    table = spark.createDataFrame(list(sets.items()), "cls long, items array<long>")
    assert rows(nd.prefixes(members, table, 75)) == sorted(want, key=repr)
    monkeypatch.setattr(nd, "MAX_SHARED", 1)
    assert rows(nd.prefixes(members, table, 75)) == sorted(want, key=repr)
