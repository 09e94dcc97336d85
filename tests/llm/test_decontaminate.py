import re

from helixframe.llm.decontaminate import blocks, decontaminate, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, size=10):
    w, hit, found = split(text), set(), set()
    for item_id, t in items:
        iw = split(t)
        for i in range(max(1, len(iw) - size + 1) if iw else 0):
            win = iw[i : i + size]
            for j in range(len(w) - len(win) + 1):
                if w[j : j + len(win)] == win:
                    hit.update(range(j, j + len(win)))
                    found.add("null" if item_id is None else str(item_id))
    return len(w), len(hit), sorted(found)


ITEMS = [(1, " ".join(f"passage{i}" for i in range(20, 45))), (2, "déjà-VU"), (3, None), (4, ""), (10, "shared line"), (None, "own line of"), (10, "shared line"), (5, " ".join("w5" for _ in range(12)))]


def test_words():
    assert [w.decode() for w in words("Déjà-vu, 3x ÄB".encode())] == split("Déjà-vu, 3x ÄB")


def check(spark, docs, items, **options):
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate(docs, bench, **options)
    for r in got.collect():
        n, hit, found = brute(r.text, items)
        assert (r.n_words, r.n_hit, r.n_items, list(r.item_ids), r.contaminated) == (n, hit, len(found), found, hit > 0)
    return got


def test_odd_documents(spark, odd_documents):
    got = check(spark, odd_documents, ITEMS)
    assert got.count() == odd_documents.count() and set(odd_documents.columns) < set(got.columns)


def test_blocks_do_not_matter(spark, odd_documents):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert len(list(blocks(bench, 40))) > 3
    check(spark, odd_documents.select("doc_id", "text"), ITEMS, block_bytes=40)


def test_repeats_and_overlaps(spark):
    docs = spark.createDataFrame([(1, "a b " * 30), (2, "c " + "a b " * 5 + "c"), (3, "b a b a b a b a b a b a")], "doc_id long, text string")
    check(spark, docs, [(1, "a b " * 6), (2, "c a b a b a b a b a b c")])


def test_empty_tables(spark, odd_documents):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate(odd_documents.where("false"), bench).count() == 0
    assert decontaminate(odd_documents, bench.where("false")).where("contaminated").count() == 0


def test_clashing_names_and_repeated_ids(spark):
    names = ["__text", "__spans", "__items", "__words", "__got", "n_words", "contaminated", "t"]
    docs = spark.createDataFrame([(1, "w5 " * 12, *[0] * 8), (1, "own words", *[1] * 8), (None, None, *[2] * 8)], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    for options in ({}, {"block_bytes": 40}):
        got = check(spark, docs, ITEMS, **options)
        assert set(docs.columns) <= set(got.columns) and sorted(r.t for r in got.collect()) == [0, 1, 2]


def test_long_document(spark):
    text = " ".join(f"w{i % 7}" for i in range(200_000)) + " " + " ".join(f"passage{i}" for i in range(20, 45))
    got = decontaminate(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")).first()
    assert (got.n_words, got.n_hit, got.n_items) == (200_025, 25, 1)
