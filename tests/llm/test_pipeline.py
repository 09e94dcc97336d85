import os
import subprocess
import sys
from pathlib import Path

import numpy as np

import corpus_pipeline as p
from tests.conftest import rows
from tests.llm.test_decontaminate import brute as contamination
from tests.llm.test_line_dedup import brute as lines
from tests.llm.test_near_dedup import brute as groups
from tests.llm.test_packing import exact

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    calm = p.drop_toxic(spark, docs, SF)
    assert calm.columns == docs.columns
    held = {r.doc_id: r.text for r in calm.collect()}
    assert 0.8 * docs.count() <= len(held) <= docs.count()

    short = p.drop_repeated_lines(spark, calm, SF)
    want = {i: kept for (i, _), (kept, _, _) in lines(list(held.items())).items()}
    got = {r.doc_id: r.text for r in short.collect()}
    assert got == want and all(r.n_chars == len(r.text) for r in short.collect())

    single = p.drop_near_duplicates(spark, short, SF)
    want = {i: want[i] for i, _, _, kept in groups(list(want.items())) if kept}
    assert {r.doc_id: r.text for r in single.collect()} == want

    clean = p.drop_contaminated(spark, single, SF)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {i: t for i, t in want.items() if not contamination(t, items)[1]}
    assert {r.doc_id: r.text for r in clean.collect()} == want and clean.columns == docs.columns

    sizes = {}
    for r in p.pack(spark, clean, SF).collect():
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r.length
    assert sizes == {i: len(x) + 1 for i, x in zip(want, exact(list(want.values())), strict=True)}
    assert np.sum(list(sizes.values())) > 0


def test_odd_documents(spark, odd_documents, tmp_path):
    docs = odd_documents
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    for start in (docs, docs.where("false")):
        at = start
        for name, stage in p.STAGES:
            out = stage(spark, at, str(tmp_path))
            assert name == "pack" or out.columns == docs.columns
            at = out
        assert (at.count() > 0) == (start is docs)


def test_toxic_texts_go_whatever_their_id(spark, tmp_path):
    """Rows with equal texts go together, also with null ids; null and empty texts and clashing columns stay."""
    mild, rude = "a quiet house by the river and a garden", "you stupid idiot go away you worthless clown"
    learned = [(i, f"{rude if i % 4 == 0 else mild} w{i}", 0) for i in range(200)]
    spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(learned + [(None, learned[0][1], 1), (900, learned[0][1], 2), (901, None, 3), (902, "", 4), (None, mild, 5)], "doc_id long, text string, __key int")
    got = p.drop_toxic(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    assert rows(got, "doc_id", "__key") == sorted([(i, 0) for i in range(200) if i % 4] + [(901, 3), (902, 4), (None, 5)], key=repr)


def test_run(spark):
    assert [n for n, _ in p.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontaminate", "pack"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in p.STAGES:
        docs = stage(spark, docs, SF)
    got = p.run(spark, SF)
    key = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert rows(got, *key) == rows(docs, *key) and got.count() > 0


def test_repeated_ids_with_unlike_texts_stay(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    docs = spark.createDataFrame([(5, a, 0), (6, a, 1), (6, b, 2), (None, b + " c", 3), (None, None, 4)], "doc_id long, text string, __key int")
    assert rows(p.drop_near_duplicates(spark, docs, SF), "doc_id", "__key") == sorted([(5, 0), (6, 2), (None, 4)], key=repr)


def test_an_operator_can_be_the_first_call_of_a_driver(tmp_path):
    """Workers that have no copy of the package get it before the first function is made."""
    code = f"""
import sys; sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {str(tmp_path)!r}).getOrCreate()
from helixframe.llm import {{module}} as m
docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
pages = spark.createDataFrame([(1, "http://a.example/", "<p>x</p>")], "page_id long, url string, html string")
assert {{call}}.count() == 1
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    for module, call in (("packing", "m.pack(docs)"), ("html_extract", "m.main_text(pages)"), ("near_dedup", "m.near_duplicates(docs)"), ("toxicity", "m.toxicity(docs, docs.selectExpr('doc_id', '1 AS toxic'))")):
        subprocess.run([sys.executable, "-c", code.format(module=module, call=call)], check=True, timeout=200, cwd=tmp_path, env=env)
