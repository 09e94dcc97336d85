import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helixframe.llm.fill_middle import ADDED, fill_middle, restore


def brute(i, text, seed=1, fim=90, spm=20):
    text = text or ""
    u = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    h = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= fim:
        return len(u), "plain", None, None, text
    lo, hi = sorted(x % (len(u) + 1) for x in h[:2])
    pre, mid, suf = "".join(u[:lo]), "".join(u[lo:hi]), "".join(u[hi:])
    if h[3] % 100 < spm:
        return len(u), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(u), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def check(docs, **options):
    out = fill_middle(docs, **options).withColumn("back", restore(F.col("output"), F.col("form")))
    for r in out.collect():
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute(r.doc_id, r.text, *options.values())
        assert r.back == (r.text or "")
    return out


def test_tables(spark):
    check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), seed=9, fim_percent=50, spm_percent=100)


def test_odd_documents(spark, odd_documents):
    docs = odd_documents.withColumnRenamed("h1", "form").withColumnRenamed("score", "__marked")
    out = check(docs)
    assert out.columns == [c for c in docs.columns if c not in ADDED] + ADDED + ["back"]
    assert fill_middle(docs.where("false")).count() == 0


def test_delimiters_escapes_and_markers_in_texts(spark):
    texts = ["\x01", "\x02", "\x02\x01\x021\x020", "a\x01b\x02c", "\x0201\x01\x01", "<P>", "x<S>y<M>", "<<S<P", "<M <P", "<", "<<<<", "\U0001f600a\U0001f600", "\n\r\n", "$1\\1", "ab", "$"]
    check(spark.createDataFrame([(i, t) for i in range(40) for t in texts], "doc_id long, text string"), seed=1, fim_percent=100)


def test_any_text(spark):
    seen = []

    @settings(max_examples=300, deadline=None)
    @given(st.text(st.sampled_from("ab<>PSM\x01\x0201 $\\é\U0001f600\n"), max_size=25))
    def more(text):
        seen.append((len(seen), text))

    more()
    check(spark.createDataFrame(seen, "doc_id long, text string"), seed=1, fim_percent=100)


def test_nothing_is_shuffled_and_no_python(spark, odd_documents):
    plan = fill_middle(odd_documents)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and plan.count("regexp_replace") == 1
