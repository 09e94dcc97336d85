import hashlib

from helixframe.llm.line_dedup import Runs, dedup_lines
from tests.conftest import rows

WHITE = " \t\n\x0b\x0c\r"


def brute(docs, min_chars=10):
    """docs: (id, text); -> {(id, text): (kept, n_lines, n_dropped)}."""
    last = float("inf")
    at = [(last if i is None else i, t or "") for i, t in docs]
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(WHITE))
    first = {}
    for i, t in at:
        for line in t.split("\n"):
            first[key(line)] = min(first.get(key(line), last), i)
    out = {}
    for i, t in at:
        lines = t.split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or first[key(x)] == i]
        out[(None if i == last else i, t)] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    return out


def check(spark, docs, **options):
    given = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(given)
    got = dedup_lines(docs.select("*"), **options)
    assert sorted(map(repr, ((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()))) == sorted(repr((i, *want[i, t or ""])) for i, t in given)
    return got


def test_odd_documents(spark, odd_documents):
    got = check(spark, odd_documents)
    assert got.columns == [c for c in odd_documents.columns if c != "n_lines"] + ["n_lines", "n_dropped"]


def test_batches_and_levels_do_not_matter(spark):
    docs = spark.createDataFrame([(i, "\n".join(f"line number {(i * j) % 37} of all" for j in range(1, 9))) for i in range(120)], "doc_id long, text string")
    for batches, fanout in ((1, 2), (5, 2), (7, 3)):
        check(spark, docs, batches=batches, fanout=fanout)


def test_compaction_keeps_each_hash_once(spark):
    runs = Runs(2)
    for b in range(5):
        runs.add(spark.createDataFrame([(i, i, b) for i in range(b, b + 10)], "h1 long, h2 long, first_doc long"))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert rows(runs.all(), "h1", "first_doc") == sorted(((i, max(0, i - 9)) for i in range(14)), key=repr)


def test_empty_table(spark, odd_documents):
    assert dedup_lines(odd_documents.where("false")).count() == 0


def test_no_python_on_the_main_path(spark, odd_documents):
    plan = dedup_lines(odd_documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_query_hash(spark):
    from helixframe.llm.queries import op1_line_dedup

    first = op1_line_dedup(spark, "/root/testdata/sf0.001").where("n_dropped = 0").orderBy("doc_id").first()
    text = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where(f"doc_id = {first.doc_id}").first().text
    assert first.kept_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_clashing_names_null_ids_and_the_largest_id(spark):
    docs = spark.createDataFrame([(2**63 - 1, "a line of some length\nown line one", 1, 2, 3), (None, "a line of some length\nown line two", 1, 2, 3), (None, "own line two", 4, 5, 6)], "doc_id long, text string, __t int, __k1 int, __lines int")
    got = check(spark, docs)
    assert got.columns == [*docs.columns, "n_lines", "n_dropped"] and {r.n_dropped for r in got.collect()} == {0, 1}
