import pyarrow as pa
from pyspark.sql import functions as F

from helixframe.llm.common import extend, lean


def test_lean_yields_all_and_ends_when_its_reader_stops():
    ended = []

    def make(batches):
        try:
            for b in batches:
                yield b + 1
        finally:
            ended.append(True)

    assert list(lean(make)(iter(range(5)))) == [1, 2, 3, 4, 5] and list(lean(make)(iter(()))) == []
    some = lean(make)(iter(range(5)))
    assert next(some) == 1
    some.close()
    assert len(ended) == 3


def test_columns_are_added_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        docs = spark.range(100, numPartitions=3).select("id", F.when(F.col("id") % 5 > 0, F.repeat(F.lit("x"), F.col("id").cast("int"))).alias("__got"))
        got = extend(docs, F.col("__got"), lambda texts: [pa.array([len(t.as_py() or "") for t in texts], pa.int64())], "n long").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.id, r.n) for r in got) == [(i, i if i % 5 else 0) for i in range(100)]
    assert extend(docs.limit(0), F.col("__got"), lambda texts: [pa.array([1] * len(texts), pa.int64())], "n long").collect() == []
