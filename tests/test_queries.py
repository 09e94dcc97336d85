import subprocess
import sys

import duckdb
import pytest

from helixframe.plans import registry
from tools.compare import norm

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_sql(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    mine = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    if name not in registry.SQL:
        assert mine
        return
    cur = con.execute(registry.SQL[name])
    got = [d[0] for d in cur.description]
    assert sorted(got) == cols
    assert mine == sorted(tuple(norm(r[got.index(c)]) for c in cols) for r in cur.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 640
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_optional_parts():
    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'assoc_raw_neuron' in e.queries() and not any(n.startswith('op1') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)


def test_command_line(spark, tmp_path, capsys):
    from helixframe.__main__ import main

    main(["list"])
    assert "bed_strict" in capsys.readouterr().out.split()
    main(["run", "value_counts", SF, str(tmp_path / "out")])
    assert spark.read.parquet(str(tmp_path / "out")).count() > 0


def test_other_import_errors_are_raised():
    code = "import sys, pytest; sys.modules['pyspark.sql'] = None\nwith pytest.raises(ModuleNotFoundError):\n    import __spark_entry__"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)
