"""All queries with SQL against DuckDB on the smallest tables, where these are there."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


def _plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def _names():
    from cairn.parity import queries

    return sorted(queries.ORACLES)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(SMALL):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SMALL}/{f}'")
    return c


@pytest.mark.parametrize("name", _names())
def test_query_equals_its_sql(spark, db, name):
    from cairn.parity import queries

    df = queries.QUERIES[name](spark, SMALL)
    got = db.execute(queries.ORACLES[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(_plain(v) for v in r) for r in got.fetchall())
    assert sorted(tuple(_plain(r[n]) for n in names) for r in df.collect()) == want


def test_every_query_has_sql():
    from cairn.parity import queries

    assert set(queries.QUERIES) == set(queries.ORACLES)


def test_the_rest_works_without_the_llm_folder(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "cairn", tmp_path / "cairn", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import re, __spark_entry__ as e; assert e.queries() and set(e.oracle_sql()) <= set(e.queries()); assert not [k for k in e.queries() if re.match('op[0-9]', k)]"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
