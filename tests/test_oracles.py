"""Every query that SQL can express gives the rows DuckDB gives."""

import math
import os

import duckdb
import pytest

from leafmill.plans import registry

DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if hasattr(v, "isoformat"):
        return str(v)[:26]
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return int(v) if isinstance(v, bool) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    result = duck.execute(registry.ORACLES[name])
    order = [c[0] for c in result.description]
    assert sorted(order) == columns
    expected = sorted(repr([plain(r[order.index(c)]) for c in columns]) for r in result.fetchall())
    assert sorted(repr([plain(r[c]) for c in columns]) for r in got.collect()) == expected


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    registry.QUERIES[name](spark, DATA).collect()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_names_without_a_session():
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=root, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
