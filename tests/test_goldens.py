"""Literal cases: what the operators make of inputs that the tables do not hold."""

import duckdb
import pytest
from golden_cases import CASES
from test_oracles import plain


@pytest.mark.parametrize("name", sorted(CASES))
def test_golden(spark, name):
    made, sql = CASES[name]
    got = made(spark, "")
    columns = sorted(got.columns)
    result = duckdb.connect().execute(sql)
    order = [c[0] for c in result.description]
    assert sorted(order) == columns
    expected = sorted(repr([plain(r[order.index(c)]) for c in columns]) for r in result.fetchall())
    assert sorted(repr([plain(r[c]) for c in columns]) for r in got.collect()) == expected
