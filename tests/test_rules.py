"""Each case of ``rules`` against its expected rows, which DuckDB gives."""

import duckdb
import pytest
import rules


@pytest.mark.parametrize("name", list(rules.QUERIES))
def test_rule(spark, name):
    got = rules.QUERIES[name](spark, None)
    expected = duckdb.connect().execute(rules.SQL[name])
    columns = [d[0] for d in expected.description]
    assert sorted(columns) == sorted(got.columns)
    key = lambda row: tuple((v is not None, v) for v in row)
    assert sorted(map(tuple, got.select(*columns).collect()), key=key) == sorted(expected.fetchall(), key=key)
