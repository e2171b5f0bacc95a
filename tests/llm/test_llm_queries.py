"""The training-data queries that SQL can express, against DuckDB on the smallest tables."""

import pytest

from galley.llm.queries import ORACLES, QUERIES
from tests.test_queries import SF, duck, norm  # noqa: F401


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):  # noqa: F811
    df = QUERIES[name](spark, SF)
    rows, r = df.collect(), duck.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert rows and sorted(r.columns) == columns
    at = [r.columns.index(c) for c in columns]
    assert sorted(tuple(norm(x[c]) for c in columns) for x in rows) == sorted(tuple(norm(x[i]) for i in at) for x in r.fetchall())
