"""Every query with an oracle against DuckDB on the smallest tables; helpers for the rest."""

import glob
import os

import duckdb
import pytest

from galley.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, (float,)) or type(v).__name__ == "Decimal":
        return f"{float(v):.9g}"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


#: Queries without a row at the smallest scale.
FEW = {"drawing_signatures", "row_validation"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows or name in FEW
    if name in ORACLES:
        r = duck.sql(ORACLES[name])
        columns = sorted(df.columns)
        assert sorted(r.columns) == columns
        at = [r.columns.index(c) for c in columns]
        assert sorted(tuple(norm(x[c]) for c in columns) for x in rows) == sorted(tuple(norm(x[i]) for i in at) for x in r.fetchall())


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
