"""Every registered query runs over the smallest tables and agrees with its SQL."""

import glob
import os

import pytest

from corpusmill.plans.queries import oracle_sql, queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def plain(value):
    if isinstance(value, float):
        return f"{value:.5g}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(plain, value)) + "]"
    return str(value)


@pytest.fixture(scope="session")
def duck():
    import duckdb

    own = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        own.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return own


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    found = queries()[name](spark, DATA)
    rows, columns = found.collect(), found.columns
    if name not in oracle_sql():
        return
    want = duck.sql(oracle_sql()[name])
    assert sorted(columns) == sorted(want.columns)
    order, other = sorted(columns), want.columns
    left = sorted("|".join(plain(r[c]) for c in order) for r in rows)
    right = sorted("|".join(plain(r[other.index(c)]) for c in order) for r in want.fetchall())
    assert left == right
