"""Every query of the subpackage runs over the smallest tables and agrees with its SQL where it has some."""

import os

import pytest

from corpusmill.llm.queries import oracle_sql, queries
from tests.test_queries import DATA, duck, plain  # noqa: F401

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):  # noqa: F811
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
