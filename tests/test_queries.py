"""Every query against its SQL on the smallest test data."""

from pathlib import Path

import pytest

from helmtrace.checks.compare import connect, difference
from helmtrace.checks.oracle import ORACLE
from helmtrace.checks.queries import QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    return connect(DATA)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name in ORACLE:
        assert difference(got, duck.sql(ORACLE[name]).df()) is None
    else:
        assert len(got.columns) > 0


def test_sql_belongs_to_queries():
    assert set(ORACLE) <= set(QUERIES)
