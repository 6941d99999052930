"""Every query of the subpackage against its SQL, or at least to its end."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import TESTDATA, connection, same

from triloom.llm import queries as Q

needs_data = pytest.mark.skipif(not os.path.isdir(TESTDATA), reason="no test tables")
QUERIES, SQL = Q.queries(), Q.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connection()


@needs_data
@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_like_sql(spark, con, name):
    same(spark, con, QUERIES[name], SQL[name])


@needs_data
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, TESTDATA).count() >= 0
