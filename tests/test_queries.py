"""Every core query against its SQL, or at least to its end."""

import os
import subprocess
import sys

import pytest
from oracle import TESTDATA, connection, same

from triloom.plans import core

needs_data = pytest.mark.skipif(not os.path.isdir(TESTDATA), reason="no test tables")
QUERIES, SQL = core.queries(), core.oracle_sql()


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


def test_nothing_else_needs_the_collections_subpackage():
    code = "import sys; sys.modules['triloom.llm'] = None; import __spark_entry__ as e; q = e.queries(); print(len(q), [k for k in q if k[0] == 'p' and k[1:2].isdigit() and k[:3] not in ('p1_', 'p6_')])"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert out.stdout.split(" ", 1)[1].strip() == "[]", out.stderr
