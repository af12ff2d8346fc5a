"""Every SQL-checkable query against its DuckDB statement at full precision.

Off by default (several minutes): LF_ORACLE_FULL=/root/testdata/sf0.01 python -m pytest tests/test_oracle_full.py
"""

import os

import pytest

import __spark_entry__ as E
from tests.oracle_compare import compare, duck

SF = os.environ.get("LF_ORACLE_FULL")

pytestmark = pytest.mark.skipif(not SF, reason="set LF_ORACLE_FULL to a scale-factor folder")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_bit_exact(spark, con, name):
    r = compare(spark, name, E.queries()[name], E.oracle_sql()[name], SF, con, digits=17)
    assert r["ok"], r
