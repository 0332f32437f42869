"""Every registered query outside the corpus operators against its SQL in DuckDB on the smallest tables."""

from __future__ import annotations

import os

import pytest

from gradelake.plans import ORACLES, QUERIES
from tools.compare import connect, rows_of

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = rows_of(df.columns, df.collect())
    cur = con.execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    want = rows_of(columns, cur.fetchall())
    assert sorted(df.columns) == sorted(columns)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert len(df.collect()) > 0 and df.columns
