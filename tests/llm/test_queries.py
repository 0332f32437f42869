"""The registered corpus queries that have SQL, against DuckDB on the smallest tables."""

import os

import pytest
from gradelake.llm.queries import ORACLES, QUERIES
from tools.compare import connect, rows_of

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    df = QUERIES[name](spark, SF)
    got = rows_of(df.columns, df.collect())
    cur = connect(SF).execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert got == rows_of(columns, cur.fetchall())
