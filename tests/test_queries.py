"""Every graph query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from graphloom.queries import ORACLE_SQL, QUERIES

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{D}/*.parquet"):
        c.sql(f"create view {os.path.basename(p).split('.')[0]} as select * from '{p}'")
    return c



@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, D).toPandas()
    if name not in ORACLE_SQL:
        assert name == "shrink_raw_data"  # compared with a plain version in test_engine
        return
    want = con.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    assert sorted(map(tuple, got[sorted(got.columns)].astype(object).where(got[sorted(got.columns)].notna(), None).values.tolist()), key=key) == sorted(map(tuple, want[sorted(want.columns)].astype(object).where(want[sorted(want.columns)].notna(), None).values.tolist()), key=key)


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["_type", "edges", "dangling"] and df.count() == 3
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
