"""Every query of the plans against DuckDB on the small tables; those without SQL must run and be stable."""

import glob
import os

import duckdb
import pytest

from strandspark import plans

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="needs the test data")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def rounded(rows):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_against_duckdb(spark, tables, name):
    got = plans.queries()[name](spark, SF)
    want = tables.sql(plans.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    quoted = [f'"{c}"' for c in columns]
    assert rounded(tuple(r) for r in got.select(*columns).collect()) == rounded(want.select(*quoted).fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_reruns_agree(spark, name):
    query = plans.queries()[name]
    first, again = (rounded(tuple(r) for r in query(spark, SF).collect()) for _ in range(2))
    assert first and first == again


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
