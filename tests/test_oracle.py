"""Every query with SQL gives DuckDB's answer on the smallest tables."""

import oracle
import pytest

import __spark_entry__
from tenorline.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.database(SF)


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    df = __spark_entry__.queries()[name](spark, SF)
    got = con.execute(__spark_entry__.oracle_sql()[name])
    assert oracle.table(df.columns, [tuple(r) for r in df.collect()]) == oracle.table([d[0] for d in got.description], got.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0 and catalog.FLAGSHIP in __spark_entry__.queries()
