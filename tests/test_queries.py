"""Every query that has SQL, against DuckDB on the smallest tables."""

import os

import pytest
from loomtab import plans
from oracle import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")


@pytest.fixture(scope="module")
def db():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query_gives_what_its_sql_gives(spark, db, name):
    df = plans.queries()[name](spark, SF)
    n, wrong = compare(df, db, plans.oracle_sql()[name])
    assert not wrong
    assert n


def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
