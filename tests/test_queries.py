"""Every core query runs over whole tables and equals its SQL where it has one."""

import pytest
from oracle import DATA, compare, connect

from kiteloom.plans import catalogue

SF = str(DATA / "sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query(spark, con, name):
    df = catalogue.queries()[name](spark, SF)
    sql = catalogue.oracles().get(name)
    if sql is None:
        assert df.count() >= 0 and df.columns
    else:
        assert compare(df, con, sql) == []


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
