"""Every training-data query runs over whole tables and equals its SQL where it has one."""

import pytest
from oracle import DATA, compare, connect

from kiteloom.llm import queries as training

SF = str(DATA / "sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(training.queries()))
def test_query(spark, con, name):
    df = training.queries()[name](spark, SF)
    sql = training.oracles().get(name)
    if sql is None:
        rows = df.collect()
        assert rows and df.columns
    else:
        assert compare(df, con, sql) == []
    if name.endswith("_found") and sql is None:
        assert len(set(rows)) == len(rows)
