"""Every query with SQL gives the rows of its SQL."""

import pytest
from oracle import difference

from tidewheel.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows(spark, name):
    assert not difference(QUERIES[name](spark, SF), ORACLES[name], SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "yoy" in df.columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
