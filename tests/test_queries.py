"""Every core query runs and equals its SQL twin, where it has one, at the scale of the driver's comparison. (In the smallest tables means of a few
prices end in an exact half of the last digit, which the engines round differently.)"""

import pytest

from lodestone.plans import catalog
from tests.oracle import compare, connect

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_oracle):
    return connect(sf_oracle)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_oracle, con, name):
    if name in SQL:
        compare(spark, con, sf_oracle, QUERIES[name], SQL[name])
    else:
        QUERIES[name](spark, sf_oracle).collect()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns
    assert set(e.oracle_sql()) <= set(e.queries())
