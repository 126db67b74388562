"""Every registered query gives the rows of its SQL twin."""

import pytest

import __spark_entry__ as entry_point
from queries import registry
from tests.compare import compare, connect


# On the smallest tables every star is seen in the first epoch.
MAY_BE_EMPTY = {"epoch_new_objects"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, con, name):
    sql = entry_point.oracle_sql()[name]
    got = entry_point.queries()[name](spark, sf_dir).toPandas()
    assert compare(got, con.execute(sql).fetchdf()) is None
    assert len(got) or name in MAY_BE_EMPTY


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
