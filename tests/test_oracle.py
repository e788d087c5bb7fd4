"""Every registered query against its SQL on the base tables."""

import pytest
from oracle import compare, connect

from workload import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf, name):
    if name in ORACLES:
        compare(spark, con, name, QUERIES[name], ORACLES[name], sf)
    else:
        assert QUERIES[name](spark, sf).count() >= 0


def test_contract():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
