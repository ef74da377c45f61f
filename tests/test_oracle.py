"""Registered queries against their SQL in DuckDB; those without SQL must return rows.

Every registered query of the inventory runs, variants (``Q-1_year``) too.
"""

import pytest
from oracle import connect, differences

from visitgrain.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("key", list(QUERIES))
def test_query(spark, con, sf_dir, key):
    if key in ORACLES:
        assert differences(spark, con, sf_dir, key, QUERIES[key], ORACLES[key]) is None
    else:
        assert not QUERIES[key](spark, sf_dir).isEmpty()


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    df = entry.entry(spark)
    assert df.columns == ["time_period", "IGD", "Rawat Inap", "Rawat Jalan"]
    assert df.count() > 0
