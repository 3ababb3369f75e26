"""Each query of the library's own operators against its SQL on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lattica import plans

from .conftest import SF, comparable


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_oracle(spark, duck, name):
    df = plans.queries()[name](spark, SF)
    got = comparable(df.columns, df.collect())
    r = duck.execute(plans.oracle_sql()[name])
    want = comparable([d[0] for d in r.description], r.fetchall())
    assert sorted(df.columns) == sorted(d[0] for d in r.description)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_runs(spark, name):
    df = plans.queries()[name](spark, SF)
    assert df.columns and df.count() >= 0


def test_entry_contract(spark):
    import __spark_entry__ as entry

    found = entry.queries()
    assert set(entry.oracle_sql()) <= set(found)
    assert entry.entry(spark).count() >= 0
