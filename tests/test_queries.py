import pytest
from oracle import same

from factweave import queries as q

NAMES = sorted(q.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, sf_dir, name):
    same(q.queries()[name](spark, sf_dir), sf_dir, q.oracle_sql()[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert set(q.queries()) <= set(e.queries()) and set(NAMES) == set(q.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
