import pytest
from compare import check

from millrace import queries as Q


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_equals_the_other_engine(spark, duck, sf, name):
    query, sql = Q.queries()[name], Q.oracle_sql().get(name)
    if sql is None:
        assert query(spark, sf).columns
        assert len(query(spark, sf).collect()) > 0
    else:
        assert check(spark, duck, query, sql, sf) == ""


def test_entry(spark):
    import __spark_entry__ as e

    assert len(e.entry(spark).collect()) == 10
    assert set(e.oracle_sql()) <= set(e.queries())
