import pytest

from millrace.errors import SqlError
from millrace.plans.rewrite import Rewriter, statements

R = Rewriter({"a": "bigint", "b": "bigint", "x": "double", "s": "string", "d": "date"})


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("select a / b", "select ((a) div nullif((b), 0L))"),
        ("select x / b", "select try_divide((x), (b))"),
        ("select 1.5", "select 1.5D"),
        ("select a from t order by a", "select a from t order by a asc nulls last"),
        ("select a from t order by a desc limit 3", "select a from t order by a desc nulls first limit 3"),
        ("select a from t order by a nulls first", "select a from t order by a asc nulls first"),
        ("select a from t group by 1", "select a from t group by 1"),
        ("select 'it''s'", "select 'it\\'s'"),
        ("select \"A\" from T", "select `a` from t"),
        ("select s like 'a\\b'", "select s like 'a\\\\\\\\b'"),
    ],
)
def test_text(given, want):
    assert R(given) == want


@pytest.mark.parametrize(
    ("sql", "state"),
    [
        ("select sum(a) over (order by b) from t", "0A000"),
        ("select a from t where a = 'x'", "42804"),
        ("select a from t where s < 3", "42804"),
        ("select s like 'a' escape 'b'", "0A000"),
        ("select round(1, 2, 3)", "42601"),
        ("select (1", "42601"),
        ("select cast(x as decimal) from t", "42601"),
        ("select cast(x as time) from t", "0A000"),
    ],
)
def test_refused(sql, state):
    with pytest.raises(SqlError) as e:
        R(sql)
    assert e.value.sqlstate == state


def test_statements_are_parted_outside_of_literals():
    assert statements("select ';'; -- a;b\n select 2;") == ["select ';'", "-- a;b\n select 2"]
