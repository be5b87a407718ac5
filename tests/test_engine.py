from decimal import Decimal

import pytest

from millrace.engine.session import AffectedRows, Engine
from millrace.errors import SqlError
from millrace.operators import analytics, relational
from millrace.sources.csv_import import import_csv
from millrace.sources.dump import dump, restore
from millrace.sources.render import render


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/db")
    e.sql("create table users (id integer primary key, name varchar(100) default 'anon', code int unique, joined date, pay decimal(8,2))")
    e.sql("insert into users values (1, 'a', 10, '2024-01-31', 1.50), (2, 'b', 20, null, null)")
    yield e
    e.close()


def rows(engine, sql, args=None):
    return [tuple(r) for r in engine.sql(sql, args).collect()]


def refused(engine, sql, state):
    with pytest.raises(SqlError) as e:
        engine.sql(sql)
    assert e.value.sqlstate == state


def test_insert_and_constraints(engine):
    assert engine.sql("insert into users (id, code) values (3, 30)") == AffectedRows(1)
    assert rows(engine, "select name from users where id = 3") == [("anon",)]
    refused(engine, "insert into users (id) values (1)", "23505")
    refused(engine, "insert into users (id, code) values (9, 10)", "23505")
    refused(engine, "insert into users (name) values ('x')", "23502")
    refused(engine, "insert into users (id, name) values (9, 5)", "42804")
    refused(engine, "insert into users (nope) values (1)", "42703")
    with pytest.raises(SqlError):
        engine.sql("insert into users (id, pay) values (9, 1.234)")
    assert rows(engine, "select count(*) from users") == [(3,)]


def test_conflicts(engine):
    assert engine.sql("insert into users (id, name, code) values (1, 'z', 11), (4, 'n', 40) on conflict (id) do nothing") == AffectedRows(1)
    engine.sql("insert into users (id, name, code) values (1, 'z', 11), (5, 'm', 50) on conflict (id) do update set name = excluded.name")
    assert rows(engine, "select id, name, code from users order by id") == [(1, "z", 10), (2, "b", 20), (4, "n", 40), (5, "m", 50)]
    engine.sql("replace into users (id, name, code) values (2, 'r', 40)")
    assert rows(engine, "select id, code from users order by id") == [(1, 10), (2, 40), (5, 50)]
    refused(engine, "insert into users (id) values (1) on conflict (name) do nothing", "0A000")


def test_update_and_delete_with_nulls(engine):
    assert engine.sql("update users set code = code + 1, name = upper(name) where joined is null") == AffectedRows(1)
    assert engine.sql("delete from users where joined > date '2020-01-01'") == AffectedRows(1)
    assert rows(engine, "select id, name, code from users") == [(2, "B", 21)]
    assert engine.sql("delete from users") == AffectedRows(1)
    assert rows(engine, "select count(*), sum(code) from users") == [(0, None)]


def test_transactions(engine):
    engine.script("begin; delete from users; rollback")
    assert rows(engine, "select count(*) from users") == [(2,)]
    with pytest.raises(ValueError), engine.transaction():
        engine.sql("truncate table users")
        raise ValueError
    assert rows(engine, "select count(*) from users") == [(2,)]
    with engine.transaction():
        engine.sql("delete from users where id = 1")
    assert rows(Engine(engine.spark, engine.store.root), "select id from users") == [(2,)]
    refused(engine, "commit", "25P01")


def test_definitions(engine):
    engine.sql("alter table users add column z int default 7")
    assert rows(engine, "select z from users where id = 1") == [(7,)]
    engine.sql("alter table users drop column z")
    refused(engine, "alter table users add column q int not null", "23502")
    engine.sql("create view v as select id from users where id > 1")
    assert rows(engine, "select * from v") == [(2,)]
    refused(engine, "insert into v values (1)", "0A000")
    engine.sql("create table copy as select id, null as n from users")
    assert engine.table("copy").dtypes == [("id", "bigint"), ("n", "string")]
    refused(engine, "create table copy (a int)", "42P07")
    engine.script("drop view v; drop table copy; drop table if exists copy")
    refused(engine, "select * from copy", "42P01")
    refused(engine, "create table t (a int, check (a > 1))", "0A000")
    refused(engine, "create table t (a decimal(2,3))", "42601")
    refused(engine, "select nope from users", "42703")


def test_readonly(engine):
    other = Engine(engine.spark, engine.store.root, readonly=True)
    assert rows(other, "select count(*) from users") == [(2,)]
    refused(other, "delete from users", "25006")


def test_parameters_cursor_explain(engine):
    assert rows(engine, "select id from users where name = ? and id < ?", ["a", 5]) == [(1,)]
    with pytest.raises(SqlError):
        engine.sql("select id from users where id = ?")
    assert engine.prepare("select name from users where id = ?")(2).collect()[0][0] == "b"
    assert [r.id for r in engine.rows("select id from users order by id")] == [1, 2]
    assert any("Filter" in r.plan for r in engine.sql("explain select id from users where id = 1").collect())
    assert [tuple(r) for r in engine.sql("analyze table users").collect()][0] == ("id", 2, 0, 2)


def test_dump_restore_csv_render(engine, tmp_path):
    text = ";\n".join(dump(engine))
    other = Engine(engine.spark, f"file://{tmp_path}/other")
    restore(other, text)
    assert rows(other, "select id, name, pay from users order by id") == [(1, "a", Decimal("1.50")), (2, "b", None)]
    assert other.schema("users") == engine.schema("users")
    (tmp_path / "x.csv").write_text('id,v,s\n1,1.5,"a ""q"", b"\n2,,\n')
    assert import_csv(engine, f"file://{tmp_path}/x.csv", "c") == AffectedRows(2)
    assert rows(engine, "select * from c order by id") == [(1, 1.5, 'a "q", b'), (2, None, "")]
    assert render(engine.sql("select id, v from c order by id"), "csv") == "id,v\n1,1.5\n2,\n"
    assert render(engine.sql("select v from c order by id"), "json") == '{"columns": ["v"], "rows": [[1.5], [null]]}'
    (tmp_path / "y.csv").write_text("id,nope\n1,2\n")
    with pytest.raises(SqlError):
        import_csv(engine, f"file://{tmp_path}/y.csv", "c")


def test_not_in_and_nulls(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    right = lambda *v: spark.createDataFrame([(x,) for x in v], "k int")
    run = lambda r: sorted((x.k or 0) for x in relational.not_in(left, r, "k", "k").collect())
    assert run(right(1)) == [2]
    assert run(right(1, None)) == []
    assert run(right()) == [0, 1, 2]


def test_null_order(spark):
    df = spark.createDataFrame([(None,), (1,), (3,), (None,), (2,)], "v int")
    assert [r.v for r in relational.sort(df, [("v", False)]).collect()] == [1, 2, 3, None, None]
    assert [r.v for r in relational.sort(df, [("v", True)]).collect()] == [None, None, 3, 2, 1]


def test_analytics_of_an_empty_table(spark):
    r = analytics.stats(spark.createDataFrame([], "a int, s string")).collect()
    assert [(x["column"], x.row_count, x.null_rate, x.p50) for x in r] == [("a", 0, 100.0, None), ("s", 0, 100.0, None)]
    with pytest.raises(ValueError):
        analytics.sample(spark.range(3), 0)
    assert analytics.sample(spark.range(30), 10).count() == 10
