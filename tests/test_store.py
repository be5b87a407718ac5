"""Commits, sessions beside each other, attached folders, parameters of changes, and the command line."""

import threading
import time
from datetime import date
from decimal import Decimal

import pytest

from millrace.cli import main
from millrace.engine.session import AffectedRows, Engine
from millrace.errors import SqlError


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}/db"


@pytest.fixture
def engine(spark, root):
    e = Engine(spark, root)
    e.sql("create table t (id integer primary key, v int, s string)")
    e.sql("insert into t values (1, 10, 'a'), (2, 20, 'b')")
    yield e
    e.close()


def rows(e, sql):
    return [tuple(r) for r in e.sql(sql).collect()]


def test_sessions_beside_each_other(engine, root):
    other = Engine(engine.spark, root)
    engine.sql("begin")
    engine.sql("update t set v = 11 where id = 1")
    assert rows(other, "select v from t where id = 1") == [(10,)]
    other.sql("insert into t values (3, 30, 'c')")
    with pytest.raises(SqlError) as e:
        engine.sql("commit")
    assert e.value.sqlstate == "40001"
    assert sorted(rows(engine, "select id, v from t")) == [(1, 10), (2, 20), (3, 30)]
    engine.sql("update t set v = 12 where id = 1")
    assert rows(other, "select v from t where id = 1") == [(12,)]


def test_other_tables_do_not_clash(engine, root):
    other = Engine(engine.spark, root)
    with engine.transaction():
        engine.sql("delete from t where id = 1")
        other.sql("create table u (a int)")
    assert sorted(Engine(engine.spark, root).tables) == ["t", "u"]
    assert rows(engine, "select id from t") == [(2,)]


def test_several_tables_change_together(engine, root, monkeypatch):
    engine.sql("create table u (a int)")
    with engine.transaction():
        engine.sql("insert into u values (1)")
        engine.sql("delete from t")
    # A commit that a crash cut short is passed over, and the next one comes after it.
    store = engine.store
    n = max(store._numbers())
    out = store._fs.create(store._path(f"{root}/_log/{n + 1:012d}.json"), False)
    out.write(bytearray(b'{"t": {"sch'))
    out.close()
    fresh = Engine(engine.spark, root)
    assert rows(fresh, "select (select count(*) from t) as t, (select count(*) from u) as u") == [(0, 1)]
    fresh.sql("insert into u values (2)")
    assert max(store._numbers()) == n + 2
    assert rows(engine, "select count(*) from u") == [(2,)]
    assert store.vacuum() >= 1
    assert rows(Engine(engine.spark, root), "select count(*) from u") == [(2,)]


def test_changes_rewrite_only_files_with_matches(engine):
    engine.sql("insert into t values (3, 30, 'c')")
    before = engine.tables["t"].parts
    assert engine.sql("update t set v = 31 where id = 3") == AffectedRows(1)
    after = engine.tables["t"].parts
    assert before[0] in after and before[1] not in after
    assert engine.sql("delete from t where v = 20") == AffectedRows(1)
    assert after[1] in engine.tables["t"].parts
    assert sorted(rows(engine, "select id, v from t")) == [(1, 10), (3, 31)]
    with pytest.raises(SqlError) as e:
        engine.sql("update t set id = 1 where id = 3")
    assert e.value.sqlstate == "23505"


def test_attached(engine, spark, tmp_path):
    other = Engine(spark, f"file://{tmp_path}/other")
    other.sql("create table r (k integer primary key, n int)")
    engine.sql(f"attach '{tmp_path.as_uri()}/other' as o")
    assert engine.sql("insert into o.r values (1, 5), (2, 7)") == AffectedRows(2)
    assert engine.sql("insert into o.r select id + 10, v from t where v > 15") == AffectedRows(1)
    assert engine.sql("update o.r set n = n * 2 where k = 1") == AffectedRows(1)
    assert engine.sql("delete from o.r where k = 2") == AffectedRows(1)
    assert engine.sql("insert into t select k + 100, n, 'o' from o.r") == AffectedRows(2)
    assert sorted(rows(other, "select * from r")) == [(1, 10), (12, 20)]
    assert sorted(rows(engine, "select t.id, o.r.n / 3 as third from t join o.r on t.id = k + 100")) == [(101, 3), (112, 6)]
    with pytest.raises(SqlError):
        engine.sql("insert into o.r values (1, 1)")
    engine.sql("detach o")
    with pytest.raises(SqlError):
        engine.sql("select * from o.r")


def test_parameters_of_changes(engine):
    engine.sql("create table p (id integer primary key, s string, f float, d date, x decimal(5,2), b bool)")
    put = engine.prepare("insert into p values (?, ?, ?, ?, ?, ?)")
    assert put(1, "it's ?", -1.5, date(2024, 2, 29), Decimal("3.25"), True) == AffectedRows(1)
    assert put(2, None, None, None, None, None) == AffectedRows(1)
    assert engine.sql("insert into p (id, s) values (?, ?) on conflict (id) do update set s = ?", [1, "no", "new"]) == AffectedRows(1)
    assert engine.sql("update p set f = ? where id = ?", [2.5, 2]) == AffectedRows(1)
    assert rows(engine, "select * from p order by id") == [(1, "new", -1.5, date(2024, 2, 29), Decimal("3.25"), True), (2, None, 2.5, None, None, None)]
    assert engine.sql("delete from p where s = ? or s is null", ["new"]) == AffectedRows(2)
    with pytest.raises(SqlError):
        engine.sql("delete from p where id = ?")


def test_cancellation(engine):
    failed = []

    def run():
        try:
            engine.sql("insert into t select count(*) + 1000, 1, 'x' from many a join many b on a.id % 7 <> b.id % 11")
        except SqlError as e:
            failed.append(e)

    engine.register_frame("many", engine.spark.range(100_000, numPartitions=4))
    thread = threading.Thread(target=run)
    thread.start()
    active = engine.spark.sparkContext.statusTracker().getActiveJobsIds
    for _ in range(600):
        if active() or not thread.is_alive():
            break
        time.sleep(0.1)
    time.sleep(1)
    engine.cancel()
    thread.join(60)
    assert failed and not thread.is_alive()
    assert rows(engine, "select count(*) from t") == [(2,)]


def test_restore_checks_once(engine, spark, tmp_path):
    from millrace.sources.dump import dump, restore

    text = ";\n".join(dump(engine))
    copy = Engine(spark, f"file://{tmp_path}/copy")
    restore(copy, text)
    assert sorted(rows(copy, "select id, v, s from t")) == [(1, 10, "a"), (2, 20, "b")]
    bad = Engine(spark, f"file://{tmp_path}/bad")
    with pytest.raises(SqlError) as e:
        restore(bad, text + ";\nINSERT INTO \"t\" VALUES (1, 1, 'x')")
    assert e.value.sqlstate == "23505"
    assert not bad.tables


def test_command_line(spark, root, tmp_path, capsys):
    run = lambda *args: (main([*args], spark), capsys.readouterr().out)
    assert run("new", root)[0] == 0
    assert run("query", root, "create table t (id integer primary key, s string); insert into t values (1, 'x'), (2, 'y')")[0] == 0
    assert run("list", root) == (0, "t\n")
    assert "y" in run("query", root, "select * from t order by id")[1]
    assert "PRIMARY KEY" in run("schema", root, "t")[1]
    assert run("check", root) == (0, "ok\n")
    assert "row_count" in run("stats", root, "t")[1]
    assert "x(1)" in run("profile", root, "t", "--top", "2")[1]
    assert run("sample", root, "t", "--n", "1", "--format", "csv")[1].count("\n") == 2
    dumped = run("dump", root)[1]
    (tmp_path / "d.sql").write_text(dumped)
    assert run("restore", f"file://{tmp_path}/again", str(tmp_path / "d.sql"))[0] == 0
    assert run("list", f"file://{tmp_path}/again")[1] == "t\n"
    (tmp_path / "c.csv").write_text("a,b\n1,x\n")
    assert run("import", root, str(tmp_path / "c.csv"), "c") == (0, "1 rows\n")
    assert run("checkpoint", root)[0] == 0
    assert run("delete", root)[0] == 0
    assert run("list", root) == (0, "")
    assert run("query", root, "select * from nope")[0] == 1


def test_folders_without_a_scheme(spark, tmp_path):
    e = Engine(spark, f"{tmp_path}/plain folder")
    e.sql("create table t (id integer primary key, v int)")
    e.sql("insert into t values (1, 1), (2, 2)")
    e.sql("insert into t values (3, 3)")
    assert e.sql("update t set v = 9 where id = 3") == AffectedRows(1)
    assert e.sql("delete from t where id = 1") == AffectedRows(1)
    assert sorted(rows(e, "select * from t")) == [(2, 2), (3, 9)]
