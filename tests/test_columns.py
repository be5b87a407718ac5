"""The library of columns and operators says the same as the engine's SQL."""

import pytest
from pyspark.sql import functions as F

from millrace.engine.session import Engine
from millrace.functions import scalar as S
from millrace.operators import analytics
from millrace.operators import relational as R

TS, D = "timestamp '2024-01-31 13:14:15.5'", "date '2024-02-29'"


@pytest.fixture(scope="module")
def engine(spark, sf):
    return Engine(spark).register(sf, names=("nation", "region", "customer", "orders"))


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def words(engine, spark):
    each = [" Äb c ", "", None, "éàß", "abcdef", "A_b%c\\d"]
    df = spark.createDataFrame([(s, n, x) for s in each for n, x in ((0, 2.5), (2, -2.5), (-3, 1e10), (None, None), (9, -0.125))], "s string, n long, x double")
    df = df.withColumn("t", F.expr("cast('2024-01-31 13:14:15.5' as timestamp_ntz) + make_dt_interval(int(coalesce(n, 1)) * 40)")).withColumn("d", F.col("t").cast("date"))
    engine.register_frame("words", df)
    return df


@pytest.mark.parametrize(
    ("sql", "column"),
    [
        ("upper(s)", lambda: S.upper("s")),
        ("lower(s)", lambda: S.lower("s")),
        ("length(s)", lambda: S.length("s")),
        ("substr(s, n)", lambda: S.substr("s", "n")),
        ("substr(s, n, 2)", lambda: S.substr("s", "n", 2)),
        ("substr(s, 3, n)", lambda: S.substr("s", 3, "n")),
        ("replace(s, 'b', 'xy')", lambda: S.replace("s", F.lit("b"), F.lit("xy"))),
        ("trim(s)", lambda: S.trim("s")),
        ("abs(x)", lambda: S.absolute("x")),
        ("round(x)", lambda: S.round_half_away("x")),
        ("round(x, n)", lambda: S.round_half_away("x", "n")),
        ("floor(x)", lambda: S.floor("x")),
        ("ceil(x)", lambda: S.ceil("x")),
        ("date(t)", lambda: S.date("t")),
        ("year(t)", lambda: S.year("t")),
        ("month(t)", lambda: S.month("t")),
        ("day(d)", lambda: S.day("d")),
        ("hour(t)", lambda: S.hour("t")),
        ("minute(t)", lambda: S.minute("t")),
        ("second(t)", lambda: S.second("t")),
        ("date_trunc('month', t)", lambda: S.date_trunc("month", "t")),
        ("date_trunc('year', d)", lambda: S.date_trunc("year", "d", is_date=True)),
        (f"datediff('month', {TS}, t)", lambda: S.datediff("month", F.expr("cast('2024-01-31 13:14:15.5' as timestamp_ntz)"), "t")),
        (f"datediff('day', t, {TS})", lambda: S.datediff("day", "t", F.expr("cast('2024-01-31 13:14:15.5' as timestamp_ntz)"))),
        (f"datediff('year', {D}, t)", lambda: S.datediff("year", F.lit("2024-02-29").cast("date"), "t")),
        ("n / 2", lambda: S.divide("n", F.lit(2).cast("bigint"), True)),
        ("7 / n", lambda: S.divide(F.lit(7).cast("bigint"), "n", True)),
        ("x / n", lambda: S.divide("x", "n", False)),
        ("d + interval 1 month", lambda: S.add_interval("d", "1 month", is_date=True)),
        ("t + interval 25 hours", lambda: S.add_interval("t", "25 hours")),
        ("s like 'A_b%c\\d'", lambda: S.like("s", "A_b%c\\d")),
        ("coalesce(s, 'none')", lambda: S.coalesce("s", F.lit("none"))),
    ],
)
def test_functions(engine, words, sql, column):
    assert rows(words.select("s", "n", column().alias("v"))) == rows(engine.query(f"select s, n, {sql} as v from words"))


def test_now(engine, words):
    a, b = words.select(S.now().alias("v")).first()[0], engine.query("select now() as v").first()[0]
    assert abs((a - b).total_seconds()) < 60


def test_operators(engine):
    q, nation, region, customer, orders = engine.query, *(engine.table(t) for t in ("nation", "region", "customer", "orders"))
    urgent = orders.filter("o_orderpriority = '1-URGENT'")
    pairs = [
        (R.scan(nation, F.col("n_nationkey") > 20, ["n_name"]), "select n_name from nation where n_nationkey > 20"),
        (R.scan(nation, cap=3).agg(F.count(F.lit(1))), "select count(*) as n from (select * from nation limit 3) x"),
        (R.lookup_range(nation, "n_nationkey", 3, 7, low_open=True).select("n_nationkey"), "select n_nationkey from nation where n_nationkey > 3 and n_nationkey <= 7"),
        (R.equi_join(nation, region, [("n_regionkey", "r_regionkey")], "full").select("n_name", "r_name"), "select n_name, r_name from nation full join region on n_regionkey = r_regionkey"),
        (R.theta_join(nation, region, nation["n_regionkey"] < region["r_regionkey"], "left").select("n_name", "r_name"), "select n_name, r_name from nation left join region on n_regionkey < r_regionkey"),
        (R.semi_join(customer, urgent, "c_custkey", "o_custkey").select("c_custkey"), "select c_custkey from customer where c_custkey in (select o_custkey from orders where o_orderpriority = '1-URGENT')"),
        (R.anti_join(customer, urgent, "c_custkey", "o_custkey").select("c_custkey"), "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT')"),
        (R.aggregate(customer, ["c_nationkey"], [("count", None), ("avg", "c_acctbal"), ("count_distinct", "c_mktsegment")], F.col("count_star") > 5), "select c_nationkey, count(*) as n, avg(c_acctbal) as a, count(distinct c_mktsegment) as d from customer group by c_nationkey having count(*) > 5"),
        (R.group_concat(nation, ["n_regionkey"], "n_name", "n_name", "; "), "select n_regionkey, group_concat(n_name, '; ') as g from nation group by n_regionkey"),
        (R.distinct(customer.select("c_mktsegment")), "select distinct c_mktsegment from customer"),
        (R.top_k(customer.select("c_custkey", "c_acctbal"), [("c_acctbal", True)], 4, 2), "select c_custkey, c_acctbal from customer order by c_acctbal desc limit 4 offset 2"),
    ]
    a, b = nation.select("n_regionkey"), region.select("r_regionkey").filter("r_regionkey > 1")
    for f, word in ((R.union, "union"), (R.union_all, "union all"), (R.intersect, "intersect"), (R.except_, "except")):
        pairs.append((f(a, b), f"select n_regionkey from nation {word} select r_regionkey from region where r_regionkey > 1"))
    for have, sql in pairs:
        assert rows(have) == rows(q(sql)), sql


def test_ranks_among_many_values(spark, monkeypatch):
    monkeypatch.setattr(analytics, "FEW", 50)
    values = spark.range(5000).select((F.col("id") * 7919 % 4001).cast("double").alias("v"))
    want = sorted(k * 7919 % 4001 for k in range(5000))
    ranks = [1, 2, 777, 2500, 2501, 4500, 4950, 5000]
    assert analytics.kth(values, ranks) == {r: float(want[r - 1]) for r in ranks}
    one = spark.range(300).select(F.when(F.col("id") < 200, 5).otherwise(F.col("id")).alias("v"))
    assert analytics.kth(one, [1, 150, 200, 201, 300]) == {1: 5, 150: 5, 200: 5, 201: 200, 300: 299}
