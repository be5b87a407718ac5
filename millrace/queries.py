"""The query catalogue: one query an operator, with SQL for another engine that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.engine.session import Engine
from millrace.functions import scalar as S
from millrace.operators import analytics, relational as R

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

_SQL: dict[str, tuple[str, str]] = {}
_FRAMES: dict[str, tuple[Callable[[Engine], DataFrame], str | None]] = {}


def _engine(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine(spark).register(sf_dir, names=TABLES)


def _both(name: str, text: str, oracle: str | None = None) -> None:
    """A query in the engine's dialect; oracle: other text for the other engine, where the dialects differ."""
    _SQL[name] = text, oracle or text


def frame(name: str, oracle: str | None):
    def add(f: Callable[[Engine], DataFrame]):
        _FRAMES[name] = f, oracle
        return f

    return add


# -- flagship ----------------------------------------------------------------------------------------------------------
_both(
    "a0_flagship",
    """select o_orderpriority as priority, l_returnflag as flag, count(*) as n, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue
    from orders join lineitem on o_orderkey = l_orderkey where l_shipdate >= timestamp '1995-01-01 00:00:00' and l_quantity < 40
    group by o_orderpriority, l_returnflag having count(*) > 5 order by revenue desc, priority, flag limit 10""",
)

# -- scans -------------------------------------------------------------------------------------------------------------
_both("s1_full_scan", "select * from nation")
_both("s2_pushdown_scan", "select l_orderkey, l_extendedprice from lineitem where l_shipdate < timestamp '1996-01-01 00:00:00' and l_quantity > 45")
frame("s3_point_lookup", "select * from orders where o_orderkey = 33")(lambda e: R.lookup(e.table("orders"), "o_orderkey", 33))
frame("s4_secondary_lookup", "select o_orderkey, o_custkey from orders where o_custkey = 7")(lambda e: R.lookup(e.table("orders"), "o_custkey", 7).select("o_orderkey", "o_custkey"))
frame("s5_range_scan", "select o_orderkey, o_totalprice from orders where o_orderkey >= 100 and o_orderkey < 300")(lambda e: R.lookup_range(e.table("orders"), "o_orderkey", 100, 300, high_open=True).select("o_orderkey", "o_totalprice"))
_both("s6_derived_scan", "select d.k, d.n from (select n_regionkey as k, count(*) as n from nation group by n_regionkey) d where d.n > 3")
_both("s7_single_row", "select 1 + 1 as two, 'x' as letter")


@frame("s8_csv_import", "select r_regionkey::bigint as id, r_name as name, r_regionkey * 1.5::double as half from region")
def _csv(e: Engine) -> DataFrame:
    from millrace.sources.csv_import import import_csv

    path = f"{e.store.root}/csv"
    rows = e.table("region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), (F.col("r_regionkey") * F.lit(1.5)).alias("half"))
    rows.coalesce(1).write.option("header", True).csv(path)  # five rows: one file
    import_csv(e, path, "imported")
    return e.table("imported")


@frame("s9_dump_restore", "select n_nationkey::bigint as k, n_name as name from nation")
def _dump(e: Engine) -> DataFrame:
    from millrace.sources.dump import dump, restore

    e.sql("create table small as select cast(n_nationkey as int) as k, n_name as name from nation")
    other = Engine(e.spark)
    restore(other, ";\n".join(dump(e)))
    return other.table("small")


@frame("s11_render", "select r_regionkey::varchar as id, r_name as name from region")
def _render(e: Engine) -> DataFrame:
    import json

    from millrace.sources.render import render

    out = json.loads(render(e.query("select r_regionkey as id, r_name as name from region"), "json"))
    return e.spark.createDataFrame([tuple(map(str, r)) for r in out["rows"]], "id string, name string").toDF(*out["columns"])


@frame("s13_attach", "select n_nationkey::bigint as k, r_name as region from nation join region on n_regionkey = r_regionkey")
def _attach(e: Engine) -> DataFrame:
    other = Engine(e.spark)
    other.register_frame("src", e.table("region"))
    other.sql("create table reg as select cast(r_regionkey as int) as id, r_name as name from src")
    e.sql(f"attach '{other.store.root}' as other")
    return e.sql("select cast(n_nationkey as int) as k, name as region from nation join other.reg on n_regionkey = id")


@frame("s14_in_memory", "select count(*) as n from part where p_size > 25")
def _memory(e: Engine) -> DataFrame:
    e.register_frame("only_here", e.table("part").select("p_size"))
    return e.sql("select count(*) as n from only_here where p_size > 25")


# -- projection, filters, expressions ----------------------------------------------------------------------------------
_both("p1_projection", "select o_orderkey, o_totalprice * 2 as twice, o_orderstatus as status from orders")
_both("p2_column_pruning", "select p_brand from part")
_both("p3_star", "select * from supplier")
_both("f1_filter", "select c_custkey from customer where c_acctbal < 0")
_both("f2_comparison", "select o_orderkey from orders where o_totalprice >= 1000 and o_totalprice <> 5000 and o_orderstatus = 'F'")
_both("f3_bool_logic", "select l_orderkey, l_linenumber from lineitem where not (l_quantity > 10 or l_discount = 0) and nullif(l_returnflag, 'N') <> 'A'")
_both("f4_in_list", "select p_partkey from part where p_size in (1, 5, 9) and p_brand not in ('Brand#11', 'Brand#22')")
_both("f4_in_null", "select p_partkey from part where p_size in (1, null) or p_size not in (2, null)")
_both("f5_between", "select l_orderkey, l_linenumber from lineitem where l_quantity between 10 and 12 and l_discount not between 0.02 and 0.06")
_both("f6_like", "select c_custkey, c_name from customer where c_name like '%1_' and c_mktsegment not like 'B%'")
_both("f7_is_null", "select event_id, nullif(event_type, 'click') is null as was_click from events where nullif(user_id, 1) is not null")
_both("f8_constant", "select r_name from region where true")
_both("e1_arith", "select l_orderkey, l_linenumber, l_linenumber / 2 as half, -l_linenumber / 4 as quarter, l_linenumber / (l_linenumber - 1) as q, round(l_extendedprice / l_quantity, 4) as unit from lineitem", "select l_orderkey, l_linenumber, (l_linenumber // 2)::bigint as half, (trunc(-l_linenumber / 4))::bigint as quarter, (case when l_linenumber = 1 then null else trunc(l_linenumber / (l_linenumber - 1)) end)::bigint as q, round(l_extendedprice / l_quantity, 4) as unit from lineitem")
_both("e1_derived", "select d.k, d.n / 4 as q, d.n / (d.k + 1) as r, d.total / d.n as mean, (d.n + 1) / 2 + d.k / 2 as h from (select o_custkey as k, count(*) as n, sum(o_totalprice) as total from orders group by o_custkey) d where d.n / 2 > 1", "select d.k, d.n // 4 as q, d.n // (d.k + 1) as r, d.total / d.n as mean, (d.n + 1) // 2 + d.k // 2 as h from (select o_custkey as k, count(*) as n, sum(o_totalprice) as total from orders group by o_custkey) d where d.n // 2 > 1")
_both("e1_cte", "with c as (select p_brand as b, count(*) as n, max(p_size) as s from part group by p_brand), d(b, half) as (select b, n / 2 from c) select c.b, c.n / 3 as third, c.s / 7 as week, d.half / 2 as quarter from c join d on c.b = d.b", "with c as (select p_brand as b, count(*) as n, max(p_size) as s from part group by p_brand), d(b, half) as (select b, n // 2 from c) select c.b, c.n // 3 as third, c.s // 7 as week, d.half // 2 as quarter from c join d on c.b = d.b")


@frame("e1_view", "select n_regionkey as k, count(*) // 2 as half, max(n_nationkey) // 3 as third from nation group by n_regionkey")
def _view_division(e: Engine) -> DataFrame:
    e.sql("create view counted as select n_regionkey as k, count(*) as n, max(n_nationkey) as m from nation group by n_regionkey")
    return e.sql("select k, n / 2 as half, counted.m / 3 as third from counted")


@frame("e1_join", "select p_partkey as k, p_size // 3 as whole, p_retailprice / 3 as part from part")
def _clashing_division(e: Engine) -> DataFrame:
    e.register_frame("a", e.table("part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("x")))
    e.register_frame("b", e.table("part").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("x")))
    return e.sql("select a.k as k, a.x / 3 as whole, b.x / 3 as part from a join b on a.k = b.k")


_both("e2_interval", "select o_orderkey, cast(o_orderdate as date) + interval '1 month' as next_month, cast(o_orderdate as date) + interval '25 hours' as day_on, o_orderdate - interval '3 hours' as before from orders", "select o_orderkey, (o_orderdate::date + interval 1 month)::date as next_month, (o_orderdate::date + interval 25 hours)::date as day_on, o_orderdate - interval 3 hours as before from orders")
_both("e3_case", "select p_partkey, case when p_size < 10 then 'small' when p_size < 30 then 'medium' else 'large' end as class, case p_brand when 'Brand#11' then 1 when 'Brand#12' then 2 end as code from part", "select p_partkey, case when p_size < 10 then 'small' when p_size < 30 then 'medium' else 'large' end as class, (case p_brand when 'Brand#11' then 1 when 'Brand#12' then 2 end)::bigint as code from part")
_both("e4_coalesce", "select event_id, coalesce(nullif(event_type, 'view'), 'none') as kind from events")
_both("e5_cast", "select o_orderkey, cast(o_totalprice as int) as whole, cast(o_orderkey as string) as text, cast('2024-02-29' as date) as day, cast(o_orderdate as date) as date_only, cast('true' as bool) as yes from orders", "select o_orderkey, trunc(o_totalprice)::bigint as whole, o_orderkey::varchar as text, '2024-02-29'::date as day, o_orderdate::date as date_only, true as yes from orders")
_both("e6_typed_literals", "select r_regionkey, date '2024-02-29' as d, timestamp '2024-02-29 12:34:56.5' as t from region")


@frame("e7_parameters", "select o_orderkey from orders where o_totalprice > 1000 and o_orderstatus = 'O'")
def _parameters(e: Engine) -> DataFrame:
    return e.prepare("select o_orderkey from orders where o_totalprice > ? and o_orderstatus = ?")(1000, "O")


# -- joins -------------------------------------------------------------------------------------------------------------
_both("j1_inner", "select o_orderkey, c_name from orders join customer on o_custkey = c_custkey where c_acctbal > 5000")
frame("j2_pk_join", "select n_name, r_name from nation join region on n_nationkey = r_regionkey")(lambda e: R.merge_join(e.table("nation"), e.table("region"), [("n_nationkey", "r_regionkey")]).select("n_name", "r_name"))
_both("j3_theta", "select n_nationkey, r_regionkey from nation join region on n_regionkey < r_regionkey or n_nationkey = 3")
_both("j4_left", "select c_custkey, o_orderkey from customer left join orders on c_custkey = o_custkey and o_totalprice > 3000")
_both("j5_right", "select o_orderkey, c_custkey from orders right join customer on c_custkey = o_custkey")
_both("j6_full", "select a.n_nationkey as a, b.s_suppkey as b from nation a full join supplier b on a.n_nationkey = b.s_suppkey")
_both("j7_self", "select a.n_name as a, b.n_name as b from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey")
_both("j8_chain", "select r_name, n_name, count(*) as n, round(sum(l_extendedprice), 2) as total from region join nation on r_regionkey = n_regionkey join customer on n_nationkey = c_nationkey join orders on c_custkey = o_custkey join lineitem on o_orderkey = l_orderkey group by r_name, n_name")
_both("j9_in", "select c_custkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 3000)")
_both("j10_exists", "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F')")
_both("j11_not_in", "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'F' and o_orderpriority = '1-URGENT')")


@frame(
    "j11_not_in_null",
    """select (select count(*) from customer where c_custkey not in (select nullif(o_custkey, 1) from orders)) as beside_null,
    (select count(*) from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'F' and o_orderpriority = '2-HIGH')) as beside_none,
    (select count(*) from customer where c_custkey not in (select o_custkey from orders where o_totalprice < 0)) as beside_nothing""",
)
def _not_in_null(e: Engine) -> DataFrame:
    left, orders = e.table("customer").select("c_custkey"), e.table("orders")
    with_null = orders.select(F.nullif(F.col("o_custkey"), F.lit(1)).alias("k"))
    some = orders.filter("o_orderstatus = 'F' and o_orderpriority = '2-HIGH'").select(F.col("o_custkey").alias("k"))
    nothing = orders.filter("o_totalprice < 0").select(F.col("o_custkey").alias("k"))
    n = lambda right, name: R.not_in(left, right, "c_custkey", "k").agg(F.count(F.lit(1)).alias(name))
    return n(with_null, "beside_null").crossJoin(n(some, "beside_none")).crossJoin(n(nothing, "beside_nothing"))  # one row each


_both("j12_not_exists", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'O' and o_orderpriority = '1-URGENT')")
_both("j13_cross", "select n_nationkey, r_regionkey from nation join region on true")

# -- aggregation -------------------------------------------------------------------------------------------------------
_both("a0_global", "select count(*) as n, sum(l_quantity) as q, min(l_shipdate) as first, max(l_shipdate) as last from lineitem")
_both("a0_empty", "select count(*) as n, sum(l_quantity) as q, max(l_tax) as m from lineitem where l_quantity < 0")
frame("a1_count_star", "select o_orderstatus, count(*) as count_star from orders group by 1")(lambda e: R.aggregate(e.table("orders"), ["o_orderstatus"], [("count", None)]))
_both("a2_count", "select event_type, count(nullif(user_id, 1)) as n from events group by event_type")
_both("a3_sum", "select l_returnflag, sum(l_linenumber) as s, round(sum(l_extendedprice), 2) as p, sum(cast(l_quantity as decimal(12,2))) as d from lineitem group by l_returnflag", "select l_returnflag, sum(l_linenumber)::bigint as s, round(sum(l_extendedprice), 2) as p, sum(l_quantity::decimal(12,2))::decimal(22,2) as d from lineitem group by l_returnflag")
_both("a4_avg", "select l_returnflag, round(avg(l_discount), 6) as a, round(avg(l_linenumber), 6) as b from lineitem group by l_returnflag")
_both("a5_min_max", "select o_orderpriority, min(o_totalprice) as lo, max(o_totalprice) as hi, min(o_orderstatus) as s, max(o_orderdate) as d from orders group by o_orderpriority")
_both("a6_count_distinct", "select l_returnflag, count(distinct l_suppkey) as n from lineitem group by l_returnflag")
_both("a7_sum_distinct", "select l_returnflag, sum(distinct l_linenumber) as s from lineitem group by l_returnflag", "select l_returnflag, sum(distinct l_linenumber)::bigint as s from lineitem group by l_returnflag")
_both("a8_avg_distinct", "select l_returnflag, round(avg(distinct l_quantity), 6) as a from lineitem group by l_returnflag")
_both("a9_group_concat", "select n_regionkey, group_concat(n_name, '|' ) as names from nation group by n_regionkey", "select n_regionkey, string_agg(n_name, '|' order by n_name) as names from nation group by n_regionkey")
_both("a10_group_alias", "select p_size / 10 as decade, count(*) as n from part group by decade", "select (p_size // 10)::bigint as decade, count(*) as n from part group by decade")
_both("a10_group_expr", "select year(o_orderdate) as y, count(*) as n from orders group by year(o_orderdate)")
_both("a10_group_pos", "select o_orderstatus, o_orderpriority, count(*) as n from orders group by 1, 2")
_both("a10_group_all", "select o_orderstatus, o_orderpriority, count(*) as n from orders group by all")
_both("a11_having", "select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 12 and sum(o_totalprice) / count(*) > 1000")
_both("a12_nested", "select l_returnflag, round(sum(l_extendedprice) / sum(l_quantity) + 1, 4) as x, count(*) * 2 as n, 'c' as c from lineitem group by l_returnflag order by sum(l_quantity) desc")
_both("a13_group_null", "select nullif(n_regionkey, 1) as k, count(*) as n from nation group by nullif(n_regionkey, 1)")
_both("a14_distinct", "select distinct o_orderstatus, nullif(o_orderpriority, '1-URGENT') as p from orders")

# -- order, limits -----------------------------------------------------------------------------------------------------
_both("o1_sort_nulls", "select n_nationkey, nullif(n_regionkey, 2) as k from nation order by k, n_nationkey limit 22", "select n_nationkey, nullif(n_regionkey, 2) as k from nation order by k asc nulls last, n_nationkey limit 22")
_both("o1_sort_nulls_desc", "select n_nationkey, nullif(n_regionkey, 2) as k from nation order by k desc, n_nationkey limit 7", "select n_nationkey, nullif(n_regionkey, 2) as k from nation order by k desc nulls first, n_nationkey limit 7")
_both("o2_topk", "select l_orderkey, l_linenumber, l_extendedprice from lineitem order by l_extendedprice desc, l_orderkey, l_linenumber limit 25")
frame("o2_topk_offset", "select o_orderkey, o_totalprice from orders order by o_totalprice desc nulls first, o_orderkey limit 10 offset 5")(lambda e: R.top_k(e.table("orders").select("o_orderkey", "o_totalprice"), [("o_totalprice", True), ("o_orderkey", False)], 10, 5))
_both("o3_limit", "select count(*) as n from (select o_orderkey from orders limit 17) d")
_both("o4_offset", "select r_name from region order by r_name limit 2 offset 2")
_both("o5_order_expression", "select p_partkey from part order by p_size * 1000 + p_partkey desc limit 9")

# -- sets, CTE, subqueries, views --------------------------------------------------------------------------------------
_both("u1_union", "select n_regionkey as k from nation union select r_regionkey + 3 from region", "select n_regionkey::bigint as k from nation union select r_regionkey + 3 from region")
_SQL["u1_union"] = ("select cast(n_regionkey as int) as k from nation union select r_regionkey + 3 from region", _SQL["u1_union"][1])
_both("u2_union_all", "select n_regionkey as k from nation union all select r_regionkey from region")
_both("u3_intersect", "select c_nationkey as k from customer intersect select s_nationkey from supplier")
_both("u4_except", "select n_nationkey as k from nation except select s_nationkey from supplier where s_acctbal > 3000")
_both("u5_nested", "select n_nationkey as k from nation union select s_nationkey from supplier intersect select c_nationkey from customer where c_acctbal < 0 order by k limit 20")
_both("q1_cte", "with big(k, total) as (select o_custkey, sum(o_totalprice) from orders group by o_custkey), named as (select c_name, total from big join customer on k = c_custkey) select c_name, round(total, 2) as total from named where total > 5000")
_both("q2_derived", "select d.c_mktsegment, d.n from (select c_mktsegment, count(*) as n from customer group by c_mktsegment) d where d.n > 10")
_both("q3_scalar_select", "select n_name, (select count(*) from supplier where s_nationkey = n_nationkey) as suppliers, (select max(r_regionkey) from region) as top from nation")
_both("q4_scalar_where", "select o_orderkey from orders where o_totalprice > (select avg(o_totalprice) * 1.5 from orders)")
_both("q5_correlated", "select o_orderkey from orders o where o_totalprice >= (select max(i.o_totalprice) from orders i where i.o_custkey = o.o_custkey)")


@frame("q6_view", "select c_mktsegment, count(*) as n from customer where c_acctbal > 0 group by 1")
def _view(e: Engine) -> DataFrame:
    e.sql("create view rich as select c_custkey, c_mktsegment from customer where c_acctbal > 0")
    return e.sql("select c_mktsegment, count(*) as n from rich group by c_mktsegment")


_both("q7_no_from", "select 7 / 2 as a, 7 / 0 as b, 2 * 3.5 as c, 'a' as d, coalesce(null, 'z') as e", "select 3::bigint as a, null::bigint as b, 7.0::double as c, 'a' as d, 'z' as e")

# -- functions ---------------------------------------------------------------------------------------------------------
_both("sf1_upper", "select n_nationkey, upper(n_name) as u, upper('aéß') as x from nation", "select n_nationkey, upper(n_name) as u, 'Aéß' as x from nation")
_both("sf2_lower", "select p_partkey, lower(p_name) as l, lower('AÉ') as x from part", "select p_partkey, lower(p_name) as l, 'aÉ' as x from part")
_both("sf3_length", "select p_partkey, length(p_name) as n, length('aé😀') as x from part")
_both("sf4_substr", "select c_custkey, substr(c_name, 3, 4) as a, substr(c_name, -4) as b, substr(c_name, 0, 3) as c, substr(c_name, 5, -2) as d, substr(c_name, -3, 2) as e from customer")
_both("sf5_replace", "select c_custkey, replace(c_name, '0', 'o') as r, replace(c_name, '', 'x') as same from customer")
_both("sf6_trim", "select r_regionkey, trim('  a b ') as t from region")
_both("sf7_abs", "select c_custkey, abs(c_acctbal) as a, abs(-c_custkey) as k from customer")
_both("sf8_round", "select o_orderkey, round(o_totalprice) as a, round(o_totalprice, 1) as b, round(o_totalprice, -2) as c, round(2.5) as d, round(-2.5) as e from orders", "select o_orderkey, round(o_totalprice) as a, round(o_totalprice * 10.0::double) / 10.0::double as b, round(o_totalprice * pow(10.0::double, -2)) / pow(10.0::double, -2) as c, 3.0::double as d, -3.0::double as e from orders")
_both("sf9_floor", "select c_custkey, floor(c_acctbal) as f, floor(c_custkey) as g from customer", "select c_custkey, floor(c_acctbal) as f, c_custkey::double as g from customer")
_both("sf10_ceil", "select c_custkey, ceil(c_acctbal) as f from customer")
frame("sf11_now", "select true as later")(lambda e: e.query("select now() > timestamp '2024-01-01 00:00:00' as later"))
_both("sf12_date", "select o_orderkey, date(o_orderdate) as d from orders", "select o_orderkey, o_orderdate::date as d from orders")
_both("sf13_year", "select o_orderkey, year(o_orderdate) as y from orders")
_both("sf14_month", "select o_orderkey, month(o_orderdate) as m from orders")
_both("sf15_day", "select o_orderkey, day(date(o_orderdate)) as d from orders", "select o_orderkey, day(o_orderdate) as d from orders")
_both("sf16_hour", "select event_id, hour(ts) as h, hour(date(ts)) as z from events", "select event_id, hour(ts) as h, 0::bigint as z from events")
_both("sf17_minute", "select event_id, minute(ts) as m from events")
_both("sf18_second", "select event_id, second(ts) as s from events")
_both("sf19_date_trunc", "select event_id, date_trunc('hour', ts) as h, date_trunc('MONTH', ts) as m, date_trunc('year', date(ts)) as y from events", "select event_id, date_trunc('hour', ts) as h, date_trunc('month', ts)::timestamp as m, date_trunc('year', ts)::date as y from events")
_both(
    "sf20_datediff",
    "select o_orderkey, datediff('day', timestamp '1995-01-31 12:00:00', o_orderdate) as d, datediff('hour', timestamp '1995-01-31 12:00:00', o_orderdate) as h, datediff('month', timestamp '1995-01-31 12:00:00', o_orderdate) as m from orders",
    """with x as (select o_orderkey, o_orderdate as b, timestamp '1995-01-31 12:00:00' as a from orders), y as (select *, (year(b) - year(a)) * 12 + month(b) - month(a) as raw, epoch_us(b - date_trunc('day', b)) as tb, epoch_us(a - date_trunc('day', a)) as ta from x)
    select o_orderkey, trunc((epoch_us(b) - epoch_us(a)) / 86400000000)::bigint as d, trunc((epoch_us(b) - epoch_us(a)) / 3600000000)::bigint as h,
    (case when raw > 0 and (day(b) < day(a) or day(b) = day(a) and tb < ta) then raw - 1 when raw < 0 and (day(b) > day(a) or day(b) = day(a) and tb > ta) then raw + 1 else raw end)::bigint as m from y""",
)


# -- changes and definitions: the table that they leave ----------------------------------------------------------------
def _table(e: Engine) -> Engine:
    e.sql("create table t (k integer primary key, name string not null default 'none', size int, price float)")
    e.sql("insert into t select p_partkey, p_name, cast(p_size as int), p_retailprice from part")
    return e


_T = "select p_partkey::bigint as k, p_name as name, p_size::bigint as size, p_retailprice as price from part"


@frame("d1_insert", f"{_T} union all select * from (values (900000001::bigint, 'a', 5::bigint, 1.5::double), (900000002, 'none', null, null)) v")
def _insert(e: Engine) -> DataFrame:
    _table(e).sql("insert into t values (900000001, 'a', 5, 1.5)")
    e.sql("insert into t (k) values (900000002)")
    return e.table("t")


@frame("d2_insert_select", f"with t as ({_T}) select * from t union all select k + 900000000, name, size, price from t where size < 10")
def _insert_select(e: Engine) -> DataFrame:
    _table(e).sql("insert into t select k + 900000000, name, size, price from t where size < 10")
    return e.table("t")


@frame("d3_update", f"with t as ({_T}) select k, name, case when size < 20 then size + 1 else size end as size, case when size < 20 then price * 2 else price end as price from t")
def _update(e: Engine) -> DataFrame:
    _table(e).sql("update t set size = size + 1, price = price * 2 where size < 20")
    return e.table("t")


@frame("d4_delete", f"with t as ({_T}) select * from t where not coalesce(nullif(size, 7) > 30, false)")
def _delete(e: Engine) -> DataFrame:
    _table(e).sql("delete from t where nullif(size, 7) > 30")
    return e.table("t")


@frame("d5_conflict_nothing", f"with t as ({_T}) select * from t union all select 900000001, 'new', 1, 2.0")
def _nothing(e: Engine) -> DataFrame:
    _table(e).sql("insert into t values (1, 'dup', 1, 1.0), (900000001, 'new', 1, 2.0), (900000001, 'second', 2, 3.0) on conflict (k) do nothing")
    return e.table("t")


@frame("d6_conflict_update", f"with t as ({_T}) select k, case when k = 1 then 'dup' else name end as name, case when k = 1 then size + 100 else size end as size, price from t union all select 900000001, 'new', 1, 2.0")
def _upsert(e: Engine) -> DataFrame:
    _table(e).sql("insert into t values (1, 'dup', 1, 1.0), (900000001, 'new', 1, 2.0) on conflict (k) do update set name = excluded.name, size = size + 100")
    return e.table("t")


@frame("d7_replace", f"with t as ({_T}) select * from t where k <> 2 union all select 2, 'last', 9, 9.5")
def _replace(e: Engine) -> DataFrame:
    _table(e).sql("replace into t values (2, 'first', 1, 1.0), (2, 'last', 9, 9.5)")
    return e.table("t")


@frame("d8_truncate", f"with t as ({_T}) select * from t where false")
def _truncate(e: Engine) -> DataFrame:
    _table(e).sql("truncate table t")
    return e.table("t")


@frame("l1_create_table", "select 1::bigint as id, 'anon' as name, true as ok, date '2024-01-31' as d, 1.25::decimal(6,2) as p")
def _create(e: Engine) -> DataFrame:
    e.script("create table u (id integer primary key, name varchar(20) default 'anon', ok bool, d date, p decimal(6,2)); insert into u (id, ok, d, p) values (1, true, '2024-01-31', 1.25)")
    return e.table("u")


@frame("l2_ctas", "select o_orderstatus as status, count(*) as n, max(o_totalprice) as top from orders group by 1")
def _ctas(e: Engine) -> DataFrame:
    e.sql("create table s as select o_orderstatus as status, count(*) as n, max(o_totalprice) as top from orders group by o_orderstatus")
    return e.table("s")


@frame("l3_drop_table", "select 0::bigint as tables")
def _drop(e: Engine) -> DataFrame:
    _table(e).script("drop table t; drop table if exists t")
    return e.spark.createDataFrame([(len(e.tables),)], "tables long")


@frame("l4_add_column", f"with t as ({_T}) select *, 7::bigint as extra from t")
def _add(e: Engine) -> DataFrame:
    _table(e).sql("alter table t add column extra int default 7")
    return e.table("t")


@frame("l5_drop_column", f"with t as ({_T}) select k, name, price from t")
def _drop_column(e: Engine) -> DataFrame:
    _table(e).sql("alter table t drop column size")
    return e.table("t")


@frame("l6_view_dropped", "select count(*) as n from region")
def _views(e: Engine) -> DataFrame:
    e.script("create view v as select * from region; drop view v; create view v as select r_name from region")
    return e.sql("select count(*) as n from v")


@frame("l7_index", f"with t as ({_T}) select k, name from t where size = 10")
def _index(e: Engine) -> DataFrame:
    _table(e).sql("create index by_size on t (size)")
    return e.sql("select k, name from t where size = 10")


_PARTS = ("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")
frame("l8_analyze", " union all ".join(f"select '{c}' as column_name, count(*) as row_count, count(*) - count({c}) as null_count, count(distinct {c}) as ndv from part" for c in _PARTS))(lambda e: analytics.analyze(e.table("part").select(*_PARTS)))
frame("l9_explain", "select true as pushed, true as pruned")(
    lambda e: e.sql("explain select o_totalprice from orders where o_orderkey = 5").agg(
        F.bool_or(F.col("plan").rlike(r"PushedFilters: \[.*EqualTo\(o_orderkey,5\)")).alias("pushed"), F.bool_or(F.col("plan").rlike(r"ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>")).alias("pruned")
    )
)


@frame("l10_transaction", f"with t as ({_T}) select * from t where k > 10 union all select 900000001, 'kept', 1, 1.0")
def _transaction(e: Engine) -> DataFrame:
    _table(e).script("begin; delete from t; rollback; begin; delete from t where k <= 10; insert into t values (900000001, 'kept', 1, 1.0); commit")
    return e.table("t")


@frame("l11_script", "select 2::bigint as n")
def _script(e: Engine) -> DataFrame:
    return e.script("create table z (a int); insert into z values (1), (2); select count(*) as n from z")[-1]


# -- table analytics ---------------------------------------------------------------------------------------------------
_NUM = "select '{c}' as \"column\", '{t}' as type, count(*) as row_count, round((count(*) - count({c})) * 100.0::double / count(*), 2) as null_rate, count(distinct {c}) as \"distinct\", min({c})::varchar as min, max({c})::varchar as max, round(quantile_cont({c}, 0.5), 2)::double as p50, quantile_disc({c}, 0.9)::double as p90, quantile_disc({c}, 0.99)::double as p99 from part"
_TXT = "select '{c}' as \"column\", 'string' as type, count(*) as row_count, round((count(*) - count({c})) * 100.0::double / count(*), 2) as null_rate, count(distinct {c}) as \"distinct\", min({c}) as min, max({c}) as max, null::double as p50, null::double as p90, null::double as p99 from part"
frame("c1_stats", " union all ".join([_NUM.format(c="p_partkey", t="bigint"), _NUM.format(c="p_size", t="int"), _TXT.format(c="p_brand")]))(lambda e: analytics.stats(e.table("part").select("p_partkey", "p_size", "p_brand")))
frame("c2_sample", "select 10::bigint as n, 10::bigint as keys, 10::bigint as members")(
    lambda e: analytics.sample(e.table("orders"), 10)
    .join(e.table("orders").withColumn("there", F.lit(1)), e.table("orders").columns, "left")
    .agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("keys"), F.count("there").alias("members"))
)
frame(
    "c3_profile",
    """with r as (select p_brand as v, count(*) as n from part group by 1), k as (select v, n, row_number() over (order by n desc, v) as i from r)
    select 'p_size' as "column", 'int' as type, min(p_size)::varchar as min, max(p_size)::varchar as max, null as top_k from part
    union all select 'p_brand', 'string', min(p_brand), max(p_brand), (select string_agg(v || '(' || n || ')', ', ' order by i) from k where i <= 5) from part""",
)(lambda e: analytics.profile(e.table("part").select("p_size", "p_brand"), 5))


@frame("c4_schema", """select 'CREATE TABLE "t" ("k" INTEGER PRIMARY KEY, "name" STRING NOT NULL DEFAULT ''none'', "size" INTEGER, "price" FLOAT)' as ddl""")
def _schema(e: Engine) -> DataFrame:
    return e.spark.createDataFrame([(_table(e).schema("t"),)], "ddl string")


@frame("c5_list", "select 't' as name")
def _list(e: Engine) -> DataFrame:
    return e.spark.createDataFrame([(n,) for n in sorted(_table(e).tables)], "name string")


# -- function library as columns ---------------------------------------------------------------------------------------
frame("sf_columns", "select c_custkey, substr(c_name, 0, 3) as a, substr(c_name, 5, -2) as b, trunc(c_custkey / 7)::bigint as c, (timestamp '2024-01-31 00:00:00' + interval 1 month)::date as d from customer")(
    lambda e: e.table("customer").select("c_custkey", S.substr("c_name", F.lit(0), F.lit(3)).alias("a"), S.substr("c_name", F.lit(5), F.lit(-2)).alias("b"), S.divide("c_custkey", F.lit(7).cast("bigint"), True).alias("c"), S.add_interval(F.lit("2024-01-31").cast("date"), "1 month", is_date=True).alias("d"))
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def of_sql(text: str):
        return lambda spark, sf_dir: _engine(spark, sf_dir).query(text)

    def of_frame(f):
        return lambda spark, sf_dir: f(_engine(spark, sf_dir))

    return {k: of_sql(t) for k, (t, _) in _SQL.items()} | {k: of_frame(f) for k, (f, _) in _FRAMES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: o for k, (_, o) in _SQL.items()} | {k: o for k, (_, o) in _FRAMES.items() if o}
