"""The catalogue of queries: one or more for every verb and function, with the same in SQL.

Every query reads whole tables from a folder of Parquet files.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import millrace as m
from millrace import Relation, Window, const, get

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


class _Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> Relation:
        return Relation(self._spark.read.parquet(f"{self._folder}/{name}.parquet"))


def query(sql: str | None) -> Callable[[Callable[[_Tables], Relation]], Callable[[_Tables], Relation]]:
    def register(make: Callable[[_Tables], Relation]) -> Callable[[_Tables], Relation]:
        QUERIES[make.__name__] = lambda spark, folder: make(_Tables(spark, folder)).df
        if sql is not None:
            ORACLE[make.__name__] = sql
        return make

    return register


def _r(x, digits: int = 4):
    return F.round(x, digits)


# Aggregation


@query("""
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
       round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL
""")
def pricing_summary(t: _Tables) -> Relation:
    return (
        t.lineitem
        >> m.sift(lambda r: r.l_shipdate <= F.lit(datetime.datetime(1998, 9, 2)).cast("timestamp_ntz"))
        >> m.group_by(l_returnflag=get("l_returnflag"), l_linestatus=get("l_linestatus"))
        >> m.aggregate(
            sum_qty=m.sum(get("l_quantity")),
            sum_disc_price=m.sum(lambda r: r.l_extendedprice * (1 - r.l_discount)),
            avg_price=m.mean(get("l_extendedprice")),
            avg_disc=m.mean(get("l_discount")),
            n=m.count(const(1)),
        )
        >> m.mutate(
            sum_qty=lambda r: _r(r.sum_qty, 2),
            sum_disc_price=lambda r: _r(r.sum_disc_price, 2),
            avg_price=lambda r: _r(r.avg_price),
            avg_disc=lambda r: _r(r.avg_disc, 6),
        )
    )


@query("SELECT p_brand, sum(p_size)::BIGINT AS total_size, count(p_type) AS n FROM part GROUP BY p_brand")
def agg_sum_count(t: _Tables) -> Relation:
    return (
        t.part
        >> m.group_by(p_brand=get("p_brand"))
        >> m.aggregate(total_size=m.sum(get("p_size")), n=m.count(get("p_type")))
    )


@query("""
SELECT l_returnflag, round(covar_samp(l_quantity, l_extendedprice), 3) AS cs, round(covar_pop(l_quantity, l_extendedprice), 3) AS cp,
       round(var_samp(l_quantity), 5) AS vs, round(var_pop(l_quantity), 5) AS vp,
       round(stddev_samp(l_quantity), 6) AS ss, round(stddev_pop(l_quantity), 6) AS sp
FROM lineitem GROUP BY l_returnflag
""")
def agg_covariance(t: _Tables) -> Relation:
    q, p = get("l_quantity"), get("l_extendedprice")
    return (
        t.lineitem
        >> m.group_by(l_returnflag=get("l_returnflag"))
        >> m.aggregate(cs=m.cov_samp(q, p), cp=m.cov_pop(q, p), vs=m.var_samp(q), vp=m.var_pop(q), ss=m.stdev_samp(q), sp=m.stdev_pop(q))
        >> m.mutate(
            cs=lambda r: _r(r.cs, 3),
            cp=lambda r: _r(r.cp, 3),
            vs=lambda r: _r(r.vs, 5),
            vp=lambda r: _r(r.vp, 5),
            ss=lambda r: _r(r.ss, 6),
            sp=lambda r: _r(r.sp, 6),
        )
    )


@query("""
SELECT o_orderpriority, round(sum(CASE WHEN o_totalprice < 0 THEN o_totalprice END), 2) AS s,
       round(coalesce(sum(CASE WHEN o_totalprice < 0 THEN o_totalprice END), 0), 2) AS t
FROM orders GROUP BY o_orderpriority
""")
def agg_total_vs_sum(t: _Tables) -> Relation:
    none = lambda r: F.when(r.o_totalprice < 0, r.o_totalprice)
    return (
        t.orders
        >> m.group_by(o_orderpriority=get("o_orderpriority"))
        >> m.aggregate(s=m.sum(none), t=m.total(none))
        >> m.mutate(s=lambda r: _r(r.s, 2), t=lambda r: _r(r.t, 2))
    )


@query("SELECT o_orderstatus, min(o_orderdate) AS lo, max(o_orderdate) AS hi, min(o_orderpriority) AS p FROM orders GROUP BY o_orderstatus")
def agg_min_max(t: _Tables) -> Relation:
    return (
        t.orders
        >> m.group_by(o_orderstatus=get("o_orderstatus"))
        >> m.aggregate(lo=m.min(get("o_orderdate")), hi=m.max(get("o_orderdate")), p=m.min(get("o_orderpriority")))
    )


@query("SELECT count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders")
def agg_global(t: _Tables) -> Relation:
    return t.orders >> m.aggregate(n=m.count(const(1)), mean=m.mean(get("o_totalprice"))) >> m.mutate(mean=lambda r: _r(r["mean"]))


@query("SELECT count(*) AS n, sum(event_id)::BIGINT AS s FROM events WHERE value < -1e300")
def agg_empty_input(t: _Tables) -> Relation:
    return t.events >> m.sift(lambda r: r.value < -1e300) >> m.aggregate(n=m.count(const(1)), s=m.sum(get("event_id")))


@query("SELECT DISTINCT c_mktsegment AS segment, c_acctbal > 0 AS positive FROM customer")
def group_distinct(t: _Tables) -> Relation:
    return t.customer >> m.group_by(segment=get("c_mktsegment"), positive=lambda r: r.c_acctbal > 0) >> m.aggregate()


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 10")
def group_having(t: _Tables) -> Relation:
    return (
        t.orders >> m.group_by(o_custkey=get("o_custkey")) >> m.aggregate(n=m.count(const(1))) >> m.sift(lambda r: r.n > 10)
    )


@query("""
SELECT CASE WHEN user_id % 5 = 0 THEN NULL ELSE user_id % 5 END AS k, count(*) AS n, count(CASE WHEN value > 50 THEN 1 END) AS big
FROM events GROUP BY 1
""")
def group_null_key(t: _Tables) -> Relation:
    return (
        t.events
        >> m.group_by(k=lambda r: F.when(r.user_id % 5 != 0, r.user_id % 5))
        >> m.aggregate(n=m.count(const(1)), big=m.count(lambda r: F.when(r.value > 50, 1)))
    )


@query("SELECT count(*) AS users FROM (SELECT DISTINCT user_id FROM events)")
def count_distinct(t: _Tables) -> Relation:
    return t.events >> m.group_by(user_id=get("user_id")) >> m.aggregate() >> m.aggregate(users=m.count(get("user_id")))


@query("SELECT event_type, round(sum(value * value), 2) AS energy FROM events GROUP BY event_type")
def agg_custom(t: _Tables) -> Relation:
    def energy(x):
        return F.sum(x * x)

    return (
        t.events
        >> m.group_by(event_type=get("event_type"))
        >> m.aggregate(energy=m.custom(energy, get("value")))
        >> m.mutate(energy=lambda r: _r(r.energy, 2))
    )


@query("SELECT p_brand, round(max(p_retailprice) - min(p_retailprice), 4) AS spread FROM part GROUP BY p_brand")
def agg_custom_pandas(t: _Tables) -> Relation:
    @F.pandas_udf("double")
    def spread(x: pd.Series) -> float:
        return float(x.max() - x.min())

    return (
        t.part
        >> m.group_by(p_brand=get("p_brand"))
        >> m.aggregate(spread=m.custom(spread, get("p_retailprice")))
        >> m.mutate(spread=lambda r: _r(r.spread))
    )


@query("SELECT l_returnflag, round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 4) AS price FROM lineitem GROUP BY l_returnflag")
def agg_custom_binary(t: _Tables) -> Relation:
    def weighted(x, w):
        return F.sum(x * w) / F.sum(w)

    return (
        t.lineitem
        >> m.group_by(l_returnflag=get("l_returnflag"))
        >> m.aggregate(price=m.custom(weighted, get("l_extendedprice"), get("l_quantity")))
        >> m.mutate(price=lambda r: _r(r.price))
    )


class _Spread:
    """The distance between the sums of two columns, a row at a time."""

    def __init__(self) -> None:
        self.sum = 0.0

    def step(self, x: float | None, y: float | None) -> None:
        if x is not None and y is not None:
            self.sum += x - y

    def finalize(self) -> float:
        return self.sum


@query("SELECT p_brand, round(sum(p_retailprice - p_size), 4) AS spread FROM part GROUP BY p_brand")
def agg_stepwise_binary(t: _Tables) -> Relation:
    return (
        t.part
        >> m.group_by(p_brand=get("p_brand"))
        >> m.aggregate(spread=m.stepwise(_Spread, get("p_retailprice"), get("p_size")))
        >> m.mutate(spread=lambda r: _r(r.spread))
    )


# Projection, selection, order


@query("""
SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net, upper(l_returnflag) AS flag
FROM lineitem WHERE l_quantity > 45 AND l_discount >= 0.05
""")
def select_sift(t: _Tables) -> Relation:
    return (
        t.lineitem
        >> m.sift(lambda r: (r.l_quantity > 45) & (r.l_discount >= 0.05))
        >> m.select(
            l_orderkey=get("l_orderkey"),
            l_linenumber=get("l_linenumber"),
            net=lambda r: _r(r.l_extendedprice * (1 - r.l_discount)),
            flag=lambda r: F.upper(r.l_returnflag),
        )
    )


@query("SELECT c_custkey, lower(c_name) AS c_name, c_nationkey, c_acctbal, c_mktsegment, c_acctbal > 0 AS positive FROM customer")
def mutate_replace(t: _Tables) -> Relation:
    return t.customer >> m.mutate(c_name=lambda r: F.lower(r.c_name), positive=lambda r: r.c_acctbal > 0)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
def order_limit_offset(t: _Tables) -> Relation:
    return (
        t.orders
        >> m.order_by(m.desc(get("o_totalprice")), get("o_orderkey"))
        >> m.limit(20, offset=5)
        >> m.select(o_orderkey=get("o_orderkey"), o_totalprice=get("o_totalprice"))
    )


@query("""
SELECT event_id, CASE WHEN value > 60 THEN value END AS v FROM events
ORDER BY CASE WHEN value > 60 THEN value END ASC NULLS LAST, event_id LIMIT 50
""")
def order_nulls_last(t: _Tables) -> Relation:
    return (
        t.events
        >> m.select(event_id=get("event_id"), v=lambda r: F.when(r.value > 60, r.value))
        >> m.order_by(get("v"), get("event_id"), nulls=m.Nulls.LAST)
        >> m.limit(50)
    )


# Joins


@query("""
SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 300000
""")
def join_inner(t: _Tables) -> Relation:
    orders = t.orders >> m.sift(lambda r: r.o_totalprice > 300000)
    return (
        t.customer
        >> m.inner_join(orders, lambda c, o: c.c_custkey == o.o_custkey)
        >> m.select(c_custkey=get("c_custkey"), c_name=get("c_name"), o_orderkey=get("o_orderkey"), o_totalprice=get("o_totalprice"))
    )


@query("SELECT n_name, r_name FROM nation CROSS JOIN region")
def join_cross(t: _Tables) -> Relation:
    return t.nation >> m.cross_join(t.region) >> m.select(n_name=lambda r: r.left.n_name, r_name=lambda r: r.right.r_name)


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey < r_regionkey")
def join_inner_theta(t: _Tables) -> Relation:
    return (
        t.nation
        >> m.inner_join(t.region, lambda n, r: n.n_regionkey < r.r_regionkey)
        >> m.select(n_name=get("n_name"), r_name=get("r_name"))
    )


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'")
def join_left(t: _Tables) -> Relation:
    return (
        t.customer
        >> m.left_join(t.orders, lambda c, o: (c.c_custkey == o.o_custkey) & (o.o_orderstatus == "P"))
        >> m.select(c_custkey=get("c_custkey"), o_orderkey=get("o_orderkey"))
    )


@query("SELECT n_name, r_name FROM nation LEFT JOIN region ON n_nationkey < r_regionkey")
def join_left_theta(t: _Tables) -> Relation:
    return (
        t.nation
        >> m.left_join(t.region, lambda n, r: n.n_nationkey < r.r_regionkey)
        >> m.select(n_name=get("n_name"), r_name=get("r_name"))
    )


@query("SELECT s_suppkey, n_name FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 5000")
def join_right(t: _Tables) -> Relation:
    return (
        t.supplier
        >> m.right_join(t.nation, lambda s, n: (s.s_nationkey == n.n_nationkey) & (s.s_acctbal > 5000))
        >> m.select(s_suppkey=get("s_suppkey"), n_name=get("n_name"))
    )


@query("SELECT c_custkey, s_suppkey FROM customer FULL JOIN supplier ON c_custkey = s_suppkey * 17")
def join_full(t: _Tables) -> Relation:
    return (
        t.customer
        >> m.full_join(t.supplier, lambda c, s: c.c_custkey == s.s_suppkey * 17)
        >> m.select(c_custkey=get("c_custkey"), s_suppkey=get("s_suppkey"))
    )


@query("SELECT n_name, r_name FROM nation FULL JOIN region ON n_nationkey < r_regionkey")
def join_full_theta(t: _Tables) -> Relation:
    return (
        t.nation
        >> m.full_join(t.region, lambda n, r: n.n_nationkey < r.r_regionkey)
        >> m.select(n_name=get("n_name"), r_name=get("r_name"))
    )


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
def join_semi(t: _Tables) -> Relation:
    return (
        t.customer
        >> m.semi_join(t.orders, lambda c, o: (o.o_custkey == c.c_custkey) & (o.o_totalprice > 250000))
        >> m.select(c_custkey=get("c_custkey"), c_name=get("c_name"))
    )


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def join_anti(t: _Tables) -> Relation:
    return t.customer >> m.anti_join(t.orders, lambda c, o: (o.o_custkey == c.c_custkey) & (o.o_totalprice > 400000)) >> m.select(c_custkey=get("c_custkey"))


@query("""
SELECT a.n_name AS one, b.n_name AS other, r_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey
JOIN region ON b.n_regionkey = r_regionkey
""")
def join_nested_self(t: _Tables) -> Relation:
    return (
        t.nation
        >> m.inner_join(t.nation, lambda a, b: (a.n_regionkey == b.n_regionkey) & (a.n_nationkey < b.n_nationkey))
        >> m.inner_join(t.region, lambda ab, r: ab.right.n_regionkey == r.r_regionkey)
        >> m.select(one=lambda r: r.left.left.n_name, other=lambda r: r.left.right.n_name, r_name=lambda r: r.right.r_name)
    )


@query("""
SELECT a.event_id, b.event_id AS other FROM events a JOIN events b
ON (CASE WHEN a.event_id % 40 = 0 THEN NULL ELSE a.event_id END) IS NOT DISTINCT FROM (CASE WHEN b.event_id % 400 = 0 THEN NULL ELSE b.event_id END)
WHERE a.user_id = b.user_id
""")
def join_null_safe(t: _Tables) -> Relation:
    key = lambda r, n: F.when(r.event_id % n != 0, r.event_id)
    return (
        t.events
        >> m.inner_join(t.events, lambda a, b: m.same(key(a, 40), key(b, 400)) & (a.user_id == b.user_id))
        >> m.select(event_id=lambda r: r.left.event_id, other=lambda r: r.right.event_id)
    )


# Set operations


def _keys(t: _Tables) -> tuple[Relation, Relation]:
    return t.customer >> m.select(k=get("c_nationkey")), t.supplier >> m.select(k=get("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(t: _Tables) -> Relation:
    a, b = _keys(t)
    return a >> m.union(b)


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def set_union_all(t: _Tables) -> Relation:
    a, b = _keys(t)
    return a >> m.union_all(b)


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(t: _Tables) -> Relation:
    a, b = _keys(t)
    return a >> m.intersect(b)


@query("WITH i AS (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) SELECT k FROM i UNION ALL SELECT k FROM i")
def set_intersect_all(t: _Tables) -> Relation:
    a, b = _keys(t)
    return a >> m.intersect_all(b)


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 400000")
def set_difference(t: _Tables) -> Relation:
    dear = t.orders >> m.sift(lambda r: r.o_totalprice > 400000) >> m.select(k=get("o_custkey"))
    return (t.customer >> m.select(k=get("c_custkey"))) >> m.difference(dear)


@query("""
WITH o AS (SELECT CASE WHEN o_custkey % 7 <> 0 THEN o_custkey END AS k FROM orders)
SELECT k FROM o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE (CASE WHEN c_custkey % 3 <> 0 THEN c_custkey END) IS NOT DISTINCT FROM o.k)
""")
def set_difference_all(t: _Tables) -> Relation:
    a = t.orders >> m.select(k=lambda r: F.when(r.o_custkey % 7 != 0, r.o_custkey))
    return a >> m.difference_all(t.customer >> m.select(k=lambda r: F.when(r.c_custkey % 3 != 0, r.c_custkey)))


# Windows

_BY_USER = {"order_by": [get("ts"), get("event_id")], "partition_by": [get("user_id")]}
_W = "PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id NULLS FIRST"


@query(f"""
SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn,
       rank() OVER (PARTITION BY user_id ORDER BY event_type) - 1 AS rk, dense_rank() OVER (PARTITION BY user_id ORDER BY event_type) - 1 AS dr
FROM events -- {_W}
""")
def win_ranks(t: _Tables) -> Relation:
    by_type = Window.rows(order_by=[get("event_type")], partition_by=[get("user_id")])
    return t.events >> m.select(
        event_id=get("event_id"),
        rn=m.row_number() >> m.over(Window.rows(**_BY_USER)),
        rk=m.rank() >> m.over(by_type),
        dr=m.dense_rank() >> m.over(by_type),
    )


@query("""
SELECT event_id, rank() OVER (PARTITION BY user_id ORDER BY CASE WHEN value > 50 THEN event_type END NULLS FIRST) - 1 AS rk
FROM events
""")
def win_rank_nulls(t: _Tables) -> Relation:
    w = Window.range(order_by=[lambda r: F.when(r.value > 50, r.event_type)], partition_by=[get("user_id")])
    return t.events >> m.select(event_id=get("event_id"), rk=m.rank() >> m.over(w))


@query(f"""
SELECT event_id, lead(value) OVER w AS nxt, lag(value, 2, -1.0) OVER w AS back2 FROM events WINDOW w AS ({_W})
""")
def win_lead_lag(t: _Tables) -> Relation:
    w = m.over(Window.rows(**_BY_USER))
    return t.events >> m.select(
        event_id=get("event_id"), nxt=m.lead(get("value")) >> w, back2=m.lag(get("value"), const(2), const(-1.0)) >> w
    )


@query(f"""
SELECT event_id, round(sum(value) OVER (w ROWS UNBOUNDED PRECEDING), 4) AS running, count(*) OVER (w ROWS UNBOUNDED PRECEDING) AS n,
       round(avg(value) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING), 4) AS near
FROM events WINDOW w AS ({_W})
""")
def win_running(t: _Tables) -> Relation:
    running = m.over(Window.rows(**_BY_USER))
    near = m.over(Window.rows(**_BY_USER, preceding=const(3), following=const(1)))
    return (
        t.events
        >> m.select(event_id=get("event_id"), running=m.sum(get("value")) >> running, n=m.count(const(1)) >> running, near=m.mean(get("value")) >> near)
        >> m.mutate(running=lambda r: _r(r.running), near=lambda r: _r(r.near))
    )


@query("""
SELECT event_id, round(var_samp(value) OVER w, 4) AS vs, round(stddev_pop(value) OVER w, 4) AS sp, round(min(value) OVER w, 4) AS lo,
       round(max(value) OVER w, 4) AS hi, round(coalesce(sum(value) OVER w, 0), 3) AS total
FROM events WINDOW w AS (PARTITION BY user_id)
""")
def win_whole_partition(t: _Tables) -> Relation:
    w = m.over(Window.rows(partition_by=[get("user_id")]))
    v = get("value")
    return (
        t.events
        >> m.select(event_id=get("event_id"), vs=m.var_samp(v) >> w, sp=m.stdev_pop(v) >> w, lo=m.min(v) >> w, hi=m.max(v) >> w, total=m.total(v) >> w)
        >> m.mutate(vs=lambda r: _r(r.vs), sp=lambda r: _r(r.sp), lo=lambda r: _r(r.lo), hi=lambda r: _r(r.hi), total=lambda r: _r(r.total, 3))
    )


@query("""
SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderpriority ORDER BY o_custkey RANGE BETWEEN 5 PRECEDING AND 2 FOLLOWING) AS n
FROM orders
""")
def win_range_number(t: _Tables) -> Relation:
    w = Window.range(order_by=[get("o_custkey")], partition_by=[get("o_orderpriority")], preceding=const(5), following=const(2))
    return t.orders >> m.select(o_orderkey=get("o_orderkey"), n=m.count(const(1)) >> m.over(w))


@query("""
SELECT event_id, round(sum(value) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND INTERVAL 0 HOUR FOLLOWING), 4) AS hour
FROM events
""")
def win_range_time(t: _Tables) -> Relation:
    w = Window.range(
        order_by=[get("ts")],
        partition_by=[get("event_type")],
        preceding=const(datetime.timedelta(hours=1)),
        following=const(datetime.timedelta(0)),
    )
    return t.events >> m.select(event_id=get("event_id"), hour=m.sum(get("value")) >> m.over(w)) >> m.mutate(hour=lambda r: _r(r.hour))


@query(f"""
SELECT event_id, first_value(CASE WHEN value > 50 THEN value END IGNORE NULLS) OVER (w ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS f,
       last_value(CASE WHEN value > 50 THEN value END IGNORE NULLS) OVER (w ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS l,
       nth_value(value, 2) OVER (w ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS second
FROM events WINDOW w AS ({_W})
""")
def win_first_last_nth(t: _Tables) -> Relation:
    big = lambda r: F.when(r.value > 50, r.value)
    w = m.over(Window.rows(**_BY_USER, preceding=const(3), following=const(0)))
    around = m.over(Window.rows(**_BY_USER, preceding=const(3), following=const(3)))
    return t.events >> m.select(
        event_id=get("event_id"), f=m.first(big) >> w, l=m.last(big) >> w, second=m.nth(get("value"), const(1)) >> around
    )


@query("""
SELECT event_id, value - avg(value) OVER (PARTITION BY user_id) > 0 AS above FROM events
""")
def win_mutate(t: _Tables) -> Relation:
    # A sum of doubles depends on the order of its rows, which decides where a value equals the mean.  Values are therefore
    # summed as the decimals they print as; users with one that does not fit (17 places, below 1e10) keep the mean of doubles.
    w = m.over(Window.rows(partition_by=[get("user_id")]))
    decimal = lambda r: r.value.try_cast("decimal(27,17)")
    return (
        t.events
        >> m.mutate(exact=lambda r: F.when(decimal(r).cast("double") == r.value, decimal(r)))
        >> m.mutate(
            mean=m.mean(get("value")) >> w,
            total=m.sum(get("exact")) >> w,
            n=m.count(get("value")) >> w,
            fitting=m.count(get("exact")) >> w,
        )
        >> m.select(
            event_id=get("event_id"),
            above=lambda r: F.coalesce(
                F.when(r.fitting == r.n, r.exact * r.n.try_cast("decimal(10,0)") > r.total), r.value - r["mean"] > 0
            ),
        )
    )


@query("""
SELECT * FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) - 1 AS k FROM events) WHERE k < 3
""")
def win_top_k(t: _Tables) -> Relation:
    w = Window.rows(order_by=[m.desc(get("value")), get("event_id")], partition_by=[get("event_type")])
    return (
        t.events
        >> m.select(event_type=get("event_type"), event_id=get("event_id"), k=m.row_number() >> m.over(w))
        >> m.sift(lambda r: r.k < 3)
    )


# Offsets and bounds that differ from row to row


@query(f"SELECT event_id, lag(value, (event_id % 3)::BIGINT, 0.0) OVER ({_W}) AS v FROM events")
def dyn_lag(t: _Tables) -> Relation:
    w = m.over(Window.rows(**_BY_USER))
    return t.events >> m.select(event_id=get("event_id"), v=m.lag(get("value"), lambda r: r.event_id % 3, const(0.0)) >> w)


@query(f"SELECT event_id, lead(value, (event_id % 4)::BIGINT, value * 2) OVER ({_W}) AS v FROM events")
def dyn_lead_default(t: _Tables) -> Relation:
    w = m.over(Window.rows(**_BY_USER))
    return t.events >> m.select(event_id=get("event_id"), v=m.lead(get("value"), lambda r: r.event_id % 4, lambda r: r.value * 2) >> w)


@query(f"""
SELECT event_id, round(sum(value) OVER w, 4) AS s, count(*) OVER w AS n, max(value) OVER w AS hi
FROM events WINDOW w AS ({_W} ROWS BETWEEN event_id % 5 PRECEDING AND event_id % 2 FOLLOWING)
""")
def dyn_rows(t: _Tables) -> Relation:
    w = m.over(Window.rows(**_BY_USER, preceding=lambda r: r.event_id % 5, following=lambda r: r.event_id % 2))
    return (
        t.events
        >> m.select(event_id=get("event_id"), s=m.sum(get("value")) >> w, n=m.count(const(1)) >> w, hi=m.max(get("value")) >> w)
        >> m.mutate(s=lambda r: _r(r.s))
    )


@query("""
SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN (event_id % 700) PRECEDING AND CURRENT ROW), 4) AS s
FROM events
""")
def dyn_range(t: _Tables) -> Relation:
    w = Window.range(order_by=[get("event_id")], partition_by=[get("user_id")], preceding=lambda r: r.event_id % 700, following=const(0))
    return t.events >> m.select(event_id=get("event_id"), s=m.sum(get("value")) >> m.over(w)) >> m.mutate(s=lambda r: _r(r.s))


@query(f"SELECT event_id, list(value) OVER ({_W} ROWS BETWEEN 4 PRECEDING AND 2 FOLLOWING)[(event_id % 4)::INT + 1] AS v FROM events")
def dyn_nth(t: _Tables) -> Relation:
    w = m.over(Window.rows(**_BY_USER, preceding=const(4), following=const(2)))
    return t.events >> m.select(event_id=get("event_id"), v=m.nth(get("value"), lambda r: r.event_id % 4) >> w)


@query(f"""
SELECT event_id, list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)[-2] AS v FROM events -- {_W}
""")
def dyn_nth_from_end(t: _Tables) -> Relation:
    w = m.over(Window.rows(**_BY_USER))
    return t.events >> m.select(event_id=get("event_id"), v=m.nth(get("value"), const(-2)) >> w)


# Functions of one's own, and conditions on other tables


@query("""
SELECT c_custkey, c_nationkey FROM customer
WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) OR c_acctbal < 0
""")
def sift_exists(t: _Tables) -> Relation:
    large = lambda c: t.orders >> m.sift(lambda o: (o.o_custkey == c.c_custkey) & (o.o_totalprice > 300000))
    return (
        t.customer
        >> m.sift(lambda c: m.exists(large(c)) | (c.c_acctbal < 0))
        >> m.select(c_custkey=get("c_custkey"), c_nationkey=get("c_nationkey"))
    )


@query("SELECT p_partkey, reverse(p_name) AS backwards FROM part")
def select_scalar_udf(t: _Tables) -> Relation:
    @F.pandas_udf("string")
    def backwards(x: pd.Series) -> pd.Series:
        return x.str[::-1]

    return t.part >> m.select(p_partkey=get("p_partkey"), backwards=lambda r: backwards(r.p_name))


#: Quarters of cents end on a five; times this they do not, and every engine rounds them alike.
_UNTIED = 0.987654321


@query(f"""
SELECT event_id, round({_UNTIED}e0 * covar_samp(value, event_id) OVER w, 3) AS cs, round({_UNTIED}e0 * covar_pop(value, event_id) OVER w, 3) AS cp,
       round({_UNTIED}e0 * var_pop(value) OVER w, 3) AS vp, round({_UNTIED}e0 * stddev_samp(value) OVER w, 4) AS ss
FROM events WINDOW w AS ({_W} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)
""")
def win_covariance(t: _Tables) -> Relation:
    w = m.over(Window.rows(**_BY_USER, preceding=6))
    x, y = get("value"), get("event_id")
    return t.events >> m.select(event_id=y, cs=m.cov_samp(x, y) >> w, cp=m.cov_pop(x, y) >> w, vp=m.var_pop(x) >> w, ss=m.stdev_samp(x) >> w) >> m.mutate(
        cs=lambda r: _r(_UNTIED * r.cs, 3), cp=lambda r: _r(_UNTIED * r.cp, 3), vp=lambda r: _r(_UNTIED * r.vp, 3), ss=lambda r: _r(_UNTIED * r.ss)
    )


@query(f"""
SELECT event_id, round(last_value(value) OVER w - first_value(value) OVER w, 6) AS change
FROM events WINDOW w AS ({_W} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)
""")
def win_moving(t: _Tables) -> Relation:
    def change(begin, end, x):
        x = x.to_numpy()
        return x[end - 1] - x[begin]

    w = m.over(Window.rows(**_BY_USER, preceding=3))
    return t.events >> m.select(event_id=get("event_id"), change=m.moving(change, get("value")) >> w) >> m.mutate(change=lambda r: _r(r.change, 6))


@query("""
SELECT event_id, rank() OVER (PARTITION BY user_id ORDER BY event_type) + count(*) OVER (PARTITION BY user_id, event_type) - 2 AS rk FROM events
""")
def win_ranking(t: _Tables) -> Relation:
    def last_peer(key):
        """The place of the last of a row's peers, from 0."""
        peers = (key != key.shift()).cumsum()
        return peers.groupby(peers).transform("size").groupby(peers).first().cumsum().reindex(peers).to_numpy() - 1

    w = Window.rows(order_by=[get("event_type")], partition_by=[get("user_id")])
    return t.events >> m.select(event_id=get("event_id"), rk=m.ranking(last_peer) >> m.over(w))
