"""Aggregation: ungrouped, grouped, distinct, filtered, and grouping sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import semantics as S
from ..operators import relational as R
from .catalog import again_as_text, query, text


@query("agg_ungrouped", "SELECT count(*) AS n, count(nullif(l_returnflag, 'R')) AS n_flag, CAST(sum(l_linenumber) AS BIGINT) AS total, min(l_shipdate) AS first_, max(l_extendedprice) AS top, round(avg(l_quantity), 6) AS mean FROM lineitem")
def agg_ungrouped(t):
    return t.lineitem.agg(F.count(F.lit(1)).alias("n"), F.count(F.nullif("l_returnflag", F.lit("R"))).alias("n_flag"), F.sum("l_linenumber").alias("total"), F.min("l_shipdate").alias("first_"), F.max("l_extendedprice").alias("top"), F.round(F.avg("l_quantity"), 6).alias("mean"))


text("agg_empty_input", "SELECT count(*) AS n, count(l_tax) AS n_tax, CAST(sum(l_linenumber) AS BIGINT) AS s, min(l_quantity) AS lo, avg(l_quantity) AS a FROM lineitem WHERE l_orderkey < 0")
text("agg_empty_grouped", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_orderkey < 0 GROUP BY l_returnflag")


@query("agg_grouped", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2))) AS DOUBLE) AS price, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY l_returnflag, l_linestatus")
def agg_grouped(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum(S.money("l_extendedprice")).cast("double").alias("price"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))


text("agg_null_group", "SELECT k, count(*) AS n, count(k) AS n_k FROM (SELECT nullif(o_orderstatus, 'P') AS k FROM orders) AS x GROUP BY k")


@query("agg_avg_decimal", "SELECT l_returnflag, round(CAST(avg(CAST(l_extendedprice AS DECIMAL(15,2))) AS DOUBLE), 4) AS mean FROM lineitem GROUP BY l_returnflag")
def agg_avg_decimal(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.round(S.avg_double(S.money("l_extendedprice")), 4).alias("mean"))


@query("agg_sum_decimal_wide", "SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2))) AS DECIMAL(25,2)) AS s FROM lineitem")
def agg_sum_decimal_wide(t):
    return t.lineitem.agg(F.sum(S.money("l_extendedprice")).alias("s"))


text("count_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS n, count(DISTINCT nullif(l_linestatus, 'O')) AS n_status FROM lineitem GROUP BY l_returnflag")
text("count_distinct_ungrouped", "SELECT count(DISTINCT l_suppkey) AS n, count(DISTINCT l_partkey) AS m FROM lineitem")


@query("count_distinct_tuple", "SELECT l_returnflag, count(DISTINCT (l_suppkey, nullif(l_linenumber, 1))) AS n FROM lineitem GROUP BY l_returnflag")
def count_distinct_tuple(t):
    return t.lineitem.groupBy("l_returnflag").agg(S.count_distinct_tuple("l_suppkey", F.nullif("l_linenumber", F.lit(1))).alias("n"))


text("sum_distinct", "SELECT l_returnflag, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS s, avg(DISTINCT l_linenumber) AS a FROM lineitem GROUP BY l_returnflag")
text("agg_filter", "SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS big, CAST(sum(l_linenumber) FILTER (WHERE l_discount < 0.05) AS BIGINT) AS s FROM lineitem GROUP BY l_returnflag")
text("having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND min(o_orderkey) < 5000")
text("group_expr", "SELECT CAST(year(o_orderdate) AS BIGINT) AS y, o_custkey % 3 AS m, count(*) AS n FROM orders GROUP BY year(o_orderdate), o_custkey % 3")
text("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
text("group_without_aggregate", "SELECT l_returnflag, l_linenumber FROM lineitem GROUP BY l_returnflag, l_linenumber")


@query("distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_orderdate FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey")
def distinct_on(t):
    return R.distinct_on(t.orders.select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.desc("o_orderdate"), F.asc("o_orderkey")])


text("grouping_sets", "SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) AS BIGINT) AS g, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")


@query("cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube(t):
    return t.orders.cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("rollup", "SELECT CAST(year(o_orderdate) AS BIGINT) AS y, o_orderstatus, count(*) AS n FROM orders GROUP BY ROLLUP (year(o_orderdate), o_orderstatus)")
def rollup(t):
    return t.orders.rollup(F.year("o_orderdate").cast("long").alias("y"), "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("agg_first", "SELECT o_custkey, first(o_orderkey ORDER BY o_orderdate, o_orderkey) AS first_order, first(nullif(o_orderstatus, 'O') ORDER BY o_orderdate, o_orderkey) AS first_status FROM orders GROUP BY o_custkey")
def agg_first(t):
    """first by an order is deterministic; first of a null is null."""
    at = F.struct("o_orderdate", "o_orderkey")
    return t.orders.groupBy("o_custkey").agg(F.min_by("o_orderkey", at).alias("first_order"), F.min_by(F.nullif("o_orderstatus", F.lit("O")), at).alias("first_status"))


@query("agg_first_empty", "SELECT first(o_orderkey) AS f FROM orders WHERE o_orderkey < 0")
def agg_first_empty(t):
    return t.orders.where("o_orderkey < 0").agg(F.first("o_orderkey").alias("f"))


text("agg_ordered_list", "SELECT n_regionkey, string_agg(n_nationkey, ',' ORDER BY n_nationkey) AS keys FROM nation GROUP BY n_regionkey")
text("agg_statistics", "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS vp, round(corr(l_quantity, l_extendedprice), 6) AS c, max_by(l_orderkey, (l_extendedprice, l_orderkey)) AS best, bool_and(l_quantity > 0) AS pos FROM lineitem GROUP BY l_returnflag")
text("agg_percentile", "SELECT l_returnflag, quantile_cont(l_quantity, 0.5) AS med FROM lineitem GROUP BY l_returnflag")


@query("approx_count_distinct")
def approx_count_distinct(t):
    return t.lineitem.agg(F.approx_count_distinct("l_partkey", 0.02).alias("n"))


again_as_text("agg_avg_decimal", "count_distinct_tuple", "distinct_on", "agg_first", "agg_sum_decimal_wide", "cube", "rollup")
text("sql_list_order_by_other", "SELECT o_custkey, list(o_orderkey ORDER BY o_orderdate DESC, o_orderkey) AS keys, list(nullif(o_orderstatus, 'O') ORDER BY o_orderkey) AS s FROM orders GROUP BY o_custkey")
