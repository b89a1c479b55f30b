"""Window functions, sorting, top-n and limits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import semantics as S
from ..operators import relational as R
from .catalog import again_as_text, query, text
from .engine import Engine

_BY = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"


@query("win_rank_family", f"SELECT o_orderkey, row_number() OVER ({_BY}) AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS rk, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS dr, round(percent_rank() OVER ({_BY}), 9) AS pr, round(cume_dist() OVER ({_BY}), 9) AS cd FROM orders")
def win_rank_family(t):
    w, p = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"), Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    return t.orders.select("o_orderkey", F.row_number().over(w).cast("long").alias("rn"), F.rank().over(p).cast("long").alias("rk"), F.dense_rank().over(p).cast("long").alias("dr"), F.round(F.percent_rank().over(w), 9).alias("pr"), F.round(F.cume_dist().over(w), 9).alias("cd"))


text("win_ntile", f"SELECT o_orderkey, CAST(ntile(4) OVER ({_BY}) AS BIGINT) AS q FROM orders")
text("win_lag_lead", f"SELECT o_orderkey, lag(o_orderkey) OVER ({_BY}) AS before_, lead(o_orderkey, 2, -1) OVER ({_BY}) AS after_ FROM orders")
text("win_first_last", f"SELECT o_orderkey, first_value(o_orderkey) OVER ({_BY}) AS f, last_value(o_orderkey) OVER ({_BY} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l, nth_value(o_orderkey, 2) OVER ({_BY} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS n FROM orders")


@query("win_rows_frame", f"SELECT o_orderkey, count(*) OVER ({_BY} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(15,2))) OVER ({_BY} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS DOUBLE) AS s FROM orders")
def win_rows_frame(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t.orders.select("o_orderkey", F.count(F.lit(1)).over(w.rowsBetween(-2, 0)).alias("n"), F.sum(S.money("o_totalprice")).over(w.rowsBetween(-2, 1)).cast("double").alias("s"))


text("win_range_frame", "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n FROM lineitem")
text("win_running_sum", "SELECT event_id, CAST(sum(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS s FROM events")
text("win_over_aggregate", "SELECT o_orderstatus, n, rank() OVER (ORDER BY n DESC, o_orderstatus) AS r FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus) AS x".replace("rank()", "CAST(rank()").replace("o_orderstatus) AS r", "o_orderstatus) AS BIGINT) AS r"))


@query("win_qualify", f"SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER ({_BY}) = 1")
def win_qualify(t):
    return R.top_n_per_group(t.orders.select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.asc("o_orderdate"), F.asc("o_orderkey")], 1).select("o_custkey", "o_orderkey")


@query("top_n_per_group", f"SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def top_n_per_group(t):
    return R.top_n_per_group(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3).select("o_custkey", "o_orderkey")


@query("order_nulls", "SELECT c_custkey, k FROM (SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer) AS x ORDER BY k DESC NULLS LAST, c_custkey LIMIT 40")
def order_nulls(t):
    return t.customer.select("c_custkey", F.nullif("c_nationkey", F.lit(3)).alias("k")).orderBy(S.desc("k"), "c_custkey").limit(40)


text("order_nulls_first", "SELECT c_custkey, k FROM (SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer) AS x ORDER BY k NULLS FIRST, c_custkey LIMIT 40")
text("order_hidden_key", "SELECT c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20")
text("order_all", "SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey")
text("top_n", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25")
text("top_n_offset", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 15")
text("top_n_beyond_end", "SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 10 OFFSET 20")


@query("limit_percent", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 1%")
def limit_percent(t):
    return R.limit_percent(t.orders.select("o_orderkey"), 1, ["o_orderkey"])


@query("limit_any", "SELECT count(*) AS n FROM (SELECT * FROM lineitem LIMIT 100 OFFSET 5) AS x")
def limit_any(t):
    return t.lineitem.offset(5).limit(100).agg(F.count(F.lit(1)).alias("n"))


@query("sample_rows")
def sample_rows(t):
    """TABLESAMPLE: a sampling operator's result isn't stated by SQL."""
    return t.lineitem.sample(0.05, seed=1).select("l_orderkey", "l_linenumber")


@query("win_groups_frame", "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n FROM lineitem")
def win_groups_frame(t):
    return R.groups_frame(t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate"), F.count(F.lit(1)), "n", ["l_suppkey"], ["l_shipdate"], -1, 1).select("l_orderkey", "l_linenumber", "n")


@query("win_exclude_current", "SELECT o_orderkey, CAST(sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING EXCLUDE CURRENT ROW) AS BIGINT) AS s FROM orders")
def win_exclude_current(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(-2, 1)
    return R.exclude_frame(t.orders, "o_orderkey", "s", w).select("o_orderkey", "s")


@query("win_exclude_group", "SELECT o_orderkey, CAST(sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE GROUP) AS BIGINT) AS s FROM orders")
def win_exclude_group(t):
    w = Window.partitionBy("o_custkey")
    return R.exclude_frame(t.orders, "o_orderkey", "s", w, "group", ["o_custkey", "o_orderpriority"]).select("o_orderkey", "s")


@query("win_exclude_ties", "SELECT o_orderkey, CAST(sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE TIES) AS BIGINT) AS s FROM orders")
def win_exclude_ties(t):
    w = Window.partitionBy("o_custkey")
    return R.exclude_frame(t.orders, "o_orderkey", "s", w, "ties", ["o_custkey", "o_orderpriority"]).select("o_orderkey", "s")


again_as_text("win_rank_family", "win_rows_frame", "win_qualify", "top_n_per_group", "order_nulls", "limit_percent", "limit_any")
text("sql_order_default_nulls", "SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer ORDER BY k, c_custkey")
text("sql_order_desc_default_nulls", "SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer ORDER BY k DESC, c_custkey DESC LIMIT 200")
text("sql_qualify_alias", "SELECT o_custkey, o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders QUALIFY r <= 2 ORDER BY o_custkey, o_orderkey")


@query("sql_sample")
def sql_sample(t):
    """A sampling clause's result isn't stated by SQL."""
    t.register("lineitem")
    return Engine(t.spark).sql("SELECT l_orderkey, l_linenumber FROM lineitem USING SAMPLE 5%")
