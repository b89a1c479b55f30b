"""Subqueries and common table expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import query, text

text("exists", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 48)")
text("not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
text("in_subquery", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
text("not_in_subquery", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 30)")
text("not_in_subquery_null", "SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT nullif(s_nationkey, 5) FROM supplier)")
text("scalar_correlated", "SELECT c_custkey, (SELECT max(o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS last_order FROM customer")
text("scalar_correlated_count", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS n FROM customer")
text("scalar_correlated_filter", "SELECT l_orderkey, l_linenumber FROM lineitem AS l WHERE l_quantity > (SELECT 1.5 * avg(l_quantity) FROM lineitem AS m WHERE m.l_suppkey = l.l_suppkey)")
text("scalar_uncorrelated", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT 1.9 * avg(o_totalprice) FROM orders)")
text("lateral_join", "SELECT r_name, x.n FROM region, LATERAL (SELECT count(*) AS n FROM nation WHERE n_regionkey = r_regionkey) AS x")
text("cte_multi_use", "WITH s AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT a.o_custkey FROM s AS a WHERE a.n = (SELECT max(n) FROM s) OR a.n = (SELECT min(n) FROM s)")
text("cte_recursive", "WITH RECURSIVE f(i, a, b) AS (SELECT 1, CAST(0 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT i + 1, b, a + b FROM f WHERE i < 40) SELECT i, a FROM f")


@query("prepared_statement", "SELECT o_orderkey FROM orders WHERE o_custkey = 42 AND o_orderstatus <> 'P'")
def prepared_statement(t):
    t.register("orders")
    return t.spark.sql("SELECT o_orderkey FROM orders WHERE o_custkey = :customer AND o_orderstatus <> :status", args={"customer": 42, "status": "P"})


@query("cte_materialized", "WITH s AS MATERIALIZED (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT count(*) AS pairs FROM s AS a JOIN s AS b ON a.n = b.n AND a.l_suppkey < b.l_suppkey")
def cte_materialized(t):
    """Both readers use one exchange: Spark reuses equal subplans."""
    s = t.lineitem.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    return s.alias("a").join(s.alias("b"), F.expr("a.n = b.n AND a.l_suppkey < b.l_suppkey")).agg(F.count(F.lit(1)).alias("pairs"))
