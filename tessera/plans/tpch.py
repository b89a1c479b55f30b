"""The TPC-H queries over the star schema at hand; those whose columns it lacks are adapted, and say so in their names.

Money is summed as decimals, so that sums don't depend on the order of rows. Supplier offers (partsupp) are derived
from the items each supplier sold.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.semantics import money
from .catalog import query, text

_D = "DECIMAL(15,2)"
_REVENUE = f"CAST(l_extendedprice AS {_D}) * (1 - CAST(l_discount AS DECIMAL(4,2)))"
_PS = "(SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, min(l_extendedprice / l_quantity) AS ps_supplycost, CAST(sum(l_quantity) AS BIGINT) AS ps_availqty FROM lineitem GROUP BY l_partkey, l_suppkey)"


def _double(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


@query("tpch_q1", f"SELECT l_returnflag, l_linestatus, {_double(f'sum(CAST(l_quantity AS {_D}))')} AS sum_qty, {_double(f'sum(CAST(l_extendedprice AS {_D}))')} AS sum_base_price, {_double(f'sum({_REVENUE})')} AS sum_disc_price, {_double(f'sum({_REVENUE} * (1 + CAST(l_tax AS DECIMAL(4,2))))')} AS sum_charge, round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 4) AS avg_disc, count(*) AS count_order FROM lineitem WHERE l_shipdate <= DATE '2001-08-01' GROUP BY l_returnflag, l_linestatus")
def q1(t):
    price, disc, tax = money("l_extendedprice"), F.col("l_discount").cast("decimal(4,2)"), F.col("l_tax").cast("decimal(4,2)")
    items = t.lineitem.where(F.col("l_shipdate") <= F.lit("2001-08-01").cast("date"))
    return items.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum(money("l_quantity")).cast("double").alias("sum_qty"),
        F.sum(price).cast("double").alias("sum_base_price"),
        F.sum(price * (1 - disc)).cast("double").alias("sum_disc_price"),
        F.sum(price * (1 - disc) * (1 + tax)).cast("double").alias("sum_charge"),
        F.round(F.avg("l_quantity"), 4).alias("avg_qty"),
        F.round(F.avg("l_extendedprice"), 4).alias("avg_price"),
        F.round(F.avg("l_discount"), 4).alias("avg_disc"),
        F.count(F.lit(1)).alias("count_order"),
    )


text("tpch_q2_adapted", f"WITH ps AS {_PS}, offers AS (SELECT ps_partkey, ps_suppkey, ps_supplycost FROM ps JOIN supplier ON s_suppkey = ps_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE') SELECT s_acctbal, s_name, n_name, p_partkey, p_brand FROM part JOIN offers AS o ON p_partkey = o.ps_partkey JOIN supplier ON s_suppkey = o.ps_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE p_size < 15 AND p_type LIKE '%ARD' AND o.ps_supplycost = (SELECT min(m.ps_supplycost) FROM offers AS m WHERE m.ps_partkey = p_partkey) ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100")
text("tpch_q3_adapted", f"SELECT l_orderkey, {_double(f'sum({_REVENUE})')} AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < DATE '1998-03-15' AND l_shipdate > DATE '1998-03-15' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10")
text("tpch_q4_adapted", "SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE o_orderdate >= DATE '1997-07-01' AND o_orderdate < DATE '1997-10-01' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate + INTERVAL '60' DAY) GROUP BY o_orderpriority")
text("tpch_q5", f"SELECT n_name, {_double(f'sum({_REVENUE})')} AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1998-01-01' GROUP BY n_name")


@query("tpch_q6", f"SELECT {_double(f'sum(CAST(l_extendedprice AS {_D}) * CAST(l_discount AS DECIMAL(4,2)))')} AS revenue FROM lineitem WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' AND CAST(l_discount AS DECIMAL(4,2)) BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
def q6(t):
    day = lambda s: F.lit(s).cast("date")
    some = t.lineitem.where((F.col("l_shipdate") >= day("1996-01-01")) & (F.col("l_shipdate") < day("1997-01-01")) & F.expr("CAST(l_discount AS DECIMAL(4,2)) BETWEEN 0.05 AND 0.07") & (F.col("l_quantity") < 24))
    return some.agg(F.sum(money("l_extendedprice") * F.col("l_discount").cast("decimal(4,2)")).cast("double").alias("revenue"))


text("tpch_q7", f"SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(year(l_shipdate) AS BIGINT) AS l_year, {_double(f'sum({_REVENUE})')} AS revenue FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation AS n1 ON s_nationkey = n1.n_nationkey JOIN nation AS n2 ON c_nationkey = n2.n_nationkey WHERE (n1.n_name = 'NATION_1' AND n2.n_name = 'NATION_2' OR n1.n_name = 'NATION_2' AND n2.n_name = 'NATION_1') AND l_shipdate BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' GROUP BY n1.n_name, n2.n_name, year(l_shipdate)")
text("tpch_q8", f"SELECT o_year, round({_double("sum(CASE WHEN nation = 'NATION_3' THEN volume ELSE 0 END)")} / {_double('sum(volume)')}, 9) AS mkt_share FROM (SELECT CAST(year(o_orderdate) AS BIGINT) AS o_year, {_REVENUE} AS volume, n2.n_name AS nation FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation AS n1 ON c_nationkey = n1.n_nationkey JOIN region ON n1.n_regionkey = r_regionkey JOIN nation AS n2 ON s_nationkey = n2.n_nationkey WHERE r_name = 'AMERICA' AND o_orderdate BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' AND p_type = 'ECONOMY') AS all_nations GROUP BY o_year")
text("tpch_q9_adapted", f"SELECT n_name AS nation, CAST(year(o_orderdate) AS BIGINT) AS o_year, round(sum(l_extendedprice * (1 - l_discount) - ps_supplycost * l_quantity), 2) AS sum_profit FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN {_PS} AS ps ON ps_suppkey = l_suppkey AND ps_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey JOIN nation ON s_nationkey = n_nationkey WHERE p_name LIKE '%blue%' GROUP BY n_name, year(o_orderdate)")
text("tpch_q10_adapted", f"SELECT c_custkey, c_name, {_double(f'sum({_REVENUE})')} AS revenue, c_acctbal, n_name FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate >= DATE '1997-10-01' AND o_orderdate < DATE '1998-01-01' AND l_returnflag = 'R' GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20")
text("tpch_q11_adapted", f"WITH v AS (SELECT ps_partkey, CAST(sum(ps_availqty) AS BIGINT) AS qty FROM {_PS} AS ps JOIN supplier ON ps_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 2 GROUP BY ps_partkey) SELECT ps_partkey, qty FROM v WHERE qty > (SELECT sum(qty) * 0.001 FROM v)")
text("tpch_q12_adapted", "SELECT l_returnflag, count(*) FILTER (WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) AS high_line_count, count(*) FILTER (WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')) AS low_line_count FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_shipdate > o_orderdate + INTERVAL '30' DAY AND l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1998-01-01' GROUP BY l_returnflag")
text("tpch_q13_adapted", "SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '%URGENT%' GROUP BY c_custkey) AS c_orders GROUP BY c_count")
text("tpch_q14", f"SELECT round(100.0 * {_double(f"sum(CASE WHEN p_type LIKE 'PROMO%' THEN {_REVENUE} ELSE 0 END)")} / {_double(f'sum({_REVENUE})')}, 8) AS promo_revenue FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= DATE '1997-09-01' AND l_shipdate < DATE '1997-10-01'")
text("tpch_q15", f"WITH revenue AS (SELECT l_suppkey AS supplier_no, sum({_REVENUE}) AS total_revenue FROM lineitem WHERE l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1997-04-01' GROUP BY l_suppkey) SELECT s_suppkey, s_name, {_double('total_revenue')} AS total_revenue FROM supplier JOIN revenue ON s_suppkey = supplier_no WHERE total_revenue = (SELECT max(total_revenue) FROM revenue)")
text("tpch_q16_adapted", f"SELECT p_brand, p_type, p_size, count(DISTINCT ps_suppkey) AS supplier_cnt FROM {_PS} AS ps JOIN part ON p_partkey = ps_partkey WHERE p_brand <> 'Brand#15' AND p_type NOT LIKE 'MED%' AND p_size IN (3, 9, 14, 19, 23, 36, 45, 49) AND ps_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY p_brand, p_type, p_size")
text("tpch_q17_adapted", f"SELECT round({_double(f'sum(CAST(l_extendedprice AS {_D}))')} / 7.0, 6) AS avg_yearly FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand = 'Brand#23' AND l_quantity < (SELECT 0.4 * avg(l_quantity) FROM lineitem AS l2 WHERE l2.l_partkey = p_partkey)")
text("tpch_q18", "SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, CAST(sum(l_quantity) AS BIGINT) AS qty FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 200) GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100")
text("tpch_q19_adapted", f"SELECT {_double(f'sum({_REVENUE})')} AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand = 'Brand#12' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 15 OR p_partkey = l_partkey AND p_brand = 'Brand#23' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 30 OR p_partkey = l_partkey AND p_brand = 'Brand#34' AND l_quantity BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 45")
text("tpch_q20_adapted", f"SELECT s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1 AND s_suppkey IN (SELECT ps_suppkey FROM {_PS} AS ps WHERE ps_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE 'b%') AND ps_availqty > (SELECT 0.5 * sum(l_quantity) FROM lineitem WHERE l_partkey = ps_partkey AND l_suppkey = ps_suppkey AND l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1999-01-01'))")
text("tpch_q21_adapted", "SELECT s_name, count(*) AS numwait FROM supplier JOIN lineitem AS l1 ON s_suppkey = l1.l_suppkey JOIN orders ON o_orderkey = l1.l_orderkey JOIN nation ON s_nationkey = n_nationkey WHERE o_orderstatus = 'F' AND l1.l_shipdate > o_orderdate + INTERVAL '60' DAY AND EXISTS (SELECT 1 FROM lineitem AS l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey) AND NOT EXISTS (SELECT 1 FROM lineitem AS l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_shipdate > o_orderdate + INTERVAL '60' DAY) GROUP BY s_name")
text("tpch_q22_adapted", f"SELECT cntrycode, count(*) AS numcust, {_double(f'sum(CAST(c_acctbal AS {_D}))')} AS totacctbal FROM (SELECT substring(c_mktsegment, 1, 2) AS cntrycode, c_acctbal, c_custkey FROM customer WHERE substring(c_mktsegment, 1, 2) IN ('AU', 'BU', 'MA') AND c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0)) AS custsale WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') GROUP BY cntrycode")
