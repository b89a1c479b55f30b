"""Joins of every type: equal keys, further conditions, inequalities, null-safe keys, and the kinds Spark has no verb for."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relational as R
from .catalog import again_as_text, query, text

# Keys that are null in places, to pin down how each join treats them.
_LEFT = "(SELECT c_custkey AS a, nullif(c_nationkey, 3) AS k, nullif(c_nationkey % 4, 1) AS k2 FROM customer) AS l"
_RIGHT = "(SELECT s_suppkey AS b, nullif(s_nationkey, 5) AS k, nullif(s_nationkey % 4, 2) AS k2 FROM supplier) AS r"


def _left(t):
    return t.customer.select(F.col("c_custkey").alias("a"), F.nullif("c_nationkey", F.lit(3)).alias("lk"), F.nullif(F.col("c_nationkey") % 4, F.lit(1)).alias("lk2"))


def _right(t):
    return t.supplier.select(F.col("s_suppkey").alias("b"), F.nullif("s_nationkey", F.lit(5)).alias("rk"), F.nullif(F.col("s_nationkey") % 4, F.lit(2)).alias("rk2"))


_KINDS = {"inner": "JOIN", "left": "LEFT JOIN", "right": "RIGHT JOIN", "full": "FULL JOIN", "semi": "SEMI JOIN", "anti": "ANTI JOIN"}


def _family(prefix: str, on: str, equal: list[tuple[str, str, bool]], less=None) -> None:
    """The six join types over one condition: equal keys (left's, right's, whether null equals null) and an inequality."""
    for kind, words in _KINDS.items():
        one_sided = kind in ("semi", "anti")

        def build(t, kind=kind, one_sided=one_sided):
            how = f"left_{kind}" if one_sided else kind
            return R.pair_join(_left(t), _right(t), equal, how, less).select("a", *([] if one_sided else ["b"]))

        query(f"{prefix}_{kind}", f"SELECT a{'' if one_sided else ', b'} FROM {_LEFT} {words} {_RIGHT} ON {on}")(build)


_family("join", "l.k = r.k", [("lk", "rk", False)])
_family("join_mixed", "l.k = r.k AND l.a < r.b", [("lk", "rk", False)], ("a", "b", "<"))
_family("join_ineq", "l.a > r.b * 2 + 50", [], ("a", "b * 2 + 50", ">"))
_family("join_null_safe", "l.k IS NOT DISTINCT FROM r.k", [("lk", "rk", True)])
_family("join_multi_key", "l.k = r.k AND l.k2 = r.k2", [("lk", "rk", False), ("lk2", "rk2", False)])
_family("join_null_safe_mixed_keys", "l.k = r.k AND l.k2 IS NOT DISTINCT FROM r.k2", [("lk", "rk", False), ("lk2", "rk2", True)])


@query("join_orders_lineitem", "SELECT o_orderkey, o_orderpriority, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity > 45")
def join_orders_lineitem(t):
    return t.orders.join(t.lineitem.where("l_quantity > 45"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "o_orderpriority", "l_linenumber")


text("join_expr_key", "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_custkey * 10 = s_suppkey + 90")
text("join_mixed_types", "SELECT n_name, s_suppkey FROM nation JOIN supplier ON CAST(n_nationkey AS BIGINT) = s_nationkey")
text("join_empty_side", "SELECT c_custkey, s_suppkey FROM customer LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey < 0) AS s ON c_nationkey = s_nationkey")
_NONE = "(SELECT * FROM supplier WHERE s_suppkey < 0) AS s"
text("join_empty_right", f"SELECT c_custkey, s_suppkey FROM {_NONE} RIGHT JOIN customer ON c_nationkey = s_nationkey")
text("join_empty_full", f"SELECT c_custkey, s_suppkey FROM customer FULL JOIN {_NONE} ON c_nationkey = s_nationkey")
text("join_empty_inner", f"SELECT c_custkey, s_suppkey FROM customer JOIN {_NONE} ON c_nationkey = s_nationkey")
text("join_empty_semi", f"SELECT c_custkey FROM customer SEMI JOIN {_NONE} ON c_nationkey = s_nationkey")
text("join_empty_mark", f"SELECT c_custkey, c_nationkey IN (SELECT s_nationkey FROM {_NONE}) AS mark FROM customer")
text("join_empty_build_left", f"SELECT s_suppkey, c_custkey FROM {_NONE} LEFT JOIN customer ON c_nationkey = s_nationkey")
text("join_right_semi", "SELECT n_name FROM nation SEMI JOIN supplier ON n_nationkey = s_nationkey AND s_acctbal > 0")
text("join_right_anti", "SELECT r_name FROM region ANTI JOIN (SELECT * FROM customer WHERE c_nationkey < 3) AS c ON r_regionkey = c_nationkey")
text("join_empty_anti", "SELECT c_custkey FROM customer ANTI JOIN (SELECT * FROM supplier WHERE s_suppkey < 0) AS s ON c_nationkey = s_nationkey")
text("join_cross", "SELECT n_name, r_name FROM nation CROSS JOIN region")
text("join_any_condition", "SELECT n.n_nationkey AS a, m.n_nationkey AS b FROM nation AS n JOIN nation AS m ON n.n_nationkey < m.n_nationkey AND (n.n_regionkey = m.n_regionkey OR n.n_nationkey + m.n_nationkey = 20)")
text("join_self", "SELECT a.n_name AS one, b.n_name AS other FROM nation AS a JOIN nation AS b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")


@query("join_mark_in", "SELECT c_custkey, nullif(c_nationkey, 3) IN (SELECT nullif(s_nationkey, 5) FROM supplier) AS mark FROM customer")
def join_mark_in(t):
    left = t.customer.select("c_custkey", F.nullif("c_nationkey", F.lit(3)).alias("k"))
    return R.mark_join(left, t.supplier.select(F.nullif("s_nationkey", F.lit(5)).alias("v")), ("k", "v")).select("c_custkey", "mark")


text("join_mark_or", "SELECT c_custkey FROM customer WHERE c_acctbal < 0 OR EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_acctbal < 0)")


@query("join_mark_less", "SELECT o_orderkey, nullif(o_custkey, 7) < ANY (SELECT nullif(s_suppkey, 3) FROM supplier) AS mark FROM orders")
def join_mark_less(t):
    left = t.orders.select("o_orderkey", F.nullif("o_custkey", F.lit(7)).alias("k"))
    return R.mark_join_less(left, t.supplier.select(F.nullif("s_suppkey", F.lit(3)).alias("v")), ("k", "v")).select("o_orderkey", "mark")


text("join_mark_inequality", "SELECT c_custkey FROM customer WHERE c_nationkey = 1 OR EXISTS (SELECT 1 FROM supplier WHERE s_suppkey * 9 < c_custkey)")


@query("join_asof", "SELECT e.event_id, o.o_orderkey FROM (SELECT event_id, user_id % 50 AS k, TIMESTAMP '1995-06-01' + to_hours(event_id * 5) AS at FROM events) AS e ASOF LEFT JOIN (SELECT o_custkey % 50 AS k, o_orderdate AS od, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2) AS o ON e.k = o.k AND e.at >= o.od")
def join_asof(t):
    left = t.events.select("event_id", (F.col("user_id") % 50).alias("k"), F.expr("TIMESTAMP_NTZ '1995-06-01 00:00:00' + make_dt_interval(0, CAST(event_id * 5 AS INT))").alias("at"))
    right = t.orders.groupBy((F.col("o_custkey") % 50).alias("k"), F.col("o_orderdate").alias("od")).agg(F.min("o_orderkey").alias("o_orderkey"))
    return R.asof_join(left, right, ["k"], "at", "od", ["o_orderkey"]).select("event_id", "o_orderkey")


@query("join_range", "SELECT p_partkey, b.item FROM part JOIN (SELECT item_id AS item, 900 + item_id * 25 AS lo, 960 + item_id * 25 AS hi FROM benchmark) AS b ON p_retailprice >= lo AND p_retailprice < hi")
def join_range(t):
    ranges = t.benchmark.select(F.col("item_id").alias("item"), (F.col("item_id") * 25 + 900).alias("lo"), (F.col("item_id") * 25 + 960).alias("hi"))
    return R.range_join(t.part, ranges, "p_retailprice", "lo", "hi", 60.0).select("p_partkey", "item")


@query("join_positional", "SELECT n_name, r_name FROM (SELECT * FROM nation ORDER BY n_nationkey) AS n POSITIONAL JOIN (SELECT * FROM region ORDER BY r_regionkey DESC) AS r")
def join_positional(t):
    return R.positional_join(t.nation.select("n_name", "n_nationkey"), t.region.select("r_name", "r_regionkey"), [F.asc("n_nationkey")], [F.desc("r_regionkey")]).select("n_name", "r_name")


@query("join_salted", "SELECT l_returnflag, count(*) AS n FROM lineitem JOIN (SELECT DISTINCT l_returnflag AS f FROM lineitem) AS x ON l_returnflag = f GROUP BY l_returnflag")
def join_salted(t):
    flags = t.lineitem.select("l_returnflag").distinct()
    return R.salted_join(t.lineitem.select("l_returnflag", "l_orderkey", "l_linenumber"), flags, ["l_returnflag"], 8).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


again_as_text(*(f"join_{k}" for k in _KINDS), *(f"join_mixed_{k}" for k in _KINDS), "join_null_safe_full", "join_mark_in", "join_asof", "join_range", "join_positional")
text("sql_join_asof_strict", "SELECT e.event_id, o.o_orderkey FROM (SELECT event_id, user_id % 50 AS k, TIMESTAMP '1995-06-01' + to_hours(event_id * 5) AS at FROM events) AS e ASOF JOIN (SELECT o_custkey % 50 AS k, o_orderdate AS od, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2) AS o ON e.k = o.k AND e.at > o.od")
text("sql_join_asof_next", "SELECT event_id, od FROM (SELECT event_id, TIMESTAMP '1995-06-01' + to_hours(event_id * 5) AS at FROM events) AS e ASOF LEFT JOIN (SELECT DISTINCT o_orderdate AS od FROM orders) AS o ON e.at <= o.od")
