"""Set operations."""

from __future__ import annotations

from .catalog import query, text

_A = "SELECT nullif(c_nationkey, 3) AS k FROM customer"
_B = "SELECT nullif(s_nationkey, 5) AS k FROM supplier"


@query("union_all", f"{_A} UNION ALL {_B}")
def union_all(t):
    return t.customer.selectExpr("nullif(c_nationkey, 3) AS k").unionAll(t.supplier.selectExpr("nullif(s_nationkey, 5) AS k"))


@query("union_by_name", "SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL BY NAME SELECT r_name AS name, r_regionkey AS k FROM region")
def union_by_name(t):
    return t.nation.selectExpr("n_nationkey AS k", "n_name AS name").unionByName(t.region.selectExpr("r_name AS name", "r_regionkey AS k"))


text("union_distinct", f"{_A} UNION {_B}")
text("sql_union_by_name", "SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL BY NAME SELECT r_name AS name, r_regionkey AS k FROM region")
text("except", f"{_A} EXCEPT {_B}")
text("except_all", f"{_A} EXCEPT ALL {_B}")
text("intersect", f"{_A} INTERSECT {_B}")
text("intersect_all", f"{_A} INTERSECT ALL {_B}")
