"""Joins and set operations, held against brute force."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from tessera.plans import registry

QUERIES = registry.queries()
ON = {
    "join": lambda l, r: l[1] is not None and l[1] == r[1],
    "join_mixed": lambda l, r: l[1] is not None and l[1] == r[1] and l[0] < r[0],
    "join_ineq": lambda l, r: l[0] > r[0] * 2 + 50,
    "join_null_safe": lambda l, r: l[1] == r[1],
    "join_multi_key": lambda l, r: None not in (l[1], l[2]) and l[1:] == r[1:],
    "join_null_safe_mixed_keys": lambda l, r: l[1] is not None and l[1:] == r[1:],
}


def unless(value, null):
    return None if value == null else value


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Rows of (id, nation): most customers in one nation, ids from 1 to 900."""
    rng = random.Random(6)
    customer = [(i, 7 if rng.random() < 0.5 else rng.randrange(25)) for i in range(1, 901)]
    supplier = [(i, rng.choice((3, 5, 7, rng.randrange(20)))) for i in range(1, 1001, 20)]
    folder = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(customer, "c_custkey long, c_nationkey int").write.parquet(f"{folder}/customer.parquet")
    spark.createDataFrame(supplier, "s_suppkey long, s_nationkey int").write.parquet(f"{folder}/supplier.parquet")
    return folder, customer, supplier


@pytest.mark.parametrize("family", sorted(ON))
@pytest.mark.parametrize("kind", ("inner", "left", "right", "full", "semi", "anti"))
def test_joins(family, kind, spark, tables):
    folder, customer, supplier = tables
    left = [(a, unless(n, 3), unless(n % 4, 1)) for a, n in customer]
    right = [(b, unless(n, 5), unless(n % 4, 2)) for b, n in supplier]
    pairs = [(l[0], r[0]) for l in left for r in right if ON[family](l, r)]
    met = {a for a, _ in pairs}, {b for _, b in pairs}
    if kind == "semi":
        want = [(a,) for a in met[0]]
    elif kind == "anti":
        want = [(l[0],) for l in left if l[0] not in met[0]]
    else:
        want = pairs + [(l[0], None) for l in left if kind in ("left", "full") and l[0] not in met[0]]
        want += [(None, r[0]) for r in right if kind in ("right", "full") and r[0] not in met[1]]
    assert Counter(map(tuple, QUERIES[f"{family}_{kind}"](spark, folder).collect())) == Counter(want)


def test_sets(spark, tables):
    folder, customer, supplier = tables
    one, other = Counter(unless(n, 3) for _, n in customer), Counter(unless(n, 5) for _, n in supplier)
    want = {"union_all": one + other, "union_distinct": Counter({*one, *other}), "except": Counter({*one} - {*other}), "except_all": one - other, "intersect": Counter({*one} & {*other}), "intersect_all": one & other}
    for name, rows in want.items():
        assert Counter(r[0] for r in QUERIES[name](spark, folder).collect()) == rows, name
