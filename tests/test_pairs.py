"""Joins of few keys and very many pairs: pair_join against brute force, and how its pairs are spread over tasks."""

from __future__ import annotations

import math
import operator
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import relational as R
from tessera.plans import registry
from tessera.plans.engine import Engine

KINDS = ("inner", "left", "right", "full", "left_semi", "left_anti")
COMPARE = {None: lambda x, y: True, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def order(value):
    """NaN is equal to itself and above all numbers."""
    return (1, 0.0) if math.isnan(value) else (0, value)


def meets(one, other, safe):
    return one is None and other is None and safe if None in (one, other) else order(one) == order(other)


@pytest.mark.parametrize("op", COMPARE)
@pytest.mark.parametrize("safe", (None, False, True))
@pytest.mark.parametrize("kind", KINDS)
def test_pair_join_against_brute_force(kind, safe, op, spark):
    """Null and NaN keys and values, whole rows twice, keys of one side; pieces of three rows. safe None: no keys."""
    rng = random.Random(8)
    row = lambda i, keys: (i // 2, rng.choice(keys), rng.choice((None, math.nan, *map(float, range(9)))))
    left, right = [row(i, (1.0, 1.0, 1.0, 2.0, math.nan, None)) for i in range(40)], [row(i, (1.0, 1.0, 3.0, math.nan, None)) for i in range(17)]
    left, right = left + left[:3], right + right[:3]
    met = lambda l, r: (safe is None or meets(l[1], r[1], safe)) and (op is None or (None not in (l[2], r[2]) and COMPARE[op](order(l[2]), order(r[2]))))
    pairs = [(m, n) for m, l in enumerate(left) for n, r in enumerate(right) if met(l, r)]
    ones, others = {m for m, _ in pairs}, {n for _, n in pairs}
    none = (None, None, None)
    if kind in ("left_semi", "left_anti"):
        want = [l for m, l in enumerate(left) if (m in ones) == (kind == "left_semi")]
    else:
        want = [left[m] + right[n] for m, n in pairs]
        want += [l + none for m, l in enumerate(left) if kind in ("left", "full") and m not in ones]
        want += [none + r for n, r in enumerate(right) if kind in ("right", "full") and n not in others]
    a, b = spark.createDataFrame(left, "i int, k double, v double"), spark.createDataFrame(right, "j int, l double, w double")
    found = R.pair_join(a, b, [] if safe is None else [("k", "l", safe)], kind, ("v", "w", op) if op else None, piece=3)
    assert Counter(str(tuple(r)) for r in found.collect()) == Counter(map(str, want))


def test_pair_join_of_nothing(spark):
    a, b = spark.range(3).toDF("a"), spark.range(0).toDF("b")
    for on, less in (([("a", "b", True)], None), ([], ("a", "b", "<"))):
        assert {k: R.pair_join(a, b, on, k, less).count() for k in KINDS} == {"inner": 0, "left": 3, "right": 0, "full": 3, "left_semi": 0, "left_anti": 3}
    with pytest.raises(TypeError):
        R.pair_join(a, b.select(F.col("b").cast("string")), [("a", "b", False)])
    assert R.pair_join(a, a.toDF("b"), [("a", "b", False)], few=2) is None


@pytest.fixture(scope="module")
def one_key(spark, tmp_path_factory):
    """9000 customers and 3000 suppliers of one nation: 27 million pairs."""
    folder = str(tmp_path_factory.mktemp("one"))
    for table, letter, n in (("customer", "c_custkey", 9000), ("supplier", "s_suppkey", 3000)):
        spark.range(n).select(F.col("id").alias(letter), F.lit(7).alias(f"{letter[0]}_nationkey")).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    return folder


@pytest.mark.parametrize("name", [*(f"{f}_{k}" for f in ("join", "join_ineq", "join_null_safe", "join_multi_key", "join_null_safe_mixed_keys") for k in KINDS[:4]), *(f"sql_join_{k}" for k in (*KINDS[:4], "null_safe_full"))])
def test_pairs_of_one_key_are_the_work_of_many_tasks(name, spark, one_key):
    tasks = registry.queries()[name](spark, one_key).where("a IS NOT NULL AND b IS NOT NULL").groupBy(F.spark_partition_id()).count().collect()
    ineq = sum(min(3000, max(0, (a - 49) // 2)) for a in range(9000))
    assert sum(r["count"] for r in tasks) == (ineq if "ineq" in name else 9000 * 3000)
    assert len(tasks) >= 3


@pytest.mark.parametrize("text", (
    "SELECT x.n_name, y.n_nationkey AS k FROM nation AS x JOIN nation AS y ON x.n_regionkey = y.n_regionkey AND y.n_nationkey > x.n_nationkey",
    "SELECT x.n_name, x.n_regionkey AS p, y.n_regionkey AS q FROM nation AS x FULL JOIN (SELECT * FROM nation WHERE n_regionkey > 1) AS y ON y.n_regionkey IS NOT DISTINCT FROM nullif(x.n_regionkey, 2);",
    "SELECT s_suppkey FROM supplier ANTI JOIN nation ON n_regionkey * 20 > s_suppkey",
    "SELECT n_name, r_name FROM nation LEFT JOIN region ON r_regionkey <= n_regionkey - 1",
))
def test_texts_of_many_pairs(text, spark, duck):
    from oracle import DATA, assert_same

    engine = Engine(spark, DATA)
    assert "tessera" in engine.translate(text)
    assert_same(engine.sql(text), duck, text)
