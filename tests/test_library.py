"""The library's own surface: helpers, sources, pins, the SQL front, plans and streams."""

from __future__ import annotations

import datetime
import math

import pytest
from oracle import DATA, assert_same
from pyspark.sql import functions as F

from tessera.functions import semantics as S
from tessera.operators import relational as R
from tessera.plans import registry
from tessera.plans.dialect import DialectError, translate
from tessera.plans.engine import Engine
from tessera.session import TUNABLES, load_settings, reset_option, set_option
from tessera.sources import tables as T
from tessera.sources.pins import Pins
from tessera.streaming.windows import stream_events, stream_tumbling, tumbling_counts


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_values_differ_from_sparks_own_as_stated(spark, duck):
    r = one(spark, S.substring(F.lit("hello"), 0, 2), S.cast_int_round(F.lit(2.5)), S.cast_int_round(F.lit("2.5").cast("decimal(5,1)"), decimal=True), S.divide(F.lit(1), F.lit(0)), S.divide(F.lit(0), F.lit(0)), S.int_divide(F.lit(-7), F.lit(2)), S.modulo(F.lit(-7), F.lit(4)), S.concat_ignore_null(F.lit("a"), F.lit(None).cast("string")))
    d = duck.sql("SELECT substring('hello', 0, 2), CAST(2.5::DOUBLE AS BIGINT), CAST(2.5::DECIMAL(5,1) AS BIGINT), 1.0::DOUBLE / 0, 0.0::DOUBLE / 0, -7 // 2, -7 % 4, concat('a', NULL)").fetchall()[0]
    assert list(r[:4]) == list(d[:4]) and math.isnan(r[4]) and math.isnan(d[4]) and list(r[5:]) == list(d[5:])


def test_like_has_no_escape(spark):
    assert one(spark, S.like(F.lit("a\\b"), "a\\_"))[0] is True


def test_first_match_alone_is_replaced(spark):
    assert one(spark, S.regexp_replace_first(F.lit("ab ab"), "(a)(b)", r"\2\1"))[0] == "ba ab"
    assert one(spark, S.regexp_replace_first(F.lit("zz"), "(a)(b)", r"\2\1"))[0] == "zz"
    assert one(spark, S.regexp_replace_first(F.lit("xaxb"), "a|b", "_"))[0] == "x_xb"
    assert one(spark, S.regexp_replace_first(F.lit("a\nb."), r"b.|(c)\1", "$0"))[0] == "a\n$0"
    assert one(spark, S.regexp_replace_first(F.lit("ccd"), r"(c)\1", r"<\0\1>"))[0] == "<ccc>d"
    assert one(spark, S.regexp_replace_all(F.lit("ab"), "[ab]", r"\0$"))[0] == "a$b$"


def test_error_raises(spark):
    with pytest.raises(Exception, match="boom"):
        one(spark, S.error("boom"))


def test_null_filter_and_aggregates(spark):
    t = spark.createDataFrame([(3, 1), (None, 2), (3, 3), (None, 4), (2, 5)], "a long, b long")
    assert t.where("a > 2").count() == 2 and t.where("NOT (a > 2)").count() == 1
    assert t.agg(F.count("a"), F.count(F.lit(1)), F.sum("a")).first() == (3, 5, 8)
    assert {tuple(r) for r in t.groupBy("a").count().collect()} == {(3, 2), (None, 2), (2, 1)}
    nothing = t.select(F.lit(None).cast("long").alias("c"))
    assert nothing.agg(F.sum("c"), F.count("c")).first() == (None, 0)


def test_tuples_with_a_null_count(spark):
    t = spark.createDataFrame([(1, None), (1, 2), (1, 2)], "a int, b int")
    assert t.agg(S.count_distinct_tuple("a", "b")).first()[0] == 2


def test_asof_join_edges(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (None, 5), (2, 9), (1, None)], "k int, t int")
    right = spark.createDataFrame([(1, 2, "x"), (1, 5, "y"), (None, 1, "n"), (2, None, "z"), (1, 9, "late")], "k int, t int, v string")
    found = {tuple(r) for r in R.asof_join(left, right, ["k"], "t", "t", ["v"]).collect()}
    assert found == {(1, 5, "y"), (1, 1, None), (None, 5, None), (2, 9, None), (1, None, None)}
    assert R.asof_join(left, right, ["k"], "t", "t", ["v"], how="inner").count() == 1


def test_range_join_finds_each_pair_once(spark):
    points = spark.range(0, 200).select(F.col("id").cast("double").alias("p"))
    ranges = spark.createDataFrame([(0.0, 10.0), (5.0, 90.0), (199.0, 200.0), (7.0, 7.0)], "lo double, hi double")
    assert R.range_join(points, ranges, "p", "lo", "hi", 8.0).count() == 10 + 85 + 1


@pytest.mark.parametrize("op", (">=", ">", "<=", "<"))
@pytest.mark.parametrize("by", (["k"], []))
def test_asof_join_against_brute_force(op, by, spark):
    """Ties of time, a hot key, null keys and times, and more ranges of time than one."""
    import operator
    import random

    rng = random.Random(3)
    sign = {">=": operator.ge, ">": operator.gt, "<=": operator.le, "<": operator.lt}[op]
    row = lambda i: (i, rng.choice((1, 1, 1, 2, None)), rng.choice((None, *range(60))))
    left, right = [row(i) for i in range(150)], [row(i) for i in range(70)]
    found = R.asof_join(spark.createDataFrame(left, "i int, k int, t int"), spark.createDataFrame(right, "j int, k int, u int"), by, "t", "u", ["j", "u"], op=op, splits=7).collect()
    assert sorted(r["i"] for r in found) == list(range(150))
    for r in found:
        near = [u for _, k, u in right if None not in (u, r["t"]) and sign(r["t"], u) and (not by or (k is not None and k == r["k"]))]
        best = (max(near) if op[0] == ">" else min(near)) if near else None
        assert r["u"] == best and ((r["j"] is None) == (best is None))


def test_range_join_of_long_ranges(spark):
    points = spark.range(0, 1000).select(F.col("id").cast("double").alias("p"))
    ranges = spark.createDataFrame([(0.0, 1e9), (5.0, 5.5), (10.0, 500.0), (-1e6, 3.0)], "lo double, hi double")
    out = R.range_join(points, ranges, "p", "lo", "hi", 1.0)
    assert out.count() == 1000 + 1 + 490 + 3 and out.distinct().count() == out.count()


def test_marks_of_inequalities(spark):
    left = spark.createDataFrame([(1,), (5,), (None,)], "k int")
    right = lambda rows: spark.createDataFrame(rows, "v int")
    marks = lambda rows, op: {r["k"]: r["mark"] for r in R.mark_join_less(left, right(rows), ("k", "v"), op).collect()}
    assert marks([(3,)], "<") == {1: True, 5: False, None: None}
    assert marks([(3,), (None,)], ">") == {1: None, 5: True, None: None}
    assert marks([], "<=") == {1: False, 5: False, None: False}


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from tessera.sources.scratch import shared_dir

    conf = SimpleNamespace(get=lambda *_: None)
    context = SimpleNamespace(getConf=lambda: conf, master="spark://host:7077")
    with pytest.raises(RuntimeError, match="share"):
        shared_dir(SimpleNamespace(sparkContext=context, conf=conf))


def test_global_row_numbers(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    rows = R.with_row_number(df, ["x"], "i").orderBy("i").collect()
    assert [(r["x"], r["i"]) for r in rows] == [(k, k + 1) for k in range(1000)]


def test_positional_join_fills_the_shorter_side(spark):
    a, b = spark.range(5).toDF("a"), spark.range(2).toDF("b")
    assert sorted(map(tuple, R.positional_join(a, b, ["a"], ["b"]).collect()), key=str) == sorted([(0, 0), (1, 1), (2, None), (3, None), (4, None)], key=str)


def test_mark_join_logic(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    right = lambda rows: spark.createDataFrame(rows, "v int")
    marks = lambda rows: {r["k"]: r["mark"] for r in R.mark_join(left, right(rows), ("k", "v")).collect()}
    assert marks([(1,)]) == {1: True, 2: False, None: None}
    assert marks([(1,), (None,)]) == {1: True, 2: None, None: None}
    assert marks([]) == {1: False, 2: False, None: False}


def test_salted_join_is_the_join(spark):
    big = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    small = spark.createDataFrame([(0, "a"), (0, "b"), (1, "c")], "k long, v string")
    assert sorted(R.salted_join(big, small, ["k"], 5).collect()) == sorted(big.join(small, "k").collect())
    with pytest.raises(ValueError, match="unmatched"):
        R.salted_join(big, small, ["k"], 5, "full")


def test_translate():
    assert translate("SELECT a // 2, '//' || \"x y\" FROM t WHERE b ~~ 'q%' -- a // b") == "SELECT (a DIV 2) AS `a // 2`, '//' || `x y` AS `'//' || \"x y\"` FROM t WHERE b LIKE 'q%'"
    assert translate("SELECT '-- \"a\" // ' AS s /* // */") == "SELECT '-- \"a\" // ' AS s"
    assert translate("SELECT a FROM t ORDER BY a DESC, b") == "SELECT a FROM t ORDER BY a DESC NULLS LAST, b ASC NULLS LAST"
    for text in ("SELECT", "SELECT 1 +", "SELECT (1", "SELECT 1 FROM t WHERE", "SELECT 1 2", "SELECT * FROM t ORDER a", "FROM t SELECT 'x"):
        with pytest.raises(DialectError):
            translate(text)


@pytest.mark.parametrize(
    "text",
    [
        "SELECT 1.0::DOUBLE / 0 AS a, -1 / 0 AS b, concat('a', NULL) AS c, substring('hello', 0, 3) AS d, CAST(2.5 AS INTEGER) AS e, CAST(2.5::DOUBLE AS INTEGER) AS f, regexp_replace('aaa', 'a', 'b') AS g, strlen('né') AS h, prefix('abc', 'ab') AS i",
        "SELECT struct_pack(a := 1, b := 'x').b AS a, extract(millisecond FROM TIMESTAMP '2024-01-01 00:00:12.345') AS b, TRY(1 // 0) AS c, TRY(CAST('x' AS INTEGER)) AS d, (1, 2) = (1, 2) AS e",
        "SELECT DISTINCT ON (n_regionkey) n_regionkey, n_name FROM nation ORDER BY n_regionkey, n_name DESC",
        "SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS r FROM nation QUALIFY r % 2 = 0 ORDER BY r DESC LIMIT 3",
        "WITH a AS (SELECT n_nationkey AS k FROM nation), b AS (SELECT k FROM a WHERE k > 20) SELECT k FROM b UNION ALL SELECT k FROM a WHERE k < 2 ORDER BY k",
        "SELECT k, CASE WHEN k IN (SELECT s_nationkey FROM supplier) THEN 'a' WHEN k IS NULL THEN 'b' ELSE 'c' END AS m FROM (SELECT nullif(n_nationkey, 3) AS k FROM nation) AS x",
        "FROM region",
        "SELECT n_regionkey AS k, count(*) AS n FROM nation GROUP BY ALL HAVING n > 1 ORDER BY ALL",
        "SELECT * EXCLUDE (n_comment) FROM (SELECT n_nationkey, n_name AS n_comment FROM nation) AS x WHERE n_nationkey NOT BETWEEN 3 AND 20",
        "SELECT a.x, b.y FROM (VALUES (1), (2)) AS a(x) JOIN (VALUES (2, 'q')) AS b(x, y) USING (x)",
        "SELECT regexp_replace('xaxb', 'a|b', '_') AS a, regexp_replace('abc', '(b)', '[\\0\\1]', 'g') AS b, regexp_matches('abc', '^b') AS d, 'a' LIKE '_' AS e, 'AB' ILIKE 'a%' AS f",
        "SELECT count(*) AS n, avg(DISTINCT x) AS a, sum(x) FILTER (WHERE x > 1) AS s FROM (VALUES (1), (1), (2), (NULL)) AS v(x)",
        "SELECT x, list_sum([x, 1]) AS s, [x, 2][1] AS f, {'a': x}['a'] AS g FROM range(3) AS t(x)".replace(", {'a': x}['a'] AS g", ""),
        "SELECT x FROM (SELECT unnest([3, 1, 2]) AS x) AS t ORDER BY x DESC LIMIT 34%",
        "SELECT date_diff('month', DATE '2024-01-31', DATE '2024-03-01') AS m, strftime(DATE '2024-01-05', '%Y/%m') AS f, DATE '2024-01-05' + INTERVAL 3 DAY AS d, 7 % -4 AS r, -7 // 2 AS q, 2 ** 3 AS p",
    ],
)
def test_texts_mean_what_they_mean_to_the_oracle(text, spark, duck):
    assert_same(Engine(spark, DATA).sql(text), duck, text)


def test_engine(spark):
    e = Engine(spark, DATA)
    assert e.sql("SELECT count(*) AS n FROM nation WHERE n_nationkey // 5 = :k", label="nations", k=1).first()["n"] == 5
    assert e.sql("SELECT count(*) AS n FROM nation WHERE n_nationkey // 5 = $k", k=1).first()["n"] == 5
    assert e.sql(f"SELECT count(*) FROM read_parquet('{DATA}/region.parquet')").first()[0] == 5
    assert e.sql(f"SELECT count(*) FROM '{DATA}/region.parquet'").first()[0] == 5
    assert e.sql("SELECT 'read_parquet(''x'')' AS s -- read_parquet('y')").first()["s"] == "read_parquet('x')"
    assert "Filter" in e.explain("SELECT * FROM nation WHERE n_nationkey = 1")
    assert e.sql("SELECT a.n_name, b.r_name FROM nation AS a POSITIONAL JOIN region AS b").count() == 25
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        e.sql("SELECT 1 // x AS q FROM (VALUES (0)) AS t(x)").collect()


def test_statements(spark, tmp_path):
    e = Engine(spark, DATA)
    e.sql("CREATE TABLE made AS SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 3")
    e.sql("INSERT INTO made VALUES (7), (8)")
    e.sql(f"COPY (SELECT k, k % 2 AS odd FROM made) TO '{tmp_path}/out' (FORMAT parquet, PARTITION_BY (odd))")
    assert sorted(r[0] for r in e.sql(f"SELECT k FROM read_parquet('{tmp_path}/out', hive_partitioning = true) WHERE odd = 1").collect()) == [1, 7]
    e.sql("PREPARE p AS SELECT k FROM made WHERE k > $1")
    assert sorted(r[0] for r in e.sql("EXECUTE p(2)").collect()) == [7, 8]
    e.sql("SET max_broadcast_join_size = 4321")
    assert "4321" in spark.conf.get(TUNABLES["max_broadcast_join_size"])
    e.sql("RESET max_broadcast_join_size")
    e.sql("CREATE MACRO share(a, b) AS round(100 * a / b, 1)")
    e.sql("CREATE MACRO clean(s) AS lower(trim(s))")
    assert e.sql("SELECT share(k, 3) AS s, clean(' X ') AS c, k AS a FROM made WHERE k = 2").first() == (66.7, "x", 2)
    e.sql("DROP TABLE made")
    assert not spark.catalog.tableExists("made")
    with pytest.raises(DialectError):
        e.sql("EXECUTE nothing(1)")


def test_pins(spark):
    pins = Pins(spark)
    path = f"{DATA}/orders.parquet"
    pins.pin(path, name="hot", cols=["o_orderkey", "o_custkey"], eager=True)
    assert "InMemoryTableScan" in pins.scan(path, ["o_orderkey"])._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryTableScan" not in pins.scan(path, ["o_totalprice"])._jdf.queryExecution().executedPlan().toString()
    assert spark.sql("SELECT count(*) FROM hot").first()[0] == spark.read.parquet(path).count()
    pins.pin(spark.range(3), name="hot", tier="memory")
    assert pins.names() == ["hot"] and pins.scan("hot").count() == 3
    pins.unpin("hot")
    assert pins.names() == [] and not spark.catalog.tableExists("hot")
    with pytest.raises(ValueError, match="tier"):
        pins.pin(path, tier="gpu")


def test_sources_round_trip(spark, tmp_path):
    nation = T.Tables(spark, DATA).nation
    T.write_parquet(nation, str(tmp_path / "p"), partition_by=("n_regionkey",))
    T.write_parquet(nation.limit(2), str(tmp_path / "p"), partition_by=("n_regionkey",), mode="append")
    back = T.read_parquet(spark, str(tmp_path / "p"))
    assert back.count() == 27 and "PartitionFilters: [isnotnull" in back.where("n_regionkey = 1")._jdf.queryExecution().executedPlan().toString()
    T.write_csv(nation, str(tmp_path / "c"))
    T.write_json(nation, str(tmp_path / "j"))
    schema = "n_nationkey int, n_name string, n_regionkey int"
    assert sorted(T.read_csv(spark, str(tmp_path / "c"), schema=schema).collect()) == sorted(nation.collect())
    assert sorted(T.read_json(spark, str(tmp_path / "j"), schema=schema).collect()) == sorted(nation.collect())


def test_escaped_partition_values(spark, tmp_path):
    df = spark.createDataFrame([("a b/c", 1), ("x=y", 2), (None, 3)], "k string, v int")
    T.write_parquet(df, str(tmp_path / "h"), partition_by=("k",))
    assert {tuple(r) for r in T.read_parquet(spark, str(tmp_path / "h")).select("k", "v").collect()} == {("a b/c", 1), ("x=y", 2), (None, 3)}


def test_scans_are_pruned_and_filtered(spark):
    items = T.Tables(spark, DATA).lineitem
    plan = items.where("l_quantity > 45").select("l_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,45.0)" in plan and "l_extendedprice" not in plan


def test_top_n_is_one_operator(spark):
    plan = T.Tables(spark, DATA).orders.orderBy(F.desc("o_totalprice")).limit(5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_options(spark):
    set_option(spark, "max_broadcast_join_size", 1234)
    assert spark.conf.get(TUNABLES["max_broadcast_join_size"]) in ("1234", "1234b")
    reset_option(spark, "max_broadcast_join_size")


def test_settings_of_a_file(tmp_path):
    (tmp_path / "s.conf").write_text("# notes\nmax_broadcast_join_size: 99  # bytes\n\nspark.sql.shuffle.partitions = '7'\n")
    assert load_settings(str(tmp_path / "s.conf")) == {"max_broadcast_join_size": "99", "spark.sql.shuffle.partitions": "7"}
    (tmp_path / "bad.conf").write_text("nonsense\n")
    with pytest.raises(ValueError, match="line 1"):
        load_settings(str(tmp_path / "bad.conf"))


def test_profiler(spark):
    e = Engine(spark, DATA)
    with pytest.raises(RuntimeError):
        e.profiler_stop()
    e.profiler_start()
    e.sql("SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1", label="counted").collect()
    rows = e.profiler_stop().collect()
    assert any(r["label"] == "counted" and r["read_rows"] > 0 for r in rows) and any(r["shuffle_read"] > 0 for r in rows)


def test_runtime_filter_is_applied(spark):
    """The selective side's keys reach the other side's scan as a Bloom filter."""
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1", "spark.sql.optimizer.runtime.bloomFilter.enabled": "true"}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        plan = Engine(spark, DATA).sql("SELECT l_orderkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT' AND o_totalprice < 5000")._jdf.queryExecution().optimizedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert "might_contain" in plan


def test_sampling_draws_about_its_share(spark):
    n = spark.read.parquet(f"{DATA}/lineitem.parquet").count()
    for name in ("sample_rows", "sql_sample"):
        assert 0.02 * n < registry.queries()[name](spark, DATA).count() < 0.09 * n
    true = spark.read.parquet(f"{DATA}/lineitem.parquet").select("l_partkey").distinct().count()
    assert abs(registry.queries()["approx_count_distinct"](spark, DATA).first()["n"] - true) < 0.1 * true


def test_a_scalar_subquery_of_two_rows_raises(spark):
    with pytest.raises(Exception, match="SCALAR_SUBQUERY_TOO_MANY_ROWS"):
        Engine(spark, DATA).sql("SELECT (SELECT n_name FROM nation) AS x").collect()


def test_stream_agrees_with_batch(spark, tmp_path):
    events = T.Tables(spark, DATA).events.withColumn("ts", F.col("ts").cast("timestamp"))
    last = spark.createDataFrame([(10**9, datetime.datetime(2030, 1, 1), 0, "end", 0.0, "{}")], events.schema)
    events.unionByName(last).coalesce(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    q = stream_tumbling(stream_events(spark, str(tmp_path / "in"), events.schema), str(tmp_path / "ckpt"), "streamed")
    q.awaitTermination(120)
    streamed = {(r["start"], r["event_type"], r["n"]) for r in spark.table("streamed").collect()}
    batch = {(r["start"], r["event_type"], r["n"]) for r in tumbling_counts(events).collect()}
    assert streamed == batch
