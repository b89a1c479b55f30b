"""Scans, filters, projections and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import semantics as S
from ..sources.pins import Pins
from ..sources.scratch import shared_dir
from ..sources.tables import read_csv, read_json, read_parquet, write_csv, write_json, write_parquet
from .catalog import again_as_text, query, text
from .engine import Engine


@query("scan_columns", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def scan_columns(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity")


@query("count_star", "SELECT count(*) AS n FROM lineitem")
def count_star(t):
    return t.lineitem.agg(F.count(F.lit(1)).alias("n"))


@query("filter_cmp", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 45 AND l_discount < 0.03 AND l_returnflag <> 'R'")
def filter_cmp(t):
    return t.lineitem.where("l_quantity >= 45 AND l_discount < 0.03D AND l_returnflag <> 'R'").select("l_orderkey", "l_linenumber")


@query("filter_between", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate BETWEEN DATE '1996-03-01' AND DATE '1996-05-31'")
def filter_between(t):
    return t.orders.where(F.col("o_orderdate").between(F.lit("1996-03-01").cast("date"), F.lit("1996-05-31").cast("date"))).select("o_orderkey", "o_orderdate")


@query("filter_in", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey IN (1, 3, 5)")
def filter_in(t):
    return t.customer.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & F.col("c_nationkey").isin(1, 3, 5)).select("c_custkey", "c_mktsegment")


text("filter_not_in_null", "SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (1, 2, NULL) OR c_custkey = 7")
text("filter_like", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'b%' AND p_name LIKE '%_l%'")
text("filter_not_like", "SELECT p_partkey FROM part WHERE p_name NOT LIKE '%blue%'")
text("filter_like_operator", "SELECT p_partkey FROM part WHERE p_name ~~ '%blue%' AND p_type !~~ 'ECO%'")


@query("filter_contains_prefix_suffix", "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'an') AND (prefix(p_name, 'b') OR suffix(p_name, 'l'))")
def filter_contains(t):
    n = F.col("p_name")
    return t.part.where(n.contains("an") & (n.startswith("b") | n.endswith("l"))).select("p_partkey", "p_name")


@query("filter_is_distinct", "SELECT o_orderkey FROM orders WHERE nullif(o_orderstatus, 'F') IS NOT DISTINCT FROM nullif(o_orderpriority, o_orderpriority) OR nullif(o_orderstatus, 'O') IS DISTINCT FROM 'P'")
def filter_is_distinct(t):
    f, o = F.nullif("o_orderstatus", F.lit("F")), F.nullif("o_orderstatus", F.lit("O"))
    return t.orders.where(f.eqNullSafe(F.nullif("o_orderpriority", F.col("o_orderpriority"))) | ~o.eqNullSafe(F.lit("P"))).select("o_orderkey")


text("filter_three_valued", "SELECT o_orderkey, a AND b AS both_, a OR b AS any_, NOT a AS not_ FROM (SELECT o_orderkey, nullif(o_orderstatus, 'P') = 'F' AS a, nullif(o_orderpriority, '5-LOW') = '1-URGENT' AS b FROM orders) AS x")
text("filter_is_null", "SELECT count(*) AS n, count(a) AS n_a FROM (SELECT nullif(o_orderstatus, 'P') AS a FROM orders) AS x WHERE a IS NULL OR a IS NOT NULL AND a = 'F'")
text("filter_range_bounds", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 10 AND l_quantity <= 12 AND NOT (l_linenumber BETWEEN 2 AND 4)")

text("project_arith", "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) * 3 - l_linenumber + 1 AS a, l_orderkey % 7 AS m, -l_orderkey AS neg FROM lineitem")


@query("project_int_div_mod", "SELECT o_orderkey, CAST((o_custkey - 700) // 8 AS BIGINT) AS q, (o_custkey - 700) % 8 AS r, o_custkey / 8 AS d, CAST(TRY(o_custkey // 0) AS BIGINT) AS z FROM orders")
def int_div_mod(t):
    k = F.col("o_custkey")
    return t.orders.select("o_orderkey", S.int_divide(k - 700, F.lit(8)).alias("q"), S.modulo(k - 700, F.lit(8)).alias("r"), S.divide(k, F.lit(8)).alias("d"), S.int_divide(k, F.lit(0)).alias("z"))


text("project_int_div_text", "SELECT o_orderkey, CAST((o_custkey - 700) // 8 AS BIGINT) AS q FROM orders")
text("project_case", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 10 THEN 'never' WHEN p_size < 30 THEN 'medium' END AS size_, CASE p_type WHEN 'PROMO' THEN 1 ELSE 0 END AS promo FROM part")
text("project_coalesce_nullif", "SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), nullif(c_name, c_name), 'none') AS segment, nullif(c_nationkey, 3) AS nation FROM customer")


@query("project_cast_round", "SELECT l_orderkey, l_linenumber, CAST(l_extendedprice / 7 AS BIGINT) AS d, CAST(CAST(l_extendedprice AS DECIMAL(15,2)) AS BIGINT) AS m, CAST(l_quantity AS VARCHAR) AS s, CAST(l_linenumber AS DOUBLE) AS f, CAST(CAST(l_orderkey AS VARCHAR) AS INTEGER) AS i FROM lineitem")
def cast_round(t):
    p = F.col("l_extendedprice")
    return t.lineitem.select("l_orderkey", "l_linenumber", S.cast_int_round(p / 7).alias("d"), S.cast_int_round(S.money(p), decimal=True).alias("m"), F.col("l_quantity").cast("string").alias("s"), F.col("l_linenumber").cast("double").alias("f"), F.col("l_orderkey").cast("string").cast("int").alias("i"))


text("try_cast", "SELECT p_partkey, TRY_CAST(split_part(p_brand, '#', 2) AS INTEGER) AS brand, TRY_CAST(p_name AS INTEGER) AS none_ FROM part")


@query("divide_by_zero", "SELECT l_orderkey, l_linenumber, (l_quantity - 10) / (l_linenumber - 1) AS q FROM lineitem WHERE l_quantity <> 10")
def divide_by_zero(t):
    return t.lineitem.where("l_quantity <> 10").select("l_orderkey", "l_linenumber", S.divide(F.col("l_quantity") - 10, F.col("l_linenumber") - 1).alias("q"))


text("dummy_scan", "SELECT 1 AS one, 'x' AS x, CAST(NULL AS INTEGER) AS nothing")
text("values", "SELECT a, b FROM (VALUES (1, 'x'), (2, NULL), (3, 'z')) AS v(a, b)")
text("empty_result", "SELECT l_orderkey FROM lineitem WHERE 1 = 0")


@query("substring", "SELECT p_partkey, substring(p_name, 0, 3) AS a, substring(p_name, 2, 4) AS b, substring(p_name, -3, 2) AS c, substring(p_name, 4) AS d, substring(p_name, 0) AS e FROM part")
def substring(t):
    return t.part.select("p_partkey", S.substring("p_name", 0, 3).alias("a"), S.substring("p_name", 2, 4).alias("b"), S.substring("p_name", -3, 2).alias("c"), S.substring("p_name", 4).alias("d"), S.substring("p_name", 0).alias("e"))


@query("strlen_length", "SELECT doc_id, strlen(text) AS bytes, length(text) AS chars FROM documents")
def strlen_length(t):
    return t.documents.select("doc_id", S.strlen("text").alias("bytes"), S.length("text").alias("chars"))


@query("regexp_replace_backref", r"SELECT p_partkey, regexp_replace(p_brand, '([A-Za-z]+)#(\d)', '\2-\1') AS first_, regexp_replace(p_name, '[aeiou]', '*', 'g') AS every FROM part")
def regexp_backref(t):
    return t.part.select("p_partkey", S.regexp_replace_first("p_brand", r"([A-Za-z]+)#(\d)", r"\2-\1").alias("first_"), S.regexp_replace_all("p_name", "[aeiou]", "*").alias("every"))


@query("concat_vs_pipe", "SELECT c_custkey, concat(nullif(c_mktsegment, 'BUILDING'), '/', c_name) AS c, nullif(c_mktsegment, 'BUILDING') || '/' || c_name AS p FROM customer")
def concat_vs_pipe(t):
    s = F.nullif("c_mktsegment", F.lit("BUILDING"))
    return t.customer.select("c_custkey", S.concat_ignore_null(s, F.lit("/"), "c_name").alias("c"), F.concat(s, F.lit("/"), "c_name").alias("p"))


text("date_parts", "SELECT event_id, CAST(year(ts) AS BIGINT) AS y, CAST(month(ts) AS BIGINT) AS m, CAST(day(ts) AS BIGINT) AS d, CAST(hour(ts) AS BIGINT) AS h, CAST(minute(ts) AS BIGINT) AS mi, CAST(second(ts) AS BIGINT) AS s FROM events")


@query("subsecond_parts", "SELECT event_id, millisecond(ts) AS ms, microsecond(ts) AS us FROM (SELECT event_id, ts + to_microseconds(event_id * 1237) AS ts FROM events) AS x")
def subsecond(t):
    ts = F.expr("ts + make_dt_interval(0, 0, 0, event_id * 0.001237BD)")
    return t.events.select("event_id", ts.alias("ts")).select("event_id", S.millisecond("ts").alias("ms"), S.microsecond("ts").alias("us"))


_UNITS = ("year", "quarter", "month", "week", "day", "hour", "minute", "second")


@query("date_trunc_units", "SELECT event_id, " + ", ".join(f"CAST(date_trunc('{u}', ts) AS TIMESTAMP) AS t_{u}" for u in _UNITS) + " FROM events")
def date_trunc_units(t):
    return t.events.select("event_id", *(S.date_trunc(u, "ts").alias(f"t_{u}") for u in _UNITS))


@query("struct_pack", "SELECT n_nationkey, struct_pack(name := n_name, region := n_regionkey) AS s, struct_pack(name := n_name).name AS name FROM nation")
def struct_pack(t):
    return t.nation.select("n_nationkey", F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).alias("s"), F.named_struct(F.lit("name"), "n_name")["name"].alias("name"))


text("math_functions", "SELECT p_partkey, abs(p_size - 25) AS a, round(p_retailprice / 3, 2) AS r, CAST(floor(p_retailprice) AS BIGINT) AS f, CAST(ceil(p_retailprice) AS BIGINT) AS c, round(sqrt(p_retailprice), 6) AS s, round(ln(p_retailprice), 6) AS l, sign(p_size - 25) * 1.0 AS g, greatest(p_size, 10) AS hi, least(p_size, 10) AS lo FROM part".replace("sign(p_size - 25) * 1.0", "CAST(sign(p_size - 25) AS BIGINT)"))
text("string_functions", "SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, trim(concat(' ', p_name, ' ')) AS t, replace(p_name, 'blue', 'red') AS r, reverse(p_name) AS v, lpad(p_type, 10, '*') AS lp, rpad(p_type, 10, '*') AS rp, left(p_name, 3) AS le, right(p_name, 3) AS ri, split_part(p_name, ' ', 2) AS sp, repeat(p_type, 2) AS re FROM part")
text("regexp_match", "SELECT p_partkey FROM part WHERE regexp_matches(p_name, '^[a-m].* [n-z]')")


@query("raise_error_branch", "SELECT p_partkey, CASE WHEN p_size > 0 THEN p_size ELSE CAST(error('size') AS INTEGER) END AS s FROM part")
def raise_error_branch(t):
    return t.part.select("p_partkey", F.when(F.col("p_size") > 0, F.col("p_size")).otherwise(S.error("size").cast("int")).alias("s"))


@query("pin_scan", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 40")
def pin_scan(t):
    """One pin for all calls on a folder: pinning a name again would replace it."""
    pins = _PINS.setdefault(t.spark.sparkContext.applicationId, Pins(t.spark))
    path = f"{t.folder}/lineitem.parquet"
    if pins.path_of("pinned_lineitem") != path:
        pins.pin(path, name="pinned_lineitem", cols=["l_orderkey", "l_quantity", "l_shipdate"])
    return pins.scan("pinned_lineitem", ["l_orderkey", "l_quantity"]).where("l_quantity > 40")


@query("unpin_scan", "SELECT n_nationkey, n_name FROM nation")
def unpin_scan(t):
    """After unpin() the same source is read from its files."""
    pins = Pins(t.spark)
    path = f"{t.folder}/nation.parquet"
    pins.pin(path, name="pinned_nation")
    pins.unpin("pinned_nation")
    return pins.scan(path, ["n_nationkey", "n_name"])


_PINS: dict[str, Pins] = {}


def _folder(t, name: str) -> str:
    """A folder of this query in the shared one; what an earlier call left there is replaced."""
    return f"{shared_dir(t.spark)}/tessera/{name}-{t.spark.sparkContext.applicationId}"


@query("copy_round_trip", "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey IN (1, 2)")
def copy_round_trip(t):
    """COPY to Parquet by region, and a scan that prunes to two of its folders."""
    path = _folder(t, "copy")
    write_parquet(t.nation, path, partition_by=("n_regionkey",), mode="overwrite")
    return read_parquet(t.spark, path).where("n_regionkey IN (1, 2)").select("n_nationkey", "n_name", "n_regionkey")


@query("csv_round_trip", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_round_trip(t):
    path = _folder(t, "csv")
    write_csv(t.nation, path, mode="overwrite")
    return read_csv(t.spark, path, schema="n_nationkey int, n_name string, n_regionkey int")


@query("json_round_trip", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def json_round_trip(t):
    path = _folder(t, "json")
    write_json(t.nation, path, mode="overwrite")
    return read_json(t.spark, path, schema="n_nationkey int, n_name string, n_regionkey int")


@query("create_table_as", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey")
def create_table_as(t):
    t.register("orders")
    engine = Engine(t.spark)
    engine.sql("CREATE OR REPLACE TABLE tessera_ctas AS SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey")
    return t.spark.table("tessera_ctas")


@query("insert_into", "SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region UNION ALL SELECT 99, NULL")
def insert_into(t):
    t.register("nation", "region")
    engine = Engine(t.spark)
    engine.sql("CREATE OR REPLACE TABLE tessera_insert AS SELECT n_nationkey AS k, n_name AS name FROM nation")
    engine.sql("INSERT INTO tessera_insert SELECT r_regionkey, r_name FROM region")
    engine.sql("INSERT INTO tessera_insert (k) VALUES (99)")
    return t.spark.table("tessera_insert")


@query("memory_rows", "SELECT * FROM (VALUES (1, 'a', 1.5::DOUBLE), (2, NULL, -0.5::DOUBLE), (NULL, 'c', NULL)) AS v(k, s, x)")
def memory_rows(t):
    """Rows of the caller, joined to no file."""
    return t.spark.createDataFrame([(1, "a", 1.5), (2, None, -0.5), (None, "c", None)], "k int, s string, x double")


@query("view_of_query", "SELECT n_regionkey, count(*) AS n FROM nation WHERE n_nationkey > 3 GROUP BY n_regionkey")
def view_of_query(t):
    t.register("nation")
    engine = Engine(t.spark)
    engine.sql("CREATE OR REPLACE TEMP VIEW tessera_some AS SELECT * FROM nation WHERE n_nationkey > 3")
    return engine.sql("SELECT n_regionkey, count(*) AS n FROM tessera_some GROUP BY n_regionkey")


@query("prepare_execute", "SELECT o_orderkey FROM orders WHERE o_custkey = 42 AND o_orderstatus <> 'P'")
def prepare_execute(t):
    t.register("orders")
    engine = Engine(t.spark)
    engine.sql("PREPARE some AS SELECT o_orderkey FROM orders WHERE o_custkey = ? AND o_orderstatus <> ?")
    return engine.sql("EXECUTE some(42, 'P')")


@query("explain_query")
def explain_query(t):
    t.register("nation")
    return Engine(t.spark).sql("EXPLAIN SELECT * FROM nation WHERE n_nationkey = 1")


@query("read_parquet_list", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")
def read_parquet_list(t):
    """File functions with a glob, a list and options."""
    return Engine(t.spark).sql(f"SELECT n_name AS name FROM read_parquet(['{t.folder}/nation.parquet'], hive_partitioning = false) UNION ALL SELECT r_name FROM read_parquet('{t.folder}/regio*.parquet')")


again_as_text("filter_contains_prefix_suffix", "project_int_div_mod", "project_cast_round", "divide_by_zero", "substring", "strlen_length", "regexp_replace_backref", "concat_vs_pipe", "subsecond_parts", "date_trunc_units", "struct_pack", "raise_error_branch")
text("sql_like_backslash", "SELECT p_partkey, p_name LIKE 'b\\_%' AS a, concat(p_name, '\\') LIKE '%\\' AS b, p_name LIKE '%!_%' ESCAPE '!' AS c FROM part")
text("sql_extract_parts", "SELECT event_id, CAST(extract(millisecond FROM ts) AS BIGINT) AS ms, CAST(extract(dow FROM ts) AS BIGINT) AS dow, CAST(date_part('doy', ts) AS BIGINT) AS doy, CAST(extract(week FROM ts) AS BIGINT) AS w FROM events")
text("sql_cast_rounding", "SELECT l_orderkey, l_linenumber, CAST(l_quantity / 2 AS INTEGER) AS a, (l_extendedprice::DECIMAL(15,2) / 3)::BIGINT AS b, CAST(CAST(l_quantity AS DECIMAL(9,1)) * 0.5 AS INTEGER) AS c, TRY_CAST('2.5' AS INTEGER) AS d, CAST(l_quantity > 25 AS INTEGER) AS e FROM lineitem")
text("sql_nan_order", "SELECT k, x FROM (VALUES (1, 'nan'::DOUBLE), (2, 'inf'::DOUBLE), (3, 1.0::DOUBLE), (4, NULL)) AS v(k, x) WHERE x > 0.5 OR x IS NULL ORDER BY x DESC, k")
