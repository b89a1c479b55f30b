"""Arrays, structs, maps and JSON; unnesting and pivoting."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import again_as_text, query, text


@query("array_passthrough", "SELECT vec_id, embedding FROM embeddings WHERE label = 1")
def array_passthrough(t):
    return t.embeddings.where("label = 1").select("vec_id", "embedding")


text("array_length_elem", "SELECT vec_id, len(embedding) AS n, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[-1] AS DOUBLE) AS z FROM embeddings")


@query("array_aggregates", "SELECT vec_id, CAST(list_max(embedding) AS DOUBLE) AS hi, CAST(list_min(embedding) AS DOUBLE) AS lo, len(list_filter(embedding, lambda x: x > 0)) AS n_pos FROM embeddings")
def array_aggregates(t):
    e = F.col("embedding")
    return t.embeddings.select("vec_id", F.array_max(e).cast("double").alias("hi"), F.array_min(e).cast("double").alias("lo"), F.size(F.filter(e, lambda x: x > 0)).cast("long").alias("n_pos"))


@query("array_dot_product", "SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE))), 5) AS dot FROM embeddings AS a CROSS JOIN (SELECT embedding FROM embeddings WHERE vec_id = 0) AS b")
def array_dot_product(t):
    one = t.embeddings.where("vec_id = 0").select(F.col("embedding").alias("b"))
    products = F.zip_with("embedding", "b", lambda x, y: x.cast("double") * y.cast("double"))
    return t.embeddings.crossJoin(F.broadcast(one)).select("vec_id", F.round(F.aggregate(products, F.lit(0.0), lambda s, x: s + x), 5).alias("dot"))  # one row


@query("unnest", "SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings")
def unnest(t):
    return t.embeddings.select("vec_id", F.posexplode("embedding").alias("i", "x")).select("vec_id", F.col("i").cast("long").alias("i"), F.col("x").cast("double").alias("x"))


text("unnest_literal", "SELECT n_name, unnest([n_nationkey, n_regionkey]) AS x FROM nation")
text("unnest_outer_empty", "SELECT c_custkey, unnest(CASE WHEN c_nationkey = 3 THEN [] ELSE [c_nationkey] END) AS x FROM customer")
text("json_extract", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing') AS m FROM events")


@query("json_struct", "SELECT k, count(*) AS n FROM (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) AS x GROUP BY k")
def json_struct(t):
    return t.events.select(F.from_json("props", "k BIGINT").alias("p")).groupBy("p.k").agg(F.count(F.lit(1)).alias("n"))


@query("map_lookup", "SELECT n_nationkey, map {'name': n_name, 'region': CAST(n_regionkey AS VARCHAR)}['region'] AS r FROM nation")
def map_lookup(t):
    return t.nation.select("n_nationkey", F.create_map(F.lit("name"), "n_name", F.lit("region"), F.col("n_regionkey").cast("string"))["region"].alias("r"))


@query("pivot", "SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F') AS F, count(*) FILTER (WHERE l_linestatus = 'O') AS O FROM lineitem GROUP BY l_returnflag")
def pivot(t):
    return t.lineitem.groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1))).na.fill(0)


@query("unpivot", "SELECT n_nationkey, name, value FROM (SELECT n_nationkey, n_regionkey AS a, n_nationkey * 2 AS b FROM nation) AS x UNPIVOT (value FOR name IN (a, b))")
def unpivot(t):
    return t.nation.selectExpr("n_nationkey", "n_regionkey AS a", "n_nationkey * 2 AS b").unpivot(["n_nationkey"], ["a", "b"], "name", "value")


@query("type_zoo", "SELECT p_partkey, CAST(p_size AS TINYINT) AS i1, CAST(p_size AS SMALLINT) AS i2, CAST(p_partkey AS INTEGER) AS i4, CAST(p_retailprice AS FLOAT) AS f4, CAST(p_retailprice AS DECIMAL(9,2)) AS d9, p_size > 25 AS b, DATE '1995-01-01' + p_size AS dt FROM part")
def type_zoo(t):
    c = F.col
    return t.part.select("p_partkey", c("p_size").cast("tinyint").alias("i1"), c("p_size").cast("smallint").alias("i2"), c("p_partkey").cast("int").alias("i4"), c("p_retailprice").cast("float").alias("f4"), c("p_retailprice").cast("decimal(9,2)").alias("d9"), (c("p_size") > 25).alias("b"), F.date_add(F.lit("1995-01-01").cast("date"), c("p_size")).alias("dt"))


again_as_text("unnest", "array_aggregates", "map_lookup", "unpivot", "type_zoo", "json_struct")
text("sql_struct_literal", "SELECT n_nationkey, {'name': n_name, 'key': n_regionkey}.key AS k, [n_nationkey, n_regionkey][2] AS r, [n_nationkey, n_regionkey, 7][2:3] AS tail FROM nation")
text("sql_list_functions", "SELECT n_nationkey, list_sort([n_regionkey, n_nationkey, 3]) AS s, list_contains([1, 2, 3], n_regionkey) AS c, len(list_transform([n_nationkey, 2], lambda x: x + 1)) AS n FROM nation")
