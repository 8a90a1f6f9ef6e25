"""Queries over nested rows, intervals and samples, each with its DuckDB text."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomgraph.functions import scalar
from loomgraph.operators import nested, search, similarity
from loomgraph.session import table

QUERIES: dict = {}


def query(name, sql):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return add


def _orders(spark, d):
    """Customers' orders as lists: keys and prices in parallel, nested in one object."""
    lists = table(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_totalprice"))).alias("o"))
    return lists.select("o_custkey", F.struct(F.col("o.o_orderkey").alias("key"), F.col("o.o_totalprice").alias("price")).alias("orders"))


@query("nest1_zip_lists", "SELECT o_custkey, o_orderkey AS key, o_totalprice AS price FROM orders")
def nest1(spark, d):
    zipped = nested.zip_lists(_orders(spark, d), ["orders|key", "orders|price"], "orders|both")
    return zipped.select("o_custkey", F.explode("orders.both").alias("b")).select("o_custkey", "b.key", "b.price")


@query("nest2_unpack_one", "SELECT n_nationkey, n_name AS name FROM nation")
def nest2(spark, d):
    df = table(spark, d, "nation").select("n_nationkey", F.array("n_name").alias("name"))
    return nested.unpack_one(df, "name")


@query("nest3_unroll", "SELECT o_custkey, max(o_totalprice) FILTER (o_orderstatus = 'F') AS F, max(o_totalprice) FILTER (o_orderstatus = 'O') AS O FROM orders GROUP BY o_custkey")
def nest3(spark, d):
    best = table(spark, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.max("o_totalprice").alias("v"))
    lists = best.groupBy("o_custkey").agg(F.collect_list(F.struct(F.col("o_orderstatus").alias("k"), "v")).alias("kv"))
    return nested.unroll(lists, "kv", "k", "v", ["F", "O"]).drop("kv")


@query("nest4_add_literal", "SELECT o_custkey, o_orderkey AS key, 'x' AS tag FROM orders")
def nest4(spark, d):
    df = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct(F.col("o_orderkey").alias("key"))).alias("orders"))
    return nested.add_literal(df, "orders|tag", "x").select("o_custkey", F.inline("orders"))


@query("nest5_join_list", "SELECT n_regionkey, string_agg(n_name, '; ' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def nest5(spark, d):
    df = table(spark, d, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("names"))
    return nested.join_list(df, "names", "; ")


@query("nest6_computed", "SELECT c_custkey, CASE WHEN c_nationkey = 0 THEN '' ELSE c_nationkey::varchar END || '/' || c_name AS uri FROM customer")
def nest6(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_name")
    return nested.computed(df, ["c_nationkey", "c_name"], "uri", lambda a, b: F.concat(a, F.lit("/"), b)).select("c_custkey", "uri")


@query("nest8_regex_filter", "SELECT p_partkey FROM part WHERE regexp_matches(p_type, '^[A-S]') AND NOT regexp_matches(p_type, 'STEEL$')")
def nest8(spark, d):
    return nested.regex_filter(table(spark, d, "part"), "p_type", "^[A-S]", "STEEL$").select("p_partkey")


@query("nest14_path_values", "SELECT o_orderkey AS value FROM orders")
def nest14(spark, d):
    return nested.explode_paths(_orders(spark, d), "orders|key")


@query("nest16_unique_views", "SELECT DISTINCT c_nationkey, c_mktsegment, c_nationkey || ',' || c_mktsegment AS view_key FROM customer")
def nest16(spark, d):
    t = table(spark, d, "customer").select("c_nationkey", "c_mktsegment")
    return nested.instances(t, "", ["c_nationkey", "c_mktsegment"])


@query("rel5_distinct", "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def rel5(spark, d):
    return table(spark, d, "customer").select("c_nationkey", "c_mktsegment").distinct()


@query("rel3_limit", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25")
def rel3(spark, d):
    return table(spark, d, "orders").orderBy("o_orderkey").limit(25).select("o_orderkey")


@query("rel16_enumerate", "SELECT n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1 AS i FROM nation")
def rel16(spark, d):
    lists = table(spark, d, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("ns"))
    return lists.select(F.posexplode("ns").alias("i", "n_name")).select("n_name", F.col("i").cast("long").alias("i"))


@query("rel19_fold", "SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey")
def rel19(spark, d):
    total = F.aggregate("orders.price", F.lit(0.0), lambda s, x: s + x)
    return _orders(spark, d).select("o_custkey", F.round(total, 2).alias("total"))


@query("rel21_unzip", "SELECT o_custkey, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders GROUP BY o_custkey")
def rel21(spark, d):
    return _orders(spark, d).select("o_custkey", F.array_min("orders.key").alias("first"), F.array_max("orders.key").alias("last"))


@query("rel27_range_overlap", "WITH r AS (SELECT r_regionkey AS k, r_regionkey * 10 AS a, r_regionkey * 10 + 15 AS b FROM region) SELECT x.k AS k, p_partkey FROM r x JOIN part ON p_size < x.b AND x.a < p_size + 1")
def rel27(spark, d):
    # Ranges are cut into cells of 8, so the join is an equality on cells before it is a range.
    r = table(spark, d, "region").select(F.col("r_regionkey").alias("k"), (F.col("r_regionkey") * 10).alias("a"), (F.col("r_regionkey") * 10 + 15).alias("b"))
    r = r.withColumn("cell", F.explode(F.sequence(F.expr("(a - 1) div 8"), F.expr("b div 8"))))
    p = table(spark, d, "part").select("p_partkey", "p_size", F.expr("p_size div 8").alias("cell"))
    return p.join(r, "cell").where("p_size < b and a < p_size + 1").select("k", "p_partkey").distinct()


@query("agg20_paired_order", "SELECT o_orderpriority, round(avg((o_totalprice >= o_custkey)::int), 6) AS share FROM orders GROUP BY 1")
def agg20(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.round(F.avg((F.col("o_totalprice") >= F.col("o_custkey")).cast("double")), 6).alias("share"))


@query("agg24_running_mean", "SELECT event_id, (sum(round(value * 100)::bigint) OVER w)::bigint AS cents, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def agg24(spark, d):
    # Sum and count, the accumulator's state, in whole cents: a rounded mean would differ by its last digit.
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    cents = F.round(F.col("value") * 100).cast("long")
    return table(spark, d, "events").select("event_id", F.sum(cents).over(w).alias("cents"), F.count("*").over(w).alias("n"))


@query("fn25_date_column", "SELECT 'o_orderdate' AS col, avg((try_cast(strftime(o_orderdate, '%Y-%m-%d') AS timestamp) IS NOT NULL)::int) > 0.5 AS is_date FROM orders UNION ALL SELECT 'o_orderpriority', avg((try_cast(o_orderpriority AS timestamp) IS NOT NULL)::int) > 0.5 FROM orders")
def fn25(spark, d):
    t = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), "o_orderpriority")
    one = t.agg(*[(F.avg(scalar.date_share(F.col(c))) > 0.5).alias(c) for c in t.columns])
    return one.unpivot([], t.columns, "col", "is_date")


@query("se12_rerank", "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal + 100 * length(c_mktsegment) DESC, c_custkey) AS place FROM customer QUALIFY place <= 3")
def se12(spark, d):
    c = table(spark, d, "customer").withColumn("long", F.length("c_mktsegment"))
    return search.rerank(c, "c_nationkey", F.col("c_acctbal"), {"long": 100}, 3, "c_custkey").select("c_custkey", "place")


@query("se23_link_suggestions", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, row_number() OVER (PARTITION BY o_orderstatus ORDER BY count(*) DESC, o_orderpriority) AS place FROM orders GROUP BY 1, 2")
def se23(spark, d):
    return search.suggest_links(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority")


@query("snk5_csv_rows", "SELECT n_nationkey || ',' || n_name || ',' || n_regionkey AS line FROM nation")
def snk5(spark, d):
    return table(spark, d, "nation").select(F.to_csv(F.struct("n_nationkey", "n_name", "n_regionkey")).alias("line"))


@query("sim6_value_ranges", "SELECT event_type, round(min(value), 6) AS lo, round(max(value), 6) AS hi FROM events GROUP BY 1")
def sim6(spark, d):
    return similarity.value_ranges(table(spark, d, "events"), "event_type", "value").select("event_type", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))
