"""Queries over paths, neighbourhoods, folds and samples, each with its DuckDB text."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomgraph.operators import evaluation, graph, labelling, nested, search
from loomgraph.session import table

QUERIES: dict = {}


def query(name, sql):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return add


def _node(prefix, column):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def _world(spark, d):
    """Regions, nations and suppliers as one tree."""
    a = table(spark, d, "nation").select(_node("r", "n_regionkey").alias("src"), _node("n", "n_nationkey").alias("dst"), F.lit("has").alias("label"))
    return a.unionByName(table(spark, d, "supplier").select(_node("n", "s_nationkey").alias("src"), _node("s", "s_suppkey").alias("dst"), F.lit("home").alias("label")))


@query("ev9_concat_folds", "WITH r AS (SELECT c_mktsegment AS source, round(avg(c_nationkey), 6) AS score FROM customer GROUP BY 1) SELECT source, round(score, 6) AS score FROM r UNION ALL SELECT 'average', round(avg(score), 6) FROM r")
def ev9(spark, d):
    r = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("source")).agg(F.round(F.avg("c_nationkey"), 6).alias("score"))
    fold = lambda rows: evaluation.with_average(rows, "source")
    return evaluation.concat_folds([fold(r.where("source < 'F'")), fold(r.where("source >= 'F'"))], "source").select("source", F.round("score", 6).alias("score"))


@query("ev10_triple_accuracy", "SELECT n_regionkey, round(avg((n_nationkey % 3 = 0)::int), 6) AS accuracy FROM nation GROUP BY 1")
def ev10(spark, d):
    gold = table(spark, d, "nation").select("n_regionkey", "n_nationkey", F.lit("x").alias("label"))
    pred = gold.where("n_nationkey % 3 != 2").withColumn("label", F.when(F.col("n_nationkey") % 3 == 0, "x").otherwise("y"))
    return evaluation.triple_accuracy(gold, pred, "n_regionkey", "n_nationkey", "label").select("n_regionkey", F.round("accuracy", 6).alias("accuracy"))


@query("se13_coherence", """
    WITH c AS (SELECT DISTINCT o_custkey AS candidate, o_orderstatus || o_orderpriority AS t FROM orders), k AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS model, o_orderstatus || o_orderpriority AS t FROM orders)
    SELECT candidate, round(coalesce(max(hits), 0) / any_value(n), 6) AS coherence FROM (SELECT candidate, count(*) AS n FROM c GROUP BY 1) LEFT JOIN (SELECT candidate, model, count(*) AS hits FROM c JOIN k USING (t) GROUP BY 1, 2) USING (candidate) GROUP BY candidate""")
def se13(spark, d):
    o = table(spark, d, "orders").withColumn("triple", F.concat("o_orderstatus", "o_orderpriority"))
    known = o.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("model"), "triple")
    return evaluation.coherence(o.select(F.col("o_custkey").alias("candidate"), "triple"), known).select("candidate", F.round("coherence", 6).alias("coherence"))


@query("gr26_neighbourhood", "SELECT 'r' || n_regionkey AS start, 'r' || n_regionkey AS node, 0 AS hops FROM nation GROUP BY ALL UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey, 1 FROM nation UNION ALL SELECT 'r' || n_regionkey, 's' || s_suppkey, 2 FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def gr26(spark, d):
    e = _world(spark, d)
    return graph.neighbourhood(e, graph.roots(e).where("node like 'r%'"), 2)


@query("gr25_prune_childless", """
    WITH s AS (SELECT * FROM supplier WHERE s_acctbal >= 5000 OR s_suppkey % 4 = 0), had AS (SELECT DISTINCT s_nationkey FROM supplier)
    SELECT 'n' || s_nationkey AS src, 's' || s_suppkey AS dst FROM s UNION ALL
    SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM s) OR n_nationkey NOT IN (SELECT s_nationkey FROM had)""")
def gr25(spark, d):
    gone = table(spark, d, "supplier").where("s_acctbal < 5000 and s_suppkey % 4 != 0").select(_node("s", "s_suppkey").alias("node"))
    return graph.prune_childless(_world(spark, d), gone).select("src", "dst")


@query("snk8_dot_lines", """SELECT '"r' || n_regionkey || '" -> "n' || n_nationkey || '" [label="has"];' AS value FROM nation""")
def snk8(spark, d):
    return graph.dot_lines(_world(spark, d).where("label = 'has'"))


def _nested(spark, d):
    one = F.struct(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("p")).alias("k"), F.col("o_orderstatus").alias("s"))
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(one).alias("orders"))


@query("sch7_delete_path", "SELECT o_custkey, o_orderkey AS id, o_orderstatus AS s FROM orders")
def sch7(spark, d):
    df = nested.delete_path(_nested(spark, d), "orders|k|p")
    return df.select("o_custkey", F.inline("orders")).select("o_custkey", "k.*", "s")


@query("sch8_cast_path", "SELECT o_custkey, o_orderkey::varchar AS id, try_cast(o_orderpriority AS int) AS p FROM orders")
def sch8(spark, d):
    df = nested.cast_path(nested.cast_path(_nested(spark, d), "orders|k|id", "string"), "orders|k|p", "int")
    return df.select("o_custkey", F.inline("orders")).select("o_custkey", "k.*")


@query("sch12_same_scope", "WITH p AS (SELECT unnest(['a', 'b', 'c|x', 'c|y', 'c|z|w']) AS path), q AS (SELECT path, regexp_replace(path, '\\|?[^|]*$', '') AS parent FROM p) SELECT x.path AS a, y.path AS b, x.parent = y.parent AS same FROM q x JOIN q y ON x.path < y.path")
def sch12(spark, d):
    return nested.same_scope(spark.range(1).select(F.explode(F.array(*[F.lit(p) for p in ("a", "b", "c|x", "c|y", "c|z|w")])).alias("path")))


@query("snk11_cross_rows", "WITH g AS (SELECT o_custkey, list(o_orderkey) AS a, list(DISTINCT o_orderstatus) AS b FROM orders GROUP BY 1), h AS (SELECT o_custkey, unnest(a) AS x, b FROM g) SELECT o_custkey, x AS \"o|a\", unnest(b) AS \"o|b\" FROM h")
def snk11(spark, d):
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("a"), F.collect_set("o_orderstatus").alias("b"))
    return nested.cross_rows(g.select("o_custkey", F.struct("a", "b").alias("o")))


@query("se3_without_repetition", "WITH p AS (SELECT o_custkey, o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL), q AS (SELECT o_custkey, max(n) AS n, count(*) FILTER (n > 1) AS kinds FROM p GROUP BY o_custkey, o_orderstatus) SELECT o_custkey FROM q GROUP BY 1 HAVING max(n) < 4 AND max(kinds) < 2")
def se3(spark, d):
    e = table(spark, d, "orders").select("o_custkey", F.col("o_orderstatus").alias("src"), F.col("o_orderpriority").alias("label"))
    return search.without_repetition(e, "o_custkey", 4, 2)


@query("se20_chain_score", "WITH c AS (SELECT o_orderstatus AS s, o_orderpriority AS t, count(*) AS n, sum(count(*)) OVER (PARTITION BY o_orderstatus) AS m FROM orders GROUP BY o_orderstatus, o_orderpriority) SELECT o_custkey, round(sum(ln(coalesce(greatest(n / m, 1e-6), 1e-6))), 6) AS score FROM orders LEFT JOIN c ON s = o_orderstatus AND t = o_orderpriority GROUP BY 1")
def se20(spark, d):
    e = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderstatus").alias("src_label"), F.lit("has").alias("label"), F.col("o_orderpriority").alias("dst_label"))
    seen = e.groupBy("src_label", "label", "dst_label").agg(F.count("*").alias("n"))
    chances = seen.select("src_label", "label", "dst_label", (F.col("n") / F.sum("n").over(Window.partitionBy("src_label"))).alias("p"))
    return search.chain_score(e, "o_custkey", chances).select("o_custkey", F.round("score", 6).alias("score"))


@query("rel4_sample", "SELECT c_custkey FROM customer ORDER BY (('0x' || substr(md5(c_custkey || '#3'), 1, 12))::bigint + 1) / 281474976710657.0::double, c_custkey LIMIT 30")
def rel4(spark, d):
    return search.sample(table(spark, d, "customer"), "c_custkey", 30, 3).select("c_custkey")


@query("src18_wide_scores", "WITH w AS (SELECT p_partkey, unnest([{'cls': 'A', 'predicate': 'p', 'score': (p_partkey % 5)::double}, {'cls': 'B', 'predicate': 'q', 'score': (p_partkey % 7)::double}], recursive := true) FROM part) SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, cls, predicate) AS place FROM w")
def src18(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 5).alias("scores_A---p"), (F.col("p_partkey") % 7).alias("scores_B---q"))
    return labelling.wide_scores(p, "p_partkey")


@query("ml6_one_hot", "WITH n AS (SELECT o_orderpriority AS f, (row_number() OVER (ORDER BY o_orderpriority) - 1)::int AS i FROM (SELECT DISTINCT o_orderpriority FROM orders)) SELECT o_custkey, i, count(*)::double AS v FROM orders JOIN n ON f = o_orderpriority GROUP BY 1, 2")
def ml6(spark, d):
    v = labelling.one_hot(table(spark, d, "orders").withColumn("w", F.lit(1.0)), "o_custkey", "o_orderpriority", "w")
    return v.select("o_custkey", F.explode(F.arrays_zip(F.col("indices").alias("i"), F.col("values").alias("v"))).alias("x")).select("o_custkey", "x.i", "x.v")
