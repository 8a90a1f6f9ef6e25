"""Queries over model graphs, mappings, inference, search and labels, each with its DuckDB text."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import alignment, inference, labelling, mapping, ontology, search, trees
from loomgraph.session import table

QUERIES: dict = {}


def query(name, sql):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return add


@query("ev5_alignment", "SELECT n_regionkey AS key, round(2.0 * p / (p + count(*)), 6) AS f1, round(1.0 * p / count(*), 6) AS recall, (2 * p)::bigint AS matched FROM (SELECT *, count(*) FILTER (n_nationkey % 2 = 0) OVER (PARTITION BY n_regionkey) AS p FROM nation) GROUP BY n_regionkey, p")
def ev5(spark, d):
    n = table(spark, d, "nation")
    def side(name, prefix, rows):
        node = F.concat(F.lit(prefix), F.col("n_nationkey").cast("string"))
        has = rows.select(F.col("n_regionkey").alias("key"), F.lit(name).alias("side"), F.lit("R").alias("src"), F.lit("R").alias("src_label"), F.lit("has").alias("pred"), node.alias("dst"), F.lit("N").alias("dst_label"), F.lit(False).alias("dst_data"))
        called = rows.select(F.col("n_regionkey").alias("key"), F.lit(name).alias("side"), node.alias("src"), F.lit("N").alias("src_label"), F.lit("name").alias("pred"), F.concat(F.lit("d"), node).alias("dst"), F.col("n_name").alias("dst_label"), F.lit(True).alias("dst_data"))
        return has.unionByName(called)
    out = alignment.align(side("gold", "N", n).unionByName(side("pred", "M", n.where("n_nationkey % 2 = 0"))), "key")
    return out.select("key", F.round("f1", 6).alias("f1"), F.round("recall", 6).alias("recall"), "matched")


@query("ml11_inference", """
    WITH v AS (SELECT unnest([0, 1]) AS x), g AS (SELECT s_suppkey AS key, s_acctbal / 5000 AS a, s_nationkey / 25.0 AS b FROM supplier),
    e AS (SELECT key, p.x AS p, q.x AS q, r.x AS r, a * p.x + b * q.x - 0.4 * r.x + 0.5 * p.x * q.x - 0.3 * q.x * r.x AS s FROM g, v p, v q, v r)
    SELECT key, round(ln(sum(exp(s))), 6) AS log_z, round(sum(exp(s)) FILTER (p = 1) / sum(exp(s)), 6) AS p0, round(sum(exp(s)) FILTER (q = 1) / sum(exp(s)), 6) AS p1, round(sum(exp(s)) FILTER (r = 1) / sum(exp(s)), 6) AS p2,
    (arg_max(p * 4 + q * 2 + r, s))::int AS best FROM e GROUP BY key""")  # fmt: skip
def ml11(spark, d):
    zero = F.lit(0.0)
    one = lambda v, w: F.struct(F.array(F.lit(v)).alias("vars"), F.array(F.lit(2)).alias("sizes"), F.array(zero, w).alias("scores"))
    two = lambda u, v, w: F.struct(F.array(F.lit(u), F.lit(v)).alias("vars"), F.array(F.lit(2), F.lit(2)).alias("sizes"), F.array(zero, zero, zero, F.lit(w)).alias("scores"))
    parts = [one(0, F.col("s_acctbal") / 5000), one(1, F.col("s_nationkey") / 25), one(2, F.lit(-0.4)), two(0, 1, 0.5), two(1, 2, -0.3)]
    factors = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.explode(F.array(*parts)).alias("f")).select("key", "f.*")
    per = inference.infer(factors, "key")
    chance = lambda v: F.round(F.exp(F.max(F.when(F.col("var") == v, F.col("log_prob")[1]))), 6).alias(f"p{v}")
    best = F.sum(F.col("best") * F.when(F.col("var") == 0, 4).when(F.col("var") == 1, 2).otherwise(1)).cast("int").alias("best")
    return per.groupBy("key").agg(F.round(F.max("log_z"), 6).alias("log_z"), chance(0), chance(1), chance(2), best)


@query("gr16_canonical_text", "SELECT o_custkey AS key, '(customer:' || string_agg('has-' || o_orderstatus, ',' ORDER BY o_orderstatus) || ')' AS text FROM orders GROUP BY o_custkey")
def gr16(spark, d):
    e = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.lit("c").alias("src"), F.lit("customer").alias("src_label"), F.lit("has").alias("label"), F.col("o_orderkey").cast("string").alias("dst"), F.col("o_orderstatus").alias("dst_label"))
    return trees.canonical_text(e, "key")


def _routes(spark, d):
    n = table(spark, d, "nation")
    there = n.select(F.col("n_regionkey").alias("key"), F.lit("start").alias("src"), F.col("n_name").alias("dst"), F.col("n_nationkey").cast("double").alias("weight"))
    return there.unionByName(n.select(F.col("n_regionkey").alias("key"), F.col("n_name").alias("src"), F.lit("end").alias("dst"), F.length("n_name").cast("double").alias("weight")))


@query("gr18_shortest_paths", "SELECT n_regionkey AS key, n_name AS node, n_nationkey::double AS distance FROM nation UNION ALL SELECT n_regionkey, 'end', min(n_nationkey + length(n_name))::double FROM nation GROUP BY 1 UNION ALL SELECT DISTINCT n_regionkey, 'start', 0.0 FROM nation")
def gr18(spark, d):
    return trees.shortest_paths(_routes(spark, d), "key", "start").select("key", "node", "distance")


@query("gr21_link_weights", "SELECT o_custkey AS key, o_orderkey, CASE WHEN o_orderstatus = 'O' THEN count(*) FILTER (o_orderstatus = 'O') OVER (PARTITION BY o_custkey) ELSE 0.5 END::double AS weight FROM orders")
def gr21(spark, d):
    t = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), "o_orderkey", F.array("o_orderstatus").alias("tags"), (F.col("o_orderstatus") != "O").alias("known"))
    return trees.link_weights(t, 1).select("key", "o_orderkey", "weight")


@query("gr22_connecting_tree", "SELECT n_regionkey AS key, round(min(n_nationkey + length(n_name)), 6)::double AS weight FROM nation GROUP BY 1")
def gr22(spark, d):
    return trees.connecting_trees(_routes(spark, d), "key", ["start", "end"], 1).select("key", F.round("weight", 6).alias("weight"))


@query("gr31_interval_parents", """
    WITH r AS (SELECT s_nationkey AS key, s_suppkey * 100 + x.a AS a, s_suppkey * 100 + x.b AS b FROM supplier, (VALUES (0, 100), (10, 50), (20, 30), (60, 70)) x(a, b))
    SELECT r.key, r.a, r.b, arg_max(p.a, p.a) AS parent_start FROM r LEFT JOIN r p ON p.key = r.key AND p.a <= r.a AND r.b <= p.b AND (p.a < r.a OR r.b < p.b) GROUP BY r.key, r.a, r.b""")
def gr31(spark, d):
    cut = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 100), (10, 50), (20, 30), (60, 70))]))
    t = table(spark, d, "supplier").select("s_nationkey", "s_suppkey", cut.alias("x"))
    t = t.select(F.col("s_nationkey").alias("key"), (F.col("s_suppkey") * 100 + F.col("x.a")).alias("a"), (F.col("s_suppkey") * 100 + F.col("x.b")).alias("b"))
    return trees.interval_parents(t, "key", "a", "b").drop("parent_end")


@query("gr33_path_pattern", "SELECT DISTINCT 'r' || n_regionkey AS start, 'c' || c_custkey AS \"end\" FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING'")
def gr33(spark, d):
    node = lambda k, c: F.concat(F.lit(k), F.col(c).cast("string"))
    a = table(spark, d, "nation").select(node("r", "n_regionkey").alias("src"), node("n", "n_nationkey").alias("dst"), F.lit("has").alias("label"))
    b = table(spark, d, "customer").select(node("n", "c_nationkey").alias("src"), node("c", "c_custkey").alias("dst"), F.col("c_mktsegment").alias("label"))
    return trees.match_path(a.unionByName(b), ["*", "BUILDING"])


def _triples(spark, d):
    """Regions and nations as classes; of each region a predicate that leads to the next one."""
    n, r = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")), table(spark, d, "region")
    to = r.select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("to"))
    p = r.join(to, (F.col("r_regionkey") + 1) % 5 == F.col("k")).select(F.concat(F.lit("p"), F.col("r_regionkey").cast("string")).alias("s"), "r_name", "to")
    sub = n.select(F.col("n_name").alias("s"), F.lit(ontology.RDFS + "subClassOf").alias("p"), F.col("r_name").alias("o"))
    rows = F.array(*[F.struct(F.lit(k).alias("p"), v.alias("o")) for k, v in ((ontology.RDF + "type", F.lit(ontology.OWL + "ObjectProperty")), (ontology.RDFS + "domain", F.col("r_name")), (ontology.RDFS + "range", F.col("to")))])
    return sub.unionByName(p.select("s", F.explode(rows).alias("t")).select("s", "t.p", "t.o"))


@query("gr4_linkable", """
    WITH c AS (SELECT n_name AS uri, n_regionkey AS k FROM nation UNION ALL SELECT r_name, r_regionkey FROM region)
    SELECT a.uri AS src, 'p' || a.k AS predicate, b.uri AS dst FROM c a JOIN c b ON b.k = (a.k + 1) % 5""")
def gr4(spark, d):
    t = _triples(spark, d)
    return ontology.linkable(ontology.predicates(t), ontology.ancestors(t))


@query("gr7_advise", "SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, label, dst) AS place FROM (SELECT o_orderstatus AS src, strftime(o_orderdate, '%Y') AS label, o_orderpriority AS dst, count(*) AS n FROM orders GROUP BY ALL) QUALIFY place <= 15")
def gr7(spark, d):
    seen = table(spark, d, "orders").select(F.col("o_orderstatus").alias("src"), F.date_format("o_orderdate", "yyyy").alias("label"), F.col("o_orderpriority").alias("dst"))
    n = seen.groupBy("src", "label", "dst").agg(F.count("*").alias("n"))
    return ontology.advise(seen).drop("p").join(n, ["src", "label", "dst"])


_SCRIPT = [
    {"_type_": "SetSemanticType", "input_attr_path": "o_custkey", "domain": "Person", "type": "key", "node_id": "Person1"},
    {"_type_": "SetSemanticType", "input_attr_path": "orders|key", "domain": "Order", "type": mapping.ID_LINK, "node_id": "Order1"},
    {"_type_": "SetSemanticType", "input_attr_path": "orders|status", "domain": "State", "type": "name", "node_id": "State1"},
    {"_type_": "SetInternalLink", "source_id": "Person1", "target_id": "Order1", "link_lbl": "placed"},
    {"_type_": "SetInternalLink", "source_id": "Order1", "target_id": "State1", "link_lbl": "in"},
]


@query("nest13_objects", "SELECT o_custkey AS key, o_orderkey AS id, 'Order' AS kind, o_orderstatus AS state FROM orders")
def nest13(spark, d):
    lists = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"))).alias("orders"))
    df, model = mapping.run(lists, _SCRIPT)
    made = df.select(mapping.objects(model, df.schema).alias("o")).select(F.col("o.key").alias("key"), F.explode("o.placed").alias("p"))
    return made.select("key", F.col(f"p.`{mapping.ID_LINK}`").alias("id"), F.col("p.@type").alias("kind"), F.col("p.in.name").alias("state"))


@query("snk3_json_objects", """SELECT '{"@type":"Nation","name":"' || n_name || '","key":' || n_nationkey || '}' AS value FROM nation""")
def snk3(spark, d):
    bind = lambda path, p: {"_type_": "SetSemanticType", "input_attr_path": path, "domain": "Nation", "type": p, "node_id": "Nation1"}
    df, model = mapping.run(table(spark, d, "nation"), [bind("n_name", "name"), bind("n_nationkey", "key")])
    return mapping.json_objects(df, model)


@query("se1_beam_search", "WITH n AS (SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey * 7 % 25 DESC, n_name LIMIT 3) SELECT n_name || '/' || s_name AS id, s_acctbal AS score FROM n JOIN supplier ON s_nationkey = n_nationkey ORDER BY score DESC, id LIMIT 4")
def se1(spark, d):
    n, s = table(spark, d, "nation"), table(spark, d, "supplier")
    start = spark.range(1).select(F.lit("").alias("id"), F.lit(0.0).alias("score"), F.lit(False).alias("terminal"), F.lit(-1).cast("long").alias("at"))
    def expand(states):
        first = states.where("at = -1").crossJoin(n).select(F.col("n_name").alias("id"), (F.col("n_nationkey") * 7 % 25).cast("double").alias("score"), F.lit(False).alias("terminal"), F.col("n_nationkey").cast("long").alias("at"))
        then = states.join(s, F.col("at") == F.col("s_nationkey")).select(F.concat_ws("/", "id", "s_name").alias("id"), F.col("s_acctbal").cast("double").alias("score"), F.lit(True).alias("terminal"), "at")
        return first.unionByName(then)
    return search.beam_search(start, expand, width=3, results=4, rounds=2).select("id", "score")


@query("se7_map_attributes", """
    WITH c AS (SELECT c_nationkey AS key, c_mktsegment AS edge, count(*) AS n, sum(c_custkey % 7) AS m FROM customer GROUP BY 1, 2),
    one AS (SELECT key, edge, n AS score, row_number() OVER (PARTITION BY key ORDER BY n DESC, edge) AS place FROM c QUALIFY place <= 2)
    SELECT one.key, one.edge AS first, c.edge AS second, (score + m)::double AS score FROM one JOIN c ON c.key = one.key AND c.edge != one.edge
    QUALIFY row_number() OVER (PARTITION BY one.key ORDER BY score + m DESC, one.edge, c.edge) <= 2""")
def se7(spark, d):
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("key"), F.col("c_mktsegment").alias("edge")).agg(F.count("*").cast("double").alias("n"), F.sum(F.col("c_custkey") % 7).cast("double").alias("m"))
    rows = c.select("key", "edge", F.explode(F.create_map(F.lit("a"), "n", F.lit("b"), "m")).alias("attr", "score"))
    m = search.map_attributes(rows, "key", ["a", "b"], 2)
    return m.select("key", F.col("mapping")[0]["edge"].alias("first"), F.col("mapping")[1]["edge"].alias("second"), "score")


@query("se8_mapping_score", "SELECT c_custkey, round((c_acctbal / 10000 + c_nationkey / 25.0 + 0.5 * (c_custkey % 3)) / 3, 6) AS score FROM customer")
def se8(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.round(search.mapping_score(F.col("c_acctbal") / 10000, F.col("c_nationkey") / 25, F.col("c_custkey") % 3), 6).alias("score"))


@query("se17_weighted_sample", "SELECT o_orderkey FROM orders WHERE o_totalprice > 0 ORDER BY -ln((('0x' || substr(md5(o_orderkey || '#7'), 1, 12))::bigint + 1) / 281474976710657.0::double) / o_totalprice, o_orderkey LIMIT 40")
def se17(spark, d):
    return search.weighted_sample(table(spark, d, "orders"), "o_orderkey", "o_totalprice", 40, 7).select("o_orderkey")


@query("sim4_t_statistic", "WITH s AS (SELECT avg(l_quantity) FILTER (l_returnflag = 'A') AS ma, avg(l_quantity) FILTER (l_returnflag = 'R') AS mb, var_samp(l_quantity) FILTER (l_returnflag = 'A') AS va, var_samp(l_quantity) FILTER (l_returnflag = 'R') AS vb, (count(*) FILTER (l_returnflag = 'A'))::double AS na, (count(*) FILTER (l_returnflag = 'R'))::double AS nb FROM lineitem) SELECT round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1 / na + 1 / nb)), 6) AS t, na + nb - 2 AS dof FROM s")
def sim4(spark, d):
    return labelling.t_statistic(table(spark, d, "lineitem"), "l_returnflag", "l_quantity", "A", "R").select(F.round("t", 6).alias("t"), "dof")


@query("sim11_training_pairs", "SELECT a.n_name AS a, b.n_name AS b, (a.n_regionkey = b.n_regionkey)::int::double AS same FROM nation a JOIN nation b ON a.n_name < b.n_name")
def sim11(spark, d):
    gold = table(spark, d, "nation").select(F.col("n_name").alias("col"), F.col("n_regionkey").alias("label"))
    pairs = gold.select(F.col("col").alias("a")).join(gold.select(F.col("col").alias("b")), F.col("a") < F.col("b"))
    return labelling.training_pairs(pairs, gold)


@query("sim13_top_labels", "WITH s AS (SELECT p_size, p_brand, max(p_partkey % 97) AS score FROM part GROUP BY 1, 2 HAVING max(p_partkey % 97) > 0) SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY score DESC, p_brand) AS rank FROM s QUALIFY rank <= 4")
def sim13(spark, d):
    return labelling.top_labels(table(spark, d, "part").select("p_size", "p_brand", (F.col("p_partkey") % 97).alias("score")), "p_size", "p_brand", "score", 4)


@query("sim16_semi_oracle", "SELECT n_name AS col, CASE WHEN n_regionkey < 2 THEN n_regionkey ELSE 0 END AS label, CASE WHEN n_regionkey < 2 THEN 1.0 ELSE 0.25 END::double AS score FROM nation")
def sim16(spark, d):
    gold = table(spark, d, "nation").select(F.col("n_name").alias("col"), F.col("n_regionkey").alias("label"))
    guess = gold.select("col", F.lit(0).cast(gold.schema["label"].dataType).alias("label"), F.lit(0.25).alias("score"))
    return labelling.oracle_labels(gold, guess, gold.where("label < 2").select("label"))
