"""Queries over the shared tables, each with its DuckDB text. Names begin with the inventory's ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import scalar as S
from loomgraph.operators import evaluation, graph, relational, similarity, statistics
from loomgraph.session import table

QUERIES: dict = {}


def query(name: str, sql: str | None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return add


def r6(c):
    return F.round(c, 6)


def T(spark, d, name):
    return table(spark, d, name)


@query("fn1_guess_type", "SELECT e AS event_type, t, count(*) AS n FROM (SELECT event_type AS e, CASE WHEN nullif(trim(props),'') IS NULL THEN 'null' WHEN try_cast(trim(props) AS double) IS NOT NULL THEN 'number' ELSE 'string' END AS t FROM events) GROUP BY ALL")
def fn1(spark, d):
    return T(spark, d, "events").select("event_type", S.guess_type(F.col("props")).alias("t")).groupBy("event_type", "t").agg(F.count("*").alias("n"))


@query("fn3_tokenize_label", "SELECT p_partkey, array_to_string(list_filter(string_split_regex(lower(regexp_replace(p_name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[_\\s:.]+'), lambda x: x <> ''), '|') AS tokens FROM part")
def fn3(spark, d):
    return T(spark, d, "part").select("p_partkey", F.array_join(S.tokenize_label(F.col("p_name")), "|").alias("tokens"))


@query("fn6_tokenize_text", "SELECT item_id, array_to_string(regexp_extract_all(lower(text), '[a-z]+|[0-9]+(?:\\.[0-9]+)*'), '|') AS tokens FROM benchmark")
def fn6(spark, d):
    return T(spark, d, "benchmark").select("item_id", F.array_join(S.tokenize_text(F.col("text")), "|").alias("tokens"))


@query("fn5_pad", "SELECT n_name, rpad(n_name, 16, ' ') AS l, lpad(n_name, 16, ' ') AS r FROM nation")
def fn5(spark, d):
    return T(spark, d, "nation").select("n_name", S.pad(F.col("n_name"), 16).alias("l"), S.pad(F.col("n_name"), 16, "right").alias("r"))


@query("fn7_strip_tags", "SELECT page_id, md5(regexp_replace(html, '<[^>]*>', '', 'g')) AS h FROM pages")
def fn7(spark, d):
    return T(spark, d, "pages").select("page_id", F.md5(S.strip_tags(F.col("html"))).alias("h"))


@query("fn8_find_all", "SELECT item_id, (length(text) - length(replace(text, 'th', ''))) // 2 AS n, strpos(text, 'th')::bigint - 1 AS first FROM benchmark WHERE contains(text, 'th')")
def fn8(spark, d):
    at = S.find_all("th", F.col("text"))
    return T(spark, d, "benchmark").where(F.col("text").contains("th")).select("item_id", F.size(at).cast("long").alias("n"), F.get(at, F.lit(0)).cast("long").alias("first"))


@query("fn9_match_positions", "WITH t AS (SELECT item_id, string_split(lower(text), ' ') AS w FROM benchmark) SELECT item_id, len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i+1] = 'the')) AS n FROM t")
def fn9(spark, d):
    words = F.split(F.lower("text"), " ", -1)
    return T(spark, d, "benchmark").select("item_id", F.size(S.match_positions(["of", "the"], words)).cast("long").alias("n"))


@query("fn10_hashtags", "SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '#[a-zA-Z_]+'))), ',') AS tags FROM documents")
def fn10(spark, d):
    return T(spark, d, "documents").select("doc_id", F.array_join(F.sort_array(S.hashtags(F.col("text"))), ",").alias("tags"))


@query("fn11_capitalized", "SELECT lang, count(*) AS n FROM documents WHERE regexp_matches(text, '^\\p{Lu}') GROUP BY lang")
def fn11(spark, d):
    return T(spark, d, "documents").where(S.is_capitalized(F.col("text"))).groupBy("lang").agg(F.count("*").alias("n"))


@query("fn13_query_params", "SELECT page_id, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page, CASE WHEN contains(url, '?') AND regexp_matches(url, '[?&]ref=') THEN regexp_extract(url, '^([^?#]*)', 1) || '?ref=' || regexp_extract(url, '[?&]ref=([^&#]*)', 1) ELSE regexp_extract(url, '^([^?#]*)', 1) END AS kept FROM pages")
def fn13(spark, d):
    return T(spark, d, "pages").select("page_id", S.query_param(F.col("url"), "page").alias("page"), S.keep_query_params(F.col("url"), ["ref"]).alias("kept"))


@query("fn14_md5", "SELECT doc_id, md5(text) AS h FROM documents")
def fn14(spark, d):
    return T(spark, d, "documents").select("doc_id", F.md5("text").alias("h"))


@query("fn15_uri", "SELECT p_partkey, 'foaf:' || p_brand AS short, 'http://xmlns.com/foaf/0.1/' || p_brand AS whole FROM part")
def fn15(spark, d):
    uri = F.concat(F.lit(S.PREFIXES["foaf"]), F.col("p_brand"))
    return T(spark, d, "part").select("p_partkey", S.simplify_uri(uri).alias("short"), S.full_uri(S.simplify_uri(uri)).alias("whole"))


@query("fn16_dates", "SELECT o_orderkey, strftime(o_orderdate, '%Y') || '-01-01' AS first, strftime(o_orderdate, '%Y') || '-12-31' AS last, strftime(o_orderdate, '%Y-%m-%d') AS own FROM orders")
def fn16(spark, d):
    year, day = F.date_format("o_orderdate", "yyyy"), F.date_format("o_orderdate", "yyyy-MM-dd")
    return T(spark, d, "orders").select("o_orderkey", S.date_earliest(year).alias("first"), S.date_latest(year).alias("last"), S.date_earliest(day).alias("own"))


@query("fn17_split_years", "SELECT o_orderkey, trim(split_part(o_orderpriority, '-', 1)) AS birth, trim(substr(o_orderpriority, length(split_part(o_orderpriority, '-', 1)) + 2)) AS death FROM orders")
def fn17(spark, d):
    y = S.split_years(F.col("o_orderpriority"))
    return T(spark, d, "orders").select("o_orderkey", y["birth"].alias("birth"), y["death"].alias("death"))


@query("fn18_slug", "SELECT p_partkey, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def fn18(spark, d):
    return T(spark, d, "part").select("p_partkey", S.slugify(F.col("p_type")).alias("slug"))


@query("fn19_guarded_uri", "SELECT s_suppkey, CASE WHEN s_acctbal < 0 OR s_name = '' THEN '' ELSE 'http://x/' || s_name END AS uri FROM supplier")
def fn19(spark, d):
    name = F.when(F.col("s_acctbal") >= 0, F.col("s_name"))
    return T(spark, d, "supplier").select("s_suppkey", S.guarded_uri(F.lit("http:/"), F.lit("x"), name).alias("uri"))


@query("fn20_log_sum_exp", "SELECT vec_id, round(list_max(embedding)::double + ln(list_sum(list_transform(embedding, lambda x: exp(x::double - list_max(embedding)::double)))), 6) AS lse, round(1 / (1 + exp(-embedding[1]::double)), 6) AS s FROM embeddings")
def fn20(spark, d):
    v = F.col("embedding").cast("array<double>")
    return T(spark, d, "embeddings").select("vec_id", r6(S.log_sum_exp(v)).alias("lse"), r6(S.sigmoid(F.get(v, F.lit(0)))).alias("s"))


@query("fn21_unravel", "SELECT p_partkey, (p_partkey // 20) % 5 AS a, (p_partkey // 4) % 5 AS b, p_partkey % 4 AS c, p_partkey % 100 AS back FROM part")
def fn21(spark, d):
    at = S.unravel_index(F.col("p_partkey"), [5, 5, 4])
    return T(spark, d, "part").select("p_partkey", *[F.get(at, F.lit(i)).alias(n) for i, n in enumerate("abc")], S.ravel_index(at, [5, 5, 4]).alias("back"))


@query("fn22_rule_constant", "SELECT event_id, regexp_replace(props, '[\\t\\r\\n''\"]', ' ', 'g') AS c FROM events")
def fn22(spark, d):
    return T(spark, d, "events").select("event_id", S.rule_constant(F.col("props")).alias("c"))


@query("fn23_numbered_labels", "SELECT l_orderkey, l_linenumber, l_returnflag || '_' || l_linenumber AS lbl, l_returnflag AS back FROM lineitem")
def fn23(spark, d):
    lbl = S.numbered_label(F.col("l_returnflag"), F.col("l_linenumber"))
    return T(spark, d, "lineitem").select("l_orderkey", "l_linenumber", lbl.alias("lbl"), S.unnumbered_label(lbl).alias("back"))


@query("fn24_uniform_bins", "SELECT ceil(greatest(p_size - 1.0, 1e-6) / 4.9)::bigint - 1 AS bin, count(*) AS n FROM part GROUP BY 1")
def fn24(spark, d):
    return T(spark, d, "part").select(S.uniform_bin(F.col("p_size").cast("double"), 1.0, 50.0, 10).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


@query("fn26_safe_div", "SELECT c_custkey, CASE WHEN c_nationkey = 0 THEN 0 ELSE round(c_acctbal / c_nationkey, 6) END AS q FROM customer")
def fn26(spark, d):
    return T(spark, d, "customer").select("c_custkey", r6(S.safe_div(F.col("c_acctbal"), F.col("c_nationkey"))).alias("q"))


@query("rel6_flatten", "SELECT n_nationkey AS key, n_name AS \"nation|name\", n_regionkey AS \"nation|region|key\" FROM nation")
def rel6(spark, d):
    nested = T(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.struct(F.col("n_name").alias("name"), F.struct(F.col("n_regionkey").alias("key")).alias("region")).alias("nation"))
    return relational.flatten_struct(nested)


@query("rel8_unpivot", "UNPIVOT (SELECT s_suppkey, s_name, s_nationkey::varchar AS s_nationkey FROM supplier) ON s_name, s_nationkey INTO NAME col VALUE val")
def rel8(spark, d):
    t = T(spark, d, "supplier").select("s_suppkey", "s_name", F.col("s_nationkey").cast("string"))
    return t.unpivot(["s_suppkey"], ["s_name", "s_nationkey"], "col", "val")


@query("rel9_first_per_key", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def rel9(spark, d):
    return relational.first_per_key(T(spark, d, "events"), ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id")


@query("rel10_group_lists", "SELECT n_regionkey, array_to_string(list_sort(list(n_name)), ',') AS names FROM nation GROUP BY n_regionkey")
def rel10(spark, d):
    return T(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list("n_name")), ",").alias("names"))


@query("rel11_chunks", "SELECT o_custkey, o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 4 AS chunk FROM orders")
def rel11(spark, d):
    return relational.chunks(T(spark, d, "orders"), 4, ["o_custkey"], [F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "chunk")


@query("rel15_exists_all", "SELECT l_orderkey, bool_or(l_quantity > 45) AS some, bool_and(l_discount < 0.08) AS every FROM lineitem GROUP BY l_orderkey")
def rel15(spark, d):
    return T(spark, d, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_quantity") > 45).alias("some"), F.bool_and(F.col("l_discount") < 0.08).alias("every"))


@query("rel22_union_all", "SELECT 'c' AS kind, c_nationkey AS nation FROM customer UNION ALL SELECT 's', s_nationkey FROM supplier")
def rel22(spark, d):
    c, s = T(spark, d, "customer").select(F.lit("c").alias("kind"), F.col("c_nationkey").alias("nation")), T(spark, d, "supplier").select(F.lit("s").alias("kind"), F.col("s_nationkey").alias("nation"))
    return c.unionByName(s)


@query("rel23_set_operators", "SELECT 'both' AS op, c_nationkey AS nation FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'only', c_nationkey FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)")
def rel23(spark, d):
    c, s = T(spark, d, "customer").select(F.col("c_nationkey").alias("nation")), T(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"))
    return c.intersect(s).select(F.lit("both").alias("op"), "nation").unionByName(c.subtract(s).select(F.lit("only").alias("op"), "nation"))


@query("rel25_top_k", "SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer QUALIFY rank <= 5")
def rel25(spark, d):
    return relational.top_k(T(spark, d, "customer"), 5, ["c_mktsegment"], [F.desc("c_acctbal"), F.col("c_custkey")]).select("c_mktsegment", "c_custkey", "rank")


@query("rel26_id_range", "SELECT o_orderkey FROM orders WHERE o_orderpriority BETWEEN '2-HIGH' AND '4-NOT SPECIFIED'")
def rel26(spark, d):
    return relational.in_range(T(spark, d, "orders"), "o_orderpriority", "2-HIGH", "4-NOT SPECIFIED").select("o_orderkey")


@query("rel28_islands", "WITH r AS (SELECT l_orderkey, l_suppkey, l_suppkey - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey) AS g FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)) SELECT l_orderkey, min(l_suppkey) AS low, max(l_suppkey) AS high, count(*) AS n FROM r GROUP BY l_orderkey, g")
def rel28(spark, d):
    return relational.islands(T(spark, d, "lineitem"), ["l_orderkey"], "l_suppkey")


@query("gr32_merge_ranges", "WITH s AS (SELECT user_id, floor(epoch(ts))::bigint AS a, floor(epoch(ts))::bigint + 86400 AS b FROM events), f AS (SELECT *, CASE WHEN a < max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM s), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM f) SELECT user_id, min(a) AS a, max(b) AS b, count(*) AS n FROM g GROUP BY user_id, g")
def gr32(spark, d):
    e = T(spark, d, "events").select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("a"))
    return relational.merge_ranges(e.withColumn("b", F.col("a") + 86400), ["user_id"], "a", "b").select("user_id", "a", "b", "n")


@query("agg4_cardinality", "WITH a AS (SELECT o_custkey, least(count(DISTINCT o_orderstatus), 2) AS s, least(count(DISTINCT o_orderkey), 2) AS k FROM orders GROUP BY 1), b AS (SELECT o_orderkey, least(count(DISTINCT o_custkey), 2) AS c FROM orders GROUP BY 1), u AS (SELECT 'o_custkey' AS given_col, 'o_orderstatus' AS col, avg(s) AS v FROM a UNION ALL SELECT 'o_custkey', 'o_orderkey', avg(k) FROM a UNION ALL SELECT 'o_orderkey', 'o_custkey', avg(c) FROM b) SELECT given_col, col, round(v, 6) AS avg_n, CASE WHEN v > 1.05 THEN '1-TO-N' ELSE '1-TO-1' END AS relation FROM u")
def agg4(spark, d):
    return statistics.cardinality(T(spark, d, "orders"), [("o_custkey", "o_orderstatus"), ("o_custkey", "o_orderkey"), ("o_orderkey", "o_custkey")]).withColumn("avg_n", r6("avg_n"))


@query("agg9_pseudo_keys", "WITH u AS (SELECT count(DISTINCT c_custkey) / count(*) AS a, count(DISTINCT c_name) / count(*) AS b, count(DISTINCT c_nationkey) / count(*) AS c FROM customer), l AS (SELECT 'c_custkey' AS col, a AS uniqueness FROM u UNION ALL SELECT 'c_name', b FROM u UNION ALL SELECT 'c_nationkey', c FROM u) SELECT col, round(uniqueness, 6) AS uniqueness, (uniqueness > 0.999 OR uniqueness = max(uniqueness) OVER ())::bigint AS vote FROM l")
def agg9(spark, d):
    return statistics.key_votes(T(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")).withColumn("uniqueness", r6("uniqueness"))


@query("agg10_node_prior", "SELECT c_mktsegment, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS p FROM customer GROUP BY 1")
def agg10(spark, d):
    return statistics.node_prior(T(spark, d, "customer"), "c_mktsegment").withColumn("p", r6("p"))


@query("agg11_p_l_given_s", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY o_orderstatus), 6) AS p FROM orders GROUP BY 1, 2")
def agg11(spark, d):
    return statistics.conditional(T(spark, d, "orders"), ["o_orderstatus"], "o_orderpriority").withColumn("p", r6("p"))


@query("agg12_p_l_given_so", "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag, l_linestatus), 6) AS p FROM lineitem GROUP BY 1, 2, 3")
def agg12(spark, d):
    return statistics.conditional(T(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_linenumber").withColumn("p", r6("p"))


@query("agg13_p_o_given_sl", "SELECT c_mktsegment, o_orderpriority, o_orderstatus, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY c_mktsegment, o_orderpriority), 6) AS p FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3")
def agg13(spark, d):
    edges = T(spark, d, "orders").join(T(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return statistics.conditional(edges, ["c_mktsegment", "o_orderpriority"], "o_orderstatus").withColumn("p", r6("p"))


@query("agg14_p_triple", "WITH e AS (SELECT c_mktsegment AS s, o_orderpriority AS l, o_orderstatus AS o FROM orders JOIN customer ON o_custkey = c_custkey), ps AS (SELECT s, count(*) / sum(count(*)) OVER () AS p FROM e GROUP BY s), po AS (SELECT o, count(*) / sum(count(*)) OVER () AS p FROM e GROUP BY o), pl AS (SELECT s, o, l, count(*) / sum(count(*)) OVER (PARTITION BY s, o) AS p FROM e GROUP BY s, o, l) SELECT s, l, o, round(ps.p * po.p * pl.p, 6) AS p FROM pl JOIN ps USING (s) JOIN po USING (o)")
def agg14(spark, d):
    e = T(spark, d, "orders").join(T(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("s"), F.col("o_orderpriority").alias("l"), F.col("o_orderstatus").alias("o"))
    ps, po = statistics.node_prior(e, "s").select("s", F.col("p").alias("ps")), statistics.node_prior(e, "o").select("o", F.col("p").alias("po"))
    pl = statistics.conditional(e, ["s", "o"], "l").join(ps, "s", "left").join(po, "o", "left")
    return pl.select("s", "l", "o", r6(F.coalesce(F.col("ps") * F.col("po") * F.col("p"), F.lit(1e-9))).alias("p"))


@query("agg15_multi_value", "WITH k AS (SELECT user_id, event_type, count(*) AS k FROM events GROUP BY 1, 2) SELECT event_type, count(*) AS nodes, round(avg((k > 1)::int), 6) AS multi, avg((k > 1)::int) > 0.01 AS is_multi FROM k GROUP BY 1")
def agg15(spark, d):
    return statistics.multi_value(T(spark, d, "events"), "user_id", "event_type").withColumn("multi", r6("multi"))


@query("agg16_numbering", "SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS number FROM events")
def agg16(spark, d):
    return statistics.numbered(T(spark, d, "events"), "user_id", "event_type", "event_id").select("event_id", "number")


@query("agg17_cooccurrence", "WITH h AS (SELECT DISTINCT user_id AS u, event_type AS t FROM events), m AS (SELECT t, count(*) AS m FROM h GROUP BY t) SELECT x.t AS a, y.t AS b, count(*) AS n, round(count(*) / greatest(max(ma.m), max(mb.m)), 6) AS p FROM h x JOIN h y ON x.u = y.u AND x.t < y.t JOIN m ma ON ma.t = x.t JOIN m mb ON mb.t = y.t GROUP BY 1, 2")
def agg17(spark, d):
    return statistics.cooccurrence(T(spark, d, "events"), "user_id", "event_type").withColumn("p", r6("p"))


@query("agg18_local_structure", "SELECT event_type, user_id % 7 AS child, count(*) AS n, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, user_id % 7 DESC) AS place FROM events GROUP BY 1, 2")
def agg18(spark, d):
    return statistics.local_structure(T(spark, d, "events").withColumn("child", F.col("user_id") % 7), "event_type", ["child"])


@query("agg19_label_codes", "SELECT p_brand, row_number() OVER (ORDER BY min(p_partkey)) - 1 AS code FROM part GROUP BY 1")
def agg19(spark, d):
    return relational.first_seen_codes(T(spark, d, "part"), "p_brand", "p_partkey")


@query("agg20_order_constraint", "SELECT round(avg((l_extendedprice >= l_quantity)::int), 6) AS share, max((l_extendedprice > l_quantity)::int) AS some_greater FROM lineitem")
def agg20(spark, d):
    return statistics.order_constraint(T(spark, d, "lineitem"), "l_extendedprice", "l_quantity").withColumn("share", r6("share"))


@query("sim1_label_jaccard", "WITH t AS (SELECT p_partkey, p_name, p_type, list_distinct(list_filter(string_split_regex(lower(p_name), '[_\\s:.]+'), lambda x: x <> '')) AS a, list_distinct(list_filter(string_split_regex(lower(p_type), '[_\\s:.]+'), lambda x: x <> '')) AS b FROM part) SELECT p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS j FROM t")
def sim1(spark, d):
    a, b = F.array_distinct(S.tokenize_label(F.lower("p_name"))), F.array_distinct(S.tokenize_label(F.lower("p_type")))
    return T(spark, d, "part").select("p_partkey", r6(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).alias("j"))


@query("sim2_ks_statistic", "WITH v AS (SELECT o_totalprice AS v, sum((o_orderstatus = 'F')::int) AS na, sum((o_orderstatus = 'O')::int) AS nb FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1), c AS (SELECT abs(sum(na) OVER (ORDER BY v) / sum(na) OVER () - sum(nb) OVER (ORDER BY v) / sum(nb) OVER ()) AS g FROM v) SELECT round(max(g), 6) AS ks FROM c")
def sim2(spark, d):
    return similarity.ks_statistic(T(spark, d, "orders"), "o_orderstatus", "o_totalprice", "F", "O").select(r6("ks").alias("ks"))


@query("sim3_mann_whitney", "WITH r AS (SELECT c_mktsegment AS g, rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2.0 AS r FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')), s AS (SELECT sum(CASE WHEN g = 'BUILDING' THEN r ELSE 0 END) AS r, sum((g = 'BUILDING')::int)::bigint AS na, sum((g <> 'BUILDING')::int)::bigint AS nb FROM r) SELECT round(r - na * (na + 1) / 2.0, 6)::double AS u, na, nb FROM s")
def sim3(spark, d):
    return similarity.mann_whitney(T(spark, d, "customer"), "c_mktsegment", "c_acctbal", "BUILDING", "MACHINERY").withColumn("u", r6("u"))


@query("sim5_set_jaccard", "WITH h AS (SELECT DISTINCT event_type AS g, user_id AS v FROM events), n AS (SELECT g, count(*) AS n FROM h GROUP BY g) SELECT x.g AS a, y.g AS b, round(count(*) / (max(na.n) + max(nb.n) - count(*)), 6) AS jaccard FROM h x JOIN h y ON x.v = y.v AND x.g < y.g JOIN n na ON na.g = x.g JOIN n nb ON nb.g = y.g GROUP BY 1, 2")
def sim5(spark, d):
    return similarity.jaccard(T(spark, d, "events"), "event_type", "user_id").withColumn("jaccard", r6("jaccard"))


@query("sim6_coverage", "WITH p AS (SELECT c_mktsegment AS g, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer GROUP BY 1) SELECT x.g AS a, y.g AS b, round(greatest(least(x.hi, y.hi) - greatest(x.lo, y.lo), 0) / (greatest(x.hi, y.hi) - least(x.lo, y.lo)), 6) AS coverage FROM p x JOIN p y ON x.g < y.g")
def sim6(spark, d):
    return similarity.coverage(T(spark, d, "customer"), "c_mktsegment", "c_acctbal").withColumn("coverage", r6("coverage"))


_TFIDF = "WITH t AS (SELECT n_nationkey % 5 AS doc, unnest(string_split(lower(p_type), ' ')) AS token FROM part JOIN nation ON p_partkey % 25 = n_nationkey), c AS (SELECT doc, token, count(*) AS n FROM t GROUP BY ALL), w AS (SELECT doc, token, n / sum(n) OVER (PARTITION BY doc) * ln((SELECT count(DISTINCT doc) FROM c) / (1 + count(*) OVER (PARTITION BY token))) AS weight FROM c)"


def _weights(spark, d):
    t = T(spark, d, "part").join(T(spark, d, "nation"), F.col("p_partkey") % 25 == F.col("n_nationkey"))
    return similarity.tfidf(t.select((F.col("n_nationkey") % 5).alias("doc"), F.explode(F.split(F.lower("p_type"), " ", -1)).alias("token")), "doc", "token")


@query("sim9_tfidf", _TFIDF + " SELECT doc, token, round(weight, 6) AS weight FROM w")
def sim9(spark, d):
    return _weights(spark, d).withColumn("weight", r6("weight"))


@query("sim8_cosine", _TFIDF + ", n AS (SELECT doc, sqrt(sum(weight * weight)) AS n FROM w GROUP BY doc) SELECT x.doc AS a, y.doc AS b, round(sum(x.weight * y.weight) / (max(nx.n) * max(ny.n)), 6) AS cosine FROM w x JOIN w y ON x.token = y.token AND x.doc < y.doc JOIN n nx ON nx.doc = x.doc JOIN n ny ON ny.doc = y.doc GROUP BY 1, 2")
def sim8(spark, d):
    return similarity.cosine(_weights(spark, d)).withColumn("cosine", r6("cosine"))


_EDGES = "WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier UNION ALL SELECT DISTINCT 's' || l_suppkey, 'f' || l_returnflag FROM lineitem)"


def _edges(spark, d):
    a = T(spark, d, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst"))
    b = T(spark, d, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("src"), F.concat(F.lit("s"), "s_suppkey").alias("dst"))
    c = T(spark, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("f"), "l_returnflag").alias("dst")).distinct()
    return a.unionByName(b).unionByName(c)


@query("gr9_roots", _EDGES + " SELECT DISTINCT src AS node FROM e WHERE src NOT IN (SELECT dst FROM e)")
def gr9(spark, d):
    return graph.roots(_edges(spark, d))


@query("gr10_adjacency", _EDGES + ", o AS (SELECT src AS node, count(*) AS n_out FROM e GROUP BY 1), i AS (SELECT dst AS node, count(*) AS n_in FROM e GROUP BY 1) SELECT node, coalesce(n_out, 0) AS n_out, coalesce(n_in, 0) AS n_in FROM o FULL JOIN i USING (node)")
def gr10(spark, d):
    return graph.adjacency(_edges(spark, d))


@query("gr11_descendants", _EDGES + ", w(node, descendant, hops) AS (SELECT src, dst, 1 FROM e UNION SELECT w.node, e.dst, w.hops + 1 FROM w JOIN e ON w.descendant = e.src) SELECT node, descendant, min(hops)::bigint AS hops FROM w GROUP BY 1, 2")
def gr11(spark, d):
    return graph.descendants(_edges(spark, d))


@query("gr13_paths", _EDGES + ", w(src, dst, path, hops) AS (SELECT src, dst, src || '>' || dst, 1 FROM e UNION ALL SELECT w.src, e.dst, w.path || '>' || e.dst, w.hops + 1 FROM w JOIN e ON w.dst = e.src) SELECT src, dst, path, hops::bigint AS hops FROM w")
def gr13(spark, d):
    return graph.paths(_edges(spark, d))


@query("gr12_cycles", "WITH RECURSIVE e AS (SELECT 'p' || p_partkey AS src, 'p' || (p_partkey * p_partkey + 3) % 97 AS dst FROM part), w(a, b) AS (SELECT src, dst FROM e UNION SELECT w.a, e.dst FROM w JOIN e ON w.b = e.src) SELECT DISTINCT a AS node FROM w WHERE a = b")
def gr12(spark, d):
    # Every part points at one other: chains that run into rings, and rings of several sizes.
    key = F.col("p_partkey")
    return graph.in_cycle(T(spark, d, "part").select(F.concat(F.lit("p"), key).alias("src"), F.concat(F.lit("p"), (key * key + 3) % 97).alias("dst")))


@query("gr25_cascade", _EDGES + ", w(node) AS (SELECT 'r1' UNION SELECT e.dst FROM w JOIN e ON w.node = e.src) SELECT node FROM w")
def gr25(spark, d):
    return graph.cascade(_edges(spark, d), spark.createDataFrame([("r1",)], "node string"))


@query("gr23_reverse", _EDGES + " SELECT dst AS src, src AS dst FROM e")
def gr23(spark, d):
    return graph.reverse(_edges(spark, d))


_RANKED = "WITH n AS (SELECT c_mktsegment AS s, o_orderpriority AS l, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), r AS (SELECT s, l, row_number() OVER (PARTITION BY s ORDER BY n DESC, l) AS rank FROM n QUALIFY rank <= 3), g AS (SELECT c_custkey AS key, c_mktsegment AS s, o_orderpriority AS l FROM customer JOIN orders ON o_custkey = c_custkey QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) = 1)"


@query("ev1_ranked_metrics", _RANKED + " SELECT round(avg(coalesce(1 / rank, 0)), 6) AS mrr, round(avg((coalesce(rank, 0) = 1)::int), 6) AS accuracy, round(avg((rank IS NOT NULL)::int), 6) AS coverage FROM g LEFT JOIN r USING (s, l)")
def ev1(spark, d):
    both = T(spark, d, "orders").join(T(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    counts = both.groupBy(F.col("c_mktsegment").alias("s"), F.col("o_orderpriority").alias("l")).agg(F.count("*").alias("n"))
    ranked = relational.top_k(counts, 3, ["s"], [F.desc("n"), F.col("l")])
    gold = relational.first_per_key(both, ["c_custkey"], [F.col("o_orderkey")]).select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("s"), F.col("o_orderpriority").alias("l"))
    lists = gold.select("key", "s").join(ranked, "s").select("key", "l", "rank")
    m = evaluation.ranked_metrics(gold.select("key", "l"), lists, "key", "l")
    return m.select(*[r6(c).alias(c) for c in m.columns])


_CELLS = "WITH m AS (SELECT CASE WHEN l_quantity > 25 THEN 'big' ELSE 'small' END AS gold, CASE WHEN l_extendedprice > 40000 THEN 'big' ELSE 'small' END AS pred, count(*) AS n FROM lineitem GROUP BY ALL)"


def _cells(spark, d):
    rows = T(spark, d, "lineitem").select(F.when(F.col("l_quantity") > 25, "big").otherwise("small").alias("g"), F.when(F.col("l_extendedprice") > 40000, "big").otherwise("small").alias("p"))
    return evaluation.confusion(rows, "g", "p")


@query("ev7_confusion", _CELLS + " SELECT * FROM m")
def ev7(spark, d):
    return _cells(spark, d)


@query("ev7_f_beta", _CELLS + ", c AS (SELECT DISTINCT gold AS cls FROM m), s AS (SELECT cls, coalesce((SELECT sum(n) FROM m WHERE gold = cls AND pred = cls), 0) AS hit, (SELECT sum(n) FROM m WHERE gold = cls) AS g, (SELECT sum(n) FROM m WHERE pred = cls) AS p FROM c) SELECT cls, round(hit / p, 6) AS precision, round(hit / g, 6) AS recall, round(2 * hit / (p + g), 6) AS f FROM s")
def ev7f(spark, d):
    f = evaluation.f_beta(_cells(spark, d))
    return f.select("cls", *[r6(c).alias(c) for c in ("precision", "recall", "f")])


@query("ev8_report_average", "WITH r AS (SELECT c_mktsegment AS source, avg(c_acctbal) AS score FROM customer GROUP BY 1) SELECT source, round(score, 6) AS score FROM r UNION ALL SELECT 'average', round(avg(score), 6) FROM r")
def ev8(spark, d):
    report = T(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("source")).agg(F.avg("c_acctbal").alias("score"))
    return evaluation.with_average(report, "source").withColumn("score", r6("score"))
