"""Features of a model graph's links for the log-linear model: what statistics, types and siblings say of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Nothing weighs less than this, so that its logarithm exists.
FLOOR = 0.01


def _both(name: Column, suffix: str, p: Column) -> Column:
    """A chance as two features, for a link that is right and for one that is wrong."""
    return F.array(
        F.struct(F.concat(name, F.lit(f"=true.{suffix}")).alias("feature"), F.greatest(p, F.lit(FLOOR)).alias("weight")),
        F.struct(F.concat(name, F.lit(f"=false.{suffix}")).alias("feature"), F.greatest(1 - p, F.lit(FLOOR)).alias("weight")),
    )


def edge_features(edges: DataFrame, types: DataFrame, by_source: DataFrame, by_ends: DataFrame, nodes: DataFrame) -> DataFrame:
    """(graph, edge, feature, weight) of every link (ML8).

    `edges`: graph, edge, src, src_label, label, dst, dst_label, data, attr (of a data node); `types`: attr, cls, predicate,
    score, candidates of each attribute; `by_source`: src_label, label, p; `by_ends`: src_label, label, dst_label, p;
    `nodes`: graph, node, p, the chance that a node belongs. A link to a data node has its type's score, how far that is
    ahead of the next or behind the first, and its place; a link between classes has the chance of its label between them,
    0.5 where never seen. Both have the chance of the label at their source and that of the whole triple. Further: whether
    no sibling is a data node, whether there is no sibling, and then whether the source has no parent; and a prior. Links
    to data nodes whose type isn't a candidate have no chances. Joins are by equality on labels, attributes and nodes."""
    best = Window.partitionBy("attr").orderBy(F.desc("score"), "cls", "predicate")
    ranked = types.withColumn("place", F.row_number().over(best) - 1).withColumn("next", F.lead("score").over(best))
    ranked = ranked.withColumn("first", F.max("score").over(Window.partitionBy("attr")))
    ahead = F.when((F.col("place") == 0) & F.col("next").isNotNull(), F.col("score") - F.col("next")).otherwise(F.col("score") - F.col("first"))
    ranked = ranked.select("attr", F.col("cls").alias("src_label"), F.col("predicate").alias("label"), "score", ahead.alias("ahead"), "place")
    own = edges.join(ranked, ["attr", "src_label", "label"], "left")
    own = own.join(by_source.select("src_label", "label", F.col("p").alias("p_source")), ["src_label", "label"], "left")
    own = own.join(by_ends.select("src_label", "label", "dst_label", F.col("p").alias("p_ends")), ["src_label", "label", "dst_label"], "left")
    chance = lambda end: nodes.select("graph", F.col("node").alias(end), F.col("p").alias(f"p_{end}"))
    own = own.join(chance("src"), ["graph", "src"], "left").join(chance("dst"), ["graph", "dst"], "left")
    children = Window.partitionBy("graph", "src")
    own = own.withColumn("children", F.count("*").over(children)).withColumn("of_data", F.sum(F.col("data").cast("int")).over(children))
    below = edges.select("graph", F.col("dst").alias("src")).distinct().withColumn("below", F.lit(True))
    own = own.join(below, ["graph", "src"], "left")

    link = F.when(F.col("data"), F.col("score")).otherwise(F.coalesce("p_ends", F.lit(0.5)))
    triple = F.when(F.col("data"), link * F.col("p_src")).otherwise(link * F.col("p_src") * F.col("p_dst"))
    name, none = F.concat("src_label", F.lit("---"), "label"), F.array().cast("array<struct<feature:string,weight:double>>")
    one = lambda feature, weight=1.0: F.array(F.struct(feature.alias("feature"), (F.lit(weight) if isinstance(weight, float) else weight).alias("weight")))
    typed = F.concat(
        _both(name, "p_semantic_type", link),
        one(F.concat(name, F.lit("=true.delta_p_semantic_type")), F.col("ahead")),
        one(F.concat(name, F.lit("=false.delta_p_semantic_type")), F.greatest(1 - F.col("ahead"), F.lit(FLOOR))),
        one(F.concat(name, F.lit("-order="), F.col("place").cast("string"))),
    )
    known = F.concat(_both(name, "p_l_given_s", F.coalesce("p_source", F.lit(FLOOR))), _both(name, "p_triple", triple))
    to_class = ~F.col("data")
    no_data = to_class & (F.col("of_data") == 0)
    alone = to_class & (F.col("children") == 1)
    cls = F.concat(F.lit("class="), "src_label")
    every = F.concat(
        F.when(F.col("data") & link.isNotNull(), typed).otherwise(none),
        F.when(link.isNotNull(), known).otherwise(none),
        F.when(no_data, one(F.concat(cls, F.lit(".source_node_no_data_child")))).otherwise(none),
        F.when(alone, one(F.concat(cls, F.lit(".no_siblings")))).otherwise(none),
        F.when(alone & F.col("below").isNull(), one(F.concat(cls, F.lit(".no_parent_&_siblings")))).otherwise(none),
        one(F.lit("prior")),
    )
    return own.select("graph", "edge", F.explode(every).alias("f")).select("graph", "edge", "f.feature", "f.weight")


def duplication_table(links: DataFrame, most: int) -> DataFrame:
    """(cls, link, n, true_links, f0..f5): features of n equal links of a class of which the bits of `true_links` are right
    (ML10): none is, one is, several are, the latter two apart for links that take several values and for others. `links`:
    cls, link, is_multi; n runs from 2 to `most`."""
    n = F.explode(F.sequence(F.lit(2), F.lit(most))).alias("n")
    own = links.select("cls", "link", F.coalesce("is_multi", F.lit(False)).alias("multi"), n)
    own = own.withColumn("true_links", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("shiftleft(1L, n) - 1"))))
    right = F.bit_count("true_links")
    flag = lambda c: c.cast("double")
    nothing = F.when(right == 0, F.lit(FLOOR)).otherwise(0.0)
    multi = F.col("multi")
    return own.select(
        "cls", "link", "n", "true_links", nothing.alias("f0"), nothing.alias("f1"),
        flag((right == 1) & multi).alias("f2"), flag((right == 1) & ~multi).alias("f3"), flag((right > 1) & multi).alias("f4"), flag((right > 1) & ~multi).alias("f5"),
    )


def link_factors(features: DataFrame, weights: DataFrame) -> DataFrame:
    """(key, vars, sizes, scores): a factor for each link, its score if it is wrong and if it is right, from its features
    (graph, edge, feature, weight) and the model's weights (feature, label 0 or 1, w) (ML9, the triple's part)."""
    score = lambda label: F.coalesce(F.sum(F.when(F.col("label") == label, F.col("weight") * F.col("w"))), F.lit(0.0))
    per = features.join(weights, "feature", "left").groupBy("graph", "edge").agg(F.array(score(0), score(1)).alias("scores"))
    return per.select(F.col("graph").alias("key"), F.array("edge").alias("vars"), F.array(F.lit(2)).alias("sizes"), "scores")


def duplication_factors(edges: DataFrame, table: DataFrame, weights: list[float]) -> DataFrame:
    """(key, vars, sizes, scores): a factor for the equal links of a node (ML9, the part of duplicates): one score for each
    set of them that is right, from duplication_table's six features. `edges`: graph, edge, src, cls, link. Groups larger
    than the table has none."""
    total = sum((F.col(f"f{k}") * w for k, w in enumerate(weights)), F.lit(0.0))
    scores = table.groupBy("cls", "link", "n").agg(F.sort_array(F.collect_list(F.struct("true_links", total.alias("s")))).alias("t"))
    scores = scores.select("cls", "link", "n", F.transform("t", lambda x: x["s"]).alias("scores"))
    groups = edges.groupBy("graph", "src", "cls", "link").agg(F.sort_array(F.collect_list("edge")).alias("vars")).withColumn("n", F.size("vars"))
    return groups.join(scores, ["cls", "link", "n"]).select(F.col("graph").alias("key"), "vars", F.transform("vars", lambda _: F.lit(2)).alias("sizes"), "scores")


def kept_links(edges: DataFrame, beliefs: DataFrame) -> DataFrame:
    """Links (graph, edge, ...) that the likeliest assignment (key, var, best) of their graph holds right (SE21's filter)."""
    right = beliefs.where("best = 1").select(F.col("key").alias("graph"), F.col("var").alias("edge"))
    return edges.join(right, ["graph", "edge"], "left_semi")


def graph_chance(scores: DataFrame) -> DataFrame:
    """(key, chance): the chance that all links of a graph are right, exp(their score minus the log partition) (ML19).
    `scores`: key, factor_score (of the assignment that holds every link right), log_z."""
    return scores.groupBy("key").agg(F.exp(F.sum("factor_score") - F.max("log_z")).alias("chance"))


def write_features(features: DataFrame) -> DataFrame:
    """(graph, edge, line): a link's features as one line of text, names in order (EV11)."""
    pair = F.format_string("%s=%.4f", F.col("feature"), F.col("weight"))
    return features.groupBy("graph", "edge").agg(F.array_join(F.sort_array(F.collect_list(pair)), ";").alias("line"))
