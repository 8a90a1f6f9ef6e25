"""Models grown attribute by attribute: states, the ways to merge the next attribute in, a beam for every source at once.

A state is a row: its source, its nodes (number, class), its links (src, label, dst or attr), the attributes still left and
the log of its chance. One round of all sources' beams is joins on class labels and one window per source, so sources are
searched side by side and none is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.rounds import cut

_STATE = ("source", "nodes", "links", "left", "score")


def _node(number: Column, label: Column) -> Column:
    return F.struct(number.cast("int").alias("node"), label.alias("label"))


def _link(src: Column, label: Column, dst: Column | None = None, attr: Column | None = None) -> Column:
    none = lambda kind: F.lit(None).cast(kind)
    return F.struct(src.cast("int").alias("src"), label.alias("label"), (none("int") if dst is None else dst.cast("int")).alias("dst"), (none("string") if attr is None else attr).alias("attr"))


def _named(states: DataFrame) -> DataFrame:
    """With `id`, the state's links as text in order, and `terminal`."""
    said = F.transform(F.array_sort("links"), lambda e: F.concat_ws(" ", e["src"].cast("string"), e["label"], F.coalesce(e["dst"].cast("string"), e["attr"])))
    labels = F.array_join(F.transform(F.array_sort("nodes"), lambda n: n["label"]), ",")
    return states.withColumn("id", F.concat_ws("|", F.col("source").cast("string"), labels, F.array_join(said, ";"))).withColumn("terminal", F.size("left") == 0)


def first_states(types: DataFrame) -> DataFrame:
    """A state for each candidate type of every source's first attribute (SE4). `types`: source, attr, cls, predicate, score;
    attributes go in the order of their names."""
    order = types.groupBy("source").agg(F.sort_array(F.collect_set("attr")).alias("attrs"))
    own = types.join(order, "source").where(F.col("attr") == F.col("attrs")[0])
    zero = F.lit(0)
    return _named(own.select(
        "source", F.array(_node(zero, F.col("cls"))).alias("nodes"), F.array(_link(zero, F.col("predicate"), attr=F.col("attr"))).alias("links"),
        F.expr("slice(attrs, 2, greatest(size(attrs) - 1, 0))").alias("left"), F.ln("score").alias("score"),
    ))


def expand(states: DataFrame, types: DataFrame, links: DataFrame) -> DataFrame:
    """All states with one attribute more (SE5, SE6, GR27, GR28): its data link goes to a node of its class that has none of
    that predicate; or to a new node of its class, which is merged in below a node, above the root, or beside the root
    under a new common parent. `links`: src, predicate, dst (classes), p, the chance of a link between them."""
    open_ = states.where("not terminal").withColumn("attr", F.col("left")[0]).withColumn("left", F.expr("slice(left, 2, greatest(size(left) - 1, 0))"))
    cand = open_.join(types.withColumnRenamed("score", "own"), ["source", "attr"]).withColumn("score", F.col("score") + F.ln("own"))
    new, attr = F.size("nodes"), F.col("attr")
    data = lambda at: _link(at, F.col("predicate"), attr=attr)
    into = cand.withColumn("at", F.explode(F.filter("nodes", lambda n: n["label"] == F.col("cls"))))
    taken = F.exists("links", lambda e: (e["src"] == F.col("at")["node"]) & (e["label"] == F.col("predicate")) & e["attr"].isNotNull())
    into = into.where(~taken).select("source", "nodes", F.concat("links", F.array(data(F.col("at")["node"]))).alias("links"), "left", "score")

    way = links.select(F.col("src").alias("up"), F.col("predicate").alias("by"), F.col("dst").alias("down"), F.col("p").alias("chance"))
    below = cand.withColumn("at", F.explode("nodes")).join(way, (F.col("at")["label"] == F.col("up")) & (F.col("cls") == F.col("down")))
    below = below.select(
        "source", F.concat("nodes", F.array(_node(new, F.col("cls")))).alias("nodes"), F.concat("links", F.array(_link(F.col("at")["node"], F.col("by"), new), data(new))).alias("links"),
        "left", (F.col("score") + F.ln("chance")).alias("score"),
    )
    root = F.filter("nodes", lambda n: ~F.exists("links", lambda e: F.coalesce(e["dst"] == n["node"], F.lit(False))))[0]
    rooted = cand.withColumn("root", root)
    above = rooted.join(way, (F.col("cls") == F.col("up")) & (F.col("root")["label"] == F.col("down")))
    above = above.select(
        "source", F.concat("nodes", F.array(_node(new, F.col("cls")))).alias("nodes"), F.concat("links", F.array(_link(new, F.col("by"), F.col("root")["node"]), data(new))).alias("links"),
        "left", (F.col("score") + F.ln("chance")).alias("score"),
    )
    # A class that links both: the new node's class and the root's.
    one, two = way.toDF("up", "by", "down", "chance"), way.toDF("up2", "by2", "down2", "chance2")
    common = one.join(two, F.col("up") == F.col("up2"))
    beside = rooted.join(common, (F.col("cls") == F.col("down")) & (F.col("root")["label"] == F.col("down2")))
    beside = beside.select(
        "source", F.concat("nodes", F.array(_node(new, F.col("cls")), _node(new + 1, F.col("up")))).alias("nodes"),
        F.concat("links", F.array(_link(new + 1, F.col("by"), new), _link(new + 1, F.col("by2"), F.col("root")["node"]), data(new))).alias("links"),
        "left", (F.col("score") + F.ln("chance") + F.ln("chance2")).alias("score"),
    )
    return _named(into.unionByName(below).unionByName(above).unionByName(beside))


def predict(types: DataFrame, links: DataFrame, width: int = 20, results: int = 1) -> DataFrame:
    """(source, id, nodes, links, left, score, terminal, place): the best models of every source by a beam of `width`
    (SE21). A source whose attributes can't all be merged in ends with the best states it got to."""
    types, links = cut(types.select("source", "attr", "cls", "predicate", "score")), cut(links.select("src", "predicate", "dst", "p"))
    best = Window.partitionBy("source").orderBy(F.desc("score"), "id")
    keep = lambda states, n: states.withColumn("place", F.row_number().over(best)).where(F.col("place") <= n)
    frontier = cut(keep(first_states(types), width).drop("place"))
    found = frontier.where("terminal")
    while not frontier.where("not terminal").isEmpty():
        following = cut(keep(expand(frontier, types, links).dropDuplicates(["id"]), width).drop("place"))
        stuck = frontier.where("not terminal").join(following.select("source").distinct(), "source", "left_anti")
        found = cut(found.unionByName(stuck).unionByName(following.where("terminal")))
        frontier = following
    return keep(found, results).withColumn("place", F.col("place").cast("long"))


def eliminate(edges: DataFrame) -> DataFrame:
    """(graph, gone, src, label, dst): of each model a candidate for every data node, without it and without the nodes that
    this leaves childless, upwards (SE19). `edges`: graph, src, label, dst, data. A candidate without links is no row."""
    variants = edges.where("data").select("graph", F.col("dst").alias("gone")).distinct()
    left = cut(edges.join(variants, "graph").where("not (data and dst = gone)"))
    while True:
        parents = left.select("graph", "gone", F.col("src").alias("dst")).distinct()
        empty = cut(left.where("not data").join(parents, ["graph", "gone", "dst"], "left_anti").select("graph", "gone", "dst").distinct())
        if empty.isEmpty():
            return left.select("graph", "gone", "src", "label", "dst")
        left = cut(left.join(empty, ["graph", "gone", "dst"], "left_anti"))
