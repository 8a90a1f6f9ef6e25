"""Graph operators over an edge table (src, dst, label): adjacency, reachability, paths, cycles, cascades.

Walks run to their fixpoint: a round joins the frontier, which holds what the round before found new, with the
edge table, so it costs what it adds. No walk has a bound on its length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.rounds import cut


def adjacency(edges: DataFrame) -> DataFrame:
    """Of each node its in- and out-degree (GR10, GR15)."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n_out"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n_in"))
    both = out.join(into, "node", "full")
    return both.select("node", F.coalesce("n_out", F.lit(0)).alias("n_out"), F.coalesce("n_in", F.lit(0)).alias("n_in"))


def roots(edges: DataFrame) -> DataFrame:
    """Nodes that no edge enters (GR9)."""
    return edges.select(F.col("src").alias("node")).distinct().join(edges.select(F.col("dst").alias("node")), "node", "left_anti")


def descendants(edges: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """(node, descendant, hops): all reachable nodes with their least distance (GR5, GR11, GR14), of every node or of
    those in `start` (node). A node in a cycle is among its own descendants."""
    step = cut(edges.select("src", "dst").distinct())
    first = step if start is None else step.join(start.select(F.col("node").alias("src")).distinct(), "src", "left_semi")
    frontier = cut(first.select(F.col("src").alias("node"), F.col("dst").alias("descendant"), F.lit(1).cast("long").alias("hops")))
    seen, hops = frontier, 1
    while not frontier.isEmpty():
        hops += 1
        reached = frontier.join(step, frontier["descendant"] == step["src"]).select("node", F.col("dst").alias("descendant")).distinct()
        frontier = cut(reached.join(seen, ["node", "descendant"], "left_anti").withColumn("hops", F.lit(hops).cast("long")))
        seen = seen.unionByName(frontier)
    return seen


def paths(edges: DataFrame) -> DataFrame:
    """Every path (src, dst, path, hops) of an acyclic graph, the path as a joined string of nodes (GR13); a graph with a
    cycle has no end of paths and is an error."""
    step = cut(edges.select(F.col("src").alias("at"), F.col("dst").alias("to")))
    frontier = cut(step.select(F.col("at").alias("src"), F.col("to").alias("dst"), F.array("at", "to").alias("nodes")))
    found = [frontier]
    while not frontier.isEmpty():
        if not frontier.where("array_contains(slice(nodes, 1, size(nodes) - 1), dst)").isEmpty():
            raise ValueError("the graph has a cycle")
        longer = frontier.join(step, frontier["dst"] == step["at"])
        frontier = cut(longer.select("src", F.col("to").alias("dst"), F.array_append("nodes", F.col("to")).alias("nodes")))
        found.append(frontier)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select("src", "dst", F.array_join("nodes", ">").alias("path"), (F.size("nodes") - 1).cast("long").alias("hops"))


def in_cycle(edges: DataFrame) -> DataFrame:
    """Nodes that reach themselves (GR12). Edges from nodes that none enters, or to nodes that none leaves, go first, round
    by round; only what is left is walked."""
    left, n = cut(edges.select("src", "dst").distinct()), -1
    while (now := left.count()) != n:
        n = now
        left = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        left = cut(left.join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"))
    return descendants(left).where("node = descendant").select("node")


def cascade(edges: DataFrame, start: DataFrame) -> DataFrame:
    """Nodes that go when `start` (node) goes: it and all that it reaches (GR25, downwards)."""
    below = descendants(edges, start).select(F.col("descendant").alias("node"))
    return start.select("node").unionByName(below).distinct()


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])


def same_edges(a: DataFrame, b: DataFrame) -> bool:
    """Whether two graphs have the same edges (GR17)."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def quick_graph(spark, literals: list[str]) -> DataFrame:
    """Edges from literals like A--likes--B (GR29)."""
    rows = spark.createDataFrame([(x,) for x in literals], "lit string")
    part = lambda k: F.get(F.split("lit", "--"), F.lit(k))
    return rows.select(part(0).alias("src"), part(2).alias("dst"), part(1).alias("label"))


def neighbourhood(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """(start, node, hops): whatever lies within `hops` links of each start (node), along links in either direction,
    with its least distance (GR26). The frontier holds new nodes only, so a round costs what it adds."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    seen = start.select(F.col("node").alias("start"), "node", F.lit(0).alias("hops")).distinct()
    frontier = seen
    for hop in range(1, hops + 1):
        following = frontier.join(both, frontier["node"] == both["src"]).select("start", F.col("dst").alias("node")).distinct()
        frontier = following.join(seen, ["start", "node"], "left_anti").withColumn("hops", F.lit(hop))
        seen = seen.unionByName(frontier)
    return seen


def prune_childless(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges left when the edges to `gone` (node) and all below them go, and then parents that keep no child, upwards
    (GR25). A node that never had a child stays."""
    below = cut(cascade(edges, gone))
    left = edges.join(below.select(F.col("node").alias("dst")), "dst", "left_anti").join(below.select(F.col("node").alias("src")), "src", "left_anti")
    left, had = cut(left), edges.select(F.col("src").alias("dst")).distinct()
    while True:
        empty = left.join(had, "dst", "left_semi").join(left.select(F.col("src").alias("dst")), "dst", "left_anti").select("dst").distinct()
        empty = cut(empty)
        if empty.isEmpty():
            return left
        left = cut(left.join(empty, "dst", "left_anti"))


def add_edges(edges: DataFrame, more: DataFrame) -> DataFrame:
    """The graph with more edges, each edge once (GR8)."""
    return edges.unionByName(more.select(*edges.columns)).distinct()


def remove_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """The graph without these edges (src, dst, label); what they link stays (GR8)."""
    return edges.join(gone, [c for c in ("src", "dst", "label") if c in gone.columns], "left_anti")


def remove_nodes(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """The graph without these nodes (node) and the edges on them (GR8)."""
    for end in ("src", "dst"):
        edges = edges.join(gone.select(F.col("node").alias(end)), end, "left_anti")
    return edges


def as_document(edges: DataFrame) -> DataFrame:
    """(nodes, edges) in one row of a model graph: its node names in order and its edges as structs, sorted (SNK9)."""
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).agg(F.sort_array(F.collect_set("node")).alias("nodes"))
    return nodes.join(edges.agg(F.sort_array(F.collect_list(F.struct("src", "label", "dst"))).alias("edges")))


def from_document(documents: DataFrame) -> DataFrame:
    """Edges of graphs that as_document made (SNK9)."""
    return documents.select(F.explode("edges").alias("e")).select("e.src", "e.dst", "e.label")


def dot_lines(edges: DataFrame) -> DataFrame:
    """(value): each edge as a line of a DOT digraph's body (SNK8)."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return edges.select(F.concat(quoted("src"), F.lit(" -> "), quoted("dst"), F.lit(" [label="), quoted("label"), F.lit("];")).alias("value"))
