"""Operators on many small graphs kept in one edge table: canonical text, shortest paths, connecting trees, patterns."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.kernels import per_object


def canonical_text(edges: DataFrame, key: str) -> DataFrame:
    """(key, text): equal for trees that differ in node ids and edge order only (GR16). `edges`: key, src, src_label,
    label, dst, dst_label. A node is written (label:edge-child,...) with its children sorted; a cycle is an error."""

    def one(rows: list[dict]):
        labels, children, entered = {}, {}, set()
        for r in rows:
            labels[r["src"]], labels[r["dst"]] = r["src_label"], r["dst_label"]
            children.setdefault(r["src"], []).append((r["label"], r["dst"]))
            entered.add(r["dst"])
        roots = [n for n in labels if n not in entered]
        text: dict = {}
        todo, open_ = [(n, False) for n in roots], set()
        while todo:
            node, done = todo.pop()
            if done:
                kids = sorted(f"{p}-{text[c]}" for p, c in children.get(node, []))
                text[node] = f"({labels[node]}:{','.join(kids)})" if kids else str(labels[node])
                open_.discard(node)
            elif node in open_:
                raise ValueError("the graph has a cycle")
            elif node not in text:
                open_.add(node)
                todo.append((node, True))
                todo += [(c, False) for _, c in children.get(node, [])]
        if len(text) < len(labels):
            raise ValueError("the graph has a cycle")
        yield (",".join(sorted(text[r] for r in roots)),)

    return per_object(edges, key, one, "text string")


def link_weights(links: DataFrame, models: int) -> DataFrame:
    """Weights of links (key, tags array, known boolean): 1 - tags / (models + 1) for those that known models hold, and
    for the rest as much as there are of them (GR21)."""
    new = ~F.coalesce("known", F.lit(False))
    high = F.sum(new.cast("double")).over(Window.partitionBy("key"))
    return links.withColumn("weight", F.when(new, high).otherwise(1 - F.size("tags") / F.lit(models + 1)))


def _distances(out: dict, start) -> dict:
    """Node -> (distance, links of a least path from `start`); of equal paths the first by its links."""
    found, todo = {}, [(0.0, (), start)]
    while todo:
        far, path, node = heapq.heappop(todo)
        if node in found:
            continue
        found[node] = (far, path)
        for weight, dst in out.get(node, ()):
            if dst not in found:
                heapq.heappush(todo, (far + weight, (*path, (node, dst)), dst))
    return found


def _adjacent(rows: list[dict], back: bool = False) -> dict:
    out: dict = {}
    for r in rows:
        a, b = (r["dst"], r["src"]) if back else (r["src"], r["dst"])
        out.setdefault(a, []).append((float(r["weight"]), b))
    return out


def shortest_paths(edges: DataFrame, key: str, start) -> DataFrame:
    """(key, node, distance, path): least paths from `start` in each graph of (key, src, dst, weight >= 0) (GR18)."""

    def one(rows: list[dict]):
        for node, (far, path) in sorted(_distances(_adjacent(rows), start).items()):
            yield node, far, [start, *[b for _, b in path]]

    kind = edges.schema["src"].dataType.simpleString()
    return per_object(edges, key, one, f"node {kind}, distance double, path array<{kind}>")


def connecting_trees(edges: DataFrame, key: str, terminals: list, top: int = 1) -> DataFrame:
    """The `top` lightest trees found whose root reaches every terminal (GR22, GR24), by searching backwards from each
    terminal: (key, place, root, weight, links). Trees of equal links count once; links that share a path weigh once."""

    def one(rows: list[dict]):
        back = _adjacent(rows, back=True)
        lightest: dict = {}
        for r in rows:
            pair = (r["src"], r["dst"])
            lightest[pair] = min(float(r["weight"]), lightest.get(pair, float("inf")))
        reach = [_distances(back, t) for t in terminals]
        trees: dict = {}
        for root in sorted(set.intersection(*[set(r) for r in reach])):
            into: dict = {}  # one entering link a node, so that what remains is a tree
            for r in reach:
                for a, b in reversed(r[root][1]):  # stored backwards: the link is b -> a
                    into.setdefault(a, b)
            links, todo = set(), list(terminals)
            while todo:
                node = todo.pop()
                if node != root and (into[node], node) not in links:
                    links.add((into[node], node))
                    todo.append(into[node])
            trees.setdefault(frozenset(links), (sum(lightest[x] for x in links), root))
        ranked = sorted((w, root, sorted(links)) for links, (w, root) in trees.items())
        for place, (w, root, links) in zip(range(1, top + 1), ranked):
            yield place, root, w, [{"src": a, "dst": b} for a, b in links]

    kind = edges.schema["src"].dataType.simpleString()
    return per_object(edges, key, one, f"place int, root {kind}, weight double, links array<struct<src:{kind},dst:{kind}>>")


def interval_parents(ranges: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Each interval's parent, the shortest other interval of its key that holds it (GR31), by a stack over intervals
    sorted by start and falling end. Adds parent_start and parent_end, null at the top. Equal intervals have one parent.
    Intervals that cross are an error, as no tree holds them."""

    def one(rows: list[dict]):
        stack: list = []
        for a, b in sorted({(r[start], r[end]) for r in rows}, key=lambda x: (x[0], -x[1])):
            while stack and stack[-1][1] <= a:
                stack.pop()
            if stack and stack[-1][1] < b:
                raise ValueError(f"intervals {stack[-1]} and {(a, b)} cross")
            yield (a, b, *(stack[-1] if stack else (None, None)))
            stack.append((a, b))

    kind = ranges.schema[start].dataType.simpleString()
    return per_object(ranges, key, one, f"{start} {kind}, {end} {kind}, parent_start {kind}, parent_end {kind}")


def match_path(edges: DataFrame, pattern: list[str]) -> DataFrame:
    """(start, end) of all paths whose links carry the labels of `pattern` in turn; '*' takes any label (GR33).
    One join a step; equal ends are reduced to one row before the next."""
    step = edges.select("src", "dst", "label")
    at = None
    for label in pattern:
        own = step if label == "*" else step.where(F.col("label") == label)
        if at is None:
            at = own.select(F.col("src").alias("start"), F.col("dst").alias("end"))
        else:
            at = at.join(own.select(F.col("src").alias("end"), F.col("dst").alias("next")), "end").select("start", F.col("next").alias("end"))
        at = at.distinct()
    return at


def nodes_with_patterns(edges: DataFrame, patterns: list[list[str]]) -> DataFrame:
    """Nodes from which every pattern has a path; two patterns may use one link (GR33)."""
    found = [match_path(edges, p).select(F.col("start").alias("node"), F.lit(i).alias("p")) for i, p in enumerate(patterns)]
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    return every.distinct().groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") == len(patterns)).select("node")
