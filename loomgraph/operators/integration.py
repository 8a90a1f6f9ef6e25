"""Known models folded into one graph, and mappings of attributes onto its links.

Models are small graphs and there are few of them: their fold depends on their order, so it is one task's work. What
is done with the graph afterwards - scores, features, evaluation - is joins and aggregates again."""

from __future__ import annotations

from collections import defaultdict
from itertools import permutations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.kernels import per_object

_OUT = "src int, src_label string, label string, dst int, dst_label string, data boolean, tags array<string>, src_tags array<string>"


class _Fold:
    """Nodes (label, data, models that have them) and links (src, label, dst -> models) so far."""

    def __init__(self) -> None:
        self.labels: list[str] = []
        self.data: list[bool] = []
        self.tags: list[set[str]] = []
        self.links: dict[tuple[int, str, int], set[str]] = {}
        self.out: dict[int, list[tuple[str, int]]] = defaultdict(list)
        self.into: dict[int, set[int]] = defaultdict(set)
        self.of: dict[str, list[int]] = defaultdict(list)

    def node(self, label: str, data: bool) -> int:
        self.labels.append(label)
        self.data.append(data)
        self.tags.append(set())
        if not data:
            self.of[label].append(len(self.labels) - 1)
        return len(self.labels) - 1

    def link(self, src: int, label: str, dst: int, model: str) -> None:
        if (src, label, dst) not in self.links:
            self.links[src, label, dst] = set()
            self.out[src].append((label, dst))
            self.into[dst].add(src)
        self.links[src, label, dst].add(model)

    def _best(self, nodes: list[int]) -> int:
        """The node of the most models, the last of equals."""
        return max(nodes, key=lambda n: (len(self.tags[n]), n))

    def add(self, model: str, edges: list[dict]) -> None:
        label: dict[str, str] = {}
        parents: dict[str, set[str]] = defaultdict(set)
        for e in edges:
            label.setdefault(e["src"], e["src_label"])
            if not e["data"]:
                label.setdefault(e["dst"], e["dst_label"])
                parents[e["dst"]].add(e["src_label"])
        groups: dict[str, list[str]] = defaultdict(list)
        for node, own in label.items():
            groups[own].append(node)
        place: dict[str, int] = {}
        for own in sorted(groups):
            for _ in range(len(groups[own]) - len(self.of[own])):
                self.node(own, False)
            free = lambda: [n for n in self.of[own] if model not in self.tags[n]]  # noqa: B023, E731
            # Nodes below a parent of the same label first, then whatever is free.
            for alike in (True, False):
                for node in groups[own]:
                    near = [n for n in free() if not alike or any(self.labels[p] in parents[node] for p in self.into[n])]
                    if node not in place and near:
                        place[node] = self._best(near)
                        self.tags[place[node]].add(model)
        used: set[int] = set()
        for e in (e for e in edges if e["data"]):
            src = place[e["src"]]
            at = next((d for p, d in self.out[src] if p == e["label"] and d not in used and self.data[d]), None)
            at = self.node("DATA_NODE", True) if at is None else at
            used.add(at)
            place[e["dst"]] = at
            self.tags[at].add(model)
        for e in edges:
            self.link(place[e["src"]], e["label"], place[e["dst"]], model)


def integration_graph(models: DataFrame) -> DataFrame:
    """(src, src_label, label, dst, dst_label, data, tags, src_tags): all models as one graph (GR19). `models`: model,
    src, src_label, label, dst, dst_label, data (whether dst is a data node). In the order of their names, each model's
    class nodes go to nodes of their label, first to those below a parent of the same label, and among them to the node
    that most models have; missing ones are added. Data nodes go by the link that leads to them. Links keep the names of
    their models."""

    def fold(rows: list[dict]):
        graph, per = _Fold(), defaultdict(list)
        for r in rows:
            per[r["model"]].append(r)
        for model in sorted(per):
            graph.add(model, sorted(per[model], key=lambda e: (e["src"], e["label"], e["dst"])))
        for (s, p, d), tags in sorted(graph.links.items()):
            yield s, graph.labels[s], p, d, graph.labels[d], graph.data[d], sorted(tags), sorted(graph.tags[s])

    return per_object(models.withColumn("graph", F.lit("known")), "graph", fold, _OUT).drop("graph")


def with_types(graph: DataFrame, types: DataFrame, tag: str = "NEW_SOURCE") -> DataFrame:
    """The graph with data nodes for a new source's candidate types (cls, predicate) that it has none for (GR20): under
    every node of that class, or under one node more where there is none. Added nodes are numbered on from its own."""
    nodes = graph.select(F.col("src").alias("node"), F.col("src_label").alias("cls")).unionByName(graph.where("not data").select(F.col("dst").alias("node"), F.col("dst_label").alias("cls"))).distinct()
    types = types.select("cls", "predicate").distinct()
    top = graph.agg(F.greatest(F.max("src"), F.max("dst")).alias("top"))
    # The numbers are given to what is missing: rows of candidate types, not of any table.
    new = types.select("cls").distinct().join(nodes, "cls", "left_anti").join(F.broadcast(top))
    new = new.select("cls", (F.col("top") + F.row_number().over(Window.orderBy("cls"))).alias("node"))
    every = nodes.unionByName(new.select("node", "cls"))
    has = graph.where("data").select(F.col("src").alias("node"), F.col("label").alias("predicate")).distinct()
    missing = types.join(every, "cls").join(has, ["node", "predicate"], "left_anti")
    last = top.join(new.agg(F.count("*").alias("more"))).select((F.col("top") + F.col("more")).alias("last"))
    number = F.col("last") + F.row_number().over(Window.orderBy("node", "predicate"))
    added = missing.join(F.broadcast(last)).select(
        F.col("node").alias("src"), F.col("cls").alias("src_label"), F.col("predicate").alias("label"), number.cast("int").alias("dst"),
        F.lit("DATA_NODE").alias("dst_label"), F.lit(True).alias("data"), F.array(F.lit(tag)).alias("tags"), F.array(F.lit(tag)).alias("src_tags"),
    )
    return graph.unionByName(added.withColumn("src", F.col("src").cast("int")))


def with_ontology(graph: DataFrame, links: DataFrame, tag: str = "ONTOLOGY") -> DataFrame:
    """The graph with the links (src label, predicate, dst label) that an ontology allows between its class nodes and that
    it lacks (GR20): equality joins on labels, then an anti join."""
    nodes = graph.select(F.col("src").alias("node"), F.col("src_label").alias("cls"), F.col("src_tags").alias("tags"))
    nodes = nodes.unionByName(graph.where("not data").select(F.col("dst").alias("node"), F.col("dst_label").alias("cls"), F.array().cast("array<string>").alias("tags")))
    nodes = nodes.groupBy("node", "cls").agg(F.max("tags").alias("tags"))
    a = nodes.select(F.col("node").alias("src"), F.col("cls").alias("src_label"), F.col("tags").alias("src_tags"))
    b = nodes.select(F.col("node").alias("dst"), F.col("cls").alias("dst_label"))
    allowed = links.select(F.col("src").alias("src_label"), F.col("predicate").alias("label"), F.col("dst").alias("dst_label")).distinct()
    may = a.join(allowed, "src_label").join(b, "dst_label").where("src <> dst")
    more = may.join(graph.select("src", "label", "dst"), ["src", "label", "dst"], "left_anti")
    more = more.withColumn("data", F.lit(False)).withColumn("tags", F.array(F.lit(tag)))
    return graph.unionByName(more.select(*graph.columns))


def mapping_features(mappings: DataFrame, graph: DataFrame) -> DataFrame:
    """(mapping, confidence, local, reduction, common): features of attribute mappings (SE9). `mappings`: mapping, attr,
    edge, score; `graph`: edge, src, tags (models of the link), src_tags. confidence: mean score. local: mean over the
    mapped nodes of the log of the largest share of their mapped links that one model has. reduction: one minus nodes
    over the most they could be (one per attribute). common: the largest share of the nodes that one model has."""
    own = mappings.join(graph.select("edge", "src", "tags", "src_tags"), "edge")
    base = own.groupBy("mapping").agg(F.avg("score").alias("confidence"), F.count("*").alias("n"), F.count_distinct("src").alias("nodes"))
    per = own.groupBy("mapping", "src").agg(F.count("*").alias("links"))
    shared = own.select("mapping", "src", F.explode("tags").alias("tag")).groupBy("mapping", "src", "tag").agg(F.count("*").alias("k")).groupBy("mapping", "src").agg(F.max("k").alias("k"))
    local = per.join(shared, ["mapping", "src"]).groupBy("mapping").agg(F.avg(F.ln(F.col("k") / F.col("links"))).alias("local"))
    tagged = own.select("mapping", "src", F.explode("src_tags").alias("tag")).distinct().groupBy("mapping", "tag").agg(F.count("*").alias("k"))
    common = tagged.groupBy("mapping").agg(F.max("k").alias("k"))
    out = base.join(local, "mapping", "left").join(common, "mapping", "left")
    reduction = F.when(F.col("n") > 1, (F.col("n") - F.col("nodes")) / (F.col("n") - 1)).otherwise(0.0)
    return out.select("mapping", "confidence", F.coalesce("local", F.lit(0.0)).alias("local"), reduction.alias("reduction"), F.coalesce(F.col("k") / F.col("nodes"), F.lit(0.0)).alias("common"))


def fit_mapping_score(features: DataFrame, target: str, logistic: bool = False):
    """A linear model of a mapping's precision, or a logistic one of whether it is right, on the four features (SE9)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    steps = [VectorAssembler(inputCols=["confidence", "local", "reduction", "common"], outputCol="x")]
    steps.append(LogisticRegression(featuresCol="x", labelCol=target) if logistic else LinearRegression(featuresCol="x", labelCol=target))
    return Pipeline(stages=steps).fit(features)


def gold_mapping(graph: DataFrame, attributes: DataFrame) -> DataFrame:
    """(model, attr, edge): of each known model the links that its attributes stand for (SE10). `graph`: edge, src, label,
    tags; `attributes`: model, attr, node (the model's own node), cls, predicate. A model's node takes one node of the
    graph: among the links of the right label and model, nodes and links are paired off in order."""
    links = graph.where("data").select("edge", "src", F.col("src_label").alias("cls"), F.col("label").alias("predicate"), F.explode("tags").alias("model"))
    number = lambda by, order: F.dense_rank().over(Window.partitionBy(*by).orderBy(order))
    ours = attributes.withColumn("n", number(["model", "cls"], "node"))
    ours = ours.withColumn("k", F.row_number().over(Window.partitionBy("model", "cls", "n", "predicate").orderBy("attr")))
    links = links.withColumn("n", number(["model", "cls"], "src"))
    links = links.withColumn("k", F.row_number().over(Window.partitionBy("model", "cls", "n", "predicate").orderBy("edge")))
    return ours.join(links, ["model", "cls", "predicate", "n", "k"]).select("model", "attr", "edge")


def evaluate_mappings(rows: DataFrame) -> DataFrame:
    """(mapping, precision, recall, f1, accuracy) under the best naming of predicted nodes (SE11). `rows`: mapping, attr,
    gold_node, gold_label, gold_predicate, node, label, predicate. Predicted nodes of a label are matched with its gold
    nodes so that most attributes agree: by all orders up to seven nodes, else by the assignment that is best."""

    def best(gains: list[list[int]]) -> int:
        n, m = len(gains), len(gains[0]) if gains else 0
        if not n or not m:
            return 0
        if n > m:
            gains = [list(c) for c in zip(*gains, strict=True)]
            n, m = m, n
        if m <= 7:
            return max(sum(gains[i][p[i]] for i in range(n)) for p in permutations(range(m), n))
        return _assign(gains)

    def score(found: list[dict]):
        hits: dict[str, dict[tuple[str, str], int]] = defaultdict(lambda: defaultdict(int))
        names: dict[str, tuple[dict, dict]] = defaultdict(lambda: ({}, {}))
        for r in found:
            names[r["label"]][0].setdefault(r["node"], len(names[r["label"]][0]))
            names[r["gold_label"]][1].setdefault(r["gold_node"], len(names[r["gold_label"]][1]))
            if r["label"] == r["gold_label"] and r["predicate"] == r["gold_predicate"]:
                hits[r["label"]][r["node"], r["gold_node"]] += 1
        tp = 0
        for label, per in hits.items():
            rows_, cols = names[label]
            gains = [[0] * len(cols) for _ in rows_]
            for (a, b), n in per.items():
                gains[rows_[a]][cols[b]] = n
            tp += best(gains)
        # One link is predicted and one is gold for each attribute.
        n = len({r["attr"] for r in found})
        p = tp / n
        yield p, p, p, tp / (2 * n - tp)

    return per_object(rows, "mapping", score, "precision double, recall double, f1 double, accuracy double")


def _assign(gains: list[list[int]]) -> int:
    """The largest sum of one cell a row, no column twice (rows at most columns): shortest augmenting paths."""
    n, m = len(gains), len(gains[0])
    u, v, match = [0] * (n + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        match[0], at = i, 0
        least, way, done = [float("inf")] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while True:
            done[at] = True
            row, step, nxt = match[at], float("inf"), 0
            for j in range(1, m + 1):
                if not done[j]:
                    cost = -gains[row - 1][j - 1] - u[row] - v[j]
                    if cost < least[j]:
                        least[j], way[j] = cost, at
                    if least[j] < step:
                        step, nxt = least[j], j
            for j in range(m + 1):
                if done[j]:
                    u[match[j]] += step
                    v[j] -= step
                else:
                    least[j] -= step
            at = nxt
            if not match[at]:
                break
        while at:
            match[at], at = match[way[at]], way[at]
    return sum(gains[match[j] - 1][j - 1] for j in range(1, m + 1) if match[j])


