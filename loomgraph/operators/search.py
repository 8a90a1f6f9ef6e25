"""Beam search, attribute mappings and weighted sampling over tables of states."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.rounds import cut


def beam_search(start: DataFrame, expand: Callable[[DataFrame], DataFrame], width: int, results: int, rounds: int) -> DataFrame:
    """States (id, score, terminal, ...) found from `start` (SE1). Each round expands the frontier, drops repeated ids, sets
    terminal states aside and keeps the `width` best others. Ends with `results` terminal states, an empty frontier or
    after `rounds`; with none found, the best state of the last frontier. Ties go to the smaller id."""
    best = (F.desc("score"), F.asc("id"))
    frontier, found, seen = cut(start), None, 0
    for _ in range(rounds):
        states = cut(expand(frontier).dropDuplicates(["id"]))
        ended = states.where("terminal")
        found = ended if found is None else found.unionByName(ended).dropDuplicates(["id"])
        seen = found.count()
        following = states.where("not terminal").orderBy(*best).limit(width)
        if seen >= results or following.isEmpty():
            break
        frontier = cut(following)
    if not seen:
        return frontier.orderBy(*best).limit(1)
    return found.orderBy(*best).limit(results)


def map_attributes(choices: DataFrame, key: str, order: list[str], width: int) -> DataFrame:
    """(key, mapping array<struct<attr, edge>>, score): attributes are bound in turn to edges, no edge twice, and the
    `width` best mappings of a key go on (SE7). `choices`: key, attr, edge, score."""
    at = choices.select(key).distinct().select(key, F.expr("cast(array() as array<struct<attr:string,edge:string>>)").alias("mapping"), F.lit(0.0).alias("score"))
    w = Window.partitionBy(key).orderBy(F.desc("score"), F.col("mapping").cast("string"))
    for attr in order:
        own = choices.where(F.col("attr") == attr).select(key, F.struct(F.col("attr").cast("string").alias("attr"), F.col("edge").cast("string").alias("edge")).alias("next"), F.col("score").alias("more"))
        free = ~F.exists("mapping", lambda m: m["edge"] == F.col("next")["edge"])
        at = at.join(own, key).where(free).select(key, F.concat("mapping", F.array("next")).alias("mapping"), (F.col("score") + F.col("more")).alias("score"))
        at = at.withColumn("place", F.row_number().over(w)).where(F.col("place") <= width).drop("place")
    return at


def mapping_score(confidence: Column, coherence: Column, reduction: Column) -> Column:
    """Mean confidence, coherence and half the size reduction, over three (SE8)."""
    return (confidence + coherence + 0.5 * reduction) / 3


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) from a key and a seed: the same in every run and on every partitioning."""
    digits = F.substring(F.md5(F.concat(key.cast("string"), F.lit(f"#{seed}"))), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 1) / float(2**48 + 1)


def weighted_sample(rows: DataFrame, key: str, weight: str, n: int, seed: int) -> DataFrame:
    """`n` rows without replacement, with chances by weight (SE17): the least exponential keys. One pass, no full sort."""
    draw = -F.ln(uniform(F.col(key), seed)) / F.col(weight)
    return rows.where(F.col(weight) > 0).withColumn("draw", draw).orderBy("draw", key).limit(n).drop("draw")


def without_repetition(edges: DataFrame, key: str, most: int, most_kinds: int) -> DataFrame:
    """(key): graphs none of whose nodes has `most` or more links of one label, or `most_kinds` or more labels that
    occur several times (SE3). `edges`: key, src, label."""
    per = edges.groupBy(key, "src", "label").agg(F.count("*").alias("n"))
    node = per.groupBy(key, "src").agg(F.max("n").alias("n"), F.sum((F.col("n") > 1).cast("int")).alias("kinds"))
    bad = node.where((F.col("n") >= most) | (F.col("kinds") >= most_kinds)).select(key).distinct()
    return edges.select(key).distinct().join(bad, key, "left_anti")


def chain_score(edges: DataFrame, key: str, chances: DataFrame, floor: float = 1e-6) -> DataFrame:
    """(key, score): sum of the logs of a graph's link chances (src_label, label, dst_label, p), `floor` for links
    never seen (SE20)."""
    p = F.coalesce(F.greatest("p", F.lit(floor)), F.lit(floor))
    return edges.join(chances, ["src_label", "label", "dst_label"], "left").groupBy(key).agg(F.sum(F.ln(p)).alias("score"))


def should_stop(before: float, now: float, drop: float = 0.3, low: float = 0.3) -> bool:
    """Whether the best score fell by more than `drop` since the last round and is below `low` (SE14)."""
    return before - now > drop and now < low


def sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """`n` rows without replacement, all if there are fewer; the same for a seed on any partitioning (REL4)."""
    return rows.withColumn("draw", uniform(F.col(key), seed)).orderBy("draw", key).limit(n).drop("draw")


def rerank(rows: DataFrame, key: str, score: Column, features: dict[str, float], k: int, tie: str) -> DataFrame:
    """The k best rows of a key by a score plus weighted features, with their place (SE12)."""
    total = score
    for name, weight in features.items():
        total = total + weight * F.col(name)
    w = Window.partitionBy(key).orderBy(total.desc(), tie)
    return rows.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= k)


def suggest_links(edges: DataFrame, cls: str, link: str, nodes: DataFrame | None = None) -> DataFrame:
    """Of each class its incoming links by frequency (SE23); with `nodes` (cls, node) a row for each node of that class that
    is there already, and one for a new node, which is null."""
    per = edges.groupBy(cls, link).agg(F.count("*").alias("n"))
    per = per.withColumn("place", F.row_number().over(Window.partitionBy(cls).orderBy(F.desc("n"), link)).cast("long"))
    if nodes is None:
        return per
    own = nodes.select(F.col("cls").alias(cls), "node")
    return per.join(own.unionByName(own.select(cls).distinct().withColumn("node", F.lit(None).cast(nodes.schema["node"].dataType))), cls)


def tracked(rounds: list[DataFrame]) -> DataFrame:
    """The states of all rounds of a search, each with its round and its place in it (SE2)."""
    out = None
    for k, states in enumerate(rounds):
        one = states.select(F.lit(k).alias("round"), "id", "score").withColumn("place", F.row_number().over(Window.partitionBy("round").orderBy(F.desc("score"), "id")).cast("long"))
        out = one if out is None else out.unionByName(one)
    return out


def start_states(attributes: DataFrame, keys: DataFrame) -> DataFrame:
    """(id, attr, cls, predicate, score): a state for each candidate type of an attribute whose predicate is its class's key
    (SE4). `attributes`: attr, cls, predicate, score; `keys`: cls, predicate. Without any, every candidate is a start."""
    own = attributes.join(keys.select("cls", "predicate").distinct(), ["cls", "predicate"], "left_semi")
    some = own.select("attr").limit(1).count()
    out = own if some else attributes
    return out.select(F.concat_ws("|", "attr", "cls", "predicate").alias("id"), "attr", "cls", "predicate", "score")


def shuffled(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """Rows with `draw`, a number by which they are in random order, the same for a seed on any partitioning (SE18)."""
    return rows.withColumn("draw", uniform(F.col(key), seed))


def choice(rows: DataFrame, group: str, key: str, seed: int) -> DataFrame:
    """One row of each group by chance (SE18): the least draw, by one aggregate."""
    own = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(group).agg(F.min_by(own, F.struct(uniform(F.col(key), seed), F.col(key))).alias("_row")).select("_row.*")
