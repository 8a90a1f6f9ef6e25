"""Statistics over rows and labelled edges: cardinalities, pseudo keys, conditional probabilities, co-occurrence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from loomgraph.operators import nested, relational


def distinct_with_null(c: Column | str) -> Column:
    """Distinct values, null being one of them."""
    c = F.col(c) if isinstance(c, str) else c
    return F.count_distinct(c) + F.coalesce(F.max(c.isNull().cast("long")), F.lit(0))


def cardinality(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Of each (given, other): the mean over given's values of min(distinct others, 2), and 1-TO-N where it
    is above 1.05 (AGG4, AGG8). One scan and one shuffle for each given column."""
    out = []
    for given in dict.fromkeys(g for g, _ in pairs):
        others = [o for g, o in pairs if g == given]
        per = df.groupBy(given).agg(*[F.least(distinct_with_null(o), F.lit(2)).alias(f"n{i}") for i, o in enumerate(others)])
        row = per.agg(*[F.avg(f"n{i}").alias(f"n{i}") for i in range(len(others))])
        cells = F.array(*[F.struct(F.lit(given).alias("given_col"), F.lit(o).alias("col"), F.col(f"n{i}").alias("avg_n")) for i, o in enumerate(others)])
        out.append(row.select(F.inline(cells)))
    rows = reduce(DataFrame.unionByName, out)
    return rows.withColumn("relation", F.when(F.col("avg_n") > 1.05, "1-TO-N").otherwise("1-TO-1"))


def key_votes(df: DataFrame) -> DataFrame:
    """Uniqueness of every column and its vote: 1 if nearly unique or the best of them (AGG9)."""
    n = F.count("*")
    one = df.agg(*[(distinct_with_null(c) / n).alias(c) for c in df.columns])
    long = one.unpivot([], df.columns, "col", "uniqueness")
    best = F.max("uniqueness").over(Window.partitionBy())
    return long.withColumn("vote", ((F.col("uniqueness") > 0.999) | (F.col("uniqueness") == best)).cast("long"))


def node_prior(edges: DataFrame, label: str) -> DataFrame:
    """P(n): nodes of a label over all nodes (AGG10). Rows of edges are nodes here."""
    per = edges.groupBy(label).agg(F.count("*").alias("n"))
    return per.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy()))


def conditional(edges: DataFrame, given: list[str], of: str) -> DataFrame:
    """P(of | given) by counts (AGG11-AGG13): partial counts first, then shares within the given values."""
    per = edges.groupBy(*given, of).agg(F.count("*").alias("n"))
    return per.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*given)))


def multi_value(edges: DataFrame, node: str, label: str) -> DataFrame:
    """Of each label: nodes that have it, the share having it more than once, and whether it is multi-valued (AGG15)."""
    per = edges.groupBy(node, label).agg(F.count("*").alias("k"))
    out = per.groupBy(label).agg(F.count("*").alias("nodes"), F.avg((F.col("k") > 1).cast("double")).alias("multi"))
    return out.withColumn("is_multi", F.col("multi") > 0.01)


def numbered(edges: DataFrame, node: str, label: str, order: str) -> DataFrame:
    """Running number of equal labels of a node (AGG16)."""
    w = Window.partitionBy(node, label).orderBy(order)
    return edges.withColumn("number", F.row_number().over(w).cast("long"))


def cooccurrence(edges: DataFrame, node: str, label: str) -> DataFrame:
    """Pairs of different labels with the nodes that have both, over the larger count of the two (AGG17)."""
    have = edges.select(node, label).distinct()
    sets = have.groupBy(node).agg(F.sort_array(F.collect_set(label)).alias("ls"))
    # Labels of a node are a set over a fixed vocabulary; its pairs come from that set, not from a join.
    pairs = sets.select(F.explode("ls").alias("a"), "ls").select("a", F.explode("ls").alias("b")).where("a < b")
    both = pairs.groupBy("a", "b").agg(F.count("*").alias("n"))
    own = have.groupBy(label).agg(F.count("*").alias("m"))
    out = both.join(own.select(F.col(label).alias("a"), F.col("m").alias("ma")), "a").join(own.select(F.col(label).alias("b"), F.col("m").alias("mb")), "b")
    return out.select("a", "b", "n", (F.col("n") / F.greatest("ma", "mb")).alias("p"))


def order_constraint(df: DataFrame, a: str, b: str) -> DataFrame:
    """Whether column a is at least b row by row (AGG20)."""
    return df.agg(F.avg((F.col(a) >= F.col(b)).cast("double")).alias("share"), F.max((F.col(a) > F.col(b)).cast("int")).alias("some_greater"))


def local_structure(edges: DataFrame, cls: str, links: list[str], key: str | None = None) -> DataFrame:
    """Of each class its links (as predicate and target) with their counts, placed: those of the class's key first, then
    by count and, of equal ones, by name from the last on (AGG18)."""
    n = F.count("*").alias("n")
    per = edges.groupBy(cls, *links).agg(n, *([F.max(key).alias("_key")] if key else []))
    order = [*([F.desc("_key")] if key else []), F.desc("n"), *[F.desc(c) for c in links]]
    out = per.withColumn("place", F.row_number().over(Window.partitionBy(cls).orderBy(*order)).cast("long"))
    return out.drop("_key") if key else out


def comparable_groups(schema: StructType) -> list[tuple[str, list[str]]]:
    """(scope, leaf paths) of the columns that stand side by side in a nested table (AGG5): objects stay in their parent's
    group, a list of objects begins one, a list of values is one of its own."""
    groups: list[tuple[str, list[str]]] = []

    def walk(kind: StructType, scope: str, prefix: str, own: list[str]) -> None:
        for f in kind.fields:
            path = f"{prefix}|{f.name}" if prefix else f.name
            if isinstance(f.dataType, StructType):
                walk(f.dataType, scope, path, own)
            elif isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, StructType):
                walk(f.dataType.elementType, path, path, begin(path))
            elif isinstance(f.dataType, ArrayType):
                groups.append((scope, [path]))
            else:
                own.append(path)

    def begin(scope: str) -> list[str]:
        groups.append((scope, []))
        return groups[-1][1]

    walk(schema, "", "", begin(""))
    return [g for g in groups if g[1]]


def sub_cardinality(df: DataFrame, scope: str, columns: list[str]) -> DataFrame:
    """Cardinalities between columns of one scope of a nested table, over the rows of that scope (AGG7)."""
    short = {c: c[len(scope) + 1 :] if scope else c for c in columns}
    rows = relational.flatten_struct(nested.scope_rows(df, scope))
    names = {s: f"c{i}" for i, s in enumerate(short.values())}
    rows = rows.select(*[F.col(f"`{s}`").alias(n) for s, n in names.items()])
    pairs = [(names[short[a]], names[short[b]]) for a in columns for b in columns if a != b]
    back = {names[s]: c for c, s in short.items()}
    table = F.create_map(*[F.lit(x) for pair in back.items() for x in pair])
    out = cardinality(rows, pairs)
    return out.select(table[F.col("given_col")].alias("given_col"), table[F.col("col")].alias("col"), "avg_n", "relation")


def cardinality_matrix(df: DataFrame) -> DataFrame:
    """(given_col, col, avg_n, relation) of all comparable columns of a nested table (AGG6). Within a group by counting.
    Between groups by their scopes, without a count: 1-TO-N into an inner scope, N-TO-1 out of it, and beside a list of
    values in the same scope 1-TO-N into the list and N-TO-1 out of it."""
    groups, parts, known = comparable_groups(df.schema), [], []
    lists = {p for _, paths in groups for p in paths if len(paths) == 1 and _is_list(df.schema, p)}
    for scope, paths in groups:
        if len(paths) > 1:
            parts.append(sub_cardinality(df, scope, paths))
    inside = lambda outer, inner: outer != inner and (outer == "" or inner.startswith(outer + "|"))
    for i, (a, mine) in enumerate(groups):
        for j, (b, others) in enumerate(groups):
            if i == j:
                continue
            if inside(a, b):
                relation = "1-TO-N"
            elif inside(b, a):
                relation = "N-TO-1"
            elif a == b:
                relation = "N-TO-1" if mine[0] in lists else "1-TO-N"
            else:
                continue
            known += [(x, y, None, relation) for x in mine for y in others]
    parts.append(df.sparkSession.createDataFrame(known, "given_col string, col string, avg_n double, relation string"))
    return reduce(DataFrame.unionByName, parts)


def _is_list(schema: StructType, path: str) -> bool:
    kind = schema
    for step in path.split("|"):
        kind = kind.elementType if isinstance(kind, ArrayType) else kind
        kind = kind[step].dataType
    return isinstance(kind, ArrayType)


def order_constraints(cells: DataFrame, scope: str) -> DataFrame:
    """How often, row by row, one column of numbers is at least another (AGG21). `cells`: source, row, node, parent, cls,
    predicate, v. Scope "node": two predicates of one node, as (cls, a, b). Scope "type": one type under two parents, as
    (cls, predicate, a, b), a and b being the parents. Cells meet by equality on their row, and on their node or type."""
    same, differ, out = (["source", "row", "node", "cls"], "predicate", ["cls"]) if scope == "node" else (["source", "row", "cls", "predicate"], "parent", ["cls", "predicate"])
    rows = cells.where("v is not null and not isnan(v)")
    a = rows.select(*same, F.col(differ).alias("a"), F.col("v").alias("va"))
    b = rows.select(*same, F.col(differ).alias("b"), F.col("v").alias("vb"))
    both = a.join(b, same).where("a < b")
    share = lambda c: F.avg(c.cast("double"))
    return both.groupBy(*out, "a", "b").agg(F.count("*").alias("n"), share(F.col("va") >= F.col("vb")).alias("at_least"), share(F.col("va") <= F.col("vb")).alias("at_most"))


def constraint_chance(constraints: DataFrame, pairs: DataFrame, default: float = 0.5) -> DataFrame:
    """`pairs` with `chance`: the learned share of the order that they show (`ge`, whether the first is at least the other),
    the default where none was learned (AGG21)."""
    keys = [c for c in ("cls", "predicate", "a", "b") if c in constraints.columns and c in pairs.columns]
    own = pairs.join(constraints.select(*keys, "at_least", "at_most"), keys, "left")
    return own.withColumn("chance", F.coalesce(F.when(F.col("ge"), F.col("at_least")).otherwise(F.col("at_most")), F.lit(default))).drop("at_least", "at_most")


def potential_gain(scores: DataFrame) -> DataFrame:
    """(node, gain): what a node's own mount (where it hangs) is better by than its best other one (AGG22). `scores`: node,
    mount, own, column, score; a column's best score counts at a mount, their mean makes the mount's. Null without another."""
    best = scores.groupBy("node", "mount", "own", "column").agg(F.max("score").alias("score"))
    mean = best.groupBy("node", "mount", "own").agg(F.avg("score").alias("score"))
    own, other = F.max(F.when(F.col("own"), F.col("score"))), F.max(F.when(~F.col("own"), F.col("score")))
    return mean.groupBy("node").agg((own - other).alias("gain"))


#: Slots of a class whose subsets are tabulated.
MOST_SLOTS = 20


def coherence_table(observed: DataFrame, floor: float = 0.01) -> DataFrame:
    """(cls, parent, slots, n_seen, n_unseen): of every subset of a class's child slots (bits, by name) the largest part
    that one observed node has, and what is left (AGG23); with a parent, the parent counts too, with null none does.
    `observed`: cls, node, parent, slot. A table has two to the power of its slots rows, so a class has at most MOST_SLOTS."""
    by_name = Window.partitionBy("cls").orderBy("slot")
    slots = observed.select("cls", "slot").where("slot is not null").distinct().withColumn("bit", F.row_number().over(by_name) - 1)
    many = F.when(F.max("bit") >= MOST_SLOTS, F.raise_error(F.lit(f"a class has more than {MOST_SLOTS} slots"))).otherwise(F.max("bit"))
    subsets = slots.groupBy("cls").agg(many.alias("last")).withColumn("slots", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("shiftleft(2L, last) - 1")))).drop("last")
    bits = observed.join(slots, ["cls", "slot"], "left").groupBy("cls", "node").agg(F.coalesce(F.bit_or(F.expr("shiftleft(1L, bit)")), F.lit(0).cast("long")).alias("has"), F.max("parent").alias("above"))
    kinds = bits.select("cls", "has", "above").distinct()
    parents = kinds.select("cls", F.col("above").alias("parent")).where("parent is not null").distinct().unionByName(kinds.select("cls", F.lit(None).cast(observed.schema["parent"].dataType).alias("parent")).distinct())
    # Kinds of nodes, not nodes: at most as many as there are subsets and parents.
    met = subsets.join(parents, "cls").join(kinds, "cls")
    with_parent = F.col("parent").isNotNull().cast("int")
    seen = F.max(F.bit_count(F.col("has").bitwiseAND(F.col("slots"))) + F.coalesce((F.col("above") == F.col("parent")).cast("int"), F.lit(0)))
    per = met.groupBy("cls", "parent", "slots").agg(seen.alias("seen"))
    whole = F.bit_count("slots") + with_parent
    up = lambda c: F.greatest(c.cast("double"), F.lit(floor))
    return per.select("cls", "parent", "slots", up(F.col("seen")).alias("n_seen"), up(whole - F.col("seen")).alias("n_unseen"))
