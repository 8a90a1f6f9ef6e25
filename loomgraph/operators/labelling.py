"""Labels of columns: features of column pairs, a forest over them, the best labels of each column."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.operators import relational, similarity

FEATURES = ("name", "ks", "mann_whitney", "number_jaccard", "text_jaccard", "cosine")


def ks_p_value(gap: Column, na: Column, nb: Column) -> Column:
    """Chance of a larger gap between two samples' distribution functions, by the Kolmogorov series (SIM2)."""
    x = gap * gap * na * nb / (na + nb)
    terms = F.transform(F.sequence(F.lit(1), F.lit(100)), lambda k: F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2 * k * k * x))
    total = F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)
    return F.when(x < 0.04, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))


@F.pandas_udf(T.DoubleType())
def _two_sided(z: pd.Series) -> pd.Series:
    return z.map(lambda v: None if v is None or math.isnan(v) else math.erfc(abs(v) / math.sqrt(2)))


def t_statistic(df: DataFrame, group: str, value: str, a: str, b: str, pooled: bool = True) -> DataFrame:
    """(t, dof) of two groups' means, with one variance for both or (Welch) one each (SIM4)."""
    rows = df.where(F.col(group).isin(a, b) & F.col(value).isNotNull())
    of = lambda fn, g: fn(F.when(F.col(group) == g, F.col(value)))
    one = rows.agg(*[of(fn, g).alias(f"{name}{k}") for k, g in (("a", a), ("b", b)) for name, fn in (("m", F.avg), ("v", F.var_samp), ("n", F.count))])
    if pooled:
        var = F.expr("((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)")
        return one.select((F.expr("ma - mb") / F.sqrt(var * F.expr("1 / na + 1 / nb"))).alias("t"), F.expr("cast(na + nb - 2 as double)").alias("dof"))
    return one.select(F.expr("(ma - mb) / sqrt(va / na + vb / nb)").alias("t"), F.expr("power(va / na + vb / nb, 2) / (power(va / na, 2) / (na - 1) + power(vb / nb, 2) / (nb - 1))").alias("dof"))


def _two_samples(numbers: DataFrame) -> DataFrame:
    """(a, b, ks, mann_whitney): p-values of every two columns of (col, v double); 0 where one has fewer than two values.
    Works on counts of distinct values, which each column gives to its pairs: values times columns, not values squared."""
    per = numbers.where("v is not null and not isnan(v)").groupBy("col", "v").agg(F.count("*").alias("n"))
    size = per.groupBy("col").agg(F.sum("n").alias("n"))
    cols = size.select(F.col("col").alias("a"), F.col("n").alias("na")).join(size.select(F.col("col").alias("b"), F.col("n").alias("nb")), F.col("a") < F.col("b"))
    own = lambda k: per.join(cols, per["col"] == cols[k]).select("a", "b", "na", "nb", "v", (F.col("n") if k == "a" else F.lit(0).cast("long")).alias("ca"), (F.col("n") if k == "b" else F.lit(0).cast("long")).alias("cb"))
    both = own("a").unionByName(own("b")).groupBy("a", "b", "na", "nb", "v").agg(F.sum("ca").alias("ca"), F.sum("cb").alias("cb"))
    w = Window.partitionBy("a", "b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    upto = both.select("*", F.sum("ca").over(w).alias("fa"), F.sum("cb").over(w).alias("fb"))
    n = F.col("ca") + F.col("cb")
    rank = F.col("fa") + F.col("fb") - n + (n + 1) / 2
    sums = upto.groupBy("a", "b", "na", "nb").agg(
        F.max(F.abs(F.col("fa") / F.col("na") - F.col("fb") / F.col("nb"))).alias("gap"), F.sum(F.col("ca") * rank).alias("ra"), F.sum((n * n * n - n).cast("double")).alias("ties")
    )
    na, nb = F.col("na").cast("double"), F.col("nb").cast("double")
    u = F.col("ra") - na * (na + 1) / 2
    total = na + nb
    sd = F.sqrt(na * nb / 12 * (total + 1 - F.col("ties") / (total * (total - 1))))
    z = F.when(sd > 0, F.greatest(F.abs(u - na * nb / 2) - 0.5, F.lit(0.0)) / sd).otherwise(0.0)
    few = (F.col("na") < 2) | (F.col("nb") < 2)
    return sums.select("a", "b", F.when(few, 0.0).otherwise(ks_p_value(F.col("gap"), na, nb)).alias("ks"), F.when(few, 0.0).otherwise(_two_sided(z)).alias("mann_whitney"))


def pair_features(values: DataFrame, names: DataFrame) -> DataFrame:
    """(a, b, *FEATURES) of every two columns (SIM10), a < b, 0 where a feature doesn't apply.

    `values`: col, v string; `names`: col, tokens array<string> of its label. Columns are few; their pairs come
    from an inequality join of `names` alone."""
    a, b = names.select(F.col("col").alias("a"), F.col("tokens").alias("ta")), names.select(F.col("col").alias("b"), F.col("tokens").alias("tb"))
    whole = F.size(F.array_union("ta", "tb"))
    pairs = a.join(b, F.col("a") < F.col("b")).select("a", "b", F.when(whole > 0, F.size(F.array_intersect("ta", "tb")) / whole).otherwise(0.0).alias("name"))
    number = F.expr("try_cast(v as double)")
    numbers = values.select("col", number.alias("v")).where("v is not null")
    texts = values.where(number.isNull())
    tokens = texts.select("col", F.explode(F.regexp_extract_all(F.lower("v"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("token"))
    parts = [
        _two_samples(numbers),
        similarity.jaccard(numbers, "col", "v").withColumnRenamed("jaccard", "number_jaccard"),
        similarity.jaccard(texts, "col", "v").withColumnRenamed("jaccard", "text_jaccard"),
        similarity.cosine(similarity.tfidf(tokens, "col", "token")),
    ]
    for p in parts:
        pairs = pairs.join(p, ["a", "b"], "left")
    return pairs.select("a", "b", *[F.coalesce(f, F.lit(0.0)).alias(f) for f in FEATURES])


def training_pairs(features: DataFrame, gold: DataFrame) -> DataFrame:
    """Features of the pairs of labelled columns and `same` (0/1), whether their labels agree (SIM11). `gold`: col, label."""
    a, b = gold.select(F.col("col").alias("a"), F.col("label").alias("la")), gold.select(F.col("col").alias("b"), F.col("label").alias("lb"))
    return features.join(a, "a").join(b, "b").withColumn("same", (F.col("la") == F.col("lb")).cast("double")).drop("la", "lb")


def _vector(features: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(features)


def fit_forest(pairs: DataFrame, trees: int = 200, depth: int = 10, seed: int = 120) -> RandomForestClassificationModel:
    """A forest that tells pairs of one label from others, both classes weighing the same (SIM12). Needs both classes."""
    n = {r["same"]: r["n"] for r in pairs.groupBy("same").agg(F.count("*").alias("n")).collect()}
    weight = F.when(F.col("same") == 1, sum(n.values()) / (2.0 * n[1.0])).otherwise(sum(n.values()) / (2.0 * n[0.0]))
    forest = RandomForestClassifier(featuresCol="x", labelCol="same", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed)
    return forest.fit(_vector(pairs).withColumn("weight", weight))


def label_scores(forest: RandomForestClassificationModel, features: DataFrame, gold: DataFrame) -> DataFrame:
    """(col, label, score): of each column and label the chance of being like a column so labelled; not itself."""
    p = forest.transform(_vector(features)).select("a", "b", vector_to_array("probability")[1].alias("score"))
    both = p.select(F.col("a").alias("col"), F.col("b").alias("other"), "score").unionByName(p.select(F.col("b").alias("col"), F.col("a").alias("other"), "score"))
    return both.join(gold.select(F.col("col").alias("other"), "label"), "other").select("col", "label", "score")


def top_labels(scores: DataFrame, key: str, label: str, score: str, n: int) -> DataFrame:
    """Of each key the `n` best labels by their best score, above 0, with their rank (SIM13); ties by label."""
    best = scores.groupBy(key, label).agg(F.max(score).alias(score)).where(F.col(score) > 0)
    w = Window.partitionBy(key).orderBy(F.desc(score), label)
    return best.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= n)


def top_labels_with_parents(scores: DataFrame, key: str, label: str, parent: str, score: str, n: int) -> DataFrame:
    """The kept labels of `top_labels`, each with its parent labels' best scores, best first (SIM14)."""
    kept = top_labels(scores, key, label, score, n).select(key, label, "rank")
    best = scores.groupBy(key, label, parent).agg(F.max(score).alias(score)).where(F.col(score) > 0)
    w = Window.partitionBy(key, label).orderBy(F.desc(score), parent)
    return kept.join(best, [key, label]).withColumn("parent_rank", F.row_number().over(w).cast("long"))


def oracle_labels(gold: DataFrame, predicted: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(col, label, score): true labels with score 1 where `known` (label) holds them or isn't given, predictions
    (col, label, score) for the other columns (SIM16)."""
    sure = gold if known is None else gold.join(known.select("label").distinct(), "label", "left_semi")
    rest = predicted.join(sure.select("col"), "col", "left_anti").select("col", "label", "score")
    return sure.select("col", "label", F.lit(1.0).alias("score")).unionByName(rest)


def wide_scores(df: DataFrame, key: str, prefix: str = "scores_", between: str = "---") -> DataFrame:
    """(key, cls, predicate, score, place) of a table with one column scores_<class>---<predicate> a label (SRC18)."""
    own = [c for c in df.columns if c.startswith(prefix) and between in c]
    parts = [c[len(prefix):].split(between, 1) for c in own]
    rows = F.array(*[F.struct(F.lit(a).alias("cls"), F.lit(b).alias("predicate"), F.col(f"`{c}`").cast("double").alias("score")) for c, (a, b) in zip(own, parts)])
    flat = df.select(key, F.inline(rows)).where("score is not null")
    w = Window.partitionBy(key).orderBy(F.desc("score"), "cls", "predicate")
    return flat.withColumn("place", F.row_number().over(w).cast("long"))


def one_hot(rows: DataFrame, key: str, feature: str, weight: str) -> DataFrame:
    """(key, indices, values): named weighted features as a sparse vector over all names in order (ML6). Names are
    numbered in ranges of their order."""
    names = relational.ranked(rows.select(F.col(feature).alias("f")).distinct(), ["f"], "i").withColumn("i", F.col("i").cast("int"))
    per = rows.groupBy(key, F.col(feature).alias("f")).agg(F.sum(weight).alias("w")).join(names, "f")
    pairs = per.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("i", "w"))).alias("p"))
    return pairs.select(key, F.col("p.i").alias("indices"), F.col("p.w").alias("values"))


def leave_one_out(features: DataFrame, gold: DataFrame, trees: int = 200, depth: int = 10) -> DataFrame:
    """(source, col, label, score): each source's columns labelled by a forest fitted on the other sources (SIM15).
    `gold`: col, label, source. One forest a source; sources are few. What is left needs pairs of both classes."""
    out = None
    for source in [r["source"] for r in gold.select("source").distinct().orderBy("source").collect()]:
        rest, own = gold.where(F.col("source") != source), gold.where(F.col("source") == source)
        forest = fit_forest(training_pairs(features, rest), trees, depth)
        scores = label_scores(forest, features, rest).join(own.select("col"), "col", "left_semi")
        one = scores.groupBy("col", "label").agg(F.max("score").alias("score")).select(F.lit(source).alias("source"), "col", "label", "score")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no sources to leave out")
    return out


def fit_node_probability(nodes: DataFrame, features: list[str], label: str) -> PipelineModel:
    """Logistic regression on scaled features of nodes, as sums of label scores and least merge costs (SIM17)."""
    steps = [VectorAssembler(inputCols=features, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="x", withMean=True), LogisticRegression(featuresCol="x", labelCol=label)]
    return Pipeline(stages=steps).fit(nodes)


def node_probability(model: PipelineModel, nodes: DataFrame) -> DataFrame:
    """Nodes with `chance`, the probability that they belong (SIM17)."""
    out = model.transform(nodes).withColumn("chance", vector_to_array("probability")[1])
    return out.select(*nodes.columns, "chance")
