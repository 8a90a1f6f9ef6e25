"""Evaluation of ranked and plain predictions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.search import uniform


def ranked_metrics(gold: DataFrame, ranked: DataFrame, key: str, label: str) -> DataFrame:
    """MRR, accuracy and coverage of ranked labels (key, label, rank) against gold (key, label) (EV1-EV3)."""
    hit = ranked.join(gold, [key, label]).groupBy(key).agg(F.min("rank").alias("rank"))
    all_ = gold.select(key).distinct().join(hit, key, "left")
    return all_.agg(
        F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"),
        F.avg(F.coalesce((F.col("rank") == 1).cast("double"), F.lit(0.0))).alias("accuracy"),
        F.avg(F.col("rank").isNotNull().cast("double")).alias("coverage"),
    )


def confusion(rows: DataFrame, gold: str, pred: str) -> DataFrame:
    """Counts of each (gold, predicted) pair (EV7)."""
    return rows.groupBy(F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def f_beta(matrix: DataFrame, beta: float = 1.0) -> DataFrame:
    """Precision, recall and F-beta of every class, 0 where undefined (EV7)."""
    cells = matrix.select(F.explode(F.array(F.struct(F.col("gold").alias("cls"), "n", F.lit(1).alias("g"), F.lit(0).alias("p"), (F.col("gold") == F.col("pred")).cast("int").alias("h")),
        F.struct(F.col("pred").alias("cls"), "n", F.lit(0).alias("g"), F.lit(1).alias("p"), F.lit(0).alias("h")))).alias("c")).select("c.*")
    per = cells.groupBy("cls").agg(F.sum(F.col("n") * F.col("h")).alias("hit"), F.sum(F.col("n") * F.col("g")).alias("gold"), F.sum(F.col("n") * F.col("p")).alias("pred"))
    div = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    per = per.withColumn("precision", div(F.col("hit").cast("double"), F.col("pred"))).withColumn("recall", div(F.col("hit").cast("double"), F.col("gold")))
    f = div((1 + beta * beta) * F.col("precision") * F.col("recall"), beta * beta * F.col("precision") + F.col("recall"))
    return per.select("cls", "precision", "recall", f.alias("f"))


def with_average(report: DataFrame, name: str) -> DataFrame:
    """A report's rows and their average row (EV8)."""
    numbers = [c for c in report.columns if c != name]
    return report.unionByName(report.agg(*[F.avg(c).alias(c) for c in numbers]).withColumn(name, F.lit("average")))


def concat_folds(folds: list[DataFrame], name: str) -> DataFrame:
    """The rows of several reports without their average rows, and one average of all (EV9)."""
    rows = folds[0].where(F.col(name) != "average")
    for f in folds[1:]:
        rows = rows.unionByName(f.where(F.col(name) != "average"))
    return with_average(rows, name)


def triple_accuracy(gold: DataFrame, pred: DataFrame, key: str, attr: str, label: str) -> DataFrame:
    """(key, accuracy): share of gold attributes that the prediction gives the same label; a missing one counts 0 (EV10)."""
    given = pred.select(key, attr, F.col(label).alias("given"))
    return gold.join(given, [key, attr], "left").groupBy(key).agg(F.avg(F.coalesce((F.col("given") == F.col(label)).cast("double"), F.lit(0.0))).alias("accuracy"))


def coherence(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """(candidate, coherence): the largest share of a candidate's triples (candidate, triple) that one known
    model (model, triple) holds; 0 where none shares any (SE13), and for a null candidate. Only its set of triples
    decides, so each different set of candidates meets each different set of models once, by an equality join on triples."""
    triples = F.array_sort(F.collect_set("triple")).alias("held")  # without nulls: they count as a triple that no model holds
    own = candidates.groupBy("candidate").agg(triples, F.max(F.col("triple").isNull().cast("int")).alias("nulls"))
    # A set goes by its least candidate or model: no two sets have the same one.
    sets = own.where("candidate is not null").groupBy("held").agg(F.min("candidate").alias("candidate"))
    models = known.groupBy("model").agg(triples).groupBy("held").agg(F.min("model").alias("model"))
    both = sets.select("candidate", F.explode("held").alias("triple")).join(models.select("model", F.explode("held").alias("triple")), "triple")
    best = both.groupBy("candidate", "model").agg(F.count("*").alias("hits")).groupBy("candidate").agg(F.max("hits").alias("hits"))
    best = sets.join(best, "candidate").select("held", "hits")
    hits = F.when(F.col("candidate").isNull(), 0).otherwise(F.coalesce("hits", F.lit(0)))
    return own.join(best, "held", "left").select("candidate", (hits / (F.size("held") + F.col("nulls"))).alias("coherence"))


def with_folds(rows: DataFrame, key: str, folds: int, seed: int = 0) -> DataFrame:
    """Rows with `fold`, from a seeded hash of their key: the same in every run and on every partitioning (EV12)."""
    return rows.withColumn("fold", F.floor(uniform(F.col(key), seed) * folds).cast("int"))


def run_folds(rows: DataFrame, folds: int, fit: Callable[[DataFrame], DataFrame], score: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """(fold, ...): every fold's rows scored by what `fit` makes of the others' (EV12). Folds are few; their jobs are one plan."""
    out = None
    for k in range(folds):
        one = score(fit(rows.where(F.col("fold") != k)), rows.where(F.col("fold") == k)).withColumn("fold", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out
