"""Similarity of columns: Jaccard, range coverage, two-sample statistics, TF-IDF cosine."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.rounds import cut


def jaccard(values: DataFrame, group: str, value: str) -> DataFrame:
    """Of each pair of groups the Jaccard similarity of their value sets (SIM5, SIM7). Pairs are formed from
    the groups that share a value, so a value that all groups hold costs groups squared, not rows squared."""
    have = values.select(F.col(group).alias("g"), F.col(value).alias("v")).where("v is not null").distinct()
    own = have.groupBy("g").agg(F.count("*").alias("n"))
    sets = have.groupBy("v").agg(F.sort_array(F.collect_set("g")).alias("gs"))
    both = sets.select(F.explode("gs").alias("a"), "gs").select("a", F.explode("gs").alias("b")).where("a < b").groupBy("a", "b").agg(F.count("*").alias("both"))
    out = both.join(own.select(F.col("g").alias("a"), F.col("n").alias("na")), "a").join(own.select(F.col("g").alias("b"), F.col("n").alias("nb")), "b")
    return out.select("a", "b", (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("jaccard"))


def value_ranges(df: DataFrame, group: str, value: str) -> DataFrame:
    """The least and the largest value of each group (SIM6)."""
    return df.groupBy(group).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))


def coverage(df: DataFrame, group: str, value: str) -> DataFrame:
    """Overlap over union of the value ranges of each pair of groups; 0 where disjoint or degenerate (SIM6)."""
    per = value_ranges(df, group, value).withColumnRenamed(group, "g")
    a, b = per.select(F.col("g").alias("a"), F.col("lo").alias("la"), F.col("hi").alias("ha")), per.select(F.col("g").alias("b"), F.col("lo").alias("lb"), F.col("hi").alias("hb"))
    over = F.least("ha", "hb") - F.greatest("la", "lb")
    whole = F.greatest("ha", "hb") - F.least("la", "lb")
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.when((over > 0) & (whole > 0), over / whole).otherwise(0.0).alias("coverage"))


def _cumulated(per: DataFrame, value: str, counts: list[str]) -> DataFrame:
    """Rows of distinct values with the sums of `counts` over all smaller values, as `before_<count>`. Values are dealt into
    ranges, summed within each, and moved on by the totals of the ranges before, so no task sorts them all."""
    n = int(per.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(per.repartitionByRange(n, value).withColumn("_part", F.spark_partition_id()))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row a range.
    starts = dealt.groupBy("_part").agg(*[F.sum(c).alias(c) for c in counts]).select("_part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_{c}") for c in counts])
    within = Window.partitionBy("_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.select("*", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"_own_{c}") for c in counts]).join(F.broadcast(starts), "_part")
    return own.select(*per.columns, *[(F.col(f"_{c}") + F.col(f"_own_{c}")).alias(f"before_{c}") for c in counts])


def ks_statistic(df: DataFrame, group: str, value: str, a: str, b: str) -> DataFrame:
    """(ks, na, nb): the largest distance of two groups' distribution functions, over per-value counts, and the groups'
    sizes (SIM2); labelling.ks_p_value gives the chance of a larger one."""
    per = df.where(F.col(group).isin(a, b) & F.col(value).isNotNull()).groupBy(value).agg(
        F.sum((F.col(group) == a).cast("long")).alias("na"), F.sum((F.col(group) == b).cast("long")).alias("nb")
    )
    upto = _cumulated(per, value, ["na", "nb"])
    # One row.
    total = F.broadcast(per.agg(F.sum("na").alias("all_a"), F.sum("nb").alias("all_b")))
    gap = (F.col("before_na") + F.col("na")) / F.col("all_a") - (F.col("before_nb") + F.col("nb")) / F.col("all_b")
    return upto.join(total).agg(F.max(F.abs(gap)).alias("ks"), F.max("all_a").alias("na"), F.max("all_b").alias("nb"))


def mann_whitney(df: DataFrame, group: str, value: str, a: str, b: str) -> DataFrame:
    """U of the first group, by average ranks over per-value counts (SIM3)."""
    per = df.where(F.col(group).isin(a, b) & F.col(value).isNotNull()).groupBy(value).agg(
        F.sum((F.col(group) == a).cast("long")).alias("na"), F.count("*").alias("n")
    )
    ranked = _cumulated(per, value, ["n"]).withColumn("rank", F.col("before_n") + (F.col("n") + 1) / 2)
    out = ranked.agg(F.sum(F.col("na") * F.col("rank")).alias("r"), F.sum("na").alias("na"), (F.sum("n") - F.sum("na")).alias("nb"))
    return out.select((F.col("r") - F.col("na") * (F.col("na") + 1) / 2).alias("u"), "na", "nb")


def tfidf(tokens: DataFrame, doc: str, token: str) -> DataFrame:
    """tf * ln(N / (1 + df)) of every document's tokens (SIM9). N is an aggregate of one row."""
    per = tokens.groupBy(F.col(doc).alias("doc"), F.col(token).alias("token")).agg(F.count("*").alias("n"))
    total = per.groupBy("doc").agg(F.sum("n").alias("total"))
    df_ = per.groupBy("token").agg(F.count("*").alias("df"))
    docs = total.agg(F.count("*").alias("docs"))
    out = per.join(total, "doc").join(df_, "token").join(F.broadcast(docs))
    out = out.where(~(F.col("token").rlike("^[0-9]+$") & (F.col("df") < 2)))
    return out.select("doc", "token", (F.col("n") / F.col("total") * F.ln(F.col("docs") / (1 + F.col("df")))).alias("weight"))


def cosine(weights: DataFrame) -> DataFrame:
    """Cosine of each pair of documents that share a token (SIM8)."""
    norm = weights.groupBy("doc").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    a, b = weights.select(F.col("doc").alias("a"), "token", F.col("weight").alias("wa")), weights.select(F.col("doc").alias("b"), "token", F.col("weight").alias("wb"))
    dots = a.join(b, "token").where("a < b").groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    dots = dots.join(norm.select(F.col("doc").alias("a"), F.col("norm").alias("na")), "a").join(norm.select(F.col("doc").alias("b"), F.col("norm").alias("nb")), "b")
    return dots.select("a", "b", F.when((F.col("na") > 0) & (F.col("nb") > 0), F.col("dot") / (F.col("na") * F.col("nb"))).otherwise(0.0).alias("cosine"))
