"""Operator 8, mixing sources to target weights: a low-discrepancy source schedule.

A source's documents are a shuffled stream, cut into blocks of equally many tokens (the last one holds
the rest). Its target is so many passes over that stream, which is a ring: a golden-ratio offset says where
in it the source starts, slot r takes the r-th block from there on in pass r div blocks, and its last slot only
the tokens that the target still lacks, so every source reaches its target to the word, also one smaller than
a block. Its slots stand at equal steps, from the same offset on, and the schedule is all slots in that order:
every stretch holds the sources nearly in proportion. What is taken of a document is read off the schedule's slots.

All of it is DataFrame code. A source may hold a third of all rows: slot numbers and stream positions are
sums over small buckets plus a prefix over the buckets' totals, never a window over a whole source.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import Scratch, columns_of, word_count

#: 2 ** 32 / golden ratio, made odd.
GOLDEN = 2654435769
SPAN = 1 << 32


@dataclass(frozen=True)
class MixRules:
    """Production parameters: weights go round the sources in code-point order (null last)."""

    weights: tuple[int, ...] = (1, 2, 3)
    most_repeats: int = 3
    #: Tokens a block; smaller where the corpus would give too few slots to mix them finely.
    block: int = 2048
    least_slots: int = 50_000
    slots_per_source: int = 2_000
    seed: int = 8
    #: Rows that one bucket of a source's stream, or one chunk of the schedule, holds on average.
    bucket: int = 4096


@dataclass
class Mix:
    """The operator's tables. sources: sid, source, weight, source_size, docs, target. schedule: slot,
    sid, rank, block, pass, tokens (of the block's first ones), cut (not the whole block). segments: sid, block, doc_id, size, start, tokens.
    taken: a row per document."""

    sources: DataFrame
    schedule: DataFrame
    segments: DataFrame
    taken: DataFrame
    block: int


def targets(sizes: DataFrame, rules: MixRules) -> DataFrame:
    """sid, source, weight, source_size, docs, target: shares by weight, filled up to the caps.

    A source is capped at most_repeats times its size. Sorted by cap over weight, the capped ones are a
    prefix: the first source whose weighted share of what is left stays within its cap ends it. These
    windows have no key; their rows are sources, not documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rows = per.withColumn("sid", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in rules.weights]), (F.col("sid") % len(rules.weights) + 1).cast("int"))
    rows = rows.withColumn("weight", weight.cast("double")).withColumn("cap", F.col("source_size") * float(rules.most_repeats))
    by_need = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    every = Window.partitionBy()
    rows = (
        rows.withColumn("before", F.coalesce(F.sum("cap").over(by_need.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("left", F.sum("weight").over(by_need.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.sum("source_size").over(every) - F.col("before")) / F.col("left"))
        .withColumn("free", F.col("level") * F.col("weight") <= F.col("cap"))
        .withColumn("common", F.max(F.when(F.col("free"), F.col("level"))).over(every))
    )
    # Levels fall from the first free source on, so the first one is their maximum among free sources.
    share = F.least("cap", F.coalesce(F.col("common") * F.col("weight"), F.col("cap")))
    return rows.select("sid", "source", "weight", "source_size", "docs", share.alias("target"))


def _prefix(rows: DataFrame, key: str, bucket: str, value: str, out: str) -> DataFrame:
    """Sum of `value` over the earlier buckets of the same key."""
    w = Window.partitionBy(key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    per = rows.groupBy(key, bucket).agg(F.sum(value).alias("bucket_sum"))
    return per.select(key, bucket, F.coalesce(F.sum("bucket_sum").over(w), F.lit(0)).alias(out))


def mix(docs: DataFrame, rules: MixRules = MixRules()) -> Mix:
    """Mixes all documents. Null or empty texts have size 0 and are taken 0 words; a null source is a
    source of its own, after the others; repeated rows are documents each; an empty table gives none."""
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark)
    sizes = scratch.write(columns_of(docs, "doc_id", "source", "text").select("doc_id", "source", word_count(F.col("text")).alias("size")))
    sources = scratch.write(targets(sizes, rules).coalesce(1))
    whole = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n"), F.count("*").alias("sources")).first()
    block = max(1, min(rules.block, whole["n"] // max(rules.least_slots, rules.slots_per_source * whole["sources"])))

    # Each source's shuffled stream: documents in the order of a hash, at the sum of the sizes before them.
    unit = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(rules.seed)), 33)
    buckets = F.ceil(F.col("docs") / rules.bucket)
    rows = (
        sizes.where("size > 0").join(sources.select("source", "sid", "docs"), sizes["source"].eqNullSafe(sources["source"]))
        .select("doc_id", "sid", "size", unit.alias("h"), F.floor(unit * buckets / float(1 << 31)).alias("bucket"))
    )
    within = Window.partitionBy("sid", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    stream = (
        rows.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .join(_prefix(rows, "sid", "bucket", "size", "base"), ["sid", "bucket"])
        .select("sid", "doc_id", "size", (F.col("base") + F.col("within")).alias("start"))
    )
    first, last = F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}")
    segments = stream.withColumn("block", F.explode(F.sequence(first, last))).select(
        "sid", "block", "doc_id", "size", "start",
        (F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - F.greatest("start", F.col("block") * block)).alias("tokens"),
    )

    # The schedule. A source's slots are made a chunk at a time, so that no task makes those of a whole source.
    goal, blocks = F.round("target").cast("long"), F.ceil(F.col("source_size") / block).cast("long")
    parts = sources.where("source_size > 0").withColumn("goal", goal).withColumn("blocks", blocks)
    parts = parts.withColumn("full", F.expr("goal div source_size * blocks")).withColumn("rest", F.expr("goal % source_size"))
    # The pass that takes only `rest` meets the stream's last block, which lacks `lack` tokens, after `ahead` others.
    offset = F.expr(f"((sid * {GOLDEN}L) % {SPAN}L) / {SPAN}D")
    parts = parts.withColumn("offset", offset).withColumn("head", F.floor(F.col("offset") * F.col("blocks")))
    parts = parts.withColumn("ahead", F.col("blocks") - 1 - F.col("head")).withColumn("lack", F.col("blocks") * block - F.col("source_size"))
    short = F.when(F.col("rest") > F.col("ahead") * block, F.col("lack")).otherwise(0)
    parts = parts.withColumn("slots", F.col("full") + F.ceil((F.col("rest") + short) / block).cast("long")).where("slots > 0")
    chunks = F.sequence(F.lit(0).cast("long"), F.expr(f"(slots - 1) div {rules.bucket}"))
    parts = parts.select("sid", "source_size", "blocks", "full", "rest", "offset", "head", "ahead", "lack", "slots", F.explode(chunks).alias("chunk")).repartition("sid", "chunk")
    ranks = F.sequence(F.col("chunk") * rules.bucket, F.least((F.col("chunk") + 1) * rules.bucket, F.col("slots")) - 1)
    chosen = parts.withColumn("rank", F.explode(ranks)).withColumn("block", (F.col("rank") + F.col("head")) % F.col("blocks"))
    whole_block = F.least(F.lit(block), F.col("source_size") - F.col("block") * block)
    gone = F.col("rank") - F.col("full")
    left = F.col("rest") - gone * block + F.when(gone > F.col("ahead"), F.col("lack")).otherwise(0)
    chosen = chosen.withColumn("tokens", F.when(F.col("rank") < F.col("full"), whole_block).otherwise(F.least(whole_block, left)))
    chosen = chosen.withColumn("cut", F.col("tokens") < whole_block)
    chosen = chosen.withColumn("place", (F.col("rank") + F.col("offset")) / F.col("slots")).withColumn("one", F.lit(1)).withColumn("all", F.lit(0))
    stretches = max(1, whole["n"] // block // rules.bucket)
    chosen = chosen.withColumn("stretch", F.floor(F.col("place") * stretches))
    at = F.row_number().over(Window.partitionBy("stretch").orderBy("place", "sid")) - 1
    schedule = (
        chosen.withColumn("within", at)
        .join(_prefix(chosen, "all", "stretch", "one", "base"), ["all", "stretch"])
        .select((F.col("base") + F.col("within")).alias("slot"), "sid", "rank", "block", F.expr("rank div blocks").alias("pass"), "tokens", "cut")
    )

    # Written, so that no plan holds the schedule and the streams at once. A source's last slot may take a part of its block.
    schedule = scratch.write(schedule)
    times = scratch.write(
        schedule.groupBy("sid", "block").agg(
            F.sum(F.when(F.col("cut"), 0).otherwise(1)).alias("times"), F.max(F.when(F.col("cut"), F.col("tokens")).otherwise(0)).alias("part")
        )
    )
    segments = scratch.write(segments)
    of_part = F.greatest(F.lit(0), F.least(F.col("tokens"), F.col("part") - F.greatest(F.col("start") - F.col("block") * block, F.lit(0))))
    taken = (
        segments.join(times, ["sid", "block"], "left")
        .groupBy("sid", "doc_id", "size", "start")
        .agg(F.sum(F.coalesce(F.col("tokens") * F.col("times") + of_part, F.lit(0))).alias("taken"))
        .select("sid", "doc_id", "size", "taken")
    )
    none = sizes.where("size = 0").join(sources.select("source", "sid"), sizes["source"].eqNullSafe(sources["source"]))
    taken = taken.unionByName(none.select("sid", "doc_id", "size", F.lit(0).cast("long").alias("taken")))
    out = taken.join(sources, "sid").select("doc_id", "size", "source_size", "target", "taken", "source", "weight")
    return Mix(sources, schedule, segments, out, block)


def op8_source_mix(spark, sf_dir: str) -> DataFrame:
    """One row per document: how many of its words the mix takes."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).taken
